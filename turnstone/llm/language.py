"""Language ID by a linear-chain conditional random field over words.

Every word has features of its affixes, its n-grams and itself (the lexicon), hashed into one table of
weights; transitions between the words' languages are learned with them. Forward-backward gives each
word's posterior, also where a text switches languages; a document's language is the one that most of
its words are expected to have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm.words import LOWER, PIECE, U, Bytes, give_back, pieces, with_columns

#: The training sample: documents a language (those with the smallest hashes), and chains of them.
DOCUMENTS, CHAINS = 400, 4000
#: Bytes of a document of the sample at most, so that a language's share of it has a bound, too.
TEXT_BYTES = 256 << 10
#: Words in a chain at most; slots of hashed features.
CHAIN, SLOTS = 64, 1 << 18
#: Chains that are spliced of two languages, as a share of all, so that transitions can be learned.
SPLICED = 0.25
EPOCHS, BATCH, RATE, DECAY = 3, 256, 0.3, 1e-6
UNKNOWN = "und"

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))])


def held_out(key: str = "doc_id") -> Column:
    """The fold that training never sees; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Words:
    """The letter words of texts and their features: `slot`s of the words `of`, in order of words."""

    @classmethod
    def of_many(cls, texts: list[str | None]) -> Words:
        """The same of any number of texts, made piece by piece: hashing takes many times the room of its result."""
        parts = [cls(texts[i:j]) for i, j in pieces(texts, PIECE // 4)] or [cls([])]
        out = parts[0]
        if len(parts) > 1:
            ends = np.cumsum([p.n for p in parts])
            out.first = np.concatenate([*(p.first[:-1] + e - p.n for p, e in zip(parts, ends, strict=True)), ends[-1:]])
            out.fixed = np.concatenate([p.fixed for p in parts])
            for k in range(len(out.grams)):
                sums = np.cumsum([len(p.grams[k]) for p in parts])
                out.gram_at[k] = np.concatenate([*(p.gram_at[k][:-1] + e - len(p.grams[k]) for p, e in zip(parts, sums, strict=True)), sums[-1:]])
                out.grams[k] = np.concatenate([p.grams[k] for p in parts])
            out.n = int(ends[-1])
        return out

    def __init__(self, texts: list[str | None]):
        b = Bytes(texts)
        low = LOWER[b.raw]
        lead = np.concatenate([[0], low[:-1]])
        latin = (lead == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)  # upper case of the second Latin block
        b.folded = np.where(latin, low + 0x20, low).astype(np.uint8)
        at, end, self.first = b.words(LETTERS)
        self.n = len(at)
        salt = np.arange(1, 10, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        slots = []
        for k, size in enumerate((1, 2, 3)):
            slots.append(b.hashes(at, np.minimum(at + size, end)) ^ salt[k])
            slots.append(b.hashes(np.maximum(end - size, at), end) ^ salt[3 + k])
        slots.append(b.hashes(at, end) ^ salt[6])
        self.fixed = np.stack([(s & U(SLOTS - 1)).astype(np.int32) for s in slots], axis=1) if self.n else np.zeros((0, 7), np.int32)
        self.grams, self.gram_at = [], []
        size = end - at
        for k, g in ((7, 3), (8, 4)):
            count = np.maximum(size - g + 1, 0)
            start = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(count.sum())
            self.grams.append(((b.hashes(start, start + g) ^ salt[k]) & U(SLOTS - 1)).astype(np.int32))
            self.gram_at.append(np.concatenate([[0], np.cumsum(count)]))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Words by languages: the sum of the weights of each word's features."""
        out = np.zeros((self.n, weights.shape[1]))
        for k in range(self.fixed.shape[1]):
            out += weights[self.fixed[:, k]]
        for slots, edge in zip(self.grams, self.gram_at, strict=True):
            if len(slots):
                sums = np.zeros((len(slots) + 1, weights.shape[1]))
                np.cumsum(weights[slots], axis=0, out=sums[1:])
                out += sums[edge[1:]] - sums[edge[:-1]]
        return out

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, number within `words`) of all features of some words."""
        slots, of = [self.fixed[words].ravel()], [np.repeat(np.arange(len(words)), self.fixed.shape[1])]
        for g, edge in zip(self.grams, self.gram_at, strict=True):
            count = edge[words + 1] - edge[words]
            i = np.repeat(edge[words] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            slots.append(g[i])
            of.append(np.repeat(np.arange(len(words)), count))
        return np.concatenate(slots), np.concatenate(of)


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chain, word, language) and summed pair posteriors of padded chains, the longest first.

    emit: log weights (chain, word, language).
    """
    n, steps, k = emit.shape
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # chains with a word at t
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    move = np.exp(trans)
    alpha = np.zeros_like(e)
    for t in range(steps):
        m = live[t]
        if not m:
            break
        a = e[:m, t] * (np.exp(begin) if t == 0 else alpha[:m, t - 1] @ move)
        alpha[:m, t] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((n, k))
    post, pairs = np.zeros_like(e), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        m = live[t]
        p = alpha[:m, t] * beta[:m]
        post[:m, t] = p / p.sum(axis=1, keepdims=True)
        if t:
            ahead = e[:m, t] * beta[:m]
            ahead /= ahead.sum(axis=1, keepdims=True)
            both = alpha[:m, t - 1, :, None] * move * ahead[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[:m] = ahead @ move.T
    return post, pairs


class Model:
    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.weights = np.zeros((SLOTS, k), np.float32)
        self.trans, self.begin = np.zeros((k, k)), np.zeros(k)

    def train(self, texts: list[str], labels: list[str], seed: int = 5) -> Model:
        """Gradient steps on the chains' conditional likelihood, each weight with its own rate."""
        w, rng, k = Words.of_many(texts), np.random.default_rng(seed), len(self.langs)
        number = {x: i for i, x in enumerate(self.langs)}
        chains: list[list[np.ndarray]] = [[] for _ in self.langs]
        for d, label in enumerate(labels):
            for i in range(w.first[d], w.first[d + 1], CHAIN):
                chains[number[label]].append(np.arange(i, min(i + CHAIN, w.first[d + 1])))
        work: list[tuple[np.ndarray, np.ndarray]] = []
        for y, own in enumerate(chains):
            for c in rng.permutation(len(own))[:CHAINS]:
                words, label = own[c], np.full(len(own[c]), y)
                z = int(rng.integers(k))
                if rng.random() < SPLICED and chains[z] and len(words) > 1:
                    other = chains[z][int(rng.integers(len(chains[z])))]
                    cut = int(rng.integers(1, len(words)))
                    tail = other[: len(words) - cut]
                    words, label = np.concatenate([words[:cut], tail]), np.concatenate([label[:cut], np.full(len(tail), z)])
                work.append((words, label))
        seen = np.full((SLOTS, k), 1e-6, np.float32)
        seen_trans = np.full((k, k), 1e-6)
        seen_begin = np.full(k, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(work))
            for i in range(0, len(order), BATCH):
                part = sorted((work[j] for j in order[i : i + BATCH]), key=lambda c: -len(c[0]))
                length = np.array([len(c[0]) for c in part])
                words, label = np.concatenate([c[0] for c in part]), np.concatenate([c[1] for c in part])
                slots, of = w.features(words)
                sums = np.stack([np.bincount(of, self.weights[slots, y], len(words)) for y in range(k)], axis=1)
                chain = np.repeat(np.arange(len(part)), length)
                step = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
                emit = np.zeros((len(part), length.max(), k))
                emit[chain, step] = sums
                post, pairs = forward_backward(emit, length, self.trans, self.begin)
                error = post[chain, step]
                error[np.arange(len(words)), label] -= 1
                grad = np.stack([np.bincount(slots, error[of, y], SLOTS) for y in range(k)], axis=1).astype(np.float32) / len(part)
                grad += DECAY * self.weights
                seen += grad**2
                self.weights -= RATE * grad / np.sqrt(seen)
                moves = np.zeros((k, k))
                inside = np.flatnonzero(step > 0)
                np.add.at(moves, (label[inside - 1], label[inside]), 1)
                for have, own, g in ((self.trans, seen_trans, (pairs - moves) / len(part)), (self.begin, seen_begin, post[:, 0].mean(axis=0) - np.bincount(label[step == 0], minlength=k) / len(part))):
                    own += g**2
                    have -= RATE * g / np.sqrt(own)
        return self

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of words, and the share of them expected in each language."""
        w = Words(texts)
        count = np.diff(w.first)
        if not w.n or not self.langs:
            return count * 0, np.zeros((len(texts), len(self.langs)))
        within = np.arange(w.n) - np.repeat(w.first[:-1], count)
        head = np.flatnonzero(within % CHAIN == 0)
        length = np.diff(np.append(head, w.n))
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        chain, step = np.repeat(place, length), within % CHAIN
        emit = np.zeros((len(head), int(length.max()), len(self.langs)))
        emit[chain, step] = w.emissions(self.weights)
        post, _ = forward_backward(emit, length[order], self.trans, self.begin)
        sums = np.zeros((w.n + 1, len(self.langs)))
        np.cumsum(post[chain, step], axis=0, out=sums[1:])
        return count, (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(count, 1)[:, None]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = DOCUMENTS) -> Model:
    """A model of the labelled rows outside the held-out fold.

    Learned from a bounded sample: of each language the `documents` rows with the smallest hash of key and
    text (chosen in every task before anything is shuffled), and of their chains CHAINS at most. Rows
    with a null label or text or one above TEXT_BYTES are no examples; without any, the model knows no language.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) <= TEXT_BYTES) & ~held_out(key)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    sample = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= documents).orderBy("lang", "n").collect()
    model = Model(sorted({r["lang"] for r in sample})).train([r["text"] for r in sample], [r["lang"] for r in sample])
    give_back()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and shares: the part of the words expected in each language.

    A null text or one without a letter is `und` with score 0 and no shares. Ties go to the language first
    in order of names. Rows stay as they are, repeated ones too; columns of these names are replaced.
    No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list[pa.Array]:
        count, shares = sent.value.shares(texts)
        langs = sent.value.langs
        pred, score, by = [], [], []
        for t, n, s in zip(texts, count.tolist(), shares, strict=True):
            # bytes above ASCII count as letters in a word; whether there is a true letter decides here
            if not n or not (any(map(str.isalpha, t[:200])) or any(map(str.isalpha, t))):
                pred.append(UNKNOWN)
                score.append(0.0)
                by.append([])
            else:
                best = int(s.argmax())
                pred.append(langs[best])
                score.append(min(1.0, max(0.0, float(s[best]))))
                by.append([(x, float(p)) for x, p in zip(langs, s, strict=True)])
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(by, pa.map_(pa.string(), pa.float64()))]

    return with_columns(docs, text, FIELDS, work, () if keep_text else (text,))
