"""Benchmark decontamination: an FM-index of each training shard is searched for test phrases.

Shard: a bounded piece of a task's documents. Its index covers the words that occur in the phrases; a
run of such words too short for the shortest phrase can't hold one and stays out, other words are
separators. Phrases are matched backwards, all at once, by ranks in a wavelet matrix over the shard's
Burrows-Wheeler transform; rows found are located by walking to sampled suffix positions; overlapping
occurrences merge into removal spans. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm.common import stage_table
from turnstone.llm.words import ALNUM, Bytes, with_columns

WINDOW = 13
#: Bytes of benchmark text whose phrases are sent to all tasks at once (about 15 bytes of arrays a byte); more are searched in turns.
PHRASE_BYTES = 4 << 20
SAMPLE = 8

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))])
_SPAN = pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())])


class Phrases:
    """Windows of benchmark items, as numbers of words: rows of `codes`, filled up with -1 on the left.

    All in arrays: item_at[edge[p] : edge[p + 1]] are the items (numbers in `names`) of phrase p.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        b = Bytes([t for _, t in items])
        at, end, first = b.words(ALNUM)
        self.names, name_of = np.unique(np.array([n for n, _ in items], dtype=object), return_inverse=True)
        self.words, ids = np.unique(b.hashes(at, end), return_inverse=True)
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        owner = np.repeat(np.arange(len(items)), count)
        start = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        length = np.minimum(n[owner], window)
        codes = np.full((len(owner), window), -1, np.int32)
        for k in range(window):  # the k-th word from the end
            some = length > k
            codes[some, window - 1 - k] = ids[start[some] + length[some] - 1 - k] + 1
        self.codes, phrase = np.unique(codes, axis=0, return_inverse=True)
        pairs = np.unique(phrase.ravel() * max(1, len(self.names)) + name_of[owner])
        self.item_at = pairs % max(1, len(self.names))
        self.edge = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.codes) + 1))
        self.length = (self.codes >= 0).sum(axis=1)

    def items(self, phrase: int) -> list[str]:
        return self.names[self.item_at[self.edge[phrase] : self.edge[phrase + 1]]].tolist()


class FmIndex:
    """Of a sequence of symbols; 0 separates and is never searched for."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        apart = symbols == 0
        # separators differ from one another, so that no comparison of suffixes passes one
        rank = np.where(apart, np.cumsum(apart) - 1, symbols + int(apart.sum()))
        span, last = 1, np.flatnonzero(apart)
        longest = int(np.diff(np.concatenate([[-1], last])).max(initial=1))
        while span < longest:
            ahead = np.zeros(n, np.int64)
            ahead[:-span] = rank[span:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
            span *= 2
        suffixes = np.argsort(rank, kind="stable")
        bwt = symbols[suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        # positions are sampled every SAMPLE symbols, and at the start of every run
        keep = (np.arange(n) % SAMPLE == 0) | np.roll(apart, 1) | apart
        self.sampled = keep[suffixes]
        self.position = np.where(self.sampled, suffixes, -1)
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            on = (bwt >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(on)]), n - int(on.sum())))
            bwt = np.concatenate([bwt[~on], bwt[on]])
        self.bwt = symbols[suffixes - 1]
        self.n = n

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before row i of the transform."""
        s = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            on = (c >> bit & 1).astype(bool)
            s, i = np.where(on, zeros + ones[s], s - ones[s]), np.where(on, zeros + ones[i], i - ones[i])
        return i - s

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(number of phrase, position) of every occurrence."""
        live = np.arange(len(phrases.codes))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        for step in range(phrases.codes.shape[1] - 1, -1, -1):
            c = phrases.codes[live, step]
            more = c >= 0
            at, x = np.flatnonzero(more), c[more]
            lo[at], hi[at] = self.before[x] + self.rank(x, lo[at]), self.before[x] + self.rank(x, hi[at])
            found = hi > lo
            live, lo, hi = live[found], lo[found], hi[found]
        count = hi - lo
        phrase = np.repeat(live, count)
        row = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        walked = np.zeros(len(row), np.int64)
        while (todo := np.flatnonzero(~self.sampled[row])).size:
            c = self.bwt[row[todo]]
            row[todo] = self.before[c] + self.rank(c, row[todo])
            walked[todo] += 1
        return phrase, self.position[row] + walked


def shard_hits(texts: list[str | None], phrases: Phrases) -> list[pa.Array]:
    """FIELDS of a shard's texts."""
    b = Bytes(texts)
    at, end, first = b.words(ALNUM)
    counts = np.diff(first)
    mark = np.zeros(len(at) + 1, np.int64)
    pairs: set[tuple[int, int]] = set()
    if len(phrases.codes) and len(at):
        h = b.hashes(at, end)
        near = np.minimum(np.searchsorted(phrases.words, h), len(phrases.words) - 1)
        symbol = np.where(phrases.words[near] == h, near + 1, 0)
        # runs of phrase words inside one text; those that are too short stay out
        owner = np.repeat(np.arange(len(texts)), counts)
        head = np.flatnonzero((symbol > 0) & np.concatenate([[True], (symbol[:-1] == 0) | (owner[1:] != owner[:-1])]))
        tail = np.flatnonzero((symbol > 0) & np.concatenate([(symbol[1:] == 0) | (owner[1:] != owner[:-1]), [True]]))
        long = tail - head + 1 >= phrases.length.min()
        head, length = head[long], (tail - head + 1)[long]
        if len(head):
            step = length + 1  # a separator after each run
            to = np.cumsum(step) - step
            origin = np.repeat(head - to, step) + np.arange(step.sum())
            text = symbol[np.minimum(origin, len(symbol) - 1)]
            text[to + length] = 0
            phrase, found = FmIndex(text, len(phrases.words)).search(phrases)
            word = origin[found]
            np.add.at(mark, word, 1)
            np.add.at(mark, word + phrases.length[phrase], -1)
            pairs = set(zip(owner[word].tolist(), phrase.tolist(), strict=True))
    hit = np.cumsum(mark[:-1]) > 0
    n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), first[:-1]) * (counts > 0) if len(texts) else counts
    items: list[set[str]] = [set() for _ in texts]
    for d, p in pairs:
        items[d].update(phrases.items(p))
    spans: list[list[dict]] = [[] for _ in texts]
    if pairs:
        chars = np.concatenate([[0], np.cumsum(b.raw & 0xC0 != 0x80)])
        for d in {d for d, _ in pairs}:
            edge = np.diff(np.concatenate([[False], hit[first[d] : first[d + 1]], [False]]).view(np.int8))
            base = chars[b.start[d]]
            spans[d] = [{"start": int(chars[at[first[d] + i]] - base), "end": int(chars[end[first[d] + j - 1]] - base)} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))]


def _merge(a, b):
    """The union of two arrays of spans, overlapping ones as one."""
    both = F.array_sort(F.concat(a, b))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(
        both,
        none,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = True, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted), spans (start, end code points to remove) and contaminated.

    A window: `window` consecutive words of a benchmark item; an item of fewer words, but not none, is one.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words. Words: letters, digits and all characters outside
    ASCII, A-Z lower-cased. Null and empty texts have no words and no hits; items without words are
    not looked for; equal items count by their item_id, a null one as an empty name; repeated rows
    each get their result; columns of these names are replaced.

    The phrases that every task gets are bounded: of a benchmark above `phrase_bytes` (measured first)
    one slice of the items after another is searched for, which adds a pass over the documents each, written out
    before the next slice is fetched. Word counts and hits then are of the union of the slices' spans.
    """
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    turns = max(1, -(-int(total) // phrase_bytes))
    spark, out = docs.sparkSession, docs
    for turn in range(turns):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(turns)) == turn).collect()
        sent = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in part], window))
        last = turn == turns - 1
        had = out.columns
        out = with_columns(out, text, FIELDS, lambda texts, sent=sent: shard_hits(texts, sent.value), () if keep_text or not last else (text,)) if turn == 0 else _next(out, text, sent, keep_text or not last, had)
        if not last:
            out = stage_table(out)
            sent.destroy()
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _next(out: DataFrame, text: str, sent, keep: bool, had: list[str]) -> DataFrame:
    """One more slice of the benchmark: its hits are joined to those that `out` has."""
    old = out.withColumnsRenamed({c: f"__{c}" for c in FIELDS.names})
    new = with_columns(old, text, FIELDS, lambda texts: shard_hits(texts, sent.value))
    spans = _merge(F.col("__spans"), F.col("spans"))
    new = new.withColumns({"spans": spans, "items": F.array_sort(F.array_union("__items", "items"))})
    inside = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + F.regexp_count(F.col(text).substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    new = new.withColumn("n_hit", F.when(F.size("spans") > 0, inside).otherwise(F.lit(0).cast("long")))
    return new.select(*had) if keep else new.select(*[c for c in had if c != text])


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_benchmark's rows."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )
