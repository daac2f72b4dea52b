"""Collocations of two to four words: pairs of ranked ids are counted in tiles, frequent pairs get ids and are paired again.

Level k pairs a frequent phrase of k - 1 words with the word behind it. A task turns names into codes: the rank of the RANKS
most frequent names of a level, else the name itself. Pairs of ranks are counted by tiles of SIDE x SIDE cells: a dense
bincount where a tile has enough pairs, sorted coordinates where it has few; what has no rank is sorted, too. Spark sums
the cells. A phrase can't be frequent unless the two phrases of one word less inside it are, so a Bloom filter
of the last level's frequent names prunes the next level's pairs; what it lets through by mistake is counted and dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm import bloom as blooms
from turnstone.llm.common import drop_staged, stage_table
from turnstone.llm.words import PIECE, U, Bytes, mix, tidy

#: A phrase counts from this frequency on; words of the longest; rows returned of each language.
LEAST, WORDS, TOP = 30, 4, 2000
#: Names of a level that have a rank, the side of a tile, and from how many pairs a tile's cells are counted densely.
RANKS, SIDE, DENSE = 1 << 16, 1 << 8, 1 << 13
#: Pairs and different words that a task holds before it counts them, and rows of a batch it returns.
HELD, HELD_WORDS, ROWS = 1 << 20, 1 << 18, 1 << 16
#: Names have 63 bits, so that a code tells a name (negative) from a rank.
NAME = U((1 << 63) - 1)
SIGN = U(1 << 63)

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_WORD = np.ones(256, bool)
_WORD[list(b" \t" + _BREAKS)] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(_BREAKS)] = True
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
_BEHIND = re.compile(rb"(?:[ \t.,;:!?\n-\r]*[^ \t.,;:!?\n-\r]+){0,%d}" % (WORDS - 1))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The names of phrases, of their first words' and last word's names."""
    return mix(left * U(0x9E3779B97F4A7C15) ^ mix(right + U(1))) & NAME


def _windows(text: memoryview, size: int) -> Iterator[tuple[memoryview, int]]:
    """A text in parts that end between words, with the words that a phrase may need behind them; and the part's own bytes."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at : _BEHIND.match(text, end).end()], end - at
        at = end
    yield text[at:], len(text) - at


class Run:
    """Words of some texts: names, and how many words from one on stand in one piece of text (WORDS at most)."""

    def __init__(self, texts: list[memoryview], own: list[int], langs: np.ndarray):
        b = Bytes(pa.array([bytes(t) for t in texts], pa.binary()))
        self.at, self.end, first = b.words(_WORD)
        per = np.diff(first)
        self.text = np.repeat(np.arange(len(texts)), per)
        # another hash of the language than a word's, or a word that is its language's name would be one and the same in all of them
        self.names = mix(b.hashes(self.at, self.end) ^ mix(langs[self.text] + U(1))) & NAME
        edge = _BREAK[b.folded]
        edge[b.start[1:] - 1] = True
        piece = np.cumsum(edge, dtype=np.int32)[self.at]
        self.reach = np.ones(len(self.at), np.int8)
        for k in range(1, WORDS):
            self.reach[: -k or None][piece[:-k] == piece[k:]] = k + 1
        #: Words that a window has only for the phrases before it.
        self.own = self.at - b.start[self.text] < np.array(own)[self.text]
        self.bytes = b.folded


def _runs(batch: pa.RecordBatch, size: int) -> Iterator[tuple[Run, list]]:
    """The texts of a batch (lang, text) in runs of about `size` bytes, and each text's language."""
    langs = batch.column(0).to_pylist()
    known = {x: U(int(Bytes([x]).hashes(np.array([0]), np.array([len(x.encode())]))[0])) for x in set(langs)}
    texts, own, of, total = [], [], [], 0
    for lang, text in zip(langs, batch.column(1), strict=True):
        for part, limit in _windows(memoryview(text.as_buffer()), size):
            texts.append(part)
            own.append(limit)
            of.append(lang)
            total += len(part)
            if total >= size:
                yield Run(texts, own, np.array([known[x] for x in of])), of
                texts, own, of, total = [], [], [], 0
    if texts:
        yield Run(texts, own, np.array([known[x] for x in of])), of


def _batches(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS]) if isinstance(c, np.ndarray) else c.slice(i, ROWS) for c in columns], names=names)


def _cast(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)


def count_words(texts: DataFrame, size: int = PIECE) -> DataFrame:
    """(lang, name, word, n) of every word of texts (lang, text), and a row without a word that has n of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        columns = ["lang", "name", "word", "n"]

        def flush() -> Iterator[pa.RecordBatch]:
            names, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            _, at, inverse = np.unique(names, return_index=True, return_inverse=True)
            sums = np.bincount(inverse, n).astype(np.int64)
            lang, word = (pa.concat_arrays([h[k] for h in held]).take(pa.array(at)) for k in (2, 3))
            yield from _batches([lang, _cast(names[at]), word, sums], columns)
            held.clear()

        for batch in batches:
            for r, of in _runs(batch, size):
                names, at, n = np.unique(r.names[r.own], return_index=True, return_counts=True)
                where = np.flatnonzero(r.own)[at]
                raw = r.bytes.tobytes()
                words = pa.array([raw[i:j] for i, j in zip(r.at[where].tolist(), r.end[where].tolist(), strict=True)], pa.binary()).cast(pa.string())
                held.append((names, n, pa.array([of[i] for i in r.text[where].tolist()], pa.string()), words))
                total = np.bincount(r.text[r.own], minlength=len(of))
                all_of: dict = {}
                for lang, k in zip(of, total.tolist(), strict=True):
                    all_of[lang] = all_of.get(lang, 0) + k
                yield pa.RecordBatch.from_arrays([pa.array(all_of.keys(), pa.string()), pa.array([0] * len(all_of), pa.int64()), pa.nulls(len(all_of), pa.string()), pa.array(all_of.values(), pa.int64())], names=columns)
                if sum(len(h[0]) for h in held) > HELD_WORDS:
                    yield from flush()
        if held:
            yield from flush()

    counted = texts.mapInArrow(tidy(run), "lang string, name long, word string, n long")
    return counted.groupBy("lang", "name", "word").agg(F.sum("n").alias("n"))


class Known:
    """The frequent names of a level as tasks see them: ranks of some, and a filter (none: the ranked are all there are)."""

    def __init__(self, ranked: np.ndarray, more: blooms.Bloom | None, parts: int = 1, part: int = 0):
        self.ranked, self.more, self.parts, self.part = ranked, more, parts, part
        self.bits = U((1 << max(4, int(len(ranked)).bit_length() + 4)) - 1)
        self.slot = np.full(int(self.bits) + 1, -1, np.int32)
        self.slot[(ranked & self.bits).astype(np.int64)] = np.arange(len(ranked), dtype=np.int32)
        lost = np.flatnonzero(self.slot[(ranked & self.bits).astype(np.int64)] != np.arange(len(ranked)))
        self.lost = lost[np.argsort(ranked[lost])]

    def ranks(self, names: np.ndarray) -> np.ndarray:
        """Of each name its rank, or -1."""
        out = self.slot[(names & self.bits).astype(np.int64)]
        other = np.flatnonzero(out >= 0)
        other = other[self.ranked[out[other]] != names[other]]
        out[other] = -1
        if len(self.lost):
            at = np.searchsorted(self.ranked[self.lost], names[other]).clip(max=len(self.lost) - 1)
            hit = self.ranked[self.lost[at]] == names[other]
            out[other[hit]] = self.lost[at[hit]]
        return out

    def maybe(self, names: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Which names can be frequent; of several parts, those whose filter isn't at hand count as such."""
        if self.more is None:
            return ranks >= 0
        return (ranks >= 0) | self.more.holds(names) | ((names % U(self.parts) != self.part) if self.parts > 1 else False)

    def mine(self, names: np.ndarray) -> np.ndarray:
        return names % U(self.parts) == self.part if self.parts > 1 else np.ones(len(names), bool)

    def codes(self, names: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        return np.where(ranks >= 0, ranks.astype(np.int64), _cast(names | SIGN))

    def named(self, codes: np.ndarray) -> np.ndarray:
        out = codes.view(np.uint64) & NAME
        out[codes >= 0] = self.ranked[codes[codes >= 0]]
        return out


def count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair of codes once, and how often it stands there."""
    ranked = (left >= 0) & (right >= 0)
    l, r = left[ranked], right[ranked]
    tile = (l // SIDE * (RANKS // SIDE) + r // SIDE).astype(np.int64)
    cell = l % SIDE * SIDE + r % SIDE
    in_tile = np.bincount(tile, minlength=(RANKS // SIDE) ** 2)
    dense = np.flatnonzero(in_tile >= DENSE)
    lefts, rights, counts = [], [], []
    few = in_tile[tile] < DENSE
    if len(dense):
        order = np.flatnonzero(~few)
        order = order[np.argsort(tile[order], kind="stable")]
        for t, cells in zip(dense.tolist(), np.split(cell[order], np.cumsum(in_tile[dense])[:-1]), strict=True):
            n = np.bincount(cells, minlength=SIDE * SIDE)
            full = np.flatnonzero(n)
            lefts.append(t // (RANKS // SIDE) * SIDE + full // SIDE)
            rights.append(t % (RANKS // SIDE) * SIDE + full % SIDE)
            counts.append(n[full])
    sparse, n = np.unique(l[few] * RANKS + r[few], return_counts=True)
    lefts.append(sparse // RANKS)
    rights.append(sparse % RANKS)
    counts.append(n)
    l, r = left[~ranked], right[~ranked]
    if len(l):
        order = np.lexsort((r, l))
        l, r = l[order], r[order]
        at = np.flatnonzero(np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])]))
        lefts.append(l[at])
        rights.append(r[at])
        counts.append(np.diff(np.append(at, len(l))))
    return np.concatenate(lefts), np.concatenate(rights), np.concatenate(counts).astype(np.int64)


def _level(texts: DataFrame, k: int, first: Known, word: Known, size: int) -> DataFrame:
    """(a, b, n): codes of phrases of k - 1 words and of the word behind them, and how often."""
    sent = texts.sparkSession.sparkContext.broadcast((first, word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase, single = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _batches([*count_pairs(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))], ["a", "b", "n"])
            held.clear()

        for batch in batches:
            for r, _ in _runs(batch, size):
                ranks = single.ranks(r.names)
                good = single.maybe(r.names, ranks)
                at = np.flatnonzero(r.own & (r.reach >= k))
                for j in range(k):
                    at = at[good[at + j]]
                names, after = r.names[at], r.names[at + 1]
                for j in range(1, k - 1):
                    names, after = joined(names, r.names[at + j]), joined(after, r.names[at + j + 1])
                keep = phrase.mine(names)
                first_ranks = phrase.ranks(names) if k > 2 else ranks[at]
                keep &= phrase.maybe(names, first_ranks)
                if k > 2:
                    keep &= phrase.maybe(after, phrase.ranks(after))
                last = at[keep] + k - 1
                held.append((phrase.codes(names[keep], first_ranks[keep]), single.codes(r.names[last], ranks[last])))
                if sum(len(h[0]) for h in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    return texts.mapInArrow(tidy(run), "a long, b long, n long")


def _known(names: DataFrame) -> list[Known]:
    """The frequent names (name, f) of a staged level for tasks; several, each with a part of the names, where they are too many for one filter."""
    top = names.orderBy(F.desc("f"), "name").limit(RANKS).select("name").toArrow().column(0).to_numpy().view(np.uint64)
    n = names.count()
    if n <= len(top):
        return [Known(top, None)]
    parts = -(-8 * n // blooms.MOST_BITS)
    return [Known(top, blooms.bloom(names.where(F.col("name") % parts == p) if parts > 1 else names, "name"), parts, p) for p in range(parts)]


def _frequent(counted: DataFrame, first: Known, word: Known, least: int) -> DataFrame:
    """(name, front, last, f) of the phrases that are frequent: codes are names again."""
    sent = counted.sparkSession.sparkContext.broadcast((first, word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase, single = sent.value
        for b in batches:
            front, last = phrase.named(b.column(0).to_numpy()), single.named(b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*map(pa.array, map(_cast, (joined(front, last), front, last))), b.column(2)], names=["name", "front", "last", "f"])

    sums = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return sums.mapInArrow(run, "name long, front long, last long, f long")


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, size: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(lang, ws, phrase, f) of the words and phrases of up to WORDS words with that frequency, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = stage_table(count_words(texts, size).where((F.col("n") >= least) | F.col("word").isNull()))
    words = counted.where("word IS NOT NULL").select("lang", "name", "word", F.col("n").alias("f"))
    levels = [words.select("lang", "name", F.array("name").alias("ws"), F.col("word").alias("phrase"), "f")]
    single = _known(words.select("name", "f"))
    for k in range(2, WORDS + 1):
        firsts = single if k == 2 else _known(levels[-1].select("name", "f"))
        pairs = [stage_table(_frequent(_level(texts, k, first, single[0] if len(single) == 1 else Known(single[0].ranked, _Any()), size), first, single[0], least)) for first in firsts]
        found = pairs[0]
        for more in pairs[1:]:
            found = found.unionByName(more)
        front = levels[-1].select("lang", F.col("name").alias("front"), F.col("ws").alias("__ws"), F.col("phrase").alias("__phrase"))
        last = words.select(F.col("name").alias("last"), F.col("word").alias("__word"))
        made = found.join(front, "front").join(last, "last")
        levels.append(stage_table(made.select("lang", "name", F.concat("__ws", F.array("last")).alias("ws"), F.concat_ws(" ", "__phrase", "__word").alias("phrase"), "f")))
        for p in pairs:
            drop_staged(p)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("name"), counted.where("word IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))


class _Any:
    """In place of a filter: nothing is known of a name that has no rank."""

    def holds(self, names: np.ndarray) -> np.ndarray:
        return np.ones(len(names), bool)


_WIDE = "DECIMAL(20, 0)"


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, size: int = PIECE) -> DataFrame:
    """Each language's best phrases of two to WORDS words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at `. , ; : ! ?` and line ends, pieces into words at blanks and tabs; null texts
    are empty, a null lang is `und`. a: how often a phrase stands in pieces, overlaps included, from `least` on. Of its
    cuts into a first part and a rest, of frequencies l and r, the one of the lowest score floor(2,000,000 a / (l + r)) counts,
    ties to the shortest first part. A phrase goes if a longer one that contains it has four fifths of its frequency or
    more. Repeated rows count as often as they stand there. Words are told apart by 63-bit hashes.
    """
    phrases, totals = frequent_phrases(docs, lang, text, least, size)
    parts = phrases.select(F.col("ws").alias("part"), F.col("f"))
    found = phrases.where(F.size("ws") > 1)
    cuts = found.select("ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    sides = cuts.withColumns({"front": F.slice("ws", 1, F.col("k")), "rest": F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k"))})
    cut = sides.join(parts.withColumnsRenamed({"part": "front", "f": "l"}), "front").join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), "rest")
    score = F.expr(f"CAST((CAST(2000000 AS {_WIDE}) * CAST(a AS {_WIDE})) div CAST(l + r AS {_WIDE}) AS BIGINT)")
    best = cut.groupBy("ws").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    spans = F.expr("flatten(transform(sequence(2, size(ws) - 1), m -> transform(sequence(1, size(ws) - m + 1), i -> slice(ws, i, m))))")
    inside = found.where(F.size("ws") > 2).select(F.explode(spans).alias("ws"), "f").groupBy("ws").agg(F.max("f").alias("longer"))
    kept = found.join(inside, "ws", "left").where(f"longer IS NULL OR CAST(5 AS {_WIDE}) * CAST(longer AS {_WIDE}) < CAST(4 AS {_WIDE}) * CAST(f AS {_WIDE})").join(best, "ws")
    rows = kept.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
