"""Removal of long repeated byte strings by distributed prefix doubling over sparse suffixes.

Rank pairs at growing offsets name ever longer strings, and Spark groups them; positions whose string is
unique are done and leave. To rank each of the corpus's bytes in every round would shuffle many times the
input, so only some positions stand for all: of every LENGTH-byte window the position, among those that leave room
for the first rank (200 bytes), whose next GRAM bytes hash lowest. Equal windows have it at the same place, so a repeated window is
one whose positions meet in every round. Ranks are 128 bits wide and go up from round to round:

  100   seed: two rolling hashes of the bytes
  200   pairs of 100-byte ranks at offset 100, at the chosen positions
  350   pairs of 200-byte ranks at offset 150, for the four groups of windows of each position that is left
  400   pairs of 200-byte ranks at offset 200, for the windows of the groups that are left

Groups whose whole surroundings are the same bytes need no last round; one of them goes on for all. Between rounds only ranks that were
seen twice go on, as a bounded Bloom filter to the next scan of the texts; what it lets through in error
meets nobody. The last round first counts half of each rank, and tells places of those seen twice only. No text is
shuffled before the spans are known. Long texts are worked on in windows that overlap by LENGTH - 1 bytes.

What documents share below LENGTH bytes stays, and is told: shared_runs has the longest run of each document that the ranks
of SHORT_RANK bytes see in others, too (pairs of 100-byte ranks at offset 50).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm.bloom import bloom, fits
from turnstone.llm.common import stage_table
from turnstone.llm.words import PIECE, U, Bytes, mix, pieces, tidy

LENGTH, GRAM = 400, 50
STEP = LENGTH // 8
#: A shorter string that documents may share without losing it, and the rank that tells it.
SHORT, SHORT_RANK = 250, 150
#: Bytes of a text that are worked on at once.
CHUNK = PIECE
_ODD = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_SECOND = U(0xE7037ED1A0B428DB)
_SECOND_INV = U(pow(int(_SECOND), -1, 1 << 64))
_CODE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)

#: A rank: 128 bits as two arrays of 64.
Rank = tuple[np.ndarray, np.ndarray]


def pair(a: Rank, b: Rank) -> Rank:
    """The rank of a pair of ranks."""
    return tuple(mix(x * odd + y) for x, y, odd in zip(a, b, _ODD, strict=True))


class Suffixes:
    """The chosen positions `at` of texts, and the windows [low, high] (first bytes) that each stands for.

    base: how many bytes of a text stand before the part of it that is given. A window has `length` bytes; the positions
    leave room for a rank of `rank` bytes in it.
    """

    def __init__(self, texts: pa.Array, base: int = 0, length: int = LENGTH, rank: int = LENGTH // 2):
        self.b = b = Bytes(texts, fold=False)
        self.base = base
        self.sums: tuple[np.ndarray, np.ndarray] | None = None
        spread = length - rank + 1
        long = np.flatnonzero(b.size >= length)
        self.at = self.low = self.high = self.text = np.zeros(0, np.int64)
        if not len(long):
            return
        key = b.rolling(GRAM)
        key = key & U(0xFFFFFFFF00000000) | np.arange(len(key), dtype=np.uint64)
        span = 1
        while 2 * span <= spread:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[: len(key) - (spread - span)], key[spread - span :])
        count = b.size[long] - length + 1
        window = np.repeat(b.start[long] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        best = (key[window] & U(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        self.at, self.low = best[head], window[head]
        self.high = window[np.append(head[1:], len(window)) - 1]
        self.text = np.searchsorted(b.start, self.at, "right") - 1

    def _second(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the other hash, and what moves them back to the first byte."""
        if self.sums is None:
            n = len(self.b.raw)
            up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_SECOND, _SECOND_INV))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[self.b.raw] * up[:n])]), down
        return self.sums

    def rank100(self, at: np.ndarray) -> Rank:
        sums, down = self._second()
        end = at + LENGTH // 4
        return self.b.hashes(at, end), mix((sums[end] - sums[at]) * down[at])

    def rank150(self, at: np.ndarray) -> Rank:
        return pair(self.rank100(at), self.rank100(at + SHORT_RANK - LENGTH // 4))

    def rank200(self, at: np.ndarray) -> Rank:
        return pair(self.rank100(at), self.rank100(at + LENGTH // 4))

    def rank350(self, at: np.ndarray) -> Rank:
        return pair(self.rank200(at), self.rank200(at + LENGTH // 2 - STEP))

    def rank400(self, at: np.ndarray) -> Rank:
        return pair(self.rank200(at), self.rank200(at + LENGTH // 2))

    def groups(self, kept: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, low, high, rank, surroundings) of the window groups of kept positions; the rank is two arrays.

        A group's windows all hold the LENGTH - STEP bytes that it is named by.
        """
        out = []
        for j in range(4):
            a, low, high = self.at[kept], self.low[kept], self.high[kept]
            first = a - STEP * (j + 1) + (0 if j == 3 else 1)
            low, high = np.maximum(low, first), np.minimum(high, a - STEP * j)
            some = low <= high
            start = (a - STEP * j)[some]
            low, high = low[some], high[some]
            out.append((self.text[kept][some], low, high, *self.rank350(start), self.b.hashes(low, high + LENGTH)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parts(texts: pa.Array, chunk: int = CHUNK, length: int = LENGTH, rank: int = LENGTH // 2) -> Iterator[tuple[int, int, Suffixes]]:
    """(i, j, Suffixes) of runs [i, j) of texts of a bounded size; a longer text comes alone, in parts."""
    for i, j in pieces(texts, min(PIECE // 2, chunk)):
        if j == i + 1 and texts[i].is_valid and texts[i].as_buffer().size > chunk:
            raw = texts[i].as_buffer()
            for at in range(0, raw.size - length + 1, chunk):
                yield i, j, Suffixes(pa.array([raw[at : min(at + chunk + length - 1, raw.size)].to_pybytes()], pa.binary()), at, length, rank)
        else:
            yield i, j, Suffixes(texts.slice(i, j - i), 0, length, rank)


def _scan(docs: DataFrame, work: Callable[[np.ndarray, Suffixes], list[np.ndarray]], schema: str, length: int = LENGTH, rank: int = LENGTH // 2) -> DataFrame:
    """Columns that `work` makes of bounded parts of (row, text)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy()
            for i, j, s in _parts(b.column(1), CHUNK, length, rank):
                if len(s.at):
                    cols = work(rows[i:j], s)
                    for k in range(0, len(cols[0]), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000].view(np.int64) if c.dtype == np.uint64 else c[k : k + 50_000]) for c in cols], names=names)

    return docs.select("row", "text").mapInArrow(tidy(run), schema)


def _twice(ranks: DataFrame, *by: str) -> DataFrame:
    """The ranks that are there more than once."""
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)


class _Seen:
    """Whether ranks are among those of a staged table; all, where they are too many to be told so."""

    def __init__(self, names: DataFrame, column: str):
        self.sent = names.sparkSession.sparkContext.broadcast(bloom(names, column) if fits(names) else None)

    def holds(self, names: np.ndarray) -> np.ndarray:
        return np.ones(len(names), bool) if self.sent.value is None else self.sent.value.holds(names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, low, high) of docs (row, text): runs of first bytes of windows that start anywhere else, too."""
    first = _scan(docs, lambda _, s: [s.rank200(s.at)[0]], "half long")
    seen200 = _Seen(stage_table(_twice(first, "half")), "half")

    def groups(s: Suffixes) -> tuple[np.ndarray, ...]:
        return s.groups(np.flatnonzero(seen200.holds(s.rank200(s.at)[0])))

    def rows350(rows: np.ndarray, s: Suffixes) -> list[np.ndarray]:
        text, low, high, one, two, around = groups(s)
        start = s.b.start[text] - s.base
        return [rows[text], low - start, high - start, one, two, around]

    cut = stage_table(_scan(docs, rows350, "row long, low long, high long, one long, two long, around long"))
    kinds = stage_table(cut.groupBy("one", "two", "around").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")))
    # the same surroundings twice: all of their windows are repeated
    sure = cut.join(kinds.where("n > 1").select("one", "two", "around"), ["one", "two", "around"]).select("row", "low", "high")
    mixed = kinds.groupBy("one", "two").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # one text speaks for each of the surroundings of a rank
    speaker = kinds.join(mixed, ["one", "two"]).select(F.col("around").bitwiseXOR(F.col("first")).alias("key"))
    seen350 = _Seen(stage_table(speaker), "key")

    def windows(rows: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray, Rank]:
        text, low, high, _, _, around = groups(s)
        kept = np.flatnonzero(seen350.holds(around ^ rows[text].view(np.uint64)))
        count = high[kept] - low[kept] + 1
        at = np.repeat(low[kept] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(text[kept], count), at, s.rank400(at)

    half = _scan(docs, lambda rows, s: [windows(rows, s)[2][0]], "one long")
    seen400 = _Seen(stage_table(_twice(half, "one")), "one")

    def rows400(rows: np.ndarray, s: Suffixes) -> list[np.ndarray]:
        text, at, (one, two) = windows(rows, s)
        fine = np.flatnonzero(seen400.holds(one))
        return [rows[text[fine]], (at - s.b.start[text] + s.base)[fine], one[fine], two[fine]]

    places = stage_table(_scan(docs, rows400, "row long, at long, one long, two long"))
    again = _twice(places, "one", "two")
    return sure.unionByName(places.join(again, ["one", "two"]).select("row", F.col("at").alias("low"), F.col("at").alias("high")))


def shared_runs(docs: DataFrame) -> DataFrame:
    """(row, longest_shared) of docs (row, text): the bytes of its longest run of strings that another row has, too.

    Every string of SHORT bytes that two rows have is seen in both; a run's ends, up to SHORT - SHORT_RANK bytes each, may
    be left out. Rows without such a string are left out.
    """
    short = {"length": SHORT, "rank": SHORT_RANK}
    half = lambda row: (mix(row.view(np.uint64)) >> U(32)).astype(np.uint32).view(np.int32)
    first = _scan(docs, lambda rows, s: [s.rank150(s.at)[0], half(rows[s.text])], "one long, of int", **short)
    ends = first.groupBy("one").agg(F.min("of").alias("a"), F.max("of").alias("z"))
    shared = stage_table(ends.where("a <> z").select("one"))
    seen = _Seen(shared, "one")

    def places(rows: np.ndarray, s: Suffixes) -> list[np.ndarray]:
        one = s.rank150(s.at)[0]
        fine = np.flatnonzero(seen.holds(one))
        return [rows[s.text[fine]], s.at[fine] - s.b.start[s.text[fine]] + s.base, one[fine]]

    at = _scan(docs, places, "row long, at long, one long", **short).join(shared, "one").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("at"))
    n = lambda x: F.lit(x).cast("long")
    start = F.struct(n(-1).alias("low"), n(-1).alias("high"), n(0).alias("best"))

    def step(acc, x):
        low, high = F.when(x <= acc["high"], acc["low"]).otherwise(x), x + SHORT_RANK
        return F.struct(low.alias("low"), high.alias("high"), F.greatest(acc["best"], high - low).alias("best"))

    return at.select("row", F.aggregate("at", start, step, lambda acc: acc["best"]).alias("longest_shared"))


def row_name(key: str = "doc_id", text: str = "text") -> Column:
    """What tells a row apart here."""
    return F.xxhash64(key, text)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (see row_name), n_bytes, kept (the bytes that are left), removed (array of start, end: maximal runs of bytes).

    A byte goes if any LENGTH-byte string over it also starts anywhere else, in its own text or another. Strings
    never cross texts and are judged on the input. A null text is an empty one; one of fewer than LENGTH
    bytes keeps all; a repeated row's bytes all go if it is that long; rows of one key but different
    texts are documents of their own; an empty table gives an empty one. Other columns are left out.
    """
    numbered = docs.select(F.col(key), F.col(text).alias("text"), row_name(key, text).alias("row"))
    spans = stage_table(repeated_spans(numbered).groupBy("row").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")))
    seen = _Seen(spans.select("row"), "row")

    def touched(yes: bool) -> DataFrame:
        """Texts that may have spans, or that surely have none; only the former are shuffled."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(seen.holds(b.column(2).to_numpy().view(np.uint64)) == yes))

        return numbered.mapInArrow(tidy(run), numbered.schema)

    none = F.lit(None).cast("array<bigint>")
    joined = touched(True).join(spans, "row", "left").select(key, "row", "text", "low", "high").unionByName(touched(False).select(key, "row", "text", none.alias("low"), none.alias("high")))
    span = pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, kept, removed = [], [], []
            for t, low, high in zip(b.column(2), b.column(3), b.column(4), strict=True):
                raw = (t.as_py() or "").encode()
                runs: list[dict] = []
                if low.is_valid:
                    start, end = low.values.to_numpy().astype(np.int64), high.values.to_numpy().astype(np.int64) + LENGTH
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    head = np.concatenate([[True], start[1:] > end[:-1]])
                    last = np.append(np.flatnonzero(head)[1:], len(start)) - 1
                    runs = [{"start": i, "end": j} for i, j in zip(start[head].tolist(), end[last].tolist(), strict=True)]
                edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(raw)]
                size.append(len(raw))
                kept.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(runs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(span))], names=[key, "row", "n_bytes", "kept", "removed"])

    pair_type = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([docs.schema[key], T.StructField("row", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(pair_type))])
    return joined.mapInArrow(tidy(cut), out)


def digest(cleaned: DataFrame, shared: DataFrame) -> DataFrame:
    """Counts and a digest of remove_repeats' rows, and shared_runs' longest run, 0 without one."""
    counted = cleaned.select(
        "doc_id",
        "row",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    return counted.join(shared, "row", "left").withColumn("longest_shared", F.coalesce("longest_shared", F.lit(0).cast("long"))).drop("row")
