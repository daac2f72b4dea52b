"""Substring dedup by line or paragraph hashing.

Units (lines, or paragraphs) are normalised and hashed where the text is; digests are grouped over all
documents, the earliest occurrence of each stays, and all others are removed. Only digests and
offsets are shuffled until the spans are known.

A passage may begin and end inside a line, where no whole line repeats. shared_passages finds those by finer units, the
sentences of lines: it removes nothing, and tells how long a run of units a document has that other documents have, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.bloom import bloom, fits
from turnstone.llm.common import stage_table
from turnstone.llm.words import PIECE, SPACED, U, Bytes, mix, pieces, tidy

LEAST_WORDS = 5
#: Bytes that end a sentence or a line.
STOP = np.zeros(256, bool)
STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True
_BASE = U(0xD1342543DE82EF95)
_INV = U(pow(int(_BASE), -1, 1 << 64))


def units_of(docs: DataFrame, key: str, text: str, separator: str, least_words: int) -> DataFrame:
    """doc (key), row (hash of the text), unit (number in the text), start and end (code points, its separator included), hi, lo (128-bit digest).

    A unit is normalised by lower-casing A-Z and by single blanks for runs of ASCII white space. Units of
    fewer than least_words words are not returned.
    """
    cut = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, row_of, texts = (b.column(k).to_pylist() for k in range(3))
            for i, j in pieces(texts):
                rows = []
                for key_, row, t in zip(keys[i:j], row_of[i:j], texts[i:j], strict=True):
                    if not t:
                        continue
                    raw, at = t.encode(), 0
                    plain = len(raw) == len(t)
                    said = raw.split(cut)
                    chars = said if plain else t.split(separator)
                    for n, (unit, c) in enumerate(zip(said, chars, strict=True)):
                        end = min(at + len(c) + len(separator), len(t))
                        words = unit.lower().split()
                        if len(words) >= least_words:
                            d = xxhash.xxh3_128_intdigest(b" ".join(words))
                            rows.append((key_, row, n, at, end, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)))
                        at = end
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "row", "unit", "start", "end", "hi", "lo"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("t")).mapInArrow(tidy(run), "doc long, row long, unit long, start long, end long, hi long, lo long")


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n", least_words: int = LEAST_WORDS) -> DataFrame:
    """The units to remove: key, row (hash of the text), unit, start, end, and where each stays: first_doc, first_unit.

    Rank: the smaller key, then the earlier unit; null keys last. Rows of one key count as one document: in
    repeated rows the same units stay, but different texts of one key have their own units. A digest may belong to a third of all documents: occurrences are
    pre-aggregated before they are shuffled, and the join back is one that Spark splits when it is skewed.
    """
    units = stage_table(units_of(docs, key, text, separator, least_words))
    rank = F.struct(F.col("doc").isNull().alias("none"), "doc", "unit")
    first = units.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hi", "lo", F.col("first.doc").alias("first_doc"), F.col("first.unit").alias("first_unit"))
    hit = units.join(first, ["hi", "lo"]).where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("unit") == F.col("first_unit"))))
    return hit.select(F.col("doc").alias(key), "row", "unit", "start", "end", "first_doc", "first_unit").dropDuplicates([key, "row", "unit"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated units cut out of `text`, and their original offsets in `removed` (array of start, end).

    A removed unit takes its separator along. Null texts stay null; empty ones, units of fewer than
    least_words words and an empty table stay as they are; a column named `removed` is replaced.
    """
    gone = repeated_units(docs, key, text, separator, least_words)
    spans = gone.groupBy(F.col(key).alias("__key"), F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    kept = docs.drop("removed")
    named = [f.name for f in kept.schema.fields]
    same = kept[key].cast("long").eqNullSafe(spans["__key"]) & (F.xxhash64(kept[text]) == spans["__row"])
    found = kept.join(spans, same, "left").select(*[kept[f"`{c}`"] for c in named], F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            out = []
            for t, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if spans:
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(t)]
                    t = "".join(t[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append(t)
            yield b.set_column(at, b.schema.field(at), pa.array(out, pa.string()))

    return found.mapInArrow(tidy(cut), found.schema)


def _sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in it, words, name) of the sentences of texts: what stands between stops, if it has a word."""
    b = Bytes(texts)
    at, end, first = b.words(SPACED & ~STOP)
    n = len(at)
    stop = np.cumsum(STOP[b.raw])[at] if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    head = np.flatnonzero(np.concatenate([[True], (stop[1:] != stop[:-1]) | (owner[1:] != owner[:-1])])) if n else np.zeros(0, np.int64)
    words = np.diff(np.append(head, n))
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, _INV))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.hashes(at, end) * up[:n])]) if n else np.zeros(1, np.uint64)
    name = mix((sums[head + words] - sums[head]) * down[head] + words.astype(np.uint64))
    of = owner[head]
    return of, np.arange(len(head)) - np.searchsorted(of, of), words, name


def shared_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row (hash of the text), shared_words, longest_shared_words of the documents that share a sentence.

    A sentence is what stands between line feeds, dots, exclamation and question marks, and has a word; sentences are equal
    as units of lines are. One that documents of two keys have is shared (a null key is a document by its text); the first of them
    counts as well as the others. The longest run of shared sentences is a passage; passages count in words. Null and empty texts,
    and an empty table, share nothing. First the names of sentences are grouped; then only those seen twice are
    looked for, and their numbers, no texts, are shuffled.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("t"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(2), PIECE // 2):
                of, _, _, name = _sentences(b.column(2).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), b.column(0).slice(i, j - i).take(pa.array(of))], names=["name", "doc"])

    ends = rows.mapInArrow(tidy(names), "name long, doc long").groupBy("name").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    shared = stage_table(ends.where("a <> b").select("name"))
    sent = docs.sparkSession.sparkContext.broadcast(bloom(shared, "name")) if fits(shared) else None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in pieces(b.column(2), PIECE // 2):
                of, unit, words, name = _sentences(b.column(2).slice(i, j - i))
                if sent is not None:
                    of, unit, words, name = (x[fine] for fine in [sent.value.holds(name)] for x in (of, unit, words, name))
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i).take(at) for c in (0, 1)), pa.array(unit.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(name.view(np.int64))], names=["doc", "row", "unit", "words", "name"])

    found = rows.mapInArrow(tidy(placed), "doc long, row long, unit int, words int, name long").join(shared, "name")
    units = found.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("unit", "words"))).alias("units"))
    n = lambda x: F.lit(x).cast("long")
    start = F.struct(n(-2).alias("last"), n(0).alias("run"), n(0).alias("best"), n(0).alias("total"))

    def step(acc, u):
        run = F.when(u["unit"] == acc["last"] + 1, acc["run"]).otherwise(n(0)) + u["words"]
        return F.struct(u["unit"].cast("long").alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"), (acc["total"] + u["words"]).alias("total"))

    sums = units.select("doc", "row", F.aggregate("units", start, step).alias("s"))
    return sums.select("doc", "row", F.col("s.total").alias("shared_words"), F.col("s.best").alias("longest_shared_words"))


def with_passages(docs: DataFrame, found: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """docs with shared_passages' two columns, 0 where nothing is shared. `text`: the column of docs with the hash of the text."""
    out = docs.join(found, (F.coalesce(docs[key].cast("long"), docs[text]) == found["doc"]) & (docs[text] == found["row"]), "left")
    return out.select(*[docs[c] for c in docs.columns if c != text], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("shared_words", "longest_shared_words")])


def digest(cleaned: DataFrame, *more: str) -> DataFrame:
    """Counts, spans and a digest of remove_repeats' rows."""
    return cleaned.select(
        "doc_id",
        *more,
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
