"""Texts that stand inside other texts: candidates by one shingle of the short one, confirmed by looking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a shingle: the largest of these that a short text has is what it is looked for by.
SIZES = (24, 6, 1)
#: An odd number that spreads the hashes of shingles.
BASE = np.uint64(0x9E3779B97F4A7C15)


#: Entries of a batch that is given back.
ENTRIES = 1 << 16


def _hashes(t: str | None, size: int) -> np.ndarray:
    """The different hashes of all substrings of `size` characters, sorted as unsigned numbers."""
    codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * BASE + codes[i : i + n]
    return np.unique((h ^ h >> np.uint64(29)) * BASE).view(np.int64)


def _anchor(size: int):
    """A function of texts that gives the least hash of all their substrings of `size` characters."""

    @F.pandas_udf(T.LongType())
    def least(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or not len(h := _hashes(t, size)) else int(h.min()) for t in text], dtype="Int64")

    return least


def _entries(whole: DataFrame, text: str, size: str) -> DataFrame:
    """whole without its text, with __shingle: a row for each different hash of a text's substrings of the row's own size, in bounded batches."""
    kept = [f for f in whole.schema.fields if f.name != text]
    out = T.StructType([*kept, T.StructField("__shingle", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, rest = b.column(b.schema.get_field_index(size)).to_pylist(), b.select([f.name for f in kept])
            at, made, n = [], [], 0
            for i in range(b.num_rows):
                h = _hashes(b.column(b.schema.get_field_index(text))[i].as_py(), sizes[i])
                at.append(np.full(len(h), i, np.int64))
                made.append(h)
                n += len(h)
                if n >= ENTRIES or i == b.num_rows - 1:
                    rows = rest.take(pa.array(np.concatenate(at)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(made))], names=out.names)
                    at, made, n = [], [], 0

    return whole.select(*[f.name for f in kept], text).mapInArrow(run, out)


def contained(short: DataFrame, whole: DataFrame, by: list[str], short_id: str, short_text: str, whole_id: str, whole_text: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(by, short_id, whole_id) where short_text, not empty, stands in whole_text of the same keys, exactly.

    A text that stands in another has all its shingles there, so it is enough to look for one: that of the smallest hash, which frequent
    ones seldom are. Whole texts are entered once under each different shingle of the sizes that their keys look for; pairs that meet are
    confirmed by the texts.
    """
    size = F.lit(sizes[-1])
    for n in reversed(sizes[:-1]):
        size = F.when(F.length(short_text) >= n, n).otherwise(size)
    sought = short.where(F.length(short_text) >= sizes[-1]).withColumn("__size", size)
    anchor = F.lit(None).cast("long")
    for n in sizes:
        anchor = F.when(F.col("__size") == n, _anchor(n)(F.when(F.col("__size") == n, F.col(short_text)))).otherwise(anchor)
    left = sought.select(*by, F.col(short_id).alias("__short"), F.col(short_text).alias("__text"), "__size", anchor.alias("__shingle"))
    sizes_sought = short.where(F.length(short_text) >= sizes[-1]).select(*by, size.alias("__size")).distinct()
    entered = whole.select(*by, F.col(whole_id).alias("__whole"), F.col(whole_text).alias("__in")).join(sizes_sought, by).where(F.length("__in") >= F.col("__size"))
    entries = _entries(entered, "__in", "__size")
    pairs = left.join(entries, [*by, "__size", "__shingle"]).select(*by, "__short", "__text", "__whole")
    texts = whole.select(*by, F.col(whole_id).alias("__whole"), F.col(whole_text).alias("__in"))
    return pairs.join(texts, [*by, "__whole"]).where(F.contains(F.col("__in"), F.col("__text"))).select(*by, F.col("__short").alias(short_id), F.col("__whole").alias(whole_id))


def summariser_stops(stops: DataFrame, brackets: DataFrame, by: list[str], order: str, stop_id: str, message: str, end_id: str, start_id: str, summary: str) -> DataFrame:
    """(by, stop, start): orphaned stops of sub-agents that made a compaction's summary: their message is part of it, and they came before its end.

    stops: by, order, stop_id, message; brackets: by, order of the end, end_id, start_id, summary. A stop goes below the first compaction
    that ends behind it and has its message.
    """
    found = contained(stops.where(F.length(message) > 0), brackets, by, stop_id, message, end_id, summary)
    ends = brackets.select(*by, end_id, start_id, F.col(order).alias("__end"))
    timed = found.join(ends, [*by, end_id]).join(stops.select(*by, stop_id, F.col(order).alias("__at")), [*by, stop_id]).where("__at < __end")
    return timed.groupBy(*by, stop_id).agg(F.min_by(start_id, "__end").alias(start_id))
