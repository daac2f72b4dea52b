"""A Bloom filter of a column of 64-bit names, of a bounded size, built by Spark and asked in tasks.

It only ever prunes: what it lets through by mistake is compared exactly later. Names too many for
MOST_BITS are joined instead (keep_named).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27
SHIFTS = (0, 21, 42)


class Bloom:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def holds(self, names: np.ndarray) -> np.ndarray:
        """For each name (unsigned 64 bits) whether it may be in."""
        out = np.ones(len(names), bool)
        for s in SHIFTS:
            at = (names << np.uint64(s) | names >> np.uint64(64 - s) if s else names) & np.uint64(self.bits - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(names: DataFrame, column: str) -> Bloom:
    """The filter of a column whose values are well mixed 64-bit names."""
    bits = 1 << 12
    n = names.count()
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    c = F.col(column)
    turned = [c if not s else F.shiftleft(c, s).bitwiseOR(F.shiftrightunsigned(c, 64 - s)) for s in SHIFTS]
    at = names.select(F.explode(F.array(*[t.bitwiseAND(F.lit(bits - 1)) for t in turned])).alias("at"))
    one = F.expr("shiftleft(1L, CAST(at & 63L AS INT))")
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return Bloom(out, bits)


def fits(names: DataFrame) -> bool:
    """Whether a filter of MOST_BITS still tells most other names apart."""
    return 8 * names.count() <= MOST_BITS


def keep_named(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows of df whose `column` (longs) is in `names` (a staged table with that column), and maybe a few others.

    Without a shuffle while the filter fits its bound; beyond it by a join.
    """
    if not fits(names):
        return df.join(names.select(column).distinct(), column, "left_semi").select(*df.columns)
    sent, at = df.sparkSession.sparkContext.broadcast(bloom(names, column)), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.holds(b.column(at).to_numpy().view(np.uint64))))

    return df.mapInArrow(run, df.schema)


#: Names up to which their table is broadcast as it is (some 20 bytes each).
BROADCAST = 1_000_000


def without_named(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows of df whose `column` (a long) isn't in `names` (a staged table with that column); rows with a null stay.

    Texts are shuffled only where names are too many to be broadcast, and then only of rows that the filter lets through.
    """
    gone = names.select(F.col(column).alias("__name")).where("__name IS NOT NULL").distinct()
    same = df[column].cast("long") == F.col("__name")
    if names.count() <= BROADCAST:
        return df.join(F.broadcast(gone), same, "left_anti")
    if not fits(names):
        return df.join(gone, same, "left_anti")
    sent, at = df.sparkSession.sparkContext.broadcast(bloom(names, column)), df.columns.index(column)

    def told(yes: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(at)
                yield b.filter(pa.array((sent.value.holds(ids.fill_null(0).cast(pa.int64()).to_numpy().view(np.uint64)) & ids.is_valid().to_numpy(zero_copy_only=False)) == yes))

        return df.mapInArrow(run, df.schema)

    maybe = told(True)
    return told(False).unionByName(maybe.join(gone, maybe[column].cast("long") == F.col("__name"), "left_anti"))
