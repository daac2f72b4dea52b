"""Rules that go row by row inside a key: one sorted Arrow pass over a partition, which starts anew at each key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a batch that a pass returns.
ROWS = 8192


def two_sided(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows of keys that have more than one value of `side`; the others can't match anything."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"__low": F.min(side).over(w), "__high": F.max(side).over(w)}).where("__low <> __high").drop("__low", "__high")


def by_key(rows: DataFrame, keys: list[str], order: list, columns: list[str], rule: Callable[[], Callable[..., Iterable[tuple]]], schema: str, placed: bool = False) -> DataFrame:
    """(keys, then what the rule returns) for rows in `order` inside their keys.

    rule() is called at the start of each key and gives a function of `columns` that returns tuples, none or more; what it holds is
    all that stays in memory. placed: rows of a key are in one partition already (a window over the keys or fewer came before).
    """
    shuffled = rows if placed else rows.repartition(*keys)
    sorted_ = shuffled.sortWithinPartitions(*keys, *order).select(*dict.fromkeys([*keys, *columns]))
    types = T.StructType([sorted_.schema[k] for k in keys]).fields + T.StructType.fromDDL(schema).fields
    out = T.StructType(types)
    made_types = [to_arrow_type(f.dataType) for f in out.fields[len(keys) :]]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, made = None, None, []
        arrow = None
        for b in batches:
            data = [b.column(b.schema.get_field_index(c)).to_pylist() for c in [*keys, *columns]]
            if arrow is None:
                arrow = [b.schema.field(b.schema.get_field_index(k)).type for k in keys]
            for row in zip(*data, strict=True):
                if at is None or row[:n] != at:
                    at, step = row[:n], rule()
                made += [at + got for got in step(*row[n:])]
            while len(made) >= ROWS:
                yield batch(made[:ROWS], arrow)
                made = made[ROWS:]
        if made:
            yield batch(made, arrow)

    def batch(made: list[tuple], arrow: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [*arrow, *made_types], strict=True)], names=out.names)

    return sorted_.mapInArrow(run, out)
