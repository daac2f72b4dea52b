"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import stage_table

#: Nodes that a task contracts at once.
PIECE = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task sees of the graph as stars of its local smallest nodes, in bounded pieces."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > PIECE:
            yield stars()
            parent.clear()
    yield stars()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node hangs on two, and nothing hangs on one that hangs itself."""
    if edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) of longs; root: the smallest node it is connected to.

    Loops and repeated edges do no harm; an empty table gives an empty one. Each round first contracts what
    a task sees, then takes a large and a small star; it is written to the shared folder, which cuts the lineage.
    Rounds are logarithmic in the number of edges. A hub's edges are never one task's: minima are
    pre-aggregated and Spark splits the skewed join.
    """
    edges = stage_table(edges.select("a", "b").where("a <> b").mapInArrow(_local_stars, "a long, b long"))
    while not _settled(edges):
        edges = stage_table(_small_star(_large_star(edges.distinct())).mapInArrow(_local_stars, "a long, b long"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
