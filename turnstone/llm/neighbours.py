"""Nearest neighbours by a block matrix join, exact.

A stated set of queries goes against all rows in blocks. Vectors are quantised to int8; the products of
int8 tiles, with a bound of the quantisation error, tell which pairs can be among a query's k nearest.
Those pairs are computed anew from the original vectors in double precision. Every task keeps a
heap of k per query over its tiles; Spark merges the tasks' heaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import stage_table

#: Bytes of query vectors that are sent to the tasks at once; more queries take more passes.
QUERY_BYTES = 32 << 20
TILE_QUERIES, TILE_ROWS, PAIRS = 512, 4096, 1 << 17


class Quantised:
    """Rows of int8 codes times a scale each; norm and error are the lengths of the coded part and of the rest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        top = np.abs(self.vectors).max(axis=1, keepdims=True)
        self.scale = np.maximum(top / 127, np.finfo(np.float64).tiny)
        codes = np.rint(self.vectors / self.scale)
        coded = codes * self.scale
        self.norm = np.sqrt((coded**2).sum(axis=1)) * (1 + 1e-9)
        self.error = np.sqrt(((self.vectors - coded) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12 * self.norm
        self.codes = codes.astype(np.int8)
        self.scale = self.scale[:, 0]


def tile(a: Quantised, b: Quantised, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products of two blocks and their error bounds.

    int8 products are summed as float32 over at most 1024 dimensions at once, which is exact.
    """
    dims, total = a.codes.shape[1], 0.0
    for d in range(0, dims, 1024):
        total = total + (a.codes[i, d : d + 1024].astype(np.float32) @ b.codes[j, d : d + 1024].T.astype(np.float32)).astype(np.float64)
    near = total * a.scale[i, None] * b.scale[None, j]
    bound = a.norm[i, None] * b.error[None, j] + a.error[i, None] * (b.norm + b.error)[None, j]
    return near, bound + 1e-9 * np.abs(near)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, added up from the first dimension to the last."""
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        total += x * y
    return total


class Heaps:
    """The k best (score, then smaller id) of each of n queries so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.count = np.zeros(n, np.int64)

    def least(self, i: slice) -> np.ndarray:
        """The score that a further one has to reach; -inf while there are fewer than k."""
        return np.where(self.count[i] >= self.k, self.score[i, -1], -np.inf)

    def push(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        held = np.arange(self.k)[None, :] < self.count[touched, None]
        s = np.concatenate([self.score[touched].ravel(), score])
        v = np.concatenate([self.id[touched].ravel(), ids])
        real = np.concatenate([held.ravel(), np.ones(len(query), bool)])
        q, s, v = q[real], s[real], v[real]
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (v[1:] != v[:-1])])
        q, s, v = q[new], s[new], v[new]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < self.k
        self.score[q[keep], place[keep]], self.id[q[keep], place[keep]] = s[keep], v[keep]
        self.count[touched] = np.bincount(np.searchsorted(touched, q[keep]), minlength=len(touched))


def _by_id(low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The largest of each query's lower bounds for every id: rows of one id can be one neighbour."""
    order = np.argsort(ids, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    return low if len(head) == len(ids) else np.maximum.reduceat(low[:, order], head, axis=1)


def search(queries: Quantised, rows: Quantised, heaps: Heaps) -> None:
    """Every pair of two blocks, by tiles; a row is no neighbour of a query of its own id."""
    for i in range(0, len(queries.ids), TILE_QUERIES):
        qi = slice(i, min(i + TILE_QUERIES, len(queries.ids)))
        for j in range(0, len(rows.ids), TILE_ROWS):
            rj = slice(j, min(j + TILE_ROWS, len(rows.ids)))
            near, bound = tile(queries, rows, qi, rj)
            low = near - bound
            low[queries.ids[qi, None] == rows.ids[None, rj]] = -np.inf
            low = _by_id(low, rows.ids[rj])
            least = heaps.least(qi)
            if low.shape[1] > heaps.k:
                least = np.maximum(least, np.partition(low, low.shape[1] - heaps.k, axis=1)[:, low.shape[1] - heaps.k])
            # so written, a bound that isn't a number keeps its pair
            q, r = np.nonzero(~(near + bound < least[:, None]) & (queries.ids[qi, None] != rows.ids[None, rj]))
            for p in range(0, len(q), PAIRS):
                a, b = q[p : p + PAIRS] + i, r[p : p + PAIRS] + j
                heaps.push(a, rows.ids[b], products(queries.vectors[a], rows.vectors[b]))


def usable(vector: str) -> Column:
    """Neither null nor empty nor all zero, and without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, ids, matrix) of a batch of (id, vector), for each length of vectors."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    size = np.diff(lists.offsets.to_numpy())
    flat, start = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    for dims in np.unique(size):
        at = np.flatnonzero(size == dims)
        yield int(dims), ids[at].astype(np.int64), flat[start[at][:, None] + np.arange(dims)]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products, ties to the smaller id.

    All rows are candidates but those of the query's own id. Unusable vectors (see `usable`) and rows
    without an id take no part; vectors of different lengths are no pairs; equal (id, vector) rows count
    once; a query with fewer candidates gets them all; an empty table gives none. Other columns are
    ignored. The queries sent to the tasks are bounded: they are counted first, and above
    query_bytes they go in as many passes over the rows as it takes, each of about that size; what a pass finds is
    written out before the next part is fetched.
    """
    spark = rows.sparkSession
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    asked = stage_table(rows.where(is_query).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable("v")).distinct())
    total = asked.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-int(total) // query_bytes))
    parts = []
    for turn in range(passes):
        block = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(passes)) == turn).toArrow()
        sets: dict[int, tuple[list, list]] = {}
        for b in block.to_batches():
            for dims, ids, m in _blocks(b):
                sets.setdefault(dims, ([], []))[0].append(ids)
                sets[dims][1].append(m)
        sent = spark.sparkContext.broadcast({d: (np.concatenate(i), np.concatenate(m)) for d, (i, m) in sets.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = {d: Quantised(*x) for d, x in sent.value.items()}
            heaps = {d: Heaps(len(q.ids), k) for d, q in queries.items()}
            for b in batches:
                for dims, ids, m in _blocks(b):
                    if dims in queries:
                        search(queries[dims], Quantised(ids, m), heaps[dims])
            for d, h in heaps.items():
                real = np.arange(k)[None, :] < h.count[:, None]
                q = np.broadcast_to(queries[d].ids[:, None], real.shape)[real]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(h.id[real]), pa.array(h.score[real])], names=["query_id", "vec_id", "score"])

        part = good.mapInArrow(run, "query_id long, vec_id long, score double")
        if passes > 1:  # one part of the queries at a time is held
            part = stage_table(part)
            sent.destroy()
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
