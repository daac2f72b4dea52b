"""A stored result over many sources that is brought up to date by reading the sources that changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators.catalog import snapshot_diff
from turnstone.sources import captures

#: Sources up to which their paths are handed to the reader; more are found by a join while all are read.
MOST_PATHS = 100_000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of the files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))


def refresh(spark: SparkSession, root: str, store: str, read: Callable[[str | list[str]], DataFrame], summarise: Callable[[DataFrame], DataFrame], key: str) -> tuple[DataFrame, int]:
    """(result, how many sources were read): summarise() over all rows below root, of which only touched keys are computed anew.

    read(paths): the rows of some sources, or of all below a folder, with `source`, the file's path (_metadata.file_path). summarise() must
    give rows that depend on the rows of one key only, and hold it. A version of the store has the result, the listing that it was made of, and
    which keys a source has. A source that was added, changed or removed touches its keys, those it had and those it has; the rows of touched
    keys are read again from all sources that have any, and take the place of the stored ones. Versions are committed as
    captures' batches are: a run that is lost leaves the last version as it was.
    """
    at = f"{store}/__batch={uuid.uuid4().hex}"
    known = captures.commits(spark, store)
    listing(spark, root).write.parquet(f"{at}/sources")
    now = spark.read.parquet(f"{at}/sources")
    if not known:
        rows = read(root)
        index, result, n = rows.select("source", key).distinct(), summarise(rows), now.count()
    else:
        old = {name: spark.read.parquet(f"{store}/__batch={known[-1]}/{name}") for name in ("sources", "index", "result")}
        snapshot_diff(old["sources"], now).write.parquet(f"{at}/changes")
        changes = spark.read.parquet(f"{at}/changes").select(F.col("path").alias("source"), "change")
        fresh = changes.where("change <> 'removed'").select("source")
        _read_some(spark, root, read, fresh).select("source", key).distinct().write.parquet(f"{at}/fresh")
        own = spark.read.parquet(f"{at}/fresh")
        left = old["index"].join(changes, "source", "left_anti")
        index = left.unionByName(own)
        touched = old["index"].join(changes, "source", "left_semi").select(key).unionByName(own.select(key)).distinct()
        touched.write.parquet(f"{at}/touched")
        keys = spark.read.parquet(f"{at}/touched").select(F.col(key).alias("__key"))
        same = lambda d: d[key].eqNullSafe(keys["__key"])
        again = index.join(keys, same(index), "left_semi").select("source").distinct()
        n = again.count()
        rows = _read_some(spark, root, read, again)
        made = summarise(rows.join(keys, same(rows), "left_semi"))
        result = old["result"].join(keys, same(old["result"]), "left_anti").unionByName(made)
    index.write.parquet(f"{at}/index")
    result.write.parquet(f"{at}/result")
    if not captures.commit(spark, store, len(known), at.rpartition("=")[2]):
        raise RuntimeError("another run has refreshed this store meanwhile")
    return spark.read.parquet(f"{at}/result"), n


def _read_some(spark: SparkSession, root: str, read: Callable[[str | list[str]], DataFrame], sources: DataFrame) -> DataFrame:
    paths = [r[0] for r in sources.limit(MOST_PATHS + 1).collect()]
    if len(paths) > MOST_PATHS:
        return read(root).join(sources, "source", "left_semi")
    if paths:
        return read(paths)
    return read(root).limit(0)
