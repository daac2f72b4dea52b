"""Durable captures: idempotent appends, replay, deletion, journals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


#: Where a store keeps its commits: a numbered folder each, with the name of one batch.
COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commits(spark: SparkSession, path: str) -> list[str]:
    """The batches of a store that are committed, in order."""
    numbers = sorted(int(n) for n in _names(spark, f"{path}/{COMMITS}") if n.isdigit())
    return [_read_text(spark, f"{path}/{COMMITS}/{n}/batch") for n in numbers]


def commit(spark: SparkSession, path: str, number: int, batch: str) -> bool:
    """Whether the batch is commit `number` now. Of several that try, one has the folder: renaming one into its place is atomic in file systems."""
    fs, own = _fs(spark, f"{path}/{COMMITS}/.{uuid.uuid4().hex}")
    out = fs.create(own.suffix("/batch"))
    out.write(bytearray(batch.encode()))
    out.close()
    _, to = _fs(spark, f"{path}/{COMMITS}/{number}")
    won = not fs.exists(to) and fs.rename(own, to) and _read_text(spark, f"{path}/{COMMITS}/{number}/batch") == batch
    if not won:
        # where another one was faster, a rename may have put this folder inside that one's
        for left in (own, to.suffix(f"/{own.getName()}")):
            if fs.exists(left):
                fs.delete(left, True)
    return won


def stored(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame:
    """A store's committed rows; of some of its batches, where they are told. A folder without commits is one plain table."""
    names = commits(spark, path) if batches is None else batches
    if not names:
        return spark.read.parquet(path)
    return spark.read.option("basePath", path).parquet(*[f"{path}/__batch={n}" for n in names]).drop("__batch")


def _some(spark: SparkSession, path: str, batches: list[str]) -> DataFrame | None:
    """Some batches, or a plain table; None where nothing is written."""
    try:
        return stored(spark, path, batches)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def append_new(rows: DataFrame, path: str, key: str = "dedupe_key", partition_by: tuple[str, ...] = (), batch: str | None = None) -> int:
    """Appends the rows whose key the store doesn't have yet, each once; returns how many.

    In two phases: the rows are written as a batch that no reader sees, then the batch is committed. Writers may work side by side: the one that
    finds its number taken drops what the other's batches have and tries the next, so each key stands in one committed batch. batch: a name
    for what is appended, such as a stream's epoch; a batch of a name that is committed already appends nothing. A writer that is lost leaves
    an uncommitted batch, which readers (stored) pass over. Only the key column of the store is read.
    """
    spark = rows.sparkSession
    name = batch or uuid.uuid4().hex
    known = commits(spark, path)
    if batch and any(c.startswith(f"{batch}-") for c in known):
        return 0
    have = _some(spark, path, known)
    new, at = rows.dropDuplicates([key]), f"{name}-{uuid.uuid4().hex[:8]}" if batch else name
    new = new if have is None else new.join(have.select(key), key, "left_anti").select(*rows.columns)
    while True:
        writer = new.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/__batch={at}")
        written = _some(spark, path, [at])
        n = written.count() if written is not None else 0
        if not n or commit(spark, path, len(known), at):
            return n
        now = commits(spark, path)
        if batch and any(c.startswith(f"{batch}-") for c in now):
            return 0
        others, known = now[len(known) :], now
        # what was written is read again, so that what it was made of isn't computed anew
        new = written.join(stored(spark, path, others).select(key), key, "left_anti").select(*rows.columns)
        at = f"{at}-{len(known)}"


def replay(spark: SparkSession, path: str, ts: str = "ts", captured: str = "captured_at") -> DataFrame:
    """A store's rows, the capture time standing in for a missing clock."""
    return stored(spark, path).withColumn(ts, F.coalesce(ts, captured))


def replay_keys(ts: str, arrival: list[str]) -> list[Column]:
    return [F.col(ts).asc_nulls_last(), *[F.col(c) for c in arrival]]


def in_time_order(rows: DataFrame, ts: str, arrival: list[str]) -> DataFrame:
    """Replayed rows by their time, those of one time as they arrived, those without a time last; Spark sorts by ranges."""
    return rows.orderBy(*replay_keys(ts, arrival))


def merge_replays(*parts: DataFrame) -> DataFrame:
    """Hook and transcript rows as one, each kind's own columns null in the other; in_time_order puts them in order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def delete_sessions(spark: SparkSession, path: str, sessions: DataFrame, to: str, key: str = "session_id") -> int:
    """Writes a store without some sessions to `to`; returns how many rows went."""
    have = stored(spark, path)
    have.join(sessions.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(to)
    return have.count() - spark.read.parquet(to).count()


#: The version told with each binding decision, and what a decision tells.
RECONCILER = 3
JOURNAL = ("change_kind", "event_id", "native_event", "role", "evidence", "binding_evidence", "relationship", "target_event_id", "dedupe_key", "tool_call_id", "turn_id")


def journal_rows(bindings: DataFrame) -> DataFrame:
    """Binding decisions with the columns of JOURNAL, as texts and null where bindings doesn't have them, the reconciler's version and the time."""
    told = [F.col(c).cast("string").alias(c) if c in bindings.columns else F.lit(None).cast("string").alias(c) for c in JOURNAL]
    return bindings.select(*told, F.lit(RECONCILER).alias("reconciler_version"), F.current_timestamp().alias("recorded_at"))


def journal(bindings: DataFrame, path: str) -> None:
    """Appends binding decisions."""
    journal_rows(bindings).write.mode("append").parquet(path)
