"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is staged: documents may be long, and a batch is held by Spark and by Python.
BATCH_ROWS = 1000
#: Bytes of a row group of staged tables: what a task that writes holds in memory, and what one that reads may split by.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whatever store sf_dir is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under the folder that all executors share (spark.checkpoint.dir).

    Where that setting is missing a temporary folder stands in, in local mode only: on a cluster
    no machine-local folder would do, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/turnstone-{uuid.uuid4().hex}"


def stage_table(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back.

    It cuts the lineage, outlives lost executors, and gives the optimizer the table's true size, so
    that a join broadcasts it only below the session's own threshold.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(min(int(before), BATCH_ROWS)) if int(before) > 0 else str(BATCH_ROWS))
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(batch, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the folder of a staged table, which nothing that is still to run may read."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/turnstone-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
