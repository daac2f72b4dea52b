"""Relations among records of several stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.sources.staging import shared_dir


def resolve(records: DataFrame, targets: DataFrame, record_id: str, key: str, target_id: str) -> DataFrame:
    """record, state (Resolved, Ambiguous, Unresolved), target: by how many targets have the record's key."""
    t = targets.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(target_id).alias(target_id))
    state = F.when(F.col("__n") == 1, "Resolved").when(F.col("__n") > 1, "Ambiguous").otherwise("Unresolved")
    return records.join(t, key, "left").select(record_id, state.alias("state"), F.when(F.col("__n") == 1, F.col(target_id)).alias(target_id))


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, outbound, inbound of every node of an edge table."""
    ends = F.array(F.struct(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    # edges are made once; both ends of each go on
    both = edges.select(F.explode(ends).alias("e")).select("e.*")
    return both.groupBy("node").agg(F.sum("o").cast("long").alias("outbound"), F.sum("i").cast("long").alias("inbound"))


def duplicates(records: DataFrame, kind: str, natural_id: str, record_id: str) -> DataFrame:
    """Records that share kind and id with others: kind, id, first, others. A group gives a star, not its pairs."""
    g = records.groupBy(kind, natural_id).agg(F.min(record_id).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return records.join(g, [kind, natural_id]).where(F.col(record_id) != F.col("first")).select(kind, natural_id, "first", F.col(record_id).alias("other"))


def root_of(nodes: DataFrame, node: str, parent: str, most: int | None = None) -> DataFrame:
    """node, root, depth by parent pointers; nodes in or above a cycle have themselves and -1 (and, where `most` rounds are set, those deeper than 2 ** most).

    Pointer doubling: every round joins once and doubles the reach, and rounds end when no pointer moves, or when all nodes in a
    row would have been passed. A round is written to the shared folder, so a lost executor costs the round at most.
    """
    spark = nodes.sparkSession

    def staged(df: DataFrame) -> DataFrame:
        at = shared_dir(spark)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    at = staged(nodes.select(F.col(node).alias("n"), F.coalesce(parent, node).alias("p"), F.when(F.col(parent).isNull() | (F.col(parent) == F.col(node)), 0).otherwise(1).cast("long").alias("d")))
    for _ in range(at.count().bit_length() if most is None else most):
        up = at.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"))
        new = staged(at.join(up, "p", "left").select("n", F.coalesce("pp", "p").alias("p"), (F.col("d") + F.coalesce("dd", F.lit(0))).alias("d"), (F.col("pp") != F.col("p")).alias("moved")))
        at = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    tops = nodes.where(F.col(parent).isNull() | (F.col(parent) == F.col(node))).select(F.col(node).alias("p"), F.lit(True).alias("top"))
    missing = nodes.select(F.col(parent).alias("p")).distinct().join(nodes.select(F.col(node).alias("p")), "p", "left_anti").withColumn("top", F.lit(True))
    got = at.join(tops.unionByName(missing), "p", "left")
    return got.select(F.col("n").alias(node), F.when(F.col("top"), F.col("p")).otherwise(F.col("n")).alias("root"), F.when(F.col("top"), F.col("d")).otherwise(-1).alias("depth"))
