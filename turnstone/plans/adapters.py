"""The given tables seen as agent activity: views with the columns that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an event type of the table stands for.
ROLES = {"signup": "PromptSubmitted", "click": "ToolRequest", "purchase": "ToolSuccess", "error": "ToolFailure", "view": "FileAccess"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a session per user, in the order (ts, event_id); tool, path and duration from the properties."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("event_type"))
    return e.select(
        F.col("user_id").alias("session"),
        "event_id",
        "ts",
        role.alias("role"),
        k.alias("k"),
        F.concat(F.lit("tool"), (k % 5).cast("string")).alias("tool"),
        F.concat_ws("/", F.lit("/r"), F.floor(k / 10).cast("string"), k.cast("string")).alias("path"),
        F.col("value").alias("duration_ms"),
    )


#: The same view for DuckDB.
OBSERVATIONS_SQL = """obs AS (SELECT user_id AS session, event_id, ts,
    CASE event_type WHEN 'signup' THEN 'PromptSubmitted' WHEN 'click' THEN 'ToolRequest' WHEN 'purchase' THEN 'ToolSuccess' WHEN 'error' THEN 'ToolFailure' WHEN 'view' THEN 'FileAccess' END AS role,
    k, 'tool' || (k % 5) AS tool, '/r/' || (k // 10) || '/' || k AS path, value AS duration_ms
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def usage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders: a sample per line and name of its figure; the return flag is its behavior, the line status its scope's.

    Lines and orders meet by order, and as that is the bucket, samples come dealt by it: it stays the number that they are dealt by.
    """
    line = table(spark, sf_dir, "lineitem").repartition("l_orderkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    model = F.concat(F.lit("model-"), (F.col("l_suppkey") % 3).cast("string"), F.lit("."))
    names = (
        F.when(F.col("l_partkey") % 11 == 0, F.array(F.lit("maxInputTokens")))
        .when(F.col("l_partkey") % 13 == 0, F.array(F.lit("cacheReadTokens"), F.lit("usage.cache_read_input_tokens")))
        .when(F.col("l_partkey") % 17 == 0, F.array(F.concat(F.lit("modelMetrics."), model, F.lit("thinkingTokens")), F.concat(F.lit("agentMetrics.a.modelMetrics."), model, F.lit("reasoning"))))
        .when(F.col("l_linenumber") % 2 == 0, F.array(F.concat(model, F.lit("inputTokens"))))
        .otherwise(F.array(F.lit("input"), F.lit("usage.input_tokens"), F.lit("outputTokens")))
    )
    return line.select(
        F.col("o_custkey").alias("session"),
        F.col("l_orderkey").alias("bucket"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.col("l_quantity").cast("long").alias("value"),
        F.lit("tokens").alias("unit"),
        F.when(F.col("o_custkey") % 3 == 0, "Session").when(F.col("l_linestatus") == "O", "Turn").otherwise("Request").alias("scope"),
        F.when(F.col("l_returnflag") == "N", "Delta").when(F.col("l_returnflag") == "R", "Cumulative").otherwise("Final").alias("behavior"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_partkey") % 7 == 0).alias("authoritative"),
        ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") % 1_000_000).alias("line"),
        F.posexplode(names).alias("nth", "name"),
    ).select("*", (F.col("line") * 10 + F.col("nth")).alias("ord")).drop("line", "nth")


USAGE_SQL = """lines AS (SELECT *, 'model-' || (l_suppkey % 3) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    named AS (SELECT *, CASE WHEN l_partkey % 11 = 0 THEN ['maxInputTokens'] WHEN l_partkey % 13 = 0 THEN ['cacheReadTokens', 'usage.cache_read_input_tokens']
        WHEN l_partkey % 17 = 0 THEN ['modelMetrics.' || m || '.thinkingTokens', 'agentMetrics.a.modelMetrics.' || m || '.reasoning']
        WHEN l_linenumber % 2 = 0 THEN [m || '.inputTokens'] ELSE ['input', 'usage.input_tokens', 'outputTokens'] END AS names FROM lines),
    samples AS (SELECT o_custkey AS session, CAST(l_orderkey AS VARCHAR) AS bucket, l_orderkey || '-' || l_linenumber AS record_id,
    unnest(names) AS name, CAST(l_quantity AS BIGINT) AS value, 'tokens' AS unit,
    CASE WHEN o_custkey % 3 = 0 THEN 'Session' WHEN l_linestatus = 'O' THEN 'Turn' ELSE 'Request' END AS scope,
    CASE l_returnflag WHEN 'N' THEN 'Delta' WHEN 'R' THEN 'Cumulative' ELSE 'Final' END AS behavior,
    CAST(l_shipdate AS TIMESTAMP) AS ts, l_partkey % 7 = 0 AS authoritative, ((l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey % 1000000) * 10 + unnest(range(len(names))) AS ord
    FROM named)"""
