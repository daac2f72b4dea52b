"""Hook envelopes: one JSON document per file, or one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.dims import SURFACES
from turnstone.functions.times import effective_timestamp, native_timestamp

#: Columns of an envelope and where its document has them.
FIELDS = {
    "event_id": "$.eventId",
    "observed": "$.observedAtUtc",
    "provider": "$.provider",
    "configuredSurface": "$.configuredSurface",
    "detectedSurface": "$.detectedSurface",
    "sourceKind": "$.sourceKind",
    "configured_event": "$.configuredEventName",
}


def file_time(name: Column, zone: str = "UTC") -> Column:
    """The capture time in names like x_20240131_235959_123_0a1b2c3d.json; null for other names."""
    stamp = F.regexp_extract(name, r"(?i)_([0-9]{8}_[0-9]{6}_[0-9]{3})_[0-9a-f]{8}\.json$", 1)
    return F.to_utc_timestamp(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss_SSS")), zone)


def parse(raw: DataFrame, value: str = "value", path: str = "path") -> DataFrame:
    """Rows of text to envelopes; `fine` is false for what isn't a JSON object. Nothing is dropped.

    A missing event id becomes a hash of the content, so that replays of it stay one event.
    """
    doc = F.try_parse_json(value)
    got = raw.withColumn("doc", doc).withColumn("fine", F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False)))
    get = lambda p: F.try_variant_get("doc", p, "string")
    out = got.select(path, value, "fine", *[get(p).alias(c) for c, p in FIELDS.items()], F.coalesce(F.try_variant_get("doc", "$.payload", "variant"), F.col("doc")).alias("payload"))
    text = lambda p: F.try_variant_get("payload", p, "string")
    observed = F.coalesce(F.try_to_timestamp("observed"), file_time(F.col(path)))
    native = native_timestamp(text("$.timestamp"))
    told = F.coalesce(text("$.hook_event_name"), text("$.event"))
    # one surface's payloads may name the event in another dialect: there the configuration goes first
    configured_first = F.coalesce(F.lower(F.trim(F.coalesce("detectedSurface", "configuredSurface"))).isin("copilotcli", str(SURFACES.index("CopilotCli"))), F.lit(False))
    return out.withColumns(
        {
            "event_id": F.coalesce("event_id", F.substring(F.sha2(value, 256), 1, 32)),
            "observed": observed,
            "ts": effective_timestamp(native, observed),
            "native_event": F.when(configured_first, F.coalesce("configured_event", told)).otherwise(F.coalesce(told, "configured_event")),
            "session_id": F.coalesce(text("$.session_id"), text("$.sessionId"), text("$.conversation_id")),
            "tool_name": F.coalesce(text("$.tool_name"), text("$.toolName")),
            "tool_call_id": text("$.tool_use_id"),
            "transcript": F.coalesce(text("$.transcript_path"), text("$.transcriptPath")),
        }
    )


def read(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejects) below a path; a bad one never fails the scan."""
    raw = spark.read.text(path, wholetext=whole_files, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    got = parse(raw)
    return got.where("fine").drop("value", "fine"), got.where("NOT fine").select("path", "value", F.lit("not a JSON object").alias("reason"))


def scoped_session(provider: Column, surface: Column, session: Column, path: Column) -> Column:
    """provider:surface:session; rows without a session are split by file, so that they don't meet in one group."""
    return F.concat_ws(":", provider, surface, F.coalesce(session, F.concat(F.lit("unknown@"), F.sha1(F.coalesce(path, F.lit("")).cast("binary")))))


def detail_fields(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, name, value) of every top-level field of a payload VARIANT."""
    made = rows.select(key, payload).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(payload).outer()))
    return made.select(key, F.col("key").alias("name"), F.col("value").cast("string").alias("value")).where("name IS NOT NULL")


#: Dialects of transcripts that are read, and sessions of health checks, which aren't.
DIALECTS = ("claude-code-jsonl", "copilot-cli-jsonl", "cursor-jsonl")
SYNTHETIC = ("process-test", "cursor-smoke")


def named_transcripts(references: DataFrame, dialects: tuple[str, ...] = DIALECTS) -> DataFrame:
    """(path, session_id, dialect, source, agent_id): the transcripts that hooks refer to (path, session_id, dialect, role, agent_id, observed), each once.

    Paths are trimmed, `/c:/x` is `c:/x`, and they are one by any case; the first reference counts. Dialects that aren't read and synthetic
    sessions are left out. source: `main`, or a sub-agent's.
    """
    path = F.regexp_replace(F.trim("path"), r"^/(?=[A-Za-z]:)", "")
    known = F.col("dialect").isin(*dialects) & ~F.coalesce(F.lower("session_id").isin(*SYNTHETIC), F.lit(False)) & (path != "")
    source = F.when((F.col("role") == "Subagent") & F.col("agent_id").isNotNull(), F.concat(F.lit("agent-"), F.col("agent_id"))).otherwise("main")
    first = F.struct("observed", "session_id", "dialect")
    got = references.where(known).withColumn("path", path).groupBy(F.lower("path").alias("__k")).agg(F.min_by(F.struct("path", "session_id", "dialect", source.alias("source"), "agent_id"), first).alias("r"))
    return got.select("r.*")


def discover_transcripts(envelopes: DataFrame, synthetic: DataFrame | None = None) -> DataFrame:
    """(session_id, transcript): each path that hooks name, once by case; synthetic sessions left out."""
    got = envelopes.where("transcript IS NOT NULL AND session_id IS NOT NULL")
    if synthetic is not None:
        got = got.join(synthetic.select("session_id"), "session_id", "left_anti")
    return got.groupBy(F.lower("transcript").alias("__k")).agg(F.min_by("transcript", "observed").alias("transcript"), F.min_by("session_id", "observed").alias("session_id")).drop("__k")
