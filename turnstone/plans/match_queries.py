"""Queries over calls that are open while something refers to them, stand-ins, and texts inside texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import containment, open_calls, pairing
from turnstone.plans.adapters import OBSERVATIONS_SQL, observations, table
from turnstone.plans.join_queries import drained
from turnstone.plans.registry import query
from turnstone.sources.staging import shared_dir
from turnstone.streaming import observe

_STAND_INS = f"""
    WITH {OBSERVATIONS_SQL}, o AS (SELECT session, k % 7 AS signature, ts, event_id, role = 'ToolRequest' AS hook FROM obs WHERE role IN ('ToolRequest', 'ToolSuccess', 'FileAccess')),
    n AS (SELECT *, row_number() OVER (PARTITION BY session, signature, hook ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM o),
    p AS (SELECT *, lag(event_id) OVER (PARTITION BY session, signature, n ORDER BY ts, CAST(event_id AS VARCHAR)) AS partner FROM n)"""
_CHANGES = _STAND_INS + " SELECT session, signature, event_id, CASE WHEN partner IS NULL THEN 'Add' WHEN hook THEN 'PromotePrimary' ELSE 'AttachEvidence' END AS change, partner FROM p"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as hooks, successes and file accesses as transcript rows, of a signature each."""
    obs = observations(spark, sf_dir).where("role IN ('ToolRequest', 'ToolSuccess', 'FileAccess')")
    return obs.select("session", (F.col("k") % 7).alias("signature"), "ts", F.col("event_id").cast("string").alias("event_id"), (F.col("role") == "ToolRequest").alias("hook"))


@query(_CHANGES)
def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pairing.stand_ins(_told(spark, sf_dir), ["session", "signature"], ["ts", "event_id"], F.col("hook"), "event_id")
    return got.withColumns({c: F.col(c).cast("long") for c in ("event_id", "partner")})


@query(_CHANGES)
def streamed_stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream."""
    at = shared_dir(spark)
    rows = _told(spark, sf_dir).select(F.col("session").cast("string").alias("session"), F.col("signature").cast("string").alias("signature"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("hook"), "hook").otherwise("transcript").alias("origin"))
    rows.write.parquet(at)
    made = drained(observe.stand_in_changes(spark.readStream.schema(rows.schema).parquet(at)), "stand_ins")
    return made.select(*[F.col(c).cast("long").alias(c) for c in ("session", "signature", "event_id", "partner")], "change")


@query(_STAND_INS + """, e AS (SELECT session, signature, n, bool_or(hook) AS hooked, max(CASE WHEN hook THEN event_id END) AS h, max(CASE WHEN NOT hook THEN event_id END) AS t FROM n GROUP BY ALL)
    SELECT session, signature, coalesce(h, t) AS node_id, NOT hooked AS stand_in FROM e""")
def standing_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that are left when all rows have come."""
    got = pairing.standing_in(_told(spark, sf_dir), ["session", "signature"], ["ts", "event_id"], F.col("hook"), "event_id")
    return got.withColumn("node_id", F.col("node_id").cast("long"))


@query(f"""
    WITH RECURSIVE {OBSERVATIONS_SQL}, r AS (SELECT session, k % 2 AS call, event_id, role = 'ToolRequest' AS asks, CASE WHEN k % 5 > 0 THEN k % 3 END AS v, row_number() OVER (PARTITION BY session, k % 2 ORDER BY ts, event_id) AS n
        FROM obs WHERE role IN ('ToolRequest', 'ToolSuccess')),
    s AS (SELECT session, call, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i BIGINT, v BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS result_id FROM (SELECT DISTINCT session, call FROM r)
        UNION ALL SELECT session, call, n, CASE WHEN asks THEN list_append(held, {{'i': event_id, 'v': v}}) ELSE list_filter(held, lambda x: pick IS NULL OR x.i <> pick) END, pick, event_id
        FROM (SELECT *, CASE WHEN NOT asks AND len(pool) = 1 THEN pool[1].i END AS pick FROM (SELECT s.held, r.*,
            CASE WHEN r.v IS NULL THEN held WHEN len(list_filter(held, lambda x: x.v = r.v)) > 0 THEN list_filter(held, lambda x: x.v = r.v) ELSE list_filter(held, lambda x: x.v IS NULL) END AS pool
            FROM s JOIN r ON r.session = s.session AND r.call = s.call AND r.n = s.n + 1)))
    SELECT session, call, request_id, result_id FROM s WHERE request_id IS NOT NULL""")
def reused_call_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and completions under few call ids: inputs tell them apart where they are told, and what they can't tell apart stays open."""
    obs = observations(spark, sf_dir).where("role IN ('ToolRequest', 'ToolSuccess')")
    rows = obs.withColumns({"call": F.col("k") % 2, "input": F.when(F.col("k") % 5 > 0, F.col("k") % 3)})
    return open_calls.reused_ids(rows, ["session", "call"], ["ts", "event_id"], F.col("role") == "ToolRequest", "input", "event_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, r AS (SELECT session, tool, event_id, CASE WHEN k % 3 > 0 THEN event_id + 40 + k END AS closed, CASE WHEN k % 4 > 0 THEN k % 5 END AS v FROM obs WHERE role = 'ToolRequest'),
    p AS (SELECT session, tool, event_id, CASE WHEN k % 4 <> 1 THEN k % 5 END AS v FROM obs WHERE role = 'ToolFailure'),
    c AS (SELECT p.session, p.event_id, r.event_id AS request_id, CASE WHEN r.v = p.v THEN 100 ELSE 0 END AS score FROM p JOIN r USING (session, tool) WHERE r.event_id < p.event_id AND (closed IS NULL OR closed > p.event_id) AND NOT coalesce(r.v <> p.v, false)),
    b AS (SELECT *, max(score) OVER (PARTITION BY session, event_id) AS best FROM c)
    SELECT session, event_id AS probe_id, min(request_id) AS request_id FROM b WHERE score = best GROUP BY session, event_id HAVING count(*) = 1""")
def permission_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures as permissions that tell a tool and often an input, against the requests that are open then."""
    obs, k = observations(spark, sf_dir).withColumn("session", F.col("session")), F.col("k")
    asked = obs.where("role = 'ToolRequest'").select("session", "tool", F.col("event_id").alias("opened"), F.when(k % 3 > 0, F.col("event_id") + 40 + k).alias("closed"), F.col("event_id").alias("request_id"), F.when(k % 4 > 0, (k % 5).cast("string")).alias("input"))
    probes = obs.where("role = 'ToolFailure'").select("session", "tool", F.col("event_id").alias("at"), F.col("event_id").alias("probe_id"), F.when(k % 4 != 1, (k % 5).cast("string")).alias("input"))
    return open_calls.by_input(asked, probes, ["session"], "tool", "input")


#: Payloads of calls and of what refers to them, with what they tell of a call: file, command, arguments (of their column n).
_CALLS = (
    ('{"toolArgs":{"path":"C:\\\\w\\\\F{n}.py","command":"make {n}"}}', "'f' || n || '.py'", "'make ' || n", "'p' || n"),
    ('{"toolArgs":"{\\"command\\":\\"make {n}\\\\r\\\\n\\"}"}', "NULL", "'make ' || n", "'c' || n"),
    ('{"toolInput":{"n":{n}}}', "NULL", "NULL", "'n' || n"),
    ('{"tool_input":"*** Begin Patch\\n*** Update File: src/F{n}.py\\n"}', "'f' || n || '.py'", "NULL", "NULL"),
)
_REFERENCES = (
    ('{"message":"Edit file: /a/f{n}.PY, please"}', "'f' || n || '.py'", "NULL", "NULL"),
    ('{"message":"run command: make {n}"}', "NULL", "'make ' || n", "NULL"),
    ('{"toolInput":{"n":{n}}}', "NULL", "NULL", "'n' || n"),
    ('{"toolInput":{"command":"make {n}","file_path":"F{n}.py"}}', "'f' || n || '.py'", "'make ' || n", "'q' || n"),
    ('{"message":"something else {n}"}', "NULL", "NULL", "NULL"),
)


def _signals_sql(shapes: tuple) -> str:
    of = lambda i: "CASE event_id % " + str(len(shapes)) + " " + " ".join(f"WHEN {k} THEN {s[i]}" for k, s in enumerate(shapes)) + " END"
    return f"{of(1)} AS f, {of(2)} AS c, {of(3)} AS a"


def _payloads(rows: DataFrame, shapes: tuple) -> DataFrame:
    doc = F.element_at(F.array(*[F.lit(s[0]) for s in shapes]), (F.col("event_id") % len(shapes) + 1).cast("int"))
    made = rows.withColumn("payload", F.replace(doc, F.lit("{n}"), (F.col("k") % 3).cast("string")))
    return made.withColumn("__s", open_calls.call_signals(F.col("payload"))).select("*", "__s.*").drop("__s", "payload")


@query(f"""
    WITH {OBSERVATIONS_SQL}, o AS (SELECT *, k % 3 AS n FROM obs), r AS (SELECT session, event_id, CASE WHEN k % 4 > 0 THEN event_id + 60 END AS closed, {_signals_sql(_CALLS)} FROM o WHERE role IN ('ToolRequest', 'FileAccess')),
    p AS (SELECT session, event_id, {_signals_sql(_REFERENCES)} FROM o WHERE role IN ('ToolFailure', 'ToolSuccess')),
    c AS (SELECT p.session, p.event_id, r.event_id AS request_id FROM p JOIN r ON p.session = r.session AND r.event_id < p.event_id AND (closed IS NULL OR closed > p.event_id)
        AND CASE WHEN p.f IS NOT NULL AND r.f IS NOT NULL THEN p.f = r.f WHEN p.c IS NOT NULL AND r.c IS NOT NULL THEN p.c = r.c WHEN p.a IS NOT NULL AND r.a IS NOT NULL THEN p.a = r.a ELSE false END)
    SELECT session, event_id AS probe_id, min(request_id) AS request_id FROM c GROUP BY ALL HAVING count(*) = 1""")
def permission_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions and notifications that tell a file, a command or arguments of a call, in many ways, against the calls that are open then."""
    obs = observations(spark, sf_dir)
    asked = _payloads(obs.where("role IN ('ToolRequest', 'FileAccess')"), _CALLS)
    asked = asked.select("session", F.col("event_id").alias("opened"), F.when(F.col("k") % 4 > 0, F.col("event_id") + 60).alias("closed"), F.col("event_id").alias("request_id"), "file", "command", "args")
    probes = _payloads(obs.where("role IN ('ToolFailure', 'ToolSuccess')"), _REFERENCES).select("session", F.col("event_id").alias("at"), F.col("event_id").alias("probe_id"), "file", "command", "args")
    return open_calls.by_signals(asked, probes, ["session"], ["file", "command", "args"])


@query("""
    WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS summary FROM conversations),
    s AS (SELECT conv_id, turn AS stop_id, CASE turn % 3 WHEN 0 THEN substr(text, 5, 40) WHEN 1 THEN substr(text, 2, 3) ELSE reverse(text) END AS message FROM c WHERE role = 'user')
    SELECT conv_id, stop_id, min(turn) - 1 AS start_id FROM s JOIN c USING (conv_id) WHERE role = 'assistant' AND turn > stop_id AND message <> '' AND contains(summary, message) GROUP BY conv_id, stop_id""")
def compaction_summarisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' rows as stops of sub-agents with a message; every assistant's row ends a compaction whose summary is all that was said so far."""
    said = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    so_far = F.array_join(F.transform(F.array_sort(F.filter("all", lambda x: x["turn"] <= F.col("turn"))), lambda x: x["text"]), " ")
    every = said.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("all"))
    ends = said.where("role = 'assistant'").join(every, "conv_id").select("conv_id", "turn", F.col("turn").alias("end_id"), (F.col("turn") - 1).alias("start_id"), so_far.alias("summary"))
    text = F.col("text")
    message = F.when(F.col("turn") % 3 == 0, F.substring(text, 5, 40)).when(F.col("turn") % 3 == 1, F.substring(text, 2, 3)).otherwise(F.reverse(text))
    stops = said.where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("stop_id"), message.alias("message"))
    return containment.summariser_stops(stops, ends, ["conv_id"], "turn", "stop_id", "message", "end_id", "start_id", "summary")
