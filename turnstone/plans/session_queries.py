"""Queries over observations: turns, pairs, intervals, scored matches, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.text import preview
from turnstone.operators import intervals, matching, pairing, turns, usage
from turnstone.plans.adapters import OBSERVATIONS_SQL, USAGE_SQL, observations, table, usage_samples
from turnstone.plans.registry import query

ORDER = ["ts", "event_id"]
_W = "PARTITION BY session ORDER BY ts, event_id"


@query(r"""
    WITH t AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM (
        SELECT *, role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS fresh FROM conversations))
    SELECT conv_id AS session, CAST(turn_no AS BIGINT) AS turn_no, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars,
        count(*) FILTER (role = 'assistant') AS responses,
        min_by(CASE WHEN length(flat) > 60 THEN substr(flat, 1, 60) || '…' ELSE flat END, turn) AS opening
    FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM t) GROUP BY ALL""")
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    found = turns.transcript_turns(rows, ["session"], ["turn"], F.col("role") == "user", F.lit(False))
    return found.groupBy("session", "turn_no").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.length("text")).cast("long").alias("chars"),
        F.count_if(F.col("role") == "assistant").alias("responses"),
        F.min_by(preview(F.col("text"), 60), "turn").alias("opening"),
    )


@query(f"""
    WITH {OBSERVATIONS_SQL}, m AS (SELECT *, count(*) FILTER (role = 'PromptSubmitted') OVER ({_W}) AS n,
        last_value(CASE role WHEN 'PromptSubmitted' THEN 1 WHEN 'ToolFailure' THEN 0 END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS here,
        last_value(CASE role WHEN 'PromptSubmitted' THEN 1 WHEN 'ToolFailure' THEN 0 END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM obs)
    SELECT session, event_id, CASE WHEN CASE WHEN role = 'ToolFailure' THEN before ELSE here END = 1 THEN 'derived-' || n END AS turn_id FROM m""")
def derived_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    found = turns.derived_turns(obs, ["session"], ORDER, F.col("role") == "PromptSubmitted", F.col("role") == "ToolFailure")
    return found.select("session", "event_id", "turn_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, o AS (SELECT *, CASE WHEN role = 'PromptSubmitted' THEN CASE WHEN k % 2 = 0 THEN 'p' || k ELSE 'inferred:' || event_id END END AS own FROM obs)
    SELECT session, event_id, last_value(own IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_key FROM o""")
def carried_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    prompt = F.col("role") == "PromptSubmitted"
    told = obs.withColumn("prompt_id", F.when(prompt & (F.col("k") % 2 == 0), F.concat(F.lit("p"), F.col("k").cast("string"))))
    return turns.carried_prompt(told, ["session"], ORDER, "prompt_id", prompt, "event_id").select("session", "event_id", "prompt_key")


@query(f"""
    WITH {OBSERVATIONS_SQL}, s AS (SELECT *, count(*) FILTER (role = 'ToolFailure') OVER ({_W}) AS segment FROM obs)
    SELECT session, event_id, first_value(CASE WHEN role = 'PromptSubmitted' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY session, segment, k % 10 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS interaction_turn FROM s""")
def interaction_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumns({"interaction": F.col("k") % 10, "t": F.when(F.col("role") == "PromptSubmitted", F.col("event_id"))})
    return turns.interaction_turns(obs, ["session"], ORDER, "interaction", "t", F.col("role") == "ToolFailure").select("session", "event_id", "interaction_turn")


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT session, arg_max(role, (ts, event_id)) AS last_role,
        CASE arg_max(role, (ts, event_id)) WHEN 'ToolFailure' THEN 'Ended' WHEN 'ToolSuccess' THEN 'Stopped' ELSE 'Active' END AS status FROM obs WHERE role <> 'FileAccess' GROUP BY session""")
def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here a failure stands for the session's end and a success for a turn's stop."""
    as_role = F.when(F.col("role") == "ToolFailure", "SessionEnd").when(F.col("role") == "ToolSuccess", "TurnStop").otherwise(F.col("role"))
    found = turns.session_status(observations(spark, sf_dir).withColumn("as_role", as_role), ["session"], ORDER, "as_role", F.col("role") == "FileAccess")
    back = F.when(F.col("last_role") == "SessionEnd", "ToolFailure").when(F.col("last_role") == "TurnStop", "ToolSuccess").otherwise(F.col("last_role"))
    return found.select("session", back.alias("last_role"), "status")


@query("""
    WITH s AS (SELECT conv_id, turn, sha256(text) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p
        FROM conversations),
    r AS (SELECT *, count(*) FILTER (n = 1 OR h IS DISTINCT FROM p) OVER (PARTITION BY conv_id ORDER BY turn) AS revision FROM s)
    SELECT conv_id AS session, revision, first(h) AS body_hash, count(*) AS occurrences, min(turn) AS first_turn FROM r GROUP BY ALL""")
def prompt_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", F.sha2("text", 256).alias("body_hash"))
    return turns.prompt_revisions(rows, ["session"], ["turn"], "body_hash")


@query(f"""
    WITH {OBSERVATIONS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY ts, event_id) AS n FROM obs WHERE role = 'ToolRequest'),
    r AS (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY ts, event_id) AS n FROM obs WHERE role = 'ToolSuccess')
    SELECT session, tool, q.event_id AS request_id, r.event_id AS result_id FROM q JOIN r USING (session, tool, n)""")
def fifo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    left = obs.where("role = 'ToolRequest'").withColumnRenamed("event_id", "request_id")
    right = obs.where("role = 'ToolSuccess'").withColumnRenamed("event_id", "result_id")
    return pairing.fifo_pairs(left, right, ["session", "tool"], ["ts", "request_id"], ["ts", "result_id"], "request_id", "result_id")


_TIERS = """a AS (SELECT *, CASE WHEN k % 4 = 0 THEN k END AS call FROM obs WHERE role = 'ToolRequest'), b AS (SELECT *, CASE WHEN k % 4 = 0 THEN k END AS call FROM obs WHERE role = 'ToolSuccess'),
    one AS (SELECT x.event_id AS request_id, y.event_id AS result_id FROM (SELECT *, row_number() OVER (PARTITION BY session, call ORDER BY ts, event_id) AS n FROM a WHERE call IS NOT NULL) x
        JOIN (SELECT *, row_number() OVER (PARTITION BY session, call ORDER BY ts, event_id) AS n FROM b WHERE call IS NOT NULL) y USING (session, call, n)),
    two AS (SELECT x.event_id AS request_id, y.event_id AS result_id FROM
        (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY ts, event_id) AS n FROM a WHERE event_id NOT IN (SELECT request_id FROM one)) x
        JOIN (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY ts, event_id) AS n FROM b WHERE event_id NOT IN (SELECT result_id FROM one)) y USING (session, tool, n))"""


@query(f"WITH {OBSERVATIONS_SQL}, {_TIERS} SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM two")
def tiered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("call", F.when(F.col("k") % 4 == 0, F.col("k")))
    left = obs.where("role = 'ToolRequest'").withColumnRenamed("event_id", "request_id")
    right = obs.where("role = 'ToolSuccess'").withColumnRenamed("event_id", "result_id")
    return pairing.tiered_pairs(left, right, "call", ["session"], ["tool"], ["ts", "request_id"], ["ts", "result_id"], "request_id", "result_id")


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT session, event_id, request_id FROM (SELECT *, last_value(CASE WHEN role = 'ToolRequest' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY session, tool ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS request_id FROM obs) WHERE role IN ('ToolSuccess', 'ToolFailure')""")
def earlier_request_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.earlier_request(observations(spark, sf_dir), ["session", "tool"], ORDER, F.col("role") == "ToolRequest", "event_id")
    return found.where(F.col("role").isin("ToolSuccess", "ToolFailure")).select("session", "event_id", "request_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, r AS (SELECT session, tool, max(event_id) AS last_order, arg_max(role, event_id) AS outcome, arg_max(duration_ms, event_id) AS duration_ms
        FROM obs WHERE role IN ('ToolSuccess', 'ToolFailure') GROUP BY ALL),
    q AS (SELECT session, tool, count(*) AS requests FROM obs WHERE role = 'ToolRequest' GROUP BY ALL)
    SELECT session, tool, requests, outcome, duration_ms FROM q LEFT JOIN r USING (session, tool)""")
def last_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumnRenamed("role", "outcome")
    results = pairing.last_result(obs.where(F.col("outcome").isin("ToolSuccess", "ToolFailure")), ["session", "tool"], "event_id", "outcome", "duration_ms")
    requests = obs.where("outcome = 'ToolRequest'").groupBy("session", "tool").agg(F.count(F.lit(1)).alias("requests"))
    return pairing.pair_by_id(requests, results, ["session", "tool"]).select("session", "tool", "requests", "outcome", "duration_ms")


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT session, event_id,
        last_value(CASE WHEN role = 'ToolRequest' THEN path END IGNORE NULLS) OVER (PARTITION BY session, tool ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS call_path,
        coalesce(CASE WHEN k % 3 > 0 THEN ts END, last_value(CASE WHEN k % 3 > 0 THEN ts END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS clock FROM obs""")
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumns({"call_path": F.when(F.col("role") == "ToolRequest", F.col("path")), "clock": F.when(F.col("k") % 3 > 0, F.col("ts"))})
    found = pairing.inherit_time(pairing.carry_state(obs, ["session", "tool"], ORDER, "call_path"), ["session"], ORDER, "clock")
    return found.select("session", "event_id", "call_path", "clock")


@query(f"""
    WITH RECURSIVE {OBSERVATIONS_SQL}, r AS (SELECT session, event_id, role, row_number() OVER ({_W}) AS n FROM obs WHERE role IN ('ToolRequest', 'ToolSuccess')),
    s AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS end_id, CAST(NULL AS BIGINT) AS start_id FROM (SELECT DISTINCT session FROM r)
        UNION ALL SELECT s.session, r.n, CASE WHEN role = 'ToolRequest' THEN list_append(stack, event_id) WHEN len(stack) = 0 THEN stack ELSE list_slice(stack, 1, len(stack) - 1) END,
            CASE WHEN role = 'ToolSuccess' AND len(stack) > 0 THEN event_id END, CASE WHEN role = 'ToolSuccess' AND len(stack) > 0 THEN stack[len(stack)] END FROM s JOIN r ON r.session = s.session AND r.n = s.n + 1)
    SELECT session, end_id, start_id FROM s WHERE end_id IS NOT NULL""")
def compaction_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as starts and successes as ends of compactions."""
    return pairing.brackets(observations(spark, sf_dir), ["session"], ORDER, F.col("role") == "ToolRequest", F.col("role") == "ToolSuccess", "event_id")


@query(f"""
    WITH RECURSIVE {OBSERVATIONS_SQL}, r AS (SELECT session, tool, event_id, role = 'ToolRequest' AS l, epoch_us(ts) AS t, row_number() OVER (PARTITION BY session, tool ORDER BY ts, event_id) AS n FROM obs WHERE role IN ('ToolRequest', 'ToolSuccess')),
    s AS (SELECT session, tool, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(t BIGINT, i BIGINT)[]) AS ls, CAST([] AS STRUCT(t BIGINT, i BIGINT)[]) AS rs, CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id FROM (SELECT DISTINCT session, tool FROM r)
        UNION ALL SELECT session, tool, n, CASE WHEN l AND NOT fits THEN list_append(ls, own) WHEN NOT l AND fits THEN list_filter(ls, lambda x: x.i <> pick.i) ELSE ls END,
            CASE WHEN NOT l AND NOT fits THEN list_append(rs, own) WHEN l AND fits THEN list_filter(rs, lambda x: x.i <> pick.i) ELSE rs END,
            CASE WHEN fits THEN CASE WHEN l THEN own.i ELSE pick.i END END, CASE WHEN fits THEN CASE WHEN l THEN pick.i ELSE own.i END END
        FROM (SELECT *, coalesce(abs(pick.t - own.t) <= 1800000000, false) AS fits FROM (SELECT *, pool[list_position(list_transform(pool, lambda x: abs(x.t - own.t)), list_min(list_transform(pool, lambda x: abs(x.t - own.t))))] AS pick FROM (
            SELECT s.session, s.tool, r.n, l, ls, rs, {{'t': r.t, 'i': r.event_id}} AS own, CASE WHEN l THEN rs ELSE ls END AS pool FROM s JOIN r ON r.session = s.session AND r.tool = s.tool AND r.n = s.n + 1))))
    SELECT session, tool, left_id, right_id FROM s WHERE left_id IS NOT NULL""")
def greedy_skew_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and successes of one signature within 30 minutes, each once."""
    side = F.when(F.col("role") == "ToolRequest", "left").when(F.col("role") == "ToolSuccess", "right")
    rows = observations(spark, sf_dir).withColumn("side", side).where("side IS NOT NULL").select("session", "tool", "ts", "event_id", "side")
    return pairing.greedy_by_skew(rows, ["session", "tool"], ORDER, "side", "ts", "event_id", 1800.0)


@query(f"""
    WITH RECURSIVE {OBSERVATIONS_SQL}, r AS (SELECT session, tool, event_id, role = 'ToolRequest' AS asks, path, row_number() OVER (PARTITION BY session, tool ORDER BY ts, event_id) AS n FROM obs WHERE role IN ('ToolRequest', 'ToolSuccess')),
    s AS (SELECT session, tool, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a VARCHAR, i BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS result_id FROM (SELECT DISTINCT session, tool FROM r)
        UNION ALL SELECT session, tool, n, CASE WHEN asks THEN list_append(held, {{'a': path, 'i': event_id}}) ELSE list_filter(held, lambda x: x.i <> pick.i) END, CASE WHEN NOT asks THEN pick.i END, CASE WHEN NOT asks AND pick.i IS NOT NULL THEN event_id END
        FROM (SELECT *, held[coalesce(nullif(list_position(list_transform(held, lambda x: x.a), path), 0), 1)] AS pick FROM (SELECT s.session, s.tool, r.n, asks, path, event_id, held FROM s JOIN r ON r.session = s.session AND r.tool = s.tool AND r.n = s.n + 1)))
    SELECT session, tool, request_id, result_id FROM s WHERE request_id IS NOT NULL""")
def queue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "ToolRequest", "request").when(F.col("role") == "ToolSuccess", "result")
    rows = observations(spark, sf_dir).withColumn("kind", kind).where("kind IS NOT NULL").select("session", "tool", "ts", "event_id", "kind", "path")
    return pairing.queue_matches(rows, ["session", "tool"], ORDER, "kind", "path", "event_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, t AS (SELECT session, event_id AS turn_id, ts AS start, ts + INTERVAL 1 HOUR AS stop, lead(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS next FROM obs WHERE role = 'PromptSubmitted'),
    j AS (SELECT o.session, o.event_id, o.ts, t.turn_id, t.next, t.stop FROM obs o ASOF LEFT JOIN t ON o.session = t.session AND o.ts >= t.start WHERE o.role = 'FileAccess')
    SELECT session, event_id, CASE WHEN next IS NOT NULL OR ts <= stop + INTERVAL 5 SECONDS THEN turn_id END AS turn_id FROM j""")
def turn_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    t = obs.where("role = 'PromptSubmitted'").select("session", F.col("event_id").alias("turn_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("stop"))
    rows = obs.where("role = 'FileAccess'").select("session", "event_id", "ts")
    return intervals.turn_by_interval(rows, t, ["session"], "ts", "turn_id", "start", "stop").select("session", "event_id", "turn_id")


#: Prompt by prompt, with a list of what is taken.
_ADOPT = """p AS (SELECT session, event_id AS prompt_id, ts, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM obs WHERE role = 'PromptSubmitted'),
    q AS (SELECT session, event_id AS pending_id, ts FROM obs WHERE role = 'FileAccess'),
    c AS (SELECT session, n, prompt_id, list(pending_id ORDER BY q.ts, pending_id) FILTER (q.ts BETWEEN p.ts AND p.ts + INTERVAL {s} SECONDS) AS near FROM p LEFT JOIN q USING (session) GROUP BY session, n, prompt_id),
    w AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS prompt_id, CAST(NULL AS BIGINT) AS pending_id FROM (SELECT DISTINCT session FROM p)
        UNION ALL SELECT w.session, c.n, CASE WHEN len(list_filter(near, lambda x: NOT list_contains(taken, x))) > 0 THEN list_append(taken, list_filter(near, lambda x: NOT list_contains(taken, x))[1]) ELSE taken END,
            c.prompt_id, list_filter(near, lambda x: NOT list_contains(taken, x))[1] FROM w JOIN c ON c.session = w.session AND c.n = w.n + 1),
    adopted AS (SELECT session, prompt_id, pending_id FROM w WHERE pending_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {OBSERVATIONS_SQL}, {_ADOPT.format(s=7200)} FROM adopted")
def adopt_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts adopt a file access of the two hours after them (the table's events are minutes apart)."""
    obs = observations(spark, sf_dir)
    p = obs.where("role = 'PromptSubmitted'").select("session", F.col("event_id").alias("prompt_id"), F.col("ts").alias("p_ts"))
    q = obs.where("role = 'FileAccess'").select("session", F.col("event_id").alias("pending_id"), F.col("ts").alias("q_ts"))
    return intervals.adopt_pending(p, q, ["session"], "p_ts", "q_ts", "prompt_id", "pending_id", 7200)


@query(f"WITH RECURSIVE {OBSERVATIONS_SQL}, {_ADOPT.format(s=7200)} SELECT session, event_id FROM obs WHERE role = 'FileAccess' AND event_id NOT IN (SELECT pending_id FROM adopted)")
def without_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    matched = obs.where("role = 'PromptSubmitted'").select("session", F.col("event_id").alias("m_event_id"), F.col("ts").alias("m_ts"))
    return intervals.without_followers(obs.where("role = 'FileAccess'"), matched, ["session"], "ts", "event_id", 7200).select("session", "event_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, s AS (SELECT *, count(*) FILTER (role = 'ToolFailure') OVER ({_W}) AS segment FROM obs)
    SELECT session, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY session, tool, segment ORDER BY ts, event_id) <= INTERVAL 3 HOURS, false) AS is_repeat FROM s""")
def repeated_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.repeated_within(observations(spark, sf_dir), ["session", "tool"], ORDER, "ts", 3 * 3600, F.col("role") == "ToolFailure", ["session"])
    return found.select("session", "event_id", "is_repeat")


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS s, CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_quantity AS INT)) AS e FROM lineitem),
    m AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM c),
    w AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber) AS g FROM m),
    a AS (SELECT l_orderkey, g, count(*) AS members, min(s) AS started, max(e) AS ended, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS calls FROM w GROUP BY ALL HAVING count(*) >= 2)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY g) AS wave, members, started, ended, calls FROM a""")
def parallel_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_shipdate").cast("timestamp")
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("s"), (start + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("e"))
    found = intervals.waves(calls, ["l_orderkey"], "s", "e", "l_linenumber")
    return found.select("l_orderkey", "wave", "members", "started", "ended", F.array_join(F.transform("calls", lambda c: c.cast("string")), ",").alias("calls"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_shipdate) > 1 AS parallel FROM lineitem")
def step_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.step_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_shipdate").select("l_orderkey", "l_linenumber", "parallel")


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT session, event_id, prompt_id FROM (SELECT *, last_value(CASE WHEN role = 'PromptSubmitted' THEN event_id END IGNORE NULLS)
        OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt_id FROM obs) WHERE role = 'FileAccess'""")
def preceding_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.preceding(observations(spark, sf_dir), ["session"], ORDER, F.col("role") == "PromptSubmitted", "event_id", "prompt_id")
    return found.where("role = 'FileAccess'").select("session", "event_id", "prompt_id")


_CANDIDATES = """c AS (SELECT a.l_orderkey AS o, a.l_linenumber AS a, b.l_linenumber AS b,
        CASE WHEN a.l_returnflag <> b.l_returnflag THEN NULL ELSE 100 + CASE WHEN a.l_linestatus = b.l_linestatus THEN 20 ELSE 0 END END AS s,
        a.l_linestatus <> b.l_linestatus AS clash FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's lines as an inner execution (a) and a possible owner (b)."""
    side = lambda p, n: table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(n), F.col("l_returnflag").alias(f"{p}command"), F.col("l_linestatus").alias(f"{p}cwd"), F.lit(None).cast("string").alias(f"{p}sandbox"))
    return side("l_", "a").join(side("r_", "b"), "l_orderkey").where("a < b").withColumn("score", matching.field_score(matching.SHELL))


@query(f"""
    WITH {_CANDIDATES}, g AS (SELECT * FROM c WHERE s IS NOT NULL AND NOT clash), m AS (SELECT *, max(s) OVER (PARTITION BY o, a) AS best FROM g)
    SELECT o AS l_orderkey, a, min(b) AS b, min(s) AS score FROM m WHERE s = best GROUP BY o, a HAVING count(*) = 1""")
def unique_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unique_best(_candidates(spark, sf_dir), ["l_orderkey", "a"], "score").select("l_orderkey", "a", "b", "score")


@query("""
    WITH a AS (SELECT l_orderkey, l_linenumber AS a, l_partkey % 5 AS k1, l_suppkey % 3 AS k2 FROM lineitem WHERE l_linenumber % 2 = 1),
    b AS (SELECT l_orderkey, l_linenumber AS b, l_partkey % 5 AS k1, l_suppkey % 3 AS k2 FROM lineitem WHERE l_linenumber % 2 = 0),
    one AS (SELECT l_orderkey, a, min(b) AS b FROM a JOIN b USING (l_orderkey, k1) GROUP BY ALL HAVING count(*) = 1),
    two AS (SELECT l_orderkey, a, min(b) AS b FROM a JOIN b USING (l_orderkey, k2) WHERE (l_orderkey, a) NOT IN (SELECT (l_orderkey, a) FROM one) GROUP BY ALL HAVING count(*) = 1)
    SELECT l_orderkey * 100 + a AS left_id, l_orderkey * 100 + b AS right_id, 'k1' AS rung FROM one UNION ALL SELECT l_orderkey * 100 + a, l_orderkey * 100 + b, 'k2' FROM two""")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("k1"), (F.col("l_suppkey") % 3).alias("k2"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"))
    left = line.where("l_linenumber % 2 = 1").withColumnRenamed("id", "left_id")
    right = line.where("l_linenumber % 2 = 0").withColumnRenamed("id", "right_id")
    return matching.match_ladder(left, right, ["l_orderkey"], ["k1", "k2"], "left_id", "right_id")


@query("""
    WITH b AS (SELECT o_orderkey, range(1, 1 + o_custkey % 4 + 1) AS ids FROM orders), w AS (SELECT o_orderkey, unnest(ids) AS id, len(ids) AS n FROM b),
    g AS (SELECT DISTINCT o_orderkey, id, n FROM w JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = id)
    SELECT o_orderkey, string_agg(id, ',' ORDER BY id) AS calls, CASE WHEN n = 1 THEN 'nest' ELSE 'group' END AS kind FROM g GROUP BY o_orderkey, n HAVING count(*) = n""")
def batch_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "orders").select("o_orderkey", F.sequence(F.lit(1), (F.col("o_custkey") % 4 + 1).cast("int")).alias("ids"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("id"))
    found = matching.all_or_nothing(batches.withColumn("batch", F.col("o_orderkey")), calls, ["o_orderkey"], "batch", "ids", "id")
    return found.select("o_orderkey", F.array_join(F.transform("calls", lambda c: c.cast("string")), ",").alias("calls"), "kind")


@query(f"""
    WITH {OBSERVATIONS_SQL}, a AS (SELECT session, path, min(event_id) AS request_id FROM obs WHERE role = 'ToolRequest' GROUP BY ALL HAVING count(*) = 1),
    b AS (SELECT session, path, min(event_id) AS access_id FROM obs WHERE role = 'FileAccess' GROUP BY ALL HAVING count(*) = 1) SELECT * FROM a JOIN b USING (session, path)""")
def unique_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    left = obs.where("role = 'ToolRequest'").withColumnRenamed("event_id", "request_id")
    right = obs.where("role = 'FileAccess'").withColumnRenamed("event_id", "access_id")
    return matching.unique_both(left, right, ["session", "path"], "request_id", "access_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, s AS (SELECT *, count(*) FILTER (role = 'ToolFailure') OVER ({_W}) AS segment FROM obs)
    SELECT session, event_id, last_value(CASE WHEN role = 'PromptSubmitted' THEN 'server' || (k % 7) END IGNORE NULLS)
        OVER (PARTITION BY session, segment, tool ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS learned_server FROM s""")
def learned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = F.concat(F.lit("server"), (F.col("k") % 7).cast("string"))
    found = matching.learned_names(observations(spark, sf_dir), ["session"], ORDER, "tool", F.col("role") == "PromptSubmitted", server, F.col("role") == "ToolFailure")
    return found.select("session", "event_id", "learned_server")


#: The names' metrics spelled out, apart from the operator's rules: (name, metric, of a model, listed, a copy, of what).
_METRICS = ", ".join(
    [
        "('maxinputtokens', 'maxinputtokens', false, false, NULL)",
        "('input', 'inputtokens', false, false, NULL), ('usage.input_tokens', 'inputtokens', false, false, NULL)",
        "('outputtokens', 'outputtokens', false, false, NULL)",
        "('cachereadtokens', 'cachereadtokens', false, false, NULL), ('usage.cache_read_input_tokens', 'cachereadtokens', false, false, NULL)",
        *[
            f"('model-{i}.inputtokens', '{i} input', true, false, NULL), ('modelmetrics.model-{i}.thinkingtokens', '{i} reasoning', true, true, NULL), ('agentmetrics.a.modelmetrics.model-{i}.reasoning', 'a {i} reasoning', true, false, 'modelmetrics.model-{i}.thinkingtokens')"
            for i in range(3)
        ],
    ]
)


def _usage_sql(by: str, extra: str = "") -> str:
    return f"""WITH {USAGE_SQL}, metrics(low, metric, model, listed, copied) AS (VALUES {_METRICS}),
    d AS (SELECT DISTINCT ON (session, record_id, lower(name), value, lower(unit), scope, behavior, bucket) * FROM samples ORDER BY ord),
    m AS (SELECT d.*, metric, model, copied, low, CASE scope WHEN 'Session' THEN 2 WHEN 'Turn' THEN 1 ELSE 0 END AS rk{extra} FROM d JOIN metrics ON lower(name) = low),
    t AS (SELECT *, max(rk) OVER (PARTITION BY {by}) AS top FROM m),
    f AS (SELECT *, bool_or(NOT model) OVER (PARTITION BY {by}) AS plain, list(low) OVER (PARTITION BY {by}) AS lows FROM t WHERE rk = top),
    g AS (SELECT *, CASE WHEN rk > 0 THEN scope || ':' || bucket ELSE 'r:' || record_id END AS cell FROM f
        WHERE top <> 2 OR (plain AND NOT model) OR (NOT plain AND NOT coalesce(list_contains(lows, copied), false))),
    u AS (SELECT DISTINCT ON ({by}, metric, record_id, value, scope, behavior, bucket, authoritative) * FROM g ORDER BY ord),
    h AS (SELECT *, bool_or(authoritative) OVER (PARTITION BY {by}, metric, cell) AS auth FROM u),
    c AS (SELECT {by}, metric, cell, arg_max(value, (ts, CASE WHEN low LIKE 'modelmetrics.%' THEN 2 WHEN low LIKE '%.modelmetrics.%' THEN 1 ELSE 0 END, ord)) FILTER (behavior = 'Final') AS fin,
        max(value) FILTER (behavior = 'Cumulative') AS cum, coalesce(sum(value) FILTER (behavior = 'Delta'), 0) AS delta FROM h WHERE NOT auth OR authoritative GROUP BY {by}, metric, cell)
    SELECT {by}, CAST(sum(coalesce(fin, cum, delta)) AS BIGINT) AS total FROM c GROUP BY {by}"""


@query(_usage_sql("session"))
def usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_total(usage_samples(spark, sf_dir), ["session"], dealt=True)


@query(f"SELECT * FROM ({_usage_sql('session, name_key', ', low AS name_key')}) WHERE total <> 0")
def usage_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_by_name(usage_samples(spark, sf_dir), ["session"], dealt=True).select("session", "name_key", "total")


_FAMILY = ", CASE WHEN low LIKE '%cache%' THEN 'cache_read' WHEN low LIKE '%reason%' OR low LIKE '%thinking%' THEN 'reasoning' WHEN low LIKE '%output%' THEN 'output' ELSE 'input' END AS family"


@query(f"""
    SELECT session, max(total) FILTER (family = 'input') AS input, coalesce(max(total) FILTER (family = 'output'), 0) AS output, coalesce(max(total) FILTER (family = 'cache_read'), 0) AS cache_read,
        CAST(0 AS BIGINT) AS cache_write, coalesce(max(total) FILTER (family = 'reasoning'), 0) AS reasoning FROM ({_usage_sql('session, family', _FAMILY)}) GROUP BY session""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.token_totals(usage_samples(spark, sf_dir), ["session"], dealt=True)


@query(f"""
    WITH {OBSERVATIONS_SQL}, n AS (SELECT tool, count(*) FILTER (role = 'ToolRequest') AS requests, count(*) FILTER (role IN ('ToolSuccess', 'ToolFailure')) AS results,
        sum(duration_ms) FILTER (role IN ('ToolSuccess', 'ToolFailure')) AS ms FROM obs GROUP BY tool)
    SELECT tool, CASE WHEN requests > 0 THEN requests ELSE least(results, 1) END AS uses, round(ms, 2) AS duration_ms, round(100 * ms / sum(ms) OVER (), 2) AS share FROM n""")
def tool_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnstone.operators.summary import counted_durations

    obs = observations(spark, sf_dir)
    done = F.col("role").isin("ToolSuccess", "ToolFailure")
    return counted_durations(obs, [], "tool", F.col("role") == "ToolRequest", done, "duration_ms")


@query(f"""
    WITH {OBSERVATIONS_SQL}, c AS (SELECT session, tool, k, bool_or(role = 'ToolSuccess') AS ok, bool_or(role = 'ToolRequest') AS asked, bool_or(role = 'ToolFailure') AS failed, min(path) AS path FROM obs GROUP BY ALL)
    SELECT session, count(DISTINCT lower(path)) AS n_paths, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM c WHERE ok OR (asked AND NOT failed) GROUP BY session""")
def file_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnstone.operators.summary import file_access as accesses

    obs = observations(spark, sf_dir).withColumns({"paths": F.array("path"), "call": F.concat_ws(":", "tool", F.col("k").cast("string"))})
    found = accesses(obs, ["session"], "call", F.col("role") == "ToolSuccess", F.col("role") == "ToolRequest", F.col("role") == "ToolFailure", "paths")
    return found.select("session", F.size("paths").cast("long").alias("n_paths"), F.array_join("paths", ",").alias("paths"))


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT session, event_id, ts FROM (SELECT DISTINCT ON (event_id) * FROM (SELECT *, 0 AS again FROM obs UNION ALL SELECT *, 1 FROM obs WHERE k % 2 = 0) ORDER BY again)""")
def dedupe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnstone.operators.catalog import dedupe_least

    obs = observations(spark, sf_dir)
    again = obs.withColumn("again", F.lit(0)).unionByName(obs.where("k % 2 = 0").withColumn("again", F.lit(1)))
    return dedupe_least(again, ["event_id"], ["again", "ts"]).select("session", "event_id", "ts")
