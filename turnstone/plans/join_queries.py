"""Queries over bindings, orders, summaries and plans that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import tools
from turnstone.operators import catalog, matching, open_calls, pairing, placement, plan_docs, search, summary, turns, usage
from turnstone.plans.adapters import OBSERVATIONS_SQL, observations, table
from turnstone.plans.registry import query
from turnstone.sources import captures
from turnstone.sources.staging import shared_dir
from turnstone.streaming import observe

ORDER = ["ts", "event_id"]
_W = "PARTITION BY session ORDER BY ts, event_id"


@query(f"""
    WITH {OBSERVATIONS_SQL}, a AS (SELECT session, k, min(event_id) AS since, arg_min(event_id, event_id) AS hook_id FROM obs WHERE role = 'ToolSuccess' GROUP BY ALL)
    SELECT session, event_id, CASE WHEN event_id > since THEN hook_id END AS hook_id FROM obs LEFT JOIN a USING (session, k) WHERE role = 'FileAccess'""")
def learned_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's first success with a key teaches whom later file accesses of the key belong to."""
    obs = observations(spark, sf_dir)
    matches = obs.where("role = 'ToolSuccess'").withColumn("hook_id", F.col("event_id"))
    rows = obs.where("role = 'FileAccess'").select("session", "k", "event_id")
    return pairing.learned_alias(rows, matches, ["session"], "k", "event_id", "hook_id").select("session", "event_id", "hook_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY ts, event_id) AS n FROM obs WHERE role IN ('ToolRequest', 'ToolSuccess')),
    s AS (SELECT *, lag(role) OVER (PARTITION BY session, tool ORDER BY n) AS before, lag(event_id) OVER (PARTITION BY session, tool ORDER BY n) AS prior FROM r),
    m AS (SELECT *, count(*) FILTER (role = 'ToolRequest' AND before = 'ToolRequest') OVER (PARTITION BY session, tool ORDER BY n) AS mixed FROM s)
    SELECT session, tool, event_id AS end_id, CASE WHEN before = 'ToolRequest' AND mixed = 0 THEN prior END AS start_id, CASE WHEN before = 'ToolRequest' AND mixed = 0 THEN prior WHEN k % 2 = 0 THEN k END AS nested_in FROM m WHERE role = 'ToolSuccess'""")
def inner_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("owner", F.when(F.col("k") % 2 == 0, F.col("k")))
    return pairing.inner_executions(obs, ["session", "tool"], ORDER, F.col("role") == "ToolRequest", F.col("role") == "ToolSuccess", "event_id", "owner")


@query(f"""
    WITH {OBSERVATIONS_SQL}, b AS (SELECT session, k % 20 AS step, min(event_id) AS hook_id FROM obs WHERE role = 'ToolRequest' GROUP BY ALL)
    SELECT session, event_id, CASE WHEN hook_id < event_id THEN hook_id END AS hook_id FROM (SELECT *, k % 20 AS step FROM obs WHERE role = 'PromptSubmitted') LEFT JOIN b USING (session, step)""")
def thought_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("step", F.col("k") % 20)
    bindings = obs.where("role = 'ToolRequest'").withColumn("hook_id", F.col("event_id"))
    return pairing.thought_steps(obs.where("role = 'PromptSubmitted'").select("session", "step", "event_id"), bindings, ["session"], "step", "event_id", "hook_id").select("session", "event_id", "hook_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, q AS (SELECT session, tool, k % 10 AS input, k, event_id AS request_id FROM obs WHERE role = 'ToolRequest'), d AS (SELECT session, tool, k % 10 AS input, k, min(event_id) AS done FROM obs WHERE role = 'ToolSuccess' GROUP BY ALL),
    p AS (SELECT session, tool, k % 10 AS input, event_id FROM obs WHERE role = 'ToolFailure')
    SELECT session, p.event_id, min(request_id) AS request_id FROM p JOIN q USING (session, tool, input) LEFT JOIN d USING (session, tool, input, k) WHERE p.event_id > request_id AND (done IS NULL OR p.event_id < done) GROUP BY ALL HAVING count(*) = 1""")
def permission_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures as permission events: each belongs to the one request of its tool and input that is open."""
    obs = observations(spark, sf_dir)
    calls = ["session", "tool", "k"]
    done = obs.where("role = 'ToolSuccess'").groupBy(*calls).agg(F.min("event_id").alias("closed"))
    key = F.concat_ws("|", "tool", (F.col("k") % 10).cast("string")).alias("key")
    asked = obs.where("role = 'ToolRequest'").join(done, calls, "left").select("session", key, F.col("event_id").alias("opened"), "closed", F.col("event_id").alias("request_id"))
    # a call that was done before it was asked isn't open at all
    asked = asked.where("closed IS NULL OR closed > opened")
    probes = obs.where("role = 'ToolFailure'").select("session", key, F.lit(0).alias("level"), F.col("event_id").alias("at"), F.col("event_id").alias("probe_id"))
    return open_calls.sole_open(asked, probes, ["session"]).select("session", F.col("probe_id").alias("event_id"), "request_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, one AS (SELECT DISTINCT event_id AS row_id, event_id - 1 AS hook_id FROM obs WHERE k % 3 = 0), two AS (SELECT event_id AS row_id, k AS hook_id FROM obs WHERE k % 2 = 0), three AS (SELECT event_id AS row_id, session AS hook_id FROM obs)
    SELECT row_id, coalesce(one.hook_id, two.hook_id, three.hook_id) AS hook_id, CASE WHEN one.hook_id IS NOT NULL THEN 'call' WHEN two.hook_id IS NOT NULL THEN 'pending' ELSE 'agent' END AS tier FROM three LEFT JOIN one USING (row_id) LEFT JOIN two USING (row_id)""")
def binding_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript row's hook by call id, else by a pending node, else by its sub-agent."""
    obs = observations(spark, sf_dir).withColumnRenamed("event_id", "row_id")
    pick = lambda hook: ["row_id", hook.cast("long").alias("hook_id")]
    return matching.priority_bind(("call", obs.where("k % 3 = 0").select(*pick(F.col("row_id") - 1))), ("pending", obs.where("k % 2 = 0").select(*pick(F.col("k")))), ("agent", obs.select(*pick(F.col("session")))), left_id="row_id", right_id="hook_id")


@query(f"""
    WITH {OBSERVATIONS_SQL}, a AS (SELECT session, event_id AS start_id, k % 4 AS agent FROM obs WHERE role = 'ToolRequest'), b AS (SELECT session, k % 4 AS agent, arg_max(role, event_id) AS outcome, max(event_id) AS stop_id FROM obs WHERE role IN ('ToolSuccess', 'ToolFailure') GROUP BY ALL)
    SELECT session, agent, start_id, stop_id, outcome FROM a LEFT JOIN b USING (session, agent)""")
def subagent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumns({"agent": F.col("k") % 4, "stop_id": F.col("event_id"), "outcome": F.col("role")})
    stops = pairing.last_result(obs.where(F.col("role").isin("ToolSuccess", "ToolFailure")), ["session", "agent"], "stop_id", "outcome")
    return pairing.pair_by_id(obs.where("role = 'ToolRequest'").select("session", "agent", F.col("event_id").alias("start_id")), stops, ["session", "agent"]).select("session", "agent", "start_id", "stop_id", "outcome")


@query("""
    WITH c AS (SELECT a.l_orderkey AS o, a.l_linenumber AS a, b.l_linenumber AS b, CASE WHEN a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus THEN 100 ELSE 0 END AS s, a.l_partkey % 3 <> b.l_partkey % 3 AS clash
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber), g AS (SELECT * FROM c WHERE NOT clash),
    m AS (SELECT *, max(s) OVER (PARTITION BY o, a) AS best FROM g), t AS (SELECT o, a, min(b) AS b, min(s) AS score, min(best) AS best FROM m WHERE s = best GROUP BY o, a HAVING count(*) = 1)
    SELECT o AS l_orderkey, a, b, score FROM t WHERE best > 0 OR (o, a) IN (SELECT (o, a) FROM g GROUP BY o, a HAVING count(*) = 1)""")
def best_or_sole_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as file accesses and their possible owners: the best by evidence, else the only one that nothing rules out."""
    side = lambda p, n: table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias(n), *[F.col(c).alias(f"{p}_{c[2:]}") for c in ("l_returnflag", "l_linestatus")], (F.col("l_partkey") % 3).alias(f"{p}_part"))
    pairs = side("x", "a").join(side("y", "b"), "l_orderkey").where("a < b")
    same = (F.col("x_returnflag") == F.col("y_returnflag")) & (F.col("x_linestatus") == F.col("y_linestatus"))
    scored = pairs.withColumn("score", F.when(F.col("x_part") == F.col("y_part"), F.when(same, 100).otherwise(0)))
    return matching.best_or_sole(scored, ["l_orderkey", "a"], "score").select("l_orderkey", "a", "b", "score")


_KIND = """CASE WHEN k % 13 = 5 THEN 'merge' WHEN role = 'PromptSubmitted' THEN 'user' WHEN role = 'ToolRequest' THEN 'request' WHEN role = 'ToolSuccess' THEN 'result'
    WHEN role = 'ToolFailure' THEN CASE WHEN k % 2 = 0 THEN 'start' ELSE 'end' END WHEN k % 9 < 3 THEN 'agent' ELSE 'message' END"""
_IDS = "CASE WHEN k % 11 < 4 THEN 'a' || (k % 3) END AS agent, CASE WHEN k % 5 < 2 THEN 'c' || (k % 7) END AS call, CASE WHEN k % 6 = 0 THEN 'i' || (k % 4) END AS talk, CASE WHEN k % 4 > 1 OR k % 13 = 5 THEN 'n' || (k % 6) END AS own"
_HERE = "coalesce(active[coalesce(agent, '')], last_user[coalesce(agent, '')])"
_MAKES = "kind IN ('start', 'end', 'request')"
_WHO = "coalesce(agent, '')"
_PUT = "map_concat({m}, MAP {{{k}: {v}}})"
_SWAP = "map_from_entries(list_transform(map_entries({m}), lambda e: {{'key': e.key, 'value': CASE WHEN e.value = picked THEN own ELSE e.value END}}))"
_LADDER = f"""CASE WHEN kind = 'user' THEN CASE WHEN talk IS NOT NULL THEN coalesce(talks[talk], 'interaction:' || talk) WHEN own IS NOT NULL AND NOT list_contains(turns, own) THEN own ELSE 'user:' || event_id END
    WHEN agents[agent] IS NOT NULL THEN agents[agent] WHEN calls[call] IS NOT NULL THEN calls[call] WHEN talks[talk] IS NOT NULL THEN talks[talk]
    WHEN talk IS NOT NULL AND {_MAKES} THEN 'interaction:' || talk WHEN {_HERE} IS NOT NULL OR talk IS NOT NULL THEN {_HERE}
    WHEN own IS NOT NULL AND ({_MAKES} OR list_contains(turns, own)) THEN own WHEN {_MAKES} THEN kind || ':' || made END"""


def _state(name: str, value: str) -> str:
    """A map's state after a row: merged as the row says, else as given."""
    return f"CASE WHEN merges THEN {_SWAP.format(m=name)} ELSE {value} END"


@query(f"""
    WITH RECURSIVE {OBSERVATIONS_SQL}, r AS (SELECT session, event_id, {_KIND} AS kind, {_IDS}, row_number() OVER ({_W}) AS n FROM obs),
    s AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS made, CAST([] AS VARCHAR[]) AS turns, {", ".join(f"CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS {m}" for m in ("agents", "calls", "talks", "active", "last_user"))},
            CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS resolved, CAST(NULL AS VARCHAR) AS target FROM (SELECT DISTINCT session FROM r)
        UNION ALL SELECT session, n, made + CASE WHEN fresh THEN 1 ELSE 0 END + CASE WHEN merges AND NOT list_contains(turns, own) THEN 1 ELSE 0 END,
            CASE WHEN merges THEN list_append(list_filter(turns, lambda x: x <> picked AND x <> own), own) WHEN fresh THEN list_append(turns, picked) ELSE turns END,
            {_state("agents", f"CASE WHEN kind = 'agent' AND agent IS NOT NULL AND picked IS NOT NULL THEN {_PUT.format(m='agents', k='agent', v='picked')} ELSE agents END")},
            {_state("calls", f"CASE WHEN kind IN ('request', 'result') AND call IS NOT NULL AND picked IS NOT NULL THEN {_PUT.format(m='calls', k='call', v='picked')} ELSE calls END")},
            {_state("talks", f"CASE WHEN talks_it AND picked IS NOT NULL THEN {_PUT.format(m='talks', k='talk', v='picked')} ELSE talks END").replace("map_entries(talks)", f"map_entries(CASE WHEN talks_it THEN {_PUT.format(m='talks', k='talk', v='picked')} ELSE talks END)")},
            {_state("active", f"CASE WHEN kind = 'start' THEN {_PUT.format(m='active', k=_WHO, v='picked')} WHEN kind = 'end' AND active[coalesce(agent, '')] = picked THEN map_from_entries(list_filter(map_entries(active), lambda e: e.key <> coalesce(agent, ''))) ELSE active END")},
            {_state("last_user", f"CASE WHEN kind = 'user' THEN {_PUT.format(m='last_user', k=_WHO, v='picked')} ELSE last_user END")},
            event_id, picked, CASE WHEN merges THEN own END
        FROM (SELECT *, picked IS NOT NULL AND NOT list_contains(turns, picked) AS fresh, kind = 'merge' AND own IS NOT NULL AND picked IS NOT NULL AND picked <> own AS merges,
                talk IS NOT NULL AND talks[talk] IS NULL AND NOT (kind <> 'user' AND (agents[agent] IS NOT NULL OR calls[call] IS NOT NULL)) AS talks_it
            FROM (SELECT *, {_LADDER} AS picked FROM (SELECT s.made, s.turns, s.agents, s.calls, s.talks, s.active, s.last_user, r.* FROM s JOIN r ON r.session = s.session AND r.n = s.n + 1)))),
    m AS (SELECT session, n, resolved AS source, target FROM s WHERE target IS NOT NULL),
    f AS (SELECT session, event_id, resolved, resolved AS turn_id, n, 0 AS step FROM s WHERE event_id IS NOT NULL
        UNION ALL SELECT session, event_id, resolved, target, n, step FROM (SELECT f.session, f.event_id, f.resolved, m.target, m.n, f.step + 1 AS step, row_number() OVER (PARTITION BY f.session, f.event_id ORDER BY m.n) AS first
            FROM f JOIN m ON m.session = f.session AND m.source = f.turn_id AND m.n >= f.n + least(f.step, 1)) WHERE first = 1)
    SELECT session, event_id, resolved, arg_max(turn_id, step) FILTER (turn_id IS NOT NULL) AS turn_id FROM f GROUP BY session, event_id, resolved""")
def resolved_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, agents, calls, interactions and turns' own ids among a session's events, some of which tell that two turns are one."""
    obs = observations(spark, sf_dir)
    k, role = F.col("k"), F.col("role")
    told = lambda when, letter, of: F.when(when, F.concat(F.lit(letter), (k % of).cast("string")))
    kind = F.when(k % 13 == 5, "merge").when(role == "PromptSubmitted", "user").when(role == "ToolRequest", "request").when(role == "ToolSuccess", "result")
    kind = kind.when(role == "ToolFailure", F.when(k % 2 == 0, "start").otherwise("end")).when(k % 9 < 3, "agent").otherwise("message")
    rows = obs.withColumns({"kind": kind, "agent": told(k % 11 < 4, "a", 3), "call": told(k % 5 < 2, "c", 7), "talk": told(k % 6 == 0, "i", 4), "own": told((k % 4 > 1) | (k % 13 == 5), "n", 6)})
    return turns.ladder_turns(rows, ["session"], ORDER, "event_id", "kind", "agent", "call", "talk", "own")


@query(f"""
    WITH {OBSERVATIONS_SQL}, t AS (SELECT session, event_id AS turn_id, ts FROM obs WHERE role = 'PromptSubmitted'), p AS (SELECT session, event_id, ts, CASE WHEN k % 4 = 0 THEN event_id - 1 END AS own FROM obs WHERE role = 'ToolFailure'),
    j AS (SELECT p.*, t.turn_id AS latest FROM p ASOF LEFT JOIN t ON p.session = t.session AND p.ts >= t.ts)
    SELECT session, event_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.session = j.session AND t.turn_id = j.own) THEN own ELSE latest END AS before_turn FROM j""")
def system_prompt_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures as system prompts, some of which tell their turn."""
    obs = observations(spark, sf_dir)
    prompts = obs.where("role = 'ToolFailure'").select("session", "event_id", "ts", F.when(F.col("k") % 4 == 0, F.col("event_id") - 1).alias("turn_id"))
    begun = obs.where("role = 'PromptSubmitted'").select("session", F.col("event_id").alias("turn_id"), F.col("ts").alias("began"))
    return turns.place_system_prompts(prompts, begun, ["session"], "turn_id", "ts", "began").select("session", "event_id", "before_turn")


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN 2 ELSE 1 END, ts, event_id % 3, event_id) AS position FROM obs""")
def display_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("ordinal", F.col("event_id") % 3)
    return turns.display_order(obs, ["session"], "ts", "ordinal", "event_id", F.col("k") == 1, F.col("k") == 2).select("session", "event_id", "position")


@query(f"""
    WITH {OBSERVATIONS_SQL}, b AS (SELECT session, k % 6 AS turn, min(ts) AS a, max(ts) AS z FROM obs GROUP BY ALL)
    SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY a, turn) AS number, (epoch_us(z) - epoch_us(a)) / 1000.0 AS wall_ms FROM b""")
def turn_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = turns.turn_bounds(observations(spark, sf_dir).withColumn("turn", F.col("k") % 6), ["session", "turn"], "ts")
    return turns.number_turns(bounds, ["session"], ["started", "turn"]).select("session", "turn", "number", "wall_ms")


@query(f"""
    WITH {OBSERVATIONS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY duration_ms DESC, event_id) AS n FROM obs)
    SELECT session, string_agg(event_id, ',' ORDER BY n) AS top FROM n WHERE n <= 16 GROUP BY session""")
def top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = catalog.strongest(observations(spark, sf_dir), ["session"], [F.col("duration_ms").desc(), F.col("event_id")], ["event_id"], 16)
    return got.select("session", F.array_join(F.transform("top", lambda t: t["event_id"].cast("string")), ",").alias("top"))


@query("""
    SELECT conv_id, turn, true AS visible, NOT (turn % 3 = 0 AND role = 'system') AS summarised FROM conversations WHERE role <> 'user' AND NOT (role = 'system' AND turn % 2 = 0)
    UNION ALL SELECT conv_id, turn, false, NOT (turn % 3 = 0 AND role = 'system') FROM conversations WHERE role = 'user' OR (role = 'system' AND turn % 2 = 0)""")
def event_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' rows are prompts, system rows bare records (odd ones with a status); every third is left out of summaries unless it is a tool's."""
    role = F.when(F.col("role") == "user", "PromptSubmitted").when(F.col("role") == "system", "Generic").otherwise("ToolRequest")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), F.lit("ProviderSpecific").alias("kind"), F.lit(" ").alias("text"), F.lit(None).cast("string").alias("tool"), F.when(F.col("turn") % 2 == 1, "done").alias("status"), F.lit(None).cast("string").alias("skill"), ((F.col("turn") % 3 == 0) & (F.col("role") == "system")).alias("excluded"))
    seen = catalog.visible_events(rows).select("conv_id", "turn", F.lit(True).alias("visible"))
    counted = catalog.summarised_events(rows).select("conv_id", "turn", F.lit(True).alias("summarised"))
    out = rows.select("conv_id", "turn").join(seen, ["conv_id", "turn"], "left").join(counted, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.coalesce("visible", F.lit(False)).alias("visible"), F.coalesce("summarised", F.lit(False)).alias("summarised"))


@query("""
    SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS turns FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey) WHERE coalesce(n, 0) > 0 OR c_mktsegment = 'BUILDING'""")
def without_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("turns"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "Normal").otherwise("Unknown").alias("workspace_kind")).join(n, "c_custkey", "left")
    return catalog.without_shells(rows).select("c_custkey", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"))


@query(f"""
    WITH {OBSERVATIONS_SQL}, s AS (SELECT session, count(*) FILTER (role = 'ToolRequest') AS t, count(*) FILTER (role = 'ToolFailure') AS f FROM obs WHERE k % 9 > 0 GROUP BY session),
    c AS (SELECT session, k AS call, max(CASE WHEN role = 'ToolFailure' THEN 1 ELSE 0 END) AS g FROM obs WHERE role <> 'PromptSubmitted' GROUP BY ALL), b AS (SELECT DISTINCT session, k AS call FROM obs WHERE role = 'ToolSuccess'),
    u AS (SELECT session, count(*) AS u, CAST(sum(g) AS BIGINT) AS g FROM c ANTI JOIN b USING (session, call) GROUP BY session)
    SELECT session, coalesce(t, 0) + coalesce(u, 0) AS tools, coalesce(f, 0) + coalesce(g, 0) AS failures, coalesce(u, 0) AS unmatched FROM s FULL JOIN u USING (session)""")
def hook_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumns({"call_id": F.col("k"), "excluded": F.col("k") % 9 == 0})
    return summary.hook_summary(obs, obs.where("role = 'ToolSuccess'"), obs.where("role <> 'PromptSubmitted'"), ["session"])


@query(f"""
    WITH {OBSERVATIONS_SQL}, m AS (SELECT *, ['git/log', 'git-status', 'fetch', 'docs/find', 'git'][k % 5 + 1] AS name FROM obs)
    SELECT name, CASE WHEN count(*) FILTER (role = 'ToolRequest') > 0 THEN count(*) FILTER (role = 'ToolRequest') ELSE least(count(*) FILTER (role = 'ToolSuccess'), 1) END AS uses,
        round(sum(duration_ms) FILTER (role = 'ToolSuccess'), 2) AS duration_ms, round(100 * sum(duration_ms) FILTER (role = 'ToolSuccess') / sum(sum(duration_ms) FILTER (role = 'ToolSuccess')) OVER (), 2) AS share FROM m GROUP BY name""")
def mcp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("k") % 5 + 1).cast("int"))
    rows = observations(spark, sf_dir).withColumn("name", tools.mcp_key(pick("git", "git", None, "docs", "git"), pick(None, "git-status", "fetch", "find", None), pick("mcp__git__log", "x", "y", "z", None)))
    return summary.counted_durations(rows, [], "name", F.col("role") == "ToolRequest", F.col("role") == "ToolSuccess", "duration_ms")


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'Session' ELSE 'Turn' END AS scope, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'Cumulative' ELSE 'Unknown' END AS behavior FROM orders""")
def session_rescope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("Turn").alias("scope"), F.lit("Unknown").alias("behavior"), (F.col("o_custkey") % 3 == 0).alias("authoritative"), F.when(F.col("o_orderkey") % 2 == 0, "input_tokens").otherwise("output_tokens").alias("name"))
    family = tools.token_family(F.col("name"))
    return usage.session_rescope(rows, family["input"], family["cache_read"]).select("o_orderkey", "scope", "behavior")


@query(f"""
    WITH {OBSERVATIONS_SQL}
    SELECT session, event_id FROM (SELECT session, event_id, row_number() OVER (PARTITION BY session, event_id % 10 ORDER BY ts) AS n FROM obs) WHERE n = 1""")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one number in a session as one source's and another's: the first arrives."""
    obs = observations(spark, sf_dir).withColumn("number", F.col("event_id") % 10)
    return catalog.merge_events(obs, ["session"], "number", "ts").select("session", "event_id")


@query("""
    WITH a AS (SELECT source, lang, doc_id, CASE WHEN n_chars % 4 > 0 THEN sha256(text) END AS body, n_chars AS modified FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
    b AS (SELECT source || lang AS plan, arg_max(coalesce(body, ''), (body IS NOT NULL, modified, lpad(CAST(doc_id AS VARCHAR), 9, '0'))) AS body, arg_max(doc_id, (body IS NOT NULL, modified, lpad(CAST(doc_id AS VARCHAR), 9, '0'))) AS best, count(DISTINCT doc_id) AS alternates FROM a GROUP BY 1)
    SELECT plan, nullif(body, '') AS body, best, alternates FROM b""")
def merged_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    rows = docs.select(F.concat("source", "lang").alias("plan"), F.when(F.col("n_chars") % 4 > 0, F.sha2("text", 256)).alias("body"), F.col("n_chars").alias("modified"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"))
    got = plan_docs.merge_artifacts(rows, "plan", "body", "modified", "path")
    return got.select("plan", "body", F.col("path").cast("long").alias("best"), F.size("alternates").cast("long").alias("alternates"))


@query("""
    SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 50 END AS session FROM documents LEFT JOIN (SELECT doc_id % 50 AS s, max(quality) AS quality FROM labels WHERE toxic = 0 GROUP BY 1) ON s = doc_id % 50""")
def hidden_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("session"))
    seen = table(spark, sf_dir, "labels").where("toxic = 0 AND quality = 1").select((F.col("doc_id") % 50).alias("session"))
    return plan_docs.hide_sessions(plans, seen, "session")


@query("""
    WITH s AS (SELECT doc_id % 300 AS key, coalesce(source, '') || coalesce(lang, '') AS w FROM documents), n AS (SELECT key, count(DISTINCT w) AS candidates, min(w) AS w FROM s GROUP BY key)
    SELECT key, CASE WHEN candidates = 1 THEN w END AS workspace, candidates FROM n""")
def sole_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("key"), F.concat(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("workspace"))
    return placement.sole_workspace(rows, "key", "workspace")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Ambiguous' ELSE 'Single' END AS state, CASE WHEN c_nationkey % 3 = 0 THEN 90 ELSE 95 END AS score FROM customer")
def root_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("/r"), F.col("c_custkey").cast("string"))
    roots = F.when(F.col("c_nationkey") % 3 == 0, F.array(base, F.concat(base, F.lit("x")))).otherwise(F.array(F.concat(base, F.lit("/sub")), F.upper(base)))
    return placement.root_conflicts(table(spark, sf_dir, "customer").withColumn("roots", roots), "c_custkey", "roots")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') OR contains('assistant', 'the') UNION SELECT conv_id, turn FROM conversations WHERE contains(lower(role), 'the')")
def event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumns({"fields": F.create_map(F.lit("text"), F.col("text")), "payload": F.lit("")})
    return search.find(rows, "The", "role", "fields", "payload").select("conv_id", "turn")


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT event_id, role, ts IS NOT NULL AS has_clock, 'hook' AS origin FROM obs UNION ALL SELECT conv_id * 1000 + turn, role, false, 'transcript' FROM conversations""")
def merged_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks and transcript rows in one table; each kind's own columns are null in the other's rows."""
    hooks = observations(spark, sf_dir).select("event_id", "role", "ts", F.lit("hook").alias("origin"))
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "role", F.lit("transcript").alias("origin"))
    return captures.merge_replays(hooks, said).select("event_id", "role", F.col("ts").isNotNull().alias("has_clock"), "origin")


@query("""
    WITH f AS (SELECT source, lang, doc_id, CASE WHEN max(n_chars % 4) OVER w = 3 THEN 'Missed' WHEN max(CASE WHEN n_chars % 4 = 2 THEN 1 ELSE 0 END) OVER w = 1 THEN 'Backfilled' WHEN max(CASE WHEN n_chars % 4 = 1 THEN 1 ELSE 0 END) OVER w = 1 THEN 'Live' ELSE 'Other' END AS coverage
        FROM documents WINDOW w AS (PARTITION BY source, lang))
    SELECT source, lang, min(coverage) AS coverage, count(DISTINCT doc_id) AS files FROM f GROUP BY source, lang""")
def capture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.element_at(F.array(*map(F.lit, ("Other", "Live", "Backfilled", "Missed"))), (F.col("n_chars") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("source", "lang", rank.alias("coverage"), F.array(F.col("doc_id").cast("string")).alias("files"))
    return catalog.merge_manifests(rows, ["source", "lang"]).select("source", "lang", "coverage", F.size("files").cast("long").alias("files"))


@query(f"""
    WITH {OBSERVATIONS_SQL}, s AS (SELECT session, event_id, CASE WHEN k % 5 > 0 THEN k % 20 END AS step, role AS raw FROM obs)
    SELECT session, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session, step, raw ORDER BY event_id) AS n FROM s) WHERE n = 1 OR step IS NULL""")
def usage_once_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("step", F.when(F.col("k") % 5 > 0, F.col("k") % 20))
    return usage.once_per_step(obs, ["session"], "step", "role", "event_id").select("session", "event_id")


_MCP = (("x0", "y0", 20), ("x1", "y1", 40), ("x2", "y2", 30), ("x3", "y3", 20), ("x4", "y4", 100))


@query(f"""
    WITH l AS (SELECT *, l_returnflag AS x0, l_linestatus AS x1, l_partkey % 2 AS x2, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 2 END AS x3, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 5 END AS x4 FROM lineitem),
    n AS (SELECT *, {", ".join(f"lead(x{i}) OVER w AS y{i}" for i in range(5))}, lead(1) OVER w AS more FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT l_orderkey, l_linenumber, CASE WHEN x0 = y0 AND x1 = y1 AND x2 = y2 THEN 125 END AS shell,
        CASE WHEN NOT ({" OR ".join(f"coalesce({a} <> {b}, false)" for a, b, _ in _MCP)}) THEN {" + ".join(f"CASE WHEN {a} = {b} THEN {n} ELSE 0 END" for a, b, n in _MCP)} END AS mcp,
        CASE WHEN x0 = y0 THEN 100 END AS file FROM n WHERE more = 1""")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a line's fields are worth against the next line's, as evidence of a shell call, an MCP call and a file access; a clash of any field rules out."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    part, command, given = (F.col("l_partkey") % 2), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 2), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 5)
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kinds = {
        "shell": (matching.SHELL, {"command": flag, "cwd": status, "sandbox": part}),
        "mcp": (matching.MCP, {"tool": flag, "server": status, "url": part, "command": command, "input": given}),
        "file": (matching.FILE, {"path": flag}),
    }
    rows = table(spark, sf_dir, "lineitem").withColumn("more", F.lead(F.lit(1)).over(w))
    rows = rows.withColumns({f"{side}_{kind}_{n}": c if side == "l" else F.lead(c).over(w) for kind, (_, own) in kinds.items() for n, c in own.items() for side in "lr"})
    return rows.where("more = 1").select("l_orderkey", "l_linenumber", *[matching.field_score(worth, f"l_{kind}_", f"r_{kind}_").alias(kind) for kind, (worth, _) in kinds.items()])


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what there is now and gives the table that it wrote."""
    at = shared_dir(stream.sparkSession)
    run = stream.writeStream.format("parquet").queryName(name).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


@query(f"""
    WITH RECURSIVE {OBSERVATIONS_SQL}, r AS (SELECT session, event_id, tool, role, role = 'PromptSubmitted' AS asks, k, row_number() OVER (PARTITION BY session ORDER BY epoch_us(ts) // 1000, role = 'ToolFailure', CAST(event_id AS VARCHAR)) AS n FROM obs),
    s AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS turn, false AS inside, CAST([] AS STRUCT(i BIGINT, t VARCHAR)[]) AS held, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS turn_no, CAST(NULL AS BIGINT) AS request_id FROM (SELECT DISTINCT session FROM r)
        UNION ALL SELECT session, n, turn, inside AND role <> 'ToolFailure', CASE role WHEN 'ToolRequest' THEN list_append(held, {{'i': event_id, 't': tool}}) WHEN 'ToolFailure' THEN [] WHEN 'ToolSuccess' THEN list_filter(held, lambda x: pick IS NULL OR x.i <> pick) ELSE held END,
            event_id, CASE WHEN inside THEN turn END, CASE WHEN role = 'ToolSuccess' THEN pick END
        FROM (SELECT r.session, r.n, s.turn + CASE WHEN asks THEN 1 ELSE 0 END AS turn, s.inside OR asks AS inside, held, r.event_id, r.role, r.tool, list_filter(held, lambda x: x.t = r.tool)[1].i AS pick FROM s JOIN r ON r.session = s.session AND r.n = s.n + 1))
    SELECT session, event_id, 'derived-' || turn_no AS turn_id, request_id FROM s WHERE event_id IS NOT NULL""")
def streamed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events landed and read as a stream, with a session's state: turns, open requests, stops (here failures) that forget them."""
    at = shared_dir(spark)
    role = F.when(F.col("role") == "ToolFailure", "TurnStop").otherwise(F.col("role"))
    observations(spark, sf_dir).select(F.col("session").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", role.alias("role"), "tool", F.lit(None).cast("string").alias("server")).write.parquet(at)
    stored = spark.read.parquet(at)
    steps = drained(observe.session_steps(spark.readStream.schema(stored.schema).parquet(at), open_for=None), "steps")
    return steps.select(F.col("session").cast("long").alias("session"), F.col("event_id").cast("long").alias("event_id"), "turn_id", F.col("request_id").cast("long").alias("request_id"))


@query(f"""
    WITH {OBSERVATIONS_SQL}, o AS (SELECT session, k, event_id, ts, CASE WHEN role = 'ToolRequest' THEN 'hook' ELSE 'transcript' END AS origin FROM obs),
    n AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN origin = 'hook' THEN 1 ELSE 0 END) OVER (PARTITION BY session, k ORDER BY ts, CAST(event_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hooked FROM o WINDOW w AS (PARTITION BY session, k ORDER BY ts, CAST(event_id AS VARCHAR)))
    SELECT session, k, event_id, CASE WHEN n = 1 THEN 'Added' WHEN origin = 'hook' AND hooked = 0 THEN 'PromotePrimary' ELSE 'Merged' END AS change_kind FROM n""")
def streamed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one key as rows of one call: requests are hooks, the rest transcript rows."""
    at = shared_dir(spark)
    rows = observations(spark, sf_dir).select(F.col("session").cast("string").alias("session"), F.col("k").cast("string").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("role") == "ToolRequest", "hook").otherwise("transcript").alias("origin"))
    rows.write.parquet(at)
    made = drained(observe.change_kinds(spark.readStream.schema(rows.schema).parquet(at)), "changes")
    return made.select(F.col("session").cast("long").alias("session"), F.col("call_id").cast("long").alias("k"), F.col("event_id").cast("long").alias("event_id"), "change_kind")


@query("""SELECT conv_id, turn, sha256(text) AS h FROM conversations""")
def streamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as growing files, landed in segments that are cut inside of lines, tailed as a stream."""
    at = shared_dir(spark)
    line = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.sha2("text", 256))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    body = F.concat("body", F.lit("\nnot ended"))
    cuts = F.explode(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / 50).cast("int")))
    parts = files.withColumn("body", body).select(F.col("conv_id").cast("string").alias("path"), F.lit(0).cast("long").alias("generation"), "body", cuts.alias("i"))
    parts.select("path", "generation", (F.col("i") * 50).cast("long").alias("offset"), F.col("body").substr(F.col("i") * 50 + 1, F.lit(50)).alias("chunk")).write.parquet(at)
    stored = spark.read.parquet(at)
    lines = drained(observe.tail_lines(spark.readStream.schema(stored.schema).parquet(at)), "lines")
    said = F.split("raw", " ")
    return lines.select(said[0].cast("long").alias("conv_id"), said[1].cast("long").alias("turn"), said[2].alias("h"))
