"""Queries over records and stores: detail rows, hard YAML, figures of hooks, contexts, incremental results, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import details
from turnstone.operators import catalog, pairing, plan_docs, search, summary
from turnstone.plans.adapters import OBSERVATIONS_SQL, observations, table
from turnstone.plans.join_queries import ORDER, drained
from turnstone.plans.registry import query
from turnstone.plans.source_queries import EVENTS, by_shape, shaped
from turnstone.sources import captures, incremental, sessions
from turnstone.sources.staging import shared_dir
from turnstone.streaming import observe

#: A payload for each kind of field, and what an event with it shows.
_DETAILS = (
    ('{"b":{k},"a":"x\\\\\\\\y"}', [("Scalar", "b"), ("Scalar", "no"), ("Scalar", "a")], "'b=' || k || ';a=x' || chr(92) || 'y'"),
    ('{"second":[1.50,null],"first":null,"duration":{k}.0}', [("ScalarPreferred", "zero", "second", "first"), ("ScalarPreferred", "no")], "'duration=' || k || '.0;second=[1.50,null]'"),
    ('{"o":{"z":true,"a":{"k":{k}}},"p":1}', [("ObjectMembers", "o"), ("ObjectMembers", "p")], "'z=true;a={\"k\":' || k || '}'"),
    ('{"s":"{\\"n\\":{k},\\"t\\":\\"u\\"}","o":{"m":"v"},"t":"no {json","n":7}', [("JsonStringMembers", "s"), ("JsonStringMembers", "o"), ("JsonStringMembers", "t"), ("JsonStringMembers", "n")], "'s.n=' || k || ';s.t=u;o.m=v;t=no {json;n=7'"),
    ('{"l":[{"a":1,"b":{"c":{k}}},"x"],"e":[],"q":3}', [("ArrayMembers", "l"), ("ArrayMembers", "e"), ("ArrayMembers", "q")], "'l[0].a=1;l[0].b={\"c\":' || k || '};l[1]=x;e=(none)'"),
    ('{"l":[{"a":1,"b":{"c":{"d":{k}}}},[2]],"e":[]}', [("FlattenedArrayMembers", "l"), ("FlattenedArrayMembers", "e")], "'l[0].a=1;l[0].b.c.d=' || k || ';l[1]=[2];e=(none)'"),
    ('{"duration_ms":5,"a":{k},"b":"v","duration":9}', [("Scalar", "b"), ("AllTopLevel",)], "'duration_ms=5;b=v;a=' || k"),
    ('{"trigger":"auto","context_usage_percent":81.256,"context_window_size":200500,"message_count":{k},"z":1}', [("PreCompactSummary",)], "'trigger=auto;context usage percent=81.26%;window size=200.5k;messages count/to compact=' || k || '/?'"),
    ('["no object"]', [("AllTopLevel",)], "''"),
)


@query(f"WITH {EVENTS} SELECT event_id, {by_shape(*[d[2] for d in _DETAILS])} || CASE WHEN user_id % 2 = 0 THEN CASE event_id % 9 WHEN 8 THEN 'model=m' ELSE ';model=m' END ELSE '' END AS fields FROM e WHERE event_id % 9 <> 8 OR user_id % 2 = 0")
def detail_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of all kinds of fields; rows of even users tell a model besides, and all a field that is there already."""
    rows = shaped(spark, sf_dir, *[d[0] for d in _DETAILS]).withColumn("event", F.concat(F.lit("e"), (F.col("event_id") % len(_DETAILS)).cast("string")))
    specs = details.spec_table(spark, {f"e{i}": d[1] for i, d in enumerate(_DETAILS)})
    model = F.when(F.col("user_id") % 2 == 0, "m").otherwise(" ")
    there = F.when(F.col("event") == "e0", "again")
    got = details.detail_rows(rows, "event_id", "event", "doc", specs, [("model", model), ("B", there)])
    field = F.struct("pos", F.concat_ws("=", "name", "value").alias("f"))
    return got.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(field)), lambda x: x["f"]), ";").alias("fields"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'id-' || k", "'x' || k", "'folded ' || k || ' text'", "'q'", "NULL")} AS id, {by_shape("'/w' || chr(10) || 'd' || chr(10)", "'/f'", "'/p q'", "'/t' || chr(9)", "'/c'")} AS cwd, {by_shape("'a: b'", "NULL", "NULL", "'it''s'", "NULL")} AS name,
    {by_shape("NULL", "'c'", "'deep'", "NULL", "NULL")} AS client, {by_shape("NULL", "NULL", "'v' || k", "NULL", "NULL")} AS nested FROM e""")
def hard_yamls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session YAML with texts in blocks, flow, maps in maps, escapes; the last isn't YAML and is read as far as it is flat."""
    rows = shaped(
        spark,
        sf_dir,
        "id: id-{k} # c\ncwd: |\n  /w\n  d\nname: \"a: b\"\n",
        "sessionId: 'x{k}'\ncwd: /f\ntags: [a, {b: c}]\nclientName: c\n",
        "session-id: >-\n  folded\n  {k} text\nworkingDirectory: /p\n  q\nclient_name: deep\nmore:\n  inner:\n    key: v{k}\n",
        "id: \"\\u0071\"\ncwd: \"/t\\t\"\ntitle: 'it''s'\n",
        "cwd: /c\nother: [open\n  id: no\n",
    )
    got = sessions.workspace_yaml(rows.select(F.col("event_id").cast("string").alias("path"), F.col("doc").alias("value")))
    return got.select(F.col("path").cast("long").alias("event_id"), "id", "cwd", "name", F.col("client_name").alias("client"), F.col("scalars")["more.inner.key"].alias("nested"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'Tidy ' || k", "'Two'", "'a: b'")} AS name, {by_shape("'all of it' || chr(10)", "NULL", "'long text'")} AS overview, {by_shape("'a=first thing,b=second'", "'x=one ' || k || ',=two'", "'n=in [brackets]'")} AS todos FROM e""")
def hard_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan documents whose front matter has blocks, flow and texts over several lines."""
    rows = shaped(
        spark,
        sf_dir,
        "---\nname: Tidy {k} # note\noverview: >\n  all\n  of it\ntodos:\n  - id: a\n    content: first\n      thing\n    status: done\n  - {id: b, content: second}\nmeta:\n  owner: {name: x}\n---\nbody",
        "---\nname: |-\n  Two\ntodos: [{id: x, content: 'one {k}'}, {content: two}, {id: none}]\n---\n",
        '---\nname: "a: b"\noverview: long\n  text\ntodos:\n- id: n\n  content: "in [brackets]"\n---\n',
    ).withColumn("p", plan_docs.front_matter(F.col("doc")))
    todo = F.transform("p.todos", lambda t: F.concat_ws("=", F.coalesce(t["id"], F.lit("")), t["content"]))
    return rows.select("event_id", "p.name", "p.overview", F.array_join(todo, ",").alias("todos"))


_NODES = """nodes AS (SELECT session, event_id, ts, CASE k % 14 WHEN 10 THEN 'InnerExecutionStart' WHEN 11 THEN 'InnerExecutionEnd' WHEN 12 THEN 'AgentThought'
        WHEN 13 THEN CASE role WHEN 'ToolRequest' THEN 'CompactionStart' WHEN 'ToolSuccess' THEN 'SubagentStart' WHEN 'ToolFailure' THEN 'TurnStop' ELSE 'SubagentStop' END ELSE role END AS role,
    CASE WHEN k % 6 < 2 THEN 'Mcp' WHEN k % 6 = 3 THEN 'FileRead' WHEN k % 6 = 4 THEN 'FileWrite' ELSE 'FileDelete' END AS kind, CASE k % 6 WHEN 0 THEN 'MCP:find' WHEN 1 THEN 'mcp__git__log' WHEN 2 THEN NULL ELSE 'tool' || (k % 3) END AS tool,
    CASE WHEN k % 4 = 1 THEN 'git' END AS server, CASE WHEN k % 8 = 1 THEN 'git-status' END AS mcp_tool, CASE k % 3 WHEN 0 THEN 'Mcp' WHEN 1 THEN 'Shell' ELSE 'FileRead' END AS inner_, duration_ms, path AS text, 'a' || (k % 5) AS agent,
    event_id % 5 = 0 AS excluded, event_id % 7 = 0 AS transcript, event_id % 2 = 0 AS secondary, k % 26 = 13 AS aborted, role = 'ToolFailure' AND k % 2 = 0 AS failed,
    CASE WHEN k % 9 > 0 THEN ['/p/' || (k % 12), '/P/' || (k % 12)] END AS paths, CASE WHEN k % 8 = 0 THEN ['S' || (k % 3), 's' || (k % 3)] END AS skills, CASE WHEN k % 8 = 3 THEN ['c' || (k % 2), ' '] END AS commands FROM obs)"""
_KEY = """CASE WHEN coalesce(server <> '', false) AND coalesce(m <> '', false) AND starts_with(m, server || '-') THEN m WHEN coalesce(server <> '', false) AND coalesce(m <> '', false) THEN server || '/' || m ELSE coalesce(m, server, 'MCP') END"""


@query(f"""
    WITH {OBSERVATIONS_SQL}, {_NODES}, x AS (SELECT *, coalesce(mcp_tool, CASE WHEN starts_with(tool, 'mcp__') THEN 'log' ELSE tool END) AS m, coalesce(starts_with(tool, 'MCP:'), false) AS prefixed, transcript AND NOT secondary AND role = 'ToolRequest' AS own FROM nodes),
    y AS (SELECT *, {_KEY} AS key, kind = 'Mcp' AND NOT prefixed AS native FROM x),
    c AS (SELECT session, ts, event_id, 'mcp' AS section, key AS name, false AS told FROM y WHERE own AND kind = 'Mcp' UNION ALL SELECT session, ts, event_id, 'tools', coalesce(tool, kind), false FROM y WHERE own AND kind <> 'Mcp'
        UNION ALL SELECT session, ts, event_id, 'mcp', key, false FROM y WHERE NOT excluded AND ((role = 'ToolRequest' AND native) OR (role = 'InnerExecutionStart' AND inner_ = 'Mcp'))
        UNION ALL SELECT session, ts, event_id, 'tools', tool, false FROM y WHERE NOT excluded AND role = 'ToolRequest' AND NOT native AND NOT prefixed AND tool IS NOT NULL
        UNION ALL SELECT session, ts, event_id, 'mcp', key, true FROM y WHERE NOT excluded AND ((role = 'ToolSuccess' AND native) OR (role = 'InnerExecutionEnd' AND inner_ = 'Mcp'))
        UNION ALL SELECT session, ts, event_id, 'tools', tool, true FROM y WHERE NOT excluded AND role = 'ToolSuccess' AND NOT native AND NOT prefixed AND tool IS NOT NULL),
    u AS (SELECT session, section, name, count(*) FILTER (NOT told) + CASE WHEN arg_min(told, (ts, event_id, told)) THEN 1 ELSE 0 END AS uses FROM c GROUP BY ALL),
    t AS (SELECT session, CAST(coalesce(sum(uses) FILTER (section = 'tools'), 0) AS BIGINT) AS tools, CAST(coalesce(sum(uses) FILTER (section = 'mcp'), 0) AS BIGINT) AS mcp FROM u GROUP BY session),
    f AS (SELECT *, CASE CASE WHEN NOT excluded AND role = 'ToolSuccess' AND NOT prefixed THEN kind WHEN NOT excluded AND role = 'FileAccess' THEN inner_ WHEN own AND kind <> 'Mcp' THEN kind END WHEN 'FileRead' THEN 'read' WHEN 'FileWrite' THEN 'written' WHEN 'FileDelete' THEN 'deleted' END AS l FROM y),
    w AS (SELECT session, ts, event_id, l, unnest(paths) AS v FROM f WHERE l IS NOT NULL UNION ALL SELECT session, ts, event_id, 'skills', unnest(skills) FROM y UNION ALL SELECT session, ts, event_id, 'slash_commands', unnest(commands) FROM y),
    o AS (SELECT session, l, upper(v) AS k, arg_min(v, (ts, event_id)) AS v FROM (SELECT * FROM w WHERE trim(v) <> '' AND NOT (v LIKE '/P/%' OR v LIKE 's%')) GROUP BY ALL),
    g AS (SELECT session, {", ".join(f"coalesce(string_agg(v, ',' ORDER BY k) FILTER (l = '{n}'), '') AS {n}" for n in ("skills", "slash_commands", "read", "written", "deleted"))} FROM o GROUP BY session),
    n AS (SELECT session, count(*) FILTER (NOT excluded AND role = 'InnerExecutionStart' AND inner_ = 'Shell') AS commands, count(*) FILTER (NOT excluded AND failed) AS failures, count(*) FILTER (NOT excluded AND role = 'AgentThought') AS thoughts,
        round(coalesce(sum(duration_ms) FILTER (NOT excluded AND role = 'AgentThought'), 0), 3) AS thought_ms, CAST(coalesce(sum(length(text)) FILTER (NOT excluded AND role = 'AgentThought'), 0) AS BIGINT) AS thought_chars,
        count(*) FILTER (NOT excluded AND role = 'CompactionStart') AS compactions, coalesce(bool_or(NOT excluded AND role = 'TurnStop' AND aborted), false) AS aborted,
        coalesce((epoch_us(max(ts) FILTER (NOT excluded)) - epoch_us(min(ts) FILTER (NOT excluded))) / 1000.0, 0) AS wall_ms, count(DISTINCT agent) FILTER (NOT excluded AND role IN ('SubagentStart', 'SubagentStop')) AS subagents FROM y GROUP BY session)
    SELECT n.*, coalesce(tools, 0) AS tools, coalesce(mcp, 0) AS mcp, {", ".join(f"coalesce({c}, '') AS {c}" for c in ("skills", "slash_commands", "read", "written", "deleted"))} FROM n LEFT JOIN t USING (session) LEFT JOIN g USING (session)""")
def hook_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a session's hooks; of two spellings of a path or skill in one row the first counts."""
    obs, k = observations(spark, sf_dir), F.col("k")
    other = F.when(F.col("role") == "ToolRequest", "CompactionStart").when(F.col("role") == "ToolSuccess", "SubagentStart").when(F.col("role") == "ToolFailure", "TurnStop").otherwise("SubagentStop")
    role = F.when(k % 14 == 10, "InnerExecutionStart").when(k % 14 == 11, "InnerExecutionEnd").when(k % 14 == 12, "AgentThought").when(k % 14 == 13, other).otherwise(F.col("role"))
    word = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    nodes = obs.select(
        "session", "event_id", "ts", role.alias("role"), "duration_ms", F.col("path").alias("text"), word("a", 5).alias("agent"),
        F.when(k % 6 < 2, "Mcp").when(k % 6 == 3, "FileRead").when(k % 6 == 4, "FileWrite").otherwise("FileDelete").alias("kind"),
        F.when(k % 6 == 0, "MCP:find").when(k % 6 == 1, "mcp__git__log").when(k % 6 > 2, word("tool", 3)).alias("tool"),
        F.when(k % 4 == 1, "git").alias("server"), F.when(k % 8 == 1, "git-status").alias("mcp_tool"),
        F.when(k % 3 == 0, "Mcp").when(k % 3 == 1, "Shell").otherwise("FileRead").alias("inner"),
        (F.col("event_id") % 5 == 0).alias("excluded"), (F.col("event_id") % 7 == 0).alias("transcript"), (F.col("event_id") % 2 == 0).alias("secondary"),
        (k % 26 == 13).alias("aborted"), ((F.col("role") == "ToolFailure") & (k % 2 == 0)).alias("failed"),
        F.when(k % 9 > 0, F.array(word("/p/", 12), word("/P/", 12))).alias("paths"), F.when(k % 8 == 0, F.array(word("S", 3), word("s", 3))).alias("skills"), F.when(k % 8 == 3, F.array(word("c", 2), F.lit(" "))).alias("slash_commands"),
    )
    lists = ("skills", "slash_commands", "read", "written", "deleted")
    got = summary.hook_figures(nodes, ["session"], ORDER)
    return got.withColumns({c: F.array_join(c, ",") for c in lists} | {"thought_ms": F.round("thought_ms", 3)})


@query(f"""
    WITH {OBSERVATIONS_SQL}, t AS (SELECT session, ts, event_id, CASE WHEN k % 3 = 0 THEN '/w' || (k % 2) END AS cwd, CASE WHEN k % 4 = 1 THEN 'b' || (k % 5) END AS branch FROM obs),
    c AS (SELECT session, ts, event_id, last_value(cwd IGNORE NULLS) OVER w AS cwd, last_value(branch IGNORE NULLS) OVER w AS branch FROM t WHERE cwd IS NOT NULL OR branch IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR cwd IS DISTINCT FROM lag(cwd) OVER w OR branch IS DISTINCT FROM lag(branch) OVER w THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
    i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session ORDER BY ts, event_id) AS BIGINT) AS number FROM m)
    SELECT session, number, any_value(cwd) AS cwd, any_value(branch) AS branch, count(*) AS rows, arg_min(event_id, (ts, event_id)) AS first_event_id, arg_max(event_id, (ts, event_id)) AS last_event_id FROM i GROUP BY session, number""")
def context_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that tell a folder, a branch, or both, as the contexts that a session went through."""
    k = F.col("k")
    obs = observations(spark, sf_dir).withColumns({"cwd": F.when(k % 3 == 0, F.concat(F.lit("/w"), (k % 2).cast("string"))), "branch": F.when(k % 4 == 1, F.concat(F.lit("b"), (k % 5).cast("string")))})
    return catalog.context_history(obs, ["session"], ORDER, ["cwd", "branch"]).drop("first_ts", "last_ts")


@query(f"""
    WITH {OBSERVATIONS_SQL}, t AS (SELECT session, ts, event_id, CASE WHEN k % 7 = 0 THEN 'm' || (k % 3) END AS model, CASE WHEN k % 11 = 0 THEN 'mode' || (k % 2) END AS mode FROM obs)
    SELECT session, arg_max(model, (ts, event_id)) FILTER (model IS NOT NULL) AS model, arg_max(mode, (ts, event_id)) FILTER (mode IS NOT NULL) AS mode FROM t GROUP BY session""")
def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    obs = observations(spark, sf_dir).withColumns({"model": F.when(k % 7 == 0, F.concat(F.lit("m"), (k % 3).cast("string"))), "mode": F.when(k % 11 == 0, F.concat(F.lit("mode"), (k % 2).cast("string")))})
    return catalog.last_known(obs, ["session"], ORDER, ["model", "mode"])


@query("""
    WITH l AS (SELECT l_orderkey % 500 AS s, CASE WHEN l_linenumber < 4 THEN l_orderkey // 3 END AS p, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, CASE WHEN l_quantity > 10 THEN 'b' || l_partkey || '-' || l_linenumber END AS body, l_discount > 0.05 AS ok FROM lineitem),
    o AS (SELECT s, min(p) AS p FROM l WHERE p IS NOT NULL GROUP BY s HAVING count(DISTINCT p) = 1), a AS (SELECT p, ord, body, ok FROM l WHERE p IS NOT NULL UNION ALL SELECT o.p, ord, body, ok FROM l JOIN o USING (s) WHERE l.p IS NULL)
    SELECT p, arg_max(body, ord) FILTER (body IS NOT NULL) AS body FROM a WHERE p % 4 > 0 GROUP BY p HAVING bool_or(ok)""")
def recovered_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of which no file is left, with what their sessions said of them without a path, if a session has one plan only."""
    line = F.col("l_linenumber")
    a = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("s"), F.when(line < 4, F.floor(F.col("l_orderkey") / 3)).alias("p"), ((F.col("l_orderkey") * 10 + line) * 1_000_000 + F.col("l_partkey")).alias("ord"), F.when(F.col("l_quantity") > 10, F.concat(F.lit("b"), F.col("l_partkey").cast("string"), F.lit("-"), line.cast("string"))).alias("body"), (F.col("l_discount") > 0.05).alias("ok"))
    files = a.where("p % 4 = 0").select("p")
    return plan_docs.recover_missing(a, files, "p", "ord", "body", F.col("ok"), session="s")


def _write_sources(rows: DataFrame, at: str, mode: str = "overwrite") -> None:
    rows.repartition(8, "b").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("b").json(at)


@query("""
    SELECT user_id AS session, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY user_id
    UNION ALL SELECT -1, (SELECT count(DISTINCT (user_id + event_id % 2) % 8) FROM events WHERE user_id IN (SELECT user_id FROM events WHERE (user_id + event_id % 2) % 8 IN (3, 5))), (SELECT count(DISTINCT (user_id + event_id % 2) % 8) + 1 FROM events WHERE (user_id + event_id % 2) % 8 <> 5)""")
def incremental_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two sources each; between two runs a source changes, one comes and one goes. One more row: how many sources each run read."""
    at, store = shared_dir(spark), shared_dir(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("user_id") + F.col("event_id") % 2) % 8).alias("b"))
    first = e.where("b <> 5 AND NOT (b = 3 AND event_id % 3 = 0)")
    _write_sources(first.unionByName(e.where("b = 0").withColumns({"b": F.lit(9), "user_id": -F.col("user_id") - 2})), at)
    rows = lambda paths: spark.read.schema("user_id long, event_id long").option("recursiveFileLookup", True).json(paths).withColumn("source", F.col("_metadata.file_path"))
    summed = lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
    _, every = incremental.refresh(spark, at, store, rows, summed, "user_id")
    _write_sources(e.where("b IN (3, 5)"), at)
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/b=9")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    result, some = incremental.refresh(spark, at, store, rows, summed, "user_id")
    told = spark.range(1).select(F.lit(-1).cast("long").alias("session"), F.lit(some).cast("long").alias("n"), F.lit(every).cast("long").alias("total"))
    return result.select(F.col("user_id").alias("session"), "n", "total").unionByName(told)


@query("""
    SELECT o_orderkey AS session, row_number() OVER (ORDER BY lower(o_orderpriority), o_orderdate DESC, lower(o_orderstatus), o_orderkey) AS position FROM orders""")
def catalog_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("workspace"), F.col("o_orderdate").alias("active"), F.col("o_orderstatus").alias("title"))
    return catalog.catalog_positions(o, shared_dir(spark)).select("session", "position")


@query("SELECT conv_id, turn, role FROM conversations WHERE contains(lower(role), 'st')")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_event(table(spark, sf_dir, "conversations"), "ST", "role").select("conv_id", "turn", "role")


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, role, 'k' || k AS tool_call_id, CASE WHEN k % 2 = 0 THEN CAST(session AS VARCHAR) END AS turn_id, 3 AS reconciler_version, true AS timed, 13 AS fields FROM obs""")
def binding_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions appended in two parts and read back: all thirteen fields are there, whatever the decisions tell."""
    at = shared_dir(spark)
    obs = observations(spark, sf_dir).select("event_id", "role", F.concat(F.lit("k"), F.col("k").cast("string")).alias("tool_call_id"), F.when(F.col("k") % 2 == 0, F.col("session")).alias("turn_id"), F.lit("x").alias("other"))
    captures.journal(obs.where("event_id % 2 = 0"), at)
    captures.journal(obs.where("event_id % 2 = 1").drop("other"), at)
    got = spark.read.parquet(at)
    return got.select("event_id", "role", "tool_call_id", "turn_id", "reconciler_version", F.col("recorded_at").isNotNull().alias("timed"), F.lit(len(got.columns)).alias("fields"))


@query(f"""
    WITH {OBSERVATIONS_SQL} SELECT r.session, r.event_id, arg_max(q.tool, (q.ts, q.event_id)) AS request_tool FROM obs r LEFT JOIN obs q ON q.session = r.session AND q.k = r.k AND q.role = 'ToolRequest' AND (q.ts, q.event_id) < (r.ts, r.event_id)
    WHERE r.role = 'ToolSuccess' GROUP BY ALL""")
def result_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results have their call's id only: the tool is that of the last request of the id before them."""
    obs = observations(spark, sf_dir)
    rows = pairing.earlier_request(obs, ["session", "k"], ORDER, F.col("role") == "ToolRequest", "event_id").where("role = 'ToolSuccess'").select("session", "event_id", "request_id")
    asked = obs.where("role = 'ToolRequest'").select(F.col("event_id").alias("request_id"), F.col("tool").alias("request_tool"))
    return pairing.pair_by_id(rows, asked, ["request_id"]).select("session", "event_id", "request_tool")


@query("""
    WITH m AS (SELECT 'w' || c_nationkey AS id, min('/n/' || c_custkey % 10) AS folder FROM customer GROUP BY ALL)
    SELECT s_suppkey AS session, folder FROM supplier LEFT JOIN m ON id = 'w' || s_nationkey * 2""")
def workspace_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sessions of a workspace id, customers as manifests of one; several have the same id."""
    files = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/storage/w"), F.col("c_nationkey").cast("string"), F.lit("/workspace.json")).alias("path"),
        F.concat(F.lit('{"folder":"file:///n/'), (F.col("c_custkey") % 10).cast("string"), F.lit('"}')).alias("value"),
    )
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session"), F.concat(F.lit("w"), (F.col("s_nationkey") * 2).cast("string")).alias("workspace_id"))
    return sessions.workspace_folders(rows, sessions.workspace_manifests(files)).select("session", "folder")


@query("SELECT event_id, count(*) AS n FROM events GROUP BY event_id")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice, live and as a replay, in one stream: each once."""
    at = shared_dir(spark)
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("dedupe_key"))
    e.unionByName(e).write.parquet(at)
    got = drained(observe.idempotent(spark.readStream.schema(e.schema).parquet(at)), "once")
    return got.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 0) >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM events),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM o), w AS (SELECT user_id, n, min(ts) AS a, max(ts) AS z, count(*) AS events FROM i GROUP BY ALL)
    SELECT user_id AS session, epoch_us(a) // 1000000 AS started, epoch_us(z) // 1000000 + 1800 AS ended, events FROM w WHERE epoch_us(z) + 1800000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""")
def streamed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of activity of a session as a stream closes them; those that may still go on aren't there yet."""
    at = shared_dir(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(at)
    got = drained(observe.activity_windows(spark.readStream.schema(e.schema).parquet(at)), "activity")
    return got.select("session", F.unix_seconds("started").alias("started"), F.unix_seconds("ended").alias("ended"), "events")


@query("SELECT user_id AS session, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def streamed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of two batches that stores its rows and summarises the sessions that each of them touched anew; the latest summary counts."""
    at, store, out = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"))
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(at)
    summarise = lambda d: d.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    write = lambda d, epoch: d.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)
    refresh = observe.refresh_touched(lambda: captures.stored(spark, store), summarise, write)

    def each(batch: DataFrame, epoch: int) -> None:
        captures.append_new(batch, store, "event_id", batch=f"epoch-{epoch}")
        refresh(batch, epoch)

    run = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(at).writeStream.foreachBatch(each).option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    made = spark.read.parquet(out)
    return made.groupBy("session").agg(F.max_by(F.struct("n", "last"), "epoch").alias("v")).select("session", "v.*")
