"""Queries over the providers' own rules: signatures, outcomes, attributions, figures, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import labels, outcomes, signatures, text
from turnstone.operators import catalog, intervals, plan_docs, summary, usage
from turnstone.plans.adapters import OBSERVATIONS_SQL, observations, table
from turnstone.plans.registry import query
from turnstone.plans.source_queries import EVENTS, by_shape, lines_of, parsed, shaped
from turnstone.sources import captures, envelopes, sessions, transcripts
from turnstone.sources.staging import shared_dir

#: Ways to tell calls (provider, kind, tool, payload), and what they agree on: identity and arguments.
_CALLS = (
    ("ClaudeCode", "Shell", "Bash", '{"tool_input":{"command":" ls /a ","n":1.50}}', "'Shell|'", r"""'{"command":"LS \\A","n":1.50}'"""),
    ("GitHubCopilot", "Shell", "bash ", '{"toolArgs":"{\\"n\\":1.50,\\"command\\":\\"LS \\\\\\\\a\\"}"}', "'Shell|BASH'", r"""'{"command":"LS \\A","n":1.50}'"""),
    ("GitHubCopilot", "FileRead", "view", '{"toolArgs":"no json/{k}"}', "'FileRead|VIEW'", r"""'NO JSON\' || k"""),
    ("Cursor", "Shell", "run", '{"arguments":{"command":"make {k}\\r\\n","x":2}}', "'Shell'", """'command="MAKE ' || k || '"'"""),
    ("Cursor", "TextSearch", "grep", '{"tool_input":{"glob_pattern":"*.py","path":"/r"},"pattern":" "}', "'FileSearch'", r"""'path="\\R"|glob="*.PY"'"""),
    ("Cursor", "TextSearch", "grep", '{"tool_input":{"glob_pattern":"*.py"},"pattern":"p{k}"}', "'TextSearch'", """'pattern="P' || k || '"|glob="*.PY"'"""),
    ("Cursor", "Mcp", "CallDynamicTool", '{"input":{"server":"user-Git","toolName":"log","arguments":"{\\"b\\":[{k}],\\"a\\":null}"}}', "'Mcp:GIT:LOG'", """'{"a":null,"b":[' || k || ']}'"""),
    ("Cursor", "Mcp", "MCP:Find", "{}", "'Mcp::FIND'", "'T'"),
    ("Cursor", "Web", "web", '{"search_term":"q{k}","url":"http://x"}', "'Web'", r"""'query="Q' || k || '"|url="HTTP:\\\\X"'"""),
    ("Cursor", "Task", "todo", "not json", "'Task'", "'T'"),
)


@query(f"""WITH {EVENTS} SELECT event_id, 's' || user_id || '|' || {by_shape(*[c[4] for c in _CALLS])} || '|' || sha256({by_shape(*[c[5] for c in _CALLS])}) AS signature FROM e""".replace("\\\\A", "\\\\A"))
def call_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's ways to tell a call; the first two shapes are one call but for the tool's name."""
    rows = shaped(spark, sf_dir, *[c[3] for c in _CALLS])
    of = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in _CALLS]), (F.col("event_id") % len(_CALLS) + 1).cast("int"))
    none = F.lit(None).cast("string")
    target = F.when(F.col("event_id") % len(_CALLS) >= 7, "t")
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return rows.select("event_id", signatures.call_signature(session, of(0), of(1), of(2), none, none, target, F.col("doc")).alias("signature"))


_RESULTS = (
    ('{"toolUseResult":{"success":true,"error":null}}', "success"),
    ('{"block":{"is_error":true}}', "failure"),
    ('{"toolUseResult":"ERROR: no {k}"}', "failure"),
    ('{"toolUseResult":"no error: {k}"}', "success"),
    ('{"toolUseResult":{"success":false}}', "failure"),
    ('{"toolUseResult":{"error":{"code":1}}}', "failure"),
    ('{"interrupted":true}', "interrupted"),
    ('{"toolUseResult":{"interrupted":true}}', "interrupted"),
    ('{"toolDenialKind":"user","interrupted":true}', "denied"),
    ('{"block":{"is_error":false},"toolDenialKind":" "}', "success"),
    ('{"block":{"interrupted":true}}', "interrupted"),
)


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape(*[repr(r[1]) for r in _RESULTS])} AS status, event_id % 11 NOT IN (0, 3, 9, 10) AS failed FROM e""")
def result_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = parsed()
    block = F.try_variant_get(row, "$.block", "variant")
    return shaped(spark, sf_dir, *[r[0] for r in _RESULTS]).select("event_id", outcomes.result_status(row, block).alias("status"), outcomes.result_failed(row, block).alias("failed"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'failure'", "'success'", "NULL", "'failure'", "NULL")} AS outcome, {by_shape("true", "false", "true", "false", "false")} AS claude, {by_shape("false", "false", "false", "true", "false")} AS copilot FROM e""")
def opaque_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of calls of the third provider, and blocks of thought that the first and the second can or can't read."""
    rows = shaped(spark, sf_dir, '{"s":"Rejected","thinking":" ","signature":"x"}', '{"s":"complete","text":"t","signature":"x"}', '{"s":"running","type":"redacted_thinking","content":"c"}', '{"s":"error","encryptedContent":"x"}', '{"reasoningText":"r","reasoningOpaque":"x"}')
    get = lambda n: F.try_variant_get(parsed(), f"$.{n}", "string")
    kind = F.when(get("signature").isNotNull() | (get("type") == "redacted_thinking"), get("type"))
    return rows.select("event_id", outcomes.status_outcome(get("s")).alias("outcome"), outcomes.is_opaque("ClaudeCode", kind, parsed()).alias("claude"), outcomes.is_opaque("GitHubCopilot", F.lit("reasoning"), parsed()).alias("copilot"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'git'", "'own'", "'row'", "NULL", "'a'")} AS server, {by_shape("'log__x'", "'find'", "'t' || k", "NULL", "''")} AS tool, {by_shape("NULL", "'deploy'", "'k' || k", "'attr'", "NULL")} AS skill FROM e""")
def call_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        '{"name":"mcp__git__log__x"}',
        '{"name":"mcp__git__find","block":{"attributionMcpServer":"own"},"attributionMcpServer":"row","use":"SKILL","input":{"skill":" ","skillName":" deploy "}}',
        '{"name":"mcp__git__log","attributionMcpServer":{"serverName":"row"},"message":{"attributionMcpTool":{"name":"t{k}"}},"use":"Skill","toolArgs":"{\\"skill_name\\":\\"k{k}\\"}"}',
        '{"name":"mcp__nothing","block":{"attributionSkill":"attr"},"use":"Read","input":{"skill":"no"}}',
        '{"name":"mcp__a__","use":"Skill","input":"no json"}',
    )
    part = lambda n: F.try_variant_get(parsed(), f"$.{n}", "variant")
    get = lambda n: F.try_variant_get(parsed(), f"$.{n}", "string")
    found = outcomes.mcp_identity(get("name"), part("block"), part("message"), parsed())
    skill = F.coalesce(outcomes.invoked_skill(get("use"), parsed()), outcomes.attributed("skill", part("block"), part("message"), parsed()))
    return rows.select("event_id", found["server"].alias("server"), found["tool"].alias("tool"), skill.alias("skill"))


_M = "SELECT event_id, {name} AS name, {value} AS value, {unit} AS unit, {scope} AS scope, '{behavior}' AS behavior FROM e WHERE event_id % 4 = {i}"


def _measure(i: int, *rows: tuple[str, str, str], scope: str = "'Request'", behavior: str = "Delta") -> str:
    return " UNION ALL ".join(_M.format(name=f"'{n}'", value=f"CAST({v} AS BIGINT)", unit=f"'{u}'", scope=scope, behavior=behavior, i=i) for n, v, u in rows)


@query(f"""WITH {EVENTS} {_measure(0, ("inputTokens", "k", "tokens"), ("durationMs", "2", "ms"), ("usage.a[1].output", "k", "tokens"), ("usage.other", "7", "provider units"), ("prompt", "9", "tokens"), ("completion", "9", "tokens"))}
    UNION ALL {_measure(1, ("totalNanoAiu", "5", "nano-AIU"), ("tokenDetails.input", "1", "tokens"), scope="'Turn'")} UNION ALL {_measure(2, ("outputTokens", "3", "tokens"), ("modelMetrics.m.requests.count", "k", "requests"), ("tokenDetails.cache_read", "4", "tokens"), scope="'Session'", behavior="Final")}""")
def usage_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of requests, of sub-agents and of a session's end; every fourth row has none."""
    rows = shaped(
        spark,
        sf_dir,
        '{"inputTokens":{k},"durationMs":2.0,"ttftMs":1.5,"usage":{"a":["x",{"output":{k}}],"other":7,"b":true},"responseChunk":{"copilot_usage":{"token_details":[{"token_type":"prompt","token_count":9},{"token_type":"completion","token_count":9},{"token_type":"prompt","token_count":9},{"token_count":1}]}}}',
        '{"totalNanoAiu":5,"token_details":{"input":1},"modelMetrics":{"m":{"x":1}}}',
        '{"outputTokens":3,"tokenDetails":{"cache_read":4},"modelMetrics":{"m":{"requests":{"count":{k}}}},"usage":{"x":1}}',
        "not json",
    )
    i = F.col("event_id") % 4
    native = F.when(i == 1, "subagent.completed").when(i == 2, "session.shutdown").otherwise("assistant.usage")
    return usage.measures(rows.withColumn("native", native), ["event_id"], "native", "doc", F.col("native") == "session.shutdown")


@query(f"""
    WITH RECURSIVE {OBSERVATIONS_SQL}, c AS (SELECT session, k % 3 AS t, ts, event_id, k % 2 = 0 AS scoped, count(*) FILTER (role = 'ToolFailure') OVER (PARTITION BY session ORDER BY ts, event_id) AS seg, role FROM obs),
    r AS (SELECT *, row_number() OVER (PARTITION BY session, t, seg ORDER BY ts, event_id) AS n FROM c WHERE role <> 'ToolFailure'),
    s AS (SELECT session, t, seg, n, event_id, ts AS at, scoped, false AS is_duplicate FROM r WHERE n = 1
        UNION ALL SELECT r.session, r.t, r.seg, r.n, r.event_id, CASE WHEN d THEN s.at ELSE r.ts END, CASE WHEN d THEN s.scoped ELSE r.scoped END, d
        FROM (SELECT r.session, r.t, r.seg, r.n, s.scoped <> r.scoped AND abs(epoch_us(r.ts) - epoch_us(s.at)) <= 86400000000 * 10 AS d FROM s JOIN r ON r.session = s.session AND r.t = s.t AND r.seg = s.seg AND r.n = s.n + 1) x
            JOIN r ON r.session = x.session AND r.t = x.t AND r.seg = x.seg AND r.n = x.n JOIN s ON s.session = x.session AND s.t = x.t AND s.seg = x.seg AND s.n = x.n - 1)
    SELECT session, t, event_id, is_duplicate FROM s""")
def duplicate_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a key as thoughts of one text, told for their step or their turn; a failure forgets all. Ten days stand for five seconds."""
    rows = observations(spark, sf_dir).withColumns({"t": F.col("k") % 3, "scoped": F.col("k") % 2 == 0})
    return intervals.duplicate_thoughts(rows, ["session", "t"], ["ts", "event_id"], "ts", "scoped", "event_id", 864_000, F.col("role") == "ToolFailure", ["session"]).select("session", "t", "event_id", "is_duplicate")


@query(f"""
    WITH {OBSERVATIONS_SQL}, c AS (SELECT session, k % 10 AS wave, ts, CASE WHEN k % 3 = 0 THEN ts + INTERVAL 1 MINUTE END AS ended, CASE WHEN k % 4 > 0 THEN duration_ms END AS ms, k % 7 > 0 OR k % 4 = 1 AS anchored FROM obs),
    e AS (SELECT *, coalesce(ended, make_timestamp(epoch_us(ts) + CAST(round(ms * 1000) AS BIGINT)), ts) AS z FROM c)
    SELECT session, wave, count(*) AS calls, epoch_us(min(ts) FILTER (anchored)) // 1000000 AS started, (epoch_us(max(z) FILTER (anchored)) - epoch_us(min(ts) FILTER (anchored))) / 1000.0 AS wall_ms, round(coalesce(sum(ms), 0), 3) AS summed_ms FROM e GROUP BY ALL""")
def wave_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    calls = observations(spark, sf_dir).select("session", (k % 10).alias("wave"), F.col("ts").cast("timestamp").alias("ts"), F.when(k % 3 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("ended"), F.when(k % 4 > 0, F.col("duration_ms")).alias("ms"), ((k % 7 > 0) | (k % 4 == 1)).alias("anchored"))
    got = intervals.wave_bounds(calls, ["session", "wave"], "ts", "ended", "ms", F.col("anchored"))
    return got.select("session", "wave", "calls", F.unix_seconds("started").alias("started"), "wall_ms", F.round("summed_ms", 3).alias("summed_ms"))


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS ts, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 5 SECOND END AS other, o_orderkey % 5 = 0 AS recovered, o_orderstatus FROM orders)
    SELECT o_custkey, arg_max(o_orderkey, (coalesce(epoch_us(coalesce(ts, other)), -9000000000000000), CASE WHEN recovered THEN 0 ELSE 1 END, o_orderkey)) AS o_orderkey FROM o GROUP BY o_custkey""")
def cost_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cost states: most with a time, some with a start and a duration, some with neither, some of a recovery copy."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(key % 3 > 0, date).alias("ts"), F.when(key % 2 == 0, date).alias("start"), F.lit(5000.0).alias("ms"))
    return catalog.latest_cost_state(rows, ["o_custkey"], "ts", "start", "ms", key % 5 == 0, ["o_orderkey"], "o_orderkey")


def _label_sql(n: str) -> str:
    """Thousands with two digits behind the point, halves up, in whole numbers."""
    h = f"(({n} + 5) // 10)"
    return f"CASE WHEN {n} >= 1000 THEN regexp_replace(CAST({h} // 100 AS BIGINT) || '.' || lpad(CAST(CAST({h} % 100 AS BIGINT) AS VARCHAR), 2, '0'), '\\.?0+$', '') || 'k' ELSE CAST({n} AS VARCHAR) END"


@query(f"""
    WITH {OBSERVATIONS_SQL}, f AS (SELECT session, CASE WHEN session % 3 > 0 THEN sum(k) END AS i, count(*) FILTER (role = 'ToolRequest' AND k % 2 = 0) AS o, sum(k) FILTER (k > 95) AS r, count(*) FILTER (role = 'ToolFailure' AND k < 8) AS ab, count(*) FILTER (role = 'ToolRequest') AS t FROM obs GROUP BY session),
    l AS (SELECT *, concat_ws(' · ', 'in ' || {_label_sql("i")}, CASE WHEN o > 0 THEN 'out ' || {_label_sql("o")} END, CASE WHEN r > 0 THEN 'cache r ' || {_label_sql("r")} END) AS line FROM f)
    SELECT session, line, concat_ws(';', 'Turns=' || session, CASE WHEN o > 0 THEN 'Thoughts=' || {_label_sql("o")} || ' ×' || o || ' · 1s 500ms' END, 'Tools=' || t, CASE WHEN line <> '' THEN 'Tokens=' || line END, CASE WHEN ab > 0 THEN 'Aborted=' || ab END) AS session_kpis,
        concat_ws(';', 'Tools=' || t, CASE WHEN line <> '' THEN 'Tokens=' || line END, CASE WHEN ab > 0 THEN 'Status=aborted' END) AS turn_kpis FROM l""")
def kpi_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, role, none = F.col("k"), F.col("role"), F.lit(0).cast("long")
    f = observations(spark, sf_dir).groupBy("session").agg(
        F.sum("k").alias("i"), F.count_if((role == "ToolRequest") & (k % 2 == 0)).alias("o"), F.coalesce(F.sum(F.when(k > 95, k)), none).alias("r"), F.count_if((role == "ToolFailure") & (k < 8)).alias("ab"), F.count_if(role == "ToolRequest").alias("t")
    )
    line = summary.token_line(F.when(F.col("session") % 3 > 0, F.col("i")), F.col("o"), F.col("r"), none, none)
    f = f.withColumn("line", line)
    figures = {"turns": F.col("session"), "aborted": F.col("ab"), "wall_ms": none, "thoughts": F.col("o"), "thought_ms": F.lit(1500.0), "thought_chars": F.col("o"), "mcp": none, "tools": F.col("t"), "reads": none, "writes": none, "deletes": none, "tokens": F.col("line")}
    shown = lambda figures, whole: F.array_join(F.transform(summary.kpi_list(figures, whole), lambda x: F.concat_ws("=", x["label"], x["value"])), ";")
    return f.select("session", "line", shown(figures, True).alias("session_kpis"), shown(figures | {"thoughts": none}, False).alias("turn_kpis"))


@query(f"""WITH {OBSERVATIONS_SQL} SELECT session, count(DISTINCT k % 6) AS turns, count(DISTINCT CASE WHEN role = 'ToolFailure' AND k % 5 < 2 THEN k % 6 END) AS aborted FROM obs WHERE k % 6 > 0 GROUP BY session""")
def aborted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("turn", F.when(F.col("k") % 6 > 0, F.col("k") % 6))
    return summary.aborted_turns(obs, ["session"], "turn", F.col("role") == "ToolFailure", F.col("k") % 5 < 2)


@query("""
    WITH c AS (SELECT l_orderkey AS plan, l_suppkey % 3 AS session, CASE WHEN l_linenumber % 4 > 0 THEN l_partkey END AS turn, l_returnflag = 'R' AS created, CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate END AS ts, l_linenumber * 1000000 + l_partkey AS ord FROM lineitem),
    o AS (SELECT plan, min(session) AS session FROM c GROUP BY plan HAVING count(DISTINCT session) = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY plan, session ORDER BY NOT created, ts IS NULL, ts, ord) AS n FROM c WHERE turn IS NOT NULL)
    SELECT o.plan, o.session, t.turn FROM o LEFT JOIN t ON t.plan = o.plan AND t.session = o.session AND n = 1""")
def creator_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans, lines as claims of sessions: the turn that made a plan that one session owns."""
    line = F.col("l_linenumber")
    claims = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan"), (F.col("l_suppkey") % 3).alias("session"), F.when(line % 4 > 0, F.col("l_partkey")).alias("turn"), (F.col("l_returnflag") == "R").alias("made"), F.when(line % 3 > 0, F.col("l_shipdate")).alias("ts"), (line * 1_000_000 + F.col("l_partkey")).alias("ord"), F.lit("path").alias("reason")
    )
    owners = plan_docs.bind_owner(claims, "plan", "session", "reason").where("state = 'Bound'").select("plan", "session")
    return plan_docs.creator_turns(claims, owners, "plan", "session", "turn", F.col("made"), "ts", "ord").select("plan", "session", "turn")


_LONG = "repeat(coalesce(text, ''), 60)"
_LIMIT = "CASE WHEN length({t}) > {n} THEN substr({t}, 1, {n} - 55) || chr(10) || '… [truncated; open Raw source for the complete record]' ELSE {t} END"


@query(f"""
    WITH d AS (SELECT doc_id, {_LONG} AS t FROM documents)
    SELECT doc_id, sha256({_LIMIT.format(t="t", n=32768)}) AS event_text, sha256({_LIMIT.format(t="t", n=65536)}) AS prompt, CASE WHEN length(t) > 65536 THEN length(t) END AS original_chars, sha256({_LIMIT.format(t="t", n=8192)}) AS value FROM d""")
def compacted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.repeat(F.coalesce("text", F.lit("")), F.lit(60))
    rows = table(spark, sf_dir, "documents").select("doc_id", long.alias("event_text"), long.alias("prompt"), F.create_map(F.lit("m"), long).alias("metadata"))
    got = text.compacted(rows, ["event_text"], "prompt", "metadata")
    return got.select("doc_id", F.sha2("event_text", 256).alias("event_text"), F.sha2("prompt", 256).alias("prompt"), "original_chars", F.sha2(F.col("metadata")["m"], 256).alias("value"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, unnest([1, 2]) AS n FROM e WHERE event_id % 3 <> 2)
    SELECT event_id, 's' || k || n AS session_id, CASE n WHEN 1 THEN '/p/subagents/' || k || '.jsonl' ELSE '/named/' || k END AS file, CASE n WHEN 1 THEN 'p' END AS project, CASE n WHEN 1 THEN k END AS messages,
        CASE n WHEN 2 THEN 3 END AS sidechains, CASE n WHEN 2 THEN 'hi ' || k END AS first_user_content, CASE n WHEN 1 THEN ms // 1000 END AS first_message, n = 1 AS is_subagent FROM r""")
def session_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache documents with two sessions and an entry that is none, in two spellings; every third isn't one."""
    snake = '{"version":1,"entries":{"/p/subagents/{k}.jsonl":{"session":{"actual_session_id":"s{k}1","project_name":"p","message_count":{k},"first_message_time":"{at}"}},"x":{"session":{"file_path":"/named/{k}","actual_session_id":"s{k}2"},"sidechain_count":3,"first_user_content":"hi {k}"},"y":{"session":{"summary":"no id"}},"z":4}}'
    camel = snake.replace("actual_session_id", "actualSessionId").replace("project_name", "projectName").replace("message_count", "messageCount").replace("first_message_time", "firstMessageTime").replace("file_path", "filePath").replace("sidechain_count", "sidechainCount").replace("first_user_content", "firstUserContent")
    rows = shaped(spark, sf_dir, snake, camel, '{"entries":[1]}')
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    got = sessions.session_cache(rows.select(F.col("event_id").cast("string").alias("path"), F.replace("doc", F.lit("{at}"), at).alias("value")))
    return got.select(F.col("path").cast("long").alias("event_id"), "session_id", "file", "project", "messages", "sidechains", "first_user_content", F.unix_seconds("first_message").alias("first_message"), "is_subagent")


#: What the rows of a conversation of six headers tell: header, role, step, tool, call, status, text, duration, aborted.
_BUBBLES = (
    (0, "AgentResponse", "NULL", "NULL", "NULL", "NULL", "'before'", "NULL", "false", 1, "'turn-1'"),
    (1, "PromptSubmitted", "NULL", "NULL", "NULL", "NULL", "'ask ' || k", "NULL", "false", 1, "'turn-1'"),
    (2, "AgentThought", "'m'", "NULL", "NULL", "NULL", "'t1'", "NULL", "false", 1, "'turn-1'"),
    (2, "ToolRequest", "'m'", "'edit'", "'c' || k", "'completed'", "'{\"a\":1}'", "NULL", "false", 1, "'turn-1'"),
    (2, "ToolSuccess", "'m'", "'edit'", "'c' || k", "'completed'", "'done'", "5.5", "false", 1, "'turn-1'"),
    (3, "PromptSubmitted", "NULL", "NULL", "NULL", "NULL", "'two' || chr(10) || 'lines'", "NULL", "false", 2, "'r' || k"),
    (4, "AgentThought", "NULL", "NULL", "NULL", "NULL", "'hm'", "7.0", "false", 2, "'r' || k"),
    (5, "ToolRequest", "NULL", "'run'", "NULL", "'Rejected'", "NULL", "NULL", "false", 2, "'r' || k"),
    (5, "ToolFailure", "NULL", "'run'", "NULL", "'Rejected'", "NULL", "NULL", "true", 2, "'r' || k"),
)


@query(f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT 'c' || event_id AS composer_id, {t} AS turn_no, {tid} AS turn_id, {pos} AS pos, 'b{h}' AS bubble_id, '{role}' AS role, {step} AS step, {tool} AS tool, {call} AS call, {status} AS status, {said} AS text, {ms} AS duration_ms, {gone} AS aborted FROM e" for pos, (h, role, step, tool, call, status, said, ms, gone, t, tid) in enumerate(_BUBBLES)))
def bubble_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a conversation of six rows, one of them in its header only, and one that is none."""
    heads = shaped(spark, sf_dir, '{"conversationHeaders":[{"bubbleId":"b0","type":"ai"},{"bubbleId":"b1","type":1},{"id":"b2","role":"assistant"},{"bubbleId":"b3","type":"user","requestId":"r{k}"},{"bubbleId":"b4","type":2,"text":"hm","isThought":true,"durationMs":7},{"bubbleId":"b5"},{"bubbleId":"b6","type":9}]}')
    said = {
        "b0": '{"text":"before"}',
        "b1": '{"text":"<user_query>\\nask {k}\\n</user_query>"}',
        "b2": '{"modelCallId":"m","allThinkingBlocks":[{"thinking":" "},{"text":"t1"}],"text":"left out","toolFormerData":{"name":"edit","toolCallId":"c{k}","rawArgs":"{\\"a\\":1}","status":"completed","result":"done","durationMs":5.5}}',
        "b3": '{"richText":"","content":[{"text":"two"},"lines",{}]}',
        "b5": '{"type":2,"toolFormerData":{"toolName":"run","state":"Rejected"}}',
    }
    kv = heads.select(F.concat(F.lit("composerData:c"), F.col("event_id").cast("string")).alias("key"), F.col("doc").alias("value"))
    for name, doc in said.items():
        kv = kv.unionByName(shaped(spark, sf_dir, doc).select(F.concat(F.lit("bubbleId:c"), F.col("event_id").cast("string"), F.lit(f":{name}")).alias("key"), F.col("doc").alias("value")))
    return sessions.bubble_events(kv)


@query(f"""WITH {EVENTS}, r AS (SELECT {by_shape("'/T/A' || k", "'c:/x' || k", "'/t/a' || k", "''", "'/s' || k")} AS path, {by_shape("'s' || user_id", "'s' || user_id", "'u' || user_id", "'v'", "'Process-Test'")} AS session_id, event_id,
        {by_shape("'main'", "'agent-a' || k", "'main'", "''", "''")} AS source FROM e WHERE event_id % 5 <> 3 AND event_id % 7 > 0)
    SELECT arg_min(path, (event_id)) AS path, arg_min(session_id, event_id) AS session_id, arg_min(source, event_id) AS source FROM r WHERE event_id % 5 < 3 GROUP BY lower(path)""")
def named_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, " /T/A{k} ", "/c:/x{k}", "/t/a{k}", " ", "/s{k}")
    i = F.col("event_id") % 5
    user = F.col("user_id").cast("string")
    told = rows.select(
        F.col("doc").alias("path"), F.when(i == 4, "Process-Test").when(i == 2, F.concat(F.lit("u"), user)).otherwise(F.concat(F.lit("s"), user)).alias("session_id"), F.when(F.col("event_id") % 7 == 0, "other").otherwise("cursor-jsonl").alias("dialect"), F.when(i == 1, "Subagent").otherwise("Main").alias("role"), F.when(i < 2, F.concat(F.lit("a"), F.col("k").cast("string"))).alias("agent_id"), F.col("event_id").alias("observed")
    )
    return envelopes.named_transcripts(told).select("path", "session_id", "source")


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'auto · 81.26% · 200.5k · ' || k || '/?'", "'50%'", "NULL", "NULL")} AS compaction, {by_shape("NULL", "NULL", "'Bash · timeout · first...'", "'one line ' || k")} AS failure, {by_shape("NULL", "'in ' || k || ' · cache w 1k'", "NULL", "'out 0'")} AS tokens FROM e""")
def payload_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        '{"trigger":"auto","context_usage_percent":81.256,"context_window_size":200500,"message_count":{k}}',
        '{"context_usage_percent":50,"input_tokens":{k},"cache_write_tokens":1000}',
        '{"tool_name":"Bash","failure_type":"timeout","error_message":"first  \\r\\nsecond"}',
        '{"error":"one line {k}","output_tokens":0}',
    )
    return rows.select("event_id", labels.compaction_detail(parsed()).alias("compaction"), labels.failure_detail(parsed()).alias("failure"), labels.token_detail(parsed()).alias("tokens"))


@query(f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT event_id, CASE WHEN k % 6 > 0 THEN ts END AS ts, 'hook' AS origin FROM obs WHERE event_id % 2 = 0 UNION ALL SELECT event_id, ts, 'transcript' FROM obs WHERE event_id % 2 = 1)
    SELECT event_id, origin, row_number() OVER (ORDER BY ts NULLS LAST, event_id) AS position FROM r""")
def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks, some without a clock, and transcript rows as one replay in the order of their times."""
    obs = observations(spark, sf_dir)
    hooks = obs.where("event_id % 2 = 0").select("event_id", F.when(F.col("k") % 6 > 0, F.col("ts")).alias("ts"), F.lit("hook").alias("origin"))
    both = captures.merge_replays(hooks, obs.where("event_id % 2 = 1").select("event_id", "ts", F.lit("transcript").alias("origin")))
    return catalog.positions(both, captures.replay_keys("ts", ["event_id"]), shared_dir(spark)).select("event_id", "origin", "position")


#: Rows of all families, and the events that each gives: role, call, tool, skill, stage, text, status, opaque, failed.
_FAMILIES = (
    ('{"type":"assistant.message","data":{"reasoningText":"why","reasoningOpaque":"x","toolRequests":[{"toolCallId":"c{k}","name":"bash"},{"id":"d","toolName":"view"}],"content":"said"}}', "AgentThought|||||why||false|false", "ToolRequest|c{k}|bash|||||false|false", "ToolRequest|d|view|||||false|false", "AgentResponse|||||said||false|false"),
    ('{"type":"assistant.message","data":{"encryptedContent":"x","content":" "}}', "AgentThought|||||||true|false"),
    ('{"type":"assistant.message","data":{}}', "Generic|||||||false|false"),
    ('{"type":"assistant.reasoning","data":{"reasoningOpaque":"x"}}', "AgentThought|||||||true|false"),
    ('{"type":"system.message","data":{"role":"system","content":"be {k}"}}', "SystemPrompt|||||be {k}||false|false"),
    ('{"type":"tool.execution_complete","data":{"toolCallId":"c{k}","success":true,"result":{"kind":"rejected by user"}}}', "ToolFailure|c{k}|||||rejected by user|false|true"),
    ('{"type":"tool.execution_complete","data":{"toolCallId":"c{k}","toolName":"bash","success":true}}', "ToolSuccess|c{k}|bash|||||false|false"),
    ('{"type":"permission.completed","data":{"toolCallId":"c","permissionRequest":{"toolName":"edit"},"result":{"kind":"denied"}}}', "PermissionDenied|c|edit||||denied|false|false"),
    ('{"type":"permission.completed","data":{"result":{"kind":"approved"}}}', "Generic||||||approved|false|false"),
    ('{"type":"subagent.started","data":{"agentId":"a{k}","name":"x"}}', "SubagentStart|||||||false|false"),
    ('{"type":"subagent.failed","data":{"error":"bad"}}', "SubagentStop|||||bad||false|true"),
    ('{"type":"skill.loaded","data":{"skillName":"s{k}"}}', "InstructionsLoaded|||s{k}|Loaded|||false|false"),
    ('{"type":"skill.other","data":{"name":"s"}}', "InstructionsLoaded|||s|Invoked|||false|false"),
    ('{"type":"model.call_failure","data":{"message":"m{k}","kind":"timeout"}}', "RuntimeError|||||m{k}|timeout|false|true"),
    ('{"type":"session.compaction_complete","data":{"trigger":"auto"}}', "CompactionEnd||||||auto|false|false"),
    ('{"type":"session.compaction_start","data":{}}', "CompactionStart|||||||false|false"),
    ('{"type":"session.error","data":{"error":"e","errorType":"quota"}}', "RuntimeError|||||e|quota|false|true"),
    ('{"type":"assistant.turn_end","data":{}}', "TurnStop|||||||false|false"),
    ('{"type":"else","data":{"content":"c"}}', "Generic|||||c||false|false"),
    ('{"type":"skill.loaded","data":{}}',),
)
_FAMILY_ROWS = " UNION ALL ".join(f"SELECT event_id, {pos} AS pos, replace('{row}', '{{k}}', CAST(k AS VARCHAR)) AS event FROM e WHERE event_id % {len(_FAMILIES)} = {i}" for i, (_, *rows) in enumerate(_FAMILIES) for pos, row in enumerate(rows))


@query(f"WITH {EVENTS} {_FAMILY_ROWS}")
def copilot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, *[f[0] for f in _FAMILIES])
    got = transcripts.copilot_records(lines_of(rows))
    shown = ["role", "tool_call_id", "tool_name", "skill", "stage", "text", "status", "opaque", "failed"]
    return got.select(F.substring("path", 2, 20).cast("long").alias("event_id"), "pos", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown]).alias("event"))


@query(f"""WITH {EVENTS}, h AS (SELECT 'c' || user_id AS composer_id, CASE WHEN k % 2 = 0 THEN 'n' || k END AS name, CASE WHEN k % 3 = 0 THEN 'agent' END AS mode, ms // 1000 AS updated FROM e WHERE event_id % 4 <> 3)
    SELECT composer_id, arg_max(name, (name IS NOT NULL, updated, name)) AS name, max(mode) AS mode, max(updated) AS updated, count(*) AS sources FROM h GROUP BY composer_id""")
def composer_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in lists of two spellings and one by one; a fourth of them is under another conversation's key, or no object."""
    one = '"composerId":"c{user}",{name}{mode}"lastUpdatedAt":{sec}000'
    rows = shaped(spark, sf_dir, '{"allComposers":[{' + one + "},7]}", "[{" + one.replace("composerId", "id") + '},{"name":"no id"}]', "{" + one + "}", "{" + one + "}")
    doc = F.replace(F.col("doc"), F.lit("{name}"), F.when(F.col("k") % 2 == 0, F.concat(F.lit('"name":"n'), F.col("k").cast("string"), F.lit('",'))).otherwise(""))
    doc = F.replace(doc, F.lit("{mode}"), F.when(F.col("k") % 3 == 0, '"unifiedMode":"agent",').otherwise(""))
    doc = F.replace(doc, F.lit("{sec}"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("string"))
    i = F.col("event_id") % 4
    kv = rows.select(F.when(i < 2, "ItemTable").otherwise("composerHeaders").alias("table_name"), F.when(i == 0, "composer.composerData").when(i == 1, "composer.composerHeaders").when(i == 2, F.concat(F.lit("c"), F.col("user_id").cast("string"))).otherwise("other").alias("key"), doc.alias("value"))
    return sessions.composer_headers(kv).select("composer_id", "name", "mode", F.unix_seconds("updated").alias("updated"), "sources")
