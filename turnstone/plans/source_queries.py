"""Queries over records as sources land them: JSON documents made of the given tables, read back by the library.

Each row of a table gets one of a few shapes of document, by its key; the DuckDB side tells what each shape has to give,
in terms of the table's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import labels, payloads, text, tools
from turnstone.operators import plan_docs, usage
from turnstone.plans.adapters import table
from turnstone.plans.registry import query
from turnstone.sources import captures, envelopes, sessions, transcripts
from turnstone.sources.staging import shared_dir


def shaped(spark: SparkSession, sf_dir: str, *shapes: str) -> DataFrame:
    """events with `doc`: the shape that the event's id points to, {id}, {k}, {user} and {ms} filled in."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    doc = F.element_at(F.array(*map(F.lit, shapes)), (F.col("event_id") % len(shapes) + 1).cast("int"))
    for name, value in (("id", F.col("event_id")), ("k", F.col("k")), ("user", F.col("user_id")), ("ms", F.unix_millis(F.col("ts").cast("timestamp")))):
        doc = F.replace(doc, F.lit("{" + name + "}"), value.cast("string"))
    return e.select("event_id", "user_id", "ts", "k", doc.alias("doc"))


def by_shape(*values: str) -> str:
    """SQL for the value of each shape."""
    return "CASE event_id % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


EVENTS = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events)"


def parsed() -> Column:
    return F.try_parse_json("doc")


_SURFACE_SHAPES = (
    '{"cursor_version":"2","sessionId":"s"}',
    '{"conversation_id":null}',
    '{"sessionId":"s{id}","timestamp":{ms}}',
    '{"hook_event_name":"PreToolUse","session_id":"x","timestamp":"2024-01-01T00:00:00Z"}',
    '{"hook_event_name":"PreToolUse","session_id":"x"}',
    '{"effort":1,"sessionId":"s"}',
    '{"sessionId":"s","timestamp":"2024-01-01T00:00:00Z"}',
    '{"hook_event_name":"Unheard","session_id":"x"}',
)


@query(f"WITH {EVENTS} SELECT event_id, {by_shape(*map(repr, ('CursorIde', 'CursorIde', 'CopilotCli', 'VsCodeAgentHooks', 'ClaudeCode', 'ClaudeCode', 'CopilotCli', 'CursorIde')))} AS surface FROM e")
def legacy_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, *_SURFACE_SHAPES).select("event_id", payloads.legacy_surface(parsed(), ("PreToolUse", "Stop")).alias("surface"))


@query(f"""WITH {EVENTS} SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'CopilotCli' ELSE {by_shape("'CursorIde'", "CASE user_id % 3 WHEN 1 THEN 'ClaudeCode' ELSE 'CursorIde' END", "CASE user_id % 3 WHEN 1 THEN 'ClaudeCode' ELSE 'CopilotCli' END", "CASE user_id % 3 WHEN 1 THEN 'ClaudeCode' ELSE 'VsCodeAgentHooks' END", "CASE user_id % 3 WHEN 1 THEN 'ClaudeCode' ELSE 'CursorIde' END", "'ClaudeCode'", "CASE user_id % 3 WHEN 1 THEN 'ClaudeCode' ELSE 'CursorIde' END", "CASE user_id % 3 WHEN 1 THEN 'ClaudeCode' ELSE 'CursorIde' END")} END AS surface FROM e""")
def runtime_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, *_SURFACE_SHAPES)
    env = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("RUNTIME"), F.lit("copilot-cli"))).when(F.col("user_id") % 3 == 1, F.create_map(F.lit("RUNTIME"), F.lit("odd"), F.lit("CLAUDE_CODE_CHILD_SESSION"), F.lit("1"))).otherwise(F.create_map(F.lit("CURSOR_VERSION"), F.lit(" ")))
    return rows.select("event_id", payloads.runtime_surface(parsed(), env, F.lit("CursorIde"), "RUNTIME").alias("surface"))


_RUN_SHAPES = (
    '{"result":{"content":"done {k}"},"success":true,"durationMs":{k}}',
    '{"success":false,"message":"m","latencyMs":-5}',
    '{"error":{"code":1},"status":"Cancelled by user"}',
    '{"error":null,"result":{"kind":"denied-by-rules"},"content":"c"}',
    '{"aborted":true,"stopReason":"end","modelCallDurationMs":2.5}',
)


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'done ' || k", "'m'", "'{\"code\":1}'", "'c'", "NULL")} AS result, {by_shape("NULL", "NULL", "'Cancelled by user'", "'denied-by-rules'", "'end'")} AS status,
    event_id % 5 IN (1, 2, 3) AS failed, event_id % 5 IN (2, 4) AS aborted, event_id % 5 = 3 OR k % 10 = 0 AS denied, {by_shape("CAST(k AS DOUBLE)", "0.0", "k * 1.0", "k * 1.0", "2.5")} AS duration_ms FROM e""")
def execution_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a told duration last k milliseconds by the clock."""
    native = F.when(F.col("k") % 10 == 0, "permission.denied").otherwise("tool.done")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return shaped(spark, sf_dir, *_RUN_SHAPES).select(
        "event_id",
        payloads.result_text(parsed()).alias("result"),
        payloads.status_text(parsed()).alias("status"),
        payloads.is_failure(parsed()).alias("failed"),
        payloads.is_aborted(parsed()).alias("aborted"),
        payloads.is_denied(native, parsed()).alias("denied"),
        payloads.duration_ms(payloads.told_duration(parsed()), us, us + F.col("k") * 1000).alias("duration_ms"),
    )


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'tidy-' || k", "'open'", "NULL", "NULL", "'last'")} AS skill, {by_shape("'/s/' || k || '/SKILL.md'", "NULL", "NULL", "NULL", "'/x y'")} AS skill_path FROM e""")
def attached_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        "a\n<manually_attached_skills>\nName: tidy-{k} \r\nPath: /s/{k}/SKILL.md\n</manually_attached_skills> path: /no",
        "<manually_attached_skills>name: open",
        "name: outside",
        "<manually_attached_skills>path: /p\nname:  \n</manually_attached_skills>",
        "<manually_attached_skills>path: /early\nname: last\npath: /x y</manually_attached_skills>",
    )
    return rows.select("event_id", *[c.alias(n) for n, c in payloads.attached_skill(F.col("doc")).items()])


@query(f"""WITH {EVENTS} SELECT event_id, 'auto' AS mode, event_id % 4 = 0 AS needs_user, {by_shape("1", "0", "0", "2")} AS n_changes, {by_shape("'f' || k", "NULL", "NULL", "'a'")} AS first_target FROM e WHERE event_id % 4 IN (0, 1, 3)
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM e WHERE event_id % 4 = 2""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        '{"outcome":{"mode":"auto","effectKind":"x","summary":"s","response":{},"requiresUserAction":true,"changes":[{"target":"f{k}","after":"1"},{"before":"no target"}]}}',
        '{"outcome":{"mode":"auto","effectKind":"x","summary":"s","response":{"a":1},"requiresUserAction":"no"}}',
        '{"outcome":{"mode":"auto","effectKind":"x","summary":"s","response":[]}}',
        '{"outcome":{"mode":"auto","effectKind":"x","summary":"s","response":{},"changes":[{"target":"a"},{"target":"b"}]}}',
    ).withColumn("o", payloads.outcome(parsed()))
    return rows.select("event_id", F.col("o.mode").alias("mode"), F.col("o.needs_user").alias("needs_user"), F.when(F.col("o").isNotNull(), F.size("o.changes")).alias("n_changes"), F.get("o.changes", F.lit(0))["target"].alias("first_target"))


@query(f"""WITH {EVENTS} SELECT event_id, unnest({by_shape("['input_tokens:' || k || ':Cumulative', 'output_tokens:3:Delta', 'thinking_tokens:2:Delta']", "['cache_read_input_tokens:7:Cumulative', 'cache_creation_input_tokens:' || k || ':Cumulative', 'web_search_requests:1:Delta']", "CAST([] AS VARCHAR[])")}) AS sample FROM e
    UNION ALL SELECT event_id, unnest({by_shape("['totalDuration:' || k || ':Final', 'total_cost_usd:1500000:Final', 'm-1.inputTokens:' || k || ':Final', 'm-1.webSearchRequests:2:Final']", "CAST([] AS VARCHAR[])", "['total_cost_usd:3:Final']")}) FROM e""")
def extracted_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = shaped(spark, sf_dir, '{"usage":{"input_tokens":{k},"output_tokens":3,"output_tokens_details":{"thinking_tokens":2}}}', '{"usage":{"cache_read_input_tokens":7,"cache_creation_input_tokens":{k},"server_tool_use":{"web_search_requests":1}}}', '{"usage":[]}')
    costs = shaped(spark, sf_dir, '{"totalDuration":{k},"totalCostUSD":1.5,"modelUsage":{"m-1":{"inputTokens":{k},"webSearchRequests":2},"odd":3}}', "{}", '{"total_cost_usd":0.0000025}')
    rows = messages.select("event_id", F.explode(usage.assistant_usage(parsed())).alias("s")).unionByName(costs.select("event_id", F.explode(usage.cost_state(parsed())).alias("s")))
    return rows.select("event_id", F.concat_ws(":", "s.name", F.col("s.value").cast("string"), "s.behavior").alias("sample"))


@query(f"""WITH {EVENTS}, s AS (SELECT event_id, unnest([['input_tokens', CAST(k AS VARCHAR), CASE WHEN user_id % 2 = 0 THEN 'Final' ELSE 'Cumulative' END], ['cache_write_tokens', '4', CASE WHEN user_id % 2 = 0 THEN 'Final' ELSE 'Delta' END]]) AS s FROM e
        UNION ALL SELECT event_id, unnest(CASE WHEN user_id % 2 = 0 THEN [['a', CAST(k AS VARCHAR), 'Final']] ELSE [['b', '2', 'Cumulative']] END) FROM e)
    SELECT event_id, s[1] AS name, CAST(s[2] AS BIGINT) AS value, s[3] AS behavior FROM s""")
def event_token_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's own token fields, and a session's metadata figures."""
    e = shaped(spark, sf_dir, "")
    stop = F.col("user_id") % 2 == 0
    none = F.lit(None).cast("long")
    own = e.select("event_id", F.explode(usage.token_fields(stop, F.col("k"), none, none, F.lit(4).cast("long"))).alias("s"))
    told = F.create_map(F.when(stop, "usage.final.a").otherwise("usage.latest.a.unit"), F.col("k").cast("string"), F.lit("usage.latest.b"), F.lit("2"), F.lit("usage.latest.c"), F.lit("many"), F.lit("other"), F.lit("1"))
    meta = e.select("event_id", F.explode(usage.metadata_usage(told)).alias("s"))
    pick = ["event_id", F.col("s.name").alias("name"), F.col("s.value").alias("value"), F.col("s.behavior").alias("behavior")]
    return own.select(*pick).unionByName(meta.select(*pick))


@query(f"""WITH {EVENTS} SELECT event_id, unnest({by_shape("['a.b=' || k, 'a.c[0]=1', 'a.c[1].d=2']", "['x=-3']", "CAST([] AS VARCHAR[])")}) AS figure FROM e""")
def numeric_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, '{"a":{"b":{k},"c":[1,{"d":2.0}],"t":true,"s":"4"}}', '{"x":-3,"y":1.5,"z":null}', "not json")
    return rows.select("event_id", F.explode(payloads.numeric_tree("doc")).alias("n")).select("event_id", F.concat_ws("=", "n.name", F.col("n.value").cast("string")).alias("figure"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'/a/' || k || ',/b,/c d'", "CASE user_id % 3 WHEN 0 THEN '/x,src/new.py,src/old.py,src/moved.py,/y' ELSE '/x,/y' END", "''", "'/deep'", "CASE user_id % 3 WHEN 0 THEN 'One.py,/z' ELSE '/z,one.PY' END")} AS paths FROM e""")
def target_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches count for one tool only, whatever its case; paths that differ by case are one, the first told."""
    rows = shaped(
        spark,
        sf_dir,
        '{"file_path":"/a/{k}","nested":[{"Path":"/b"},{"cwd":"/c d","path":"/B"}],"file":"/A/{k}","other":"/no"}',
        '{"path":"/x","arguments":"*** Begin\\n*** Add File: src/new.py\\n+*** x\\n*** Update File: src/old.py\\n*** Move to: src/moved.py\\n*** Update File: SRC/new.py\\n","targetPath":"/y"}',
        '{"path":" ","n":1}',
        '{"a":{"b":{"c":{"d":{"e":{"f":{"toFilePath":"/deep","g":{"h":{"path":"/too/deep"}}}}}}}}}',
        '{"diff":"*** Delete File: One.py","paths":["/z"],"more":{"file":"one.PY"}}',
    )
    tool = F.element_at(F.array(F.lit("Apply_Patch"), F.lit("edit"), F.lit(None)), (F.col("user_id") % 3 + 1).cast("int"))
    return rows.select("event_id", F.array_join(payloads.target_paths(F.col("doc"), tool), ",").alias("paths"))


@query(f"""WITH {EVENTS} SELECT event_id, sha256(c) AS arguments, 's' || user_id || '|Shell|RUN IT|' || sha256(c) AS signature FROM (SELECT *, {by_shape("'{\"a\":1.50,\"b\":{\"k\":' || k || ',\"z\":[1,{\"m\":null}]}}'", "'{\"a\":1.50,\"b\":{\"k\":' || k || ',\"z\":[1,{\"m\":null}]}}'", "''", "'[\"é\",\"{no\"]'")} AS c FROM e)""")
def tool_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, '{"b":{"z":[1,{"m":null}],"k":{k}},"a":1.50}', '{"a":1.50,"b":"{\\"k\\": {k}, \\"z\\": \\"[1, {\\\\\\"m\\\\\\": null}]\\"}"}', "{broken", '["\\u00e9","{no"]')
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return rows.select("event_id", F.sha2(F.coalesce(payloads.canonical_json("doc"), F.lit("")), 256).alias("arguments"), payloads.tool_signature(session, F.lit("Shell"), F.lit(" run \t it"), F.col("doc")).alias("signature"))


_HOOKS = (
    '{"eventId":"e{id}","observedAtUtc":"2024-05-01T10:00:00Z","provider":"claudecode","configuredEventName":"Stop","payload":{"hook_event_name":"PreToolUse","session_id":"s{user}","tool_name":"Bash","timestamp":{ms}}}',
    '{"eventId":"e{id}","observedAtUtc":"2024-05-01T10:00:00Z","provider":3,"detectedSurface":"CopilotCli","sourceKind":3,"configuredEventName":"preToolUse","payload":{"event":"odd","sessionId":"s{user}"}}',
    "{broken",
    '{"eventId":"e{id}","provider":"?","payload":{"conversation_id":"s{user}"}}',
    '["no object"]',
)


@query(f"""WITH {EVENTS} SELECT 'e' || event_id AS event_id, {by_shape("'ClaudeCode'", "'GitHubCopilot'", "''", "'Unknown'", "''")} AS provider, {by_shape("'ClaudeCode'", "'CopilotCli'", "''", "'Unknown'", "''")} AS surface,
        {by_shape("'Hook'", "'Replay'", "''", "'Hook'", "''")} AS source_kind, {by_shape("'PreToolUse'", "'preToolUse'", "''", "NULL", "''")} AS native_event, 's' || user_id AS session_id,
        {by_shape("ms // 1000", "1714557600", "0", "NULL", "0")} AS at, {by_shape("true", "true", "false", "false", "false")} AS accepted FROM e WHERE event_id % 5 IN (0, 1, 3)
    UNION ALL SELECT 'rejected', CAST(count(*) AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE event_id % 5 IN (2, 4)""")
def landed_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes written as JSON lines and scanned; one more row counts the rejects."""
    from turnstone.operators.interpret import accepted, normal_envelope

    at = shared_dir(spark)
    shaped(spark, sf_dir, *_HOOKS).select("doc").write.text(at)
    good, bad = envelopes.read(spark, at, whole_files=False)
    rows = normal_envelope(good)
    fits = rows.where(F.lit(True))
    told = accepted(fits, "provider", "surface").select("event_id", F.lit(True).alias("accepted"))
    out = rows.join(told, "event_id", "left").select("event_id", "provider", "surface", "source_kind", "native_event", "session_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
    none = F.lit(None)
    return out.unionByName(bad.agg(F.count(F.lit(1)).cast("string").alias("provider")).select(F.lit("rejected").alias("event_id"), "provider", *[none.cast(t).alias(c) for c, t in out.dtypes[2:]]))


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE epoch_us(ts) // 1000000 * 1000 + event_id % 1000 END AS ms FROM events""")
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss"))
    tail = F.concat(F.lit("_"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.when(F.col("event_id") % 3 == 2, "_xyz.json").otherwise("_0a1B2c3d.JSON"))
    return e.select("event_id", F.unix_millis(envelopes.file_time(F.concat(F.lit("/in/hook_"), "t", tail)).cast("timestamp")).alias("ms"))


_LINE = "'{\"turn\":' || turn || ',\"h\":\"' || sha256(text) || '\"}'"


@query(f"""
    WITH l AS (SELECT conv_id, turn, {_LINE} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
    SELECT 'c' || conv_id AS path, 2 * n AS line_no, CAST(coalesce(sum(length(line) + 3) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN n > 0 THEN 3 ELSE 0 END AS BIGINT) AS byte_offset, line AS raw FROM l""")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one file: a byte-order mark, CRLF ends, a blank line between rows, none behind the last."""
    line = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"h":"'), F.sha2("text", 256), F.lit('"}'))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    whole = files.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.concat(F.lit("\ufeff"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n\n")).alias("value"))
    return transcripts.split_lines(whole).select("path", "line_no", "byte_offset", "raw")


def lines_of(rows: DataFrame) -> DataFrame:
    """Documents of shaped rows as the lines of one file each."""
    return rows.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.lit(0).cast("long").alias("generation"), F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("byte_offset"), F.col("doc").alias("raw"))


@query(f"""WITH {EVENTS}, b AS (SELECT event_id, k, unnest({by_shape("['0|AgentThought||hm|false', '1|ToolRequest|t' || k || '||false', '2|AgentResponse||said|false']", "['0|ToolFailure|t' || k || '|bad|false', '1|ToolSuccess|t2|fine|false']", "['0|PromptSubmitted||ask|false']", "['0|AgentThought|||true', '1|AgentThought|||true']", "['0|Generic|||NULL']")}) AS b FROM e)
    SELECT 'f' || event_id AS path, b AS block FROM b""")
def claude_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        '{"type":"assistant","message":{"role":"assistant","content":[{"type":"thinking","thinking":"hm"},{"type":"tool_use","id":"t{k}","name":"Bash"},{"type":"text","text":"said"}]}}',
        '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t{k}","is_error":true,"content":"bad"},{"type":"tool_result","tool_use_id":"t2","content":"fine"}]}}',
        '{"type":"user","message":{"role":"user","content":"ask"}}',
        '{"type":"assistant","message":{"role":"assistant","content":[{"type":"redacted_thinking"},{"type":"thinking","thinking":" "}]}}',
        '{"type":"summary"}',
    )
    e = transcripts.claude_events(lines_of(rows))
    shown = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "").otherwise(F.col("text"))
    return e.select("path", F.concat_ws("|", F.col("block_no").cast("string"), "event_role", F.coalesce("tool_call_id", F.lit("")), shown, F.coalesce(F.col("opaque").cast("string"), F.lit("NULL"))).alias("block"))


@query(f"""WITH {EVENTS}, b AS (SELECT event_id, unnest({by_shape("['0|AgentResponse||text', '1|ToolRequest|c' || k || '|', '2|ToolRequest|d|']", "['0|ToolFailure|c' || k || '|no']", "['0|ToolSuccess|c|']", "['0|Generic||']", "['0|SessionEnd||']")}) AS b FROM e)
    SELECT 'f' || event_id AS path, b AS block FROM b""")
def copilot_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        '{"type":"assistant.message","data":{"content":"text","toolRequests":[{"toolCallId":"c{k}","name":"bash"},{"toolCallId":"d","name":"view"}]}}',
        '{"type":"tool.execution_complete","data":{"toolCallId":"c{k}","success":false,"error":"no"}}',
        '{"type":"tool.execution_complete","data":{"toolCallId":"c","success":true}}',
        '{"type":"else"}',
        '{"type":"session.shutdown","data":{}}',
    )
    e = transcripts.copilot_events(lines_of(rows))
    return e.select("path", F.concat_ws("|", F.col("block_no").cast("string"), "event_role", F.coalesce("tool_call_id", F.lit("")), F.coalesce("text", F.lit(""))).alias("block"))


@query(f"""WITH {EVENTS}, b AS (SELECT event_id, unnest({by_shape("['0|AgentThought|beside', '1|ToolRequest|']", "['0|AgentResponse|alone ' || k]", "['0|PromptSubmitted|q']", "['0|TurnStop|']")}) AS b FROM e)
    SELECT 'f' || event_id AS path, b AS block FROM b""")
def cursor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        '{"role":"assistant","message":{"content":[{"type":"text","text":"beside"},{"type":"tool_use","name":"Read"}]}}',
        '{"role":"assistant","message":{"content":[{"type":"text","text":"alone {k}"}]}}',
        '{"role":"user","message":{"content":[{"type":"text","text":"q"}]}}',
        '{"type":"turn_ended","status":"success"}',
    )
    e = transcripts.cursor_events(lines_of(rows))
    return e.select("path", F.concat_ws("|", F.col("block_no").cast("string"), "event_role", F.coalesce("text", F.lit(""))).alias("block"))


@query(f"""WITH {EVENTS} SELECT 's' || user_id AS session_id, '/p/' || arg_max(k, event_id) AS project, 'ask ' || min(event_id) AS first_prompt, min(ms) AS started, max(ms) AS active FROM e GROUP BY user_id""")
def prompt_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, '{"sessionId":"s{user}","project":"/p/{k}","display":"ask {id}","timestamp":{ms}}')
    got = sessions.prompt_history(rows.select(F.col("doc").alias("raw"), F.col("event_id").alias("line_no")).unionByName(rows.select(F.lit("{}").alias("raw"), F.col("event_id").alias("line_no"))))
    return got.select("session_id", "project", "first_prompt", F.unix_millis("started").alias("started"), F.unix_millis("active").alias("active"))


@query(f"""WITH {EVENTS} SELECT 's' || event_id AS session_id, {by_shape("'sum ' || k", "NULL", "'sum ' || k")} AS summary, 'index' AS origin FROM e
    UNION ALL SELECT 's' || user_id || ':' || event_id, 'Explore ' || k, 'subagent' FROM e WHERE event_id % 2 = 0
    UNION ALL SELECT 'w' || event_id, {by_shape("'/home/a b/' || k", "'/w/' || k")}, 'manifest' FROM e WHERE event_id % 3 < 2 OR event_id % 2 < 2""".replace("WHERE event_id % 3 < 2 OR event_id % 2 < 2", ""))
def session_side_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries, sub-agent metadata and workspace manifests."""
    index = shaped(spark, sf_dir, '{"entries":[{"sessionId":"s{id}","summary":"sum {k}"}]}', '{"entries":[{"sessionId":"s{id}"}]}', '{"version":1,"entries":[{"sessionId":"s{id}","summary":"sum {k}","firstPrompt":"p"}]}')
    agents = shaped(spark, sf_dir, '{"agentType":"Explore {k}"}', "{}")
    place = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/x/s"), F.col("user_id").cast("string"), F.lit("/subagents/agent-"), F.col("event_id").cast("string"), F.lit(".meta.json"))).otherwise("/x/other.json")
    manifests = shaped(spark, sf_dir, '{"folder":"file:///home/a%20b/{k}"}', '{"workspacePath":"/w/{k}"}')
    at = F.concat(F.lit("/store/w"), F.col("event_id").cast("string"), F.lit("/workspace.json"))
    one = sessions.session_index(index.select(F.lit("i").alias("path"), F.col("doc").alias("value"))).select("session_id", "summary", F.lit("index").alias("origin"))
    two = sessions.subagent_meta(agents.select(place.alias("path"), F.col("doc").alias("value"))).select(F.concat_ws(":", "session_id", "agent_id").alias("session_id"), F.col("agent_type").alias("summary"), F.lit("subagent").alias("origin"))
    three = sessions.workspace_manifests(manifests.select(at.alias("path"), F.col("doc").alias("value"))).select(F.col("workspace_id").alias("session_id"), F.col("folder").alias("summary"), F.lit("manifest").alias("origin"))
    return one.unionByName(two).unionByName(three)


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'id-' || k", "'x'", "NULL")} AS id, {by_shape("'/w d/' || k", "NULL", "'/c'")} AS cwd, {by_shape("'a: b'", "'t'", "NULL")} AS name FROM e""")
def workspace_yamls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "ID: id-{k}\ncwd: '/w d/{k}'\r\nname: \"a: b\"\nname: second\n", "session-id: x\n# cwd: /no\ntitle: t\n", "working_directory:   /c  \nlist:\n  - id: inner\n")
    got = sessions.workspace_yaml(rows.select(F.col("event_id").cast("string").alias("path"), F.col("doc").alias("value")))
    return got.select(F.col("path").cast("long").alias("event_id"), "id", "cwd", "name")


@query(f"""WITH {EVENTS} SELECT 'c' || event_id AS composer_id, 'b' || n AS bubble_id, n - 1 AS number, {by_shape("'ToolRequest'", "'PromptSubmitted'", "'AgentResponse'")} AS role, {by_shape("NULL", "'text ' || k", "'out'")} AS text, ms // 1000 AS created
    FROM e CROSS JOIN (SELECT unnest([1, 2]) AS n)""")
def desktop_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = shaped(spark, sf_dir, '{"createdAt":{ms},"fullConversationHeadersOnly":[{"bubbleId":"b1"},{"bubbleId":"b2"}]}').select(F.concat(F.lit("composerData:c"), F.col("event_id").cast("string")).alias("key"), F.col("doc").alias("value"))
    said = shaped(spark, sf_dir, '{"type":2,"toolFormerData":{"name":"read","toolCallId":"t"}}', '{"type":1,"text":"text {k}"}', '{"type":2,"text":"out"}')
    bodies = said.select(F.explode(F.array(*[F.concat(F.lit("bubbleId:c"), F.col("event_id").cast("string"), F.lit(f":b{n}")) for n in (1, 2)])).alias("key"), F.col("doc").alias("value"))
    kv = heads.unionByName(bodies)
    # sizes after lists are exploded and documents made are guessed far too low, so neither side may be broadcast
    got = sessions.composers(kv).join(sessions.bubbles(kv).hint("merge"), ["composer_id", "bubble_id"])
    return got.select("composer_id", "bubble_id", "number", "role", "text", F.unix_seconds("created").alias("created"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'Plan ' || k", "'Second'", "NULL")} AS title, sha256({by_shape("'# Plan ' || k || chr(10) || 'do'", "'text' || chr(10) || '#  Second '", "'no heading'")}) AS body_hash FROM e""")
def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "---\nname: x\n---\n# Plan {k}\r\ndo\n\n", "\ufefftext\n#  Second ", "\nno heading")
    got = sessions.plan_files(rows.select(F.col("event_id").cast("string").alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.col("doc").alias("value")))
    return got.select(F.col("path").cast("long").alias("event_id"), "title", "body_hash")


@query(f"""WITH {EVENTS} SELECT event_id, unnest({by_shape("['a=1', 'b={\"c\":' || k || '}']", "['only=x']", "CAST([] AS VARCHAR[])")}) AS field FROM e""")
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, '{"a":1,"b":{"c":{k}}}', '{"only":"x"}', "{}").withColumn("payload", parsed())
    return envelopes.detail_fields(rows, "event_id", "payload").select("event_id", F.concat_ws("=", "name", "value").alias("field"))


@query(f"""WITH {EVENTS} SELECT CASE event_id % 4 WHEN 1 THEN '/t/b' || user_id ELSE '/T/a' || user_id END AS transcript, count(*) AS n FROM (SELECT DISTINCT user_id, event_id % 4 AS event_id FROM e WHERE event_id % 4 < 2 AND user_id % 5 > 0) GROUP BY ALL""")
def discovered_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "/T/a{user}", "/t/b{user}", "", "")
    told = rows.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.nullif("doc", F.lit("")).alias("transcript"), F.col("ts").alias("observed"))
    again = told.where("transcript LIKE '/t/%'").withColumns({"transcript": F.upper("transcript"), "observed": F.col("observed") + F.expr("INTERVAL 10000 DAYS")})
    made = told.where("session_id LIKE '%0' OR session_id LIKE '%5'").select("session_id").distinct()
    return envelopes.discover_transcripts(told.unionByName(again), made).groupBy("transcript").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH s AS (SELECT event_id, user_id, ts FROM events) SELECT event_id, user_id AS session_id, CASE WHEN event_id % 7 = 0 THEN 1704067200 ELSE epoch_us(ts) // 1000000 END AS at, true AS kept FROM s WHERE user_id % 10 > 0
    UNION ALL SELECT -1, (SELECT count(*) FROM s), (SELECT count(*) FROM s WHERE user_id % 10 = 0), false""")
def capture_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping deliveries appended once each, replayed with the capture time for a missing clock, and sessions deleted. One more row has the counts."""
    at, kept = shared_dir(spark), shared_dir(spark)
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 7 > 0, F.col("ts").cast("timestamp")).alias("ts"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("dedupe_key"))
    n = captures.append_new(rows.where("event_id % 3 < 2"), at) + captures.append_new(rows, at) + captures.append_new(rows.where("event_id % 3 > 0"), at)
    gone = captures.delete_sessions(spark, at, rows.where("session_id % 10 = 0"), kept)
    replayed = captures.replay(spark, kept).select("event_id", "session_id", F.unix_seconds("ts").alias("at"), F.lit(True).alias("kept"))
    return replayed.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(n).cast("long").alias("session_id"), F.lit(gone).cast("long").alias("at"), F.lit(False).alias("kept")))


def _texts(spark: SparkSession, sf_dir: str, *shapes: str) -> tuple[DataFrame, Column]:
    return shaped(spark, sf_dir, *shapes), F.col("doc")


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("' inner ' || k", "' open'", "'plain'", "'a'")} AS first_span, {by_shape("'inner ' || k", "'x <user_query> open'", "'plain'", "'a' || chr(10) || chr(10) || 'b'")} AS all_spans FROM e""")
def prompt_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, doc = _texts(spark, sf_dir, "pre <user_query> inner {k}</user_query> post", "x <user_query> open", "plain", "<user_query>a</user_query>-<user_query> b\n</user_query>")
    return rows.select("event_id", text.unwrap_prompt(doc).alias("first_span"), text.unwrap_all(doc).alias("all_spans"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'completed'", "'aborted'", "'completed'", "'other ' || k", "NULL")} AS status, {by_shape("'0f8fad5b-d9cb-469f-a165-70867728950e'", "'0f8fad5b-d9cb-469f-a165-70867728950e-12'", "'gen ' || k", "''", "'0f8fad5b-d9cb-469f-a165-70867728950e'")} AS turn FROM e""")
def stops_and_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, doc = _texts(spark, sf_dir, " End_Turn ", "ERROR", "complete [REDACTED]", "Other  {k}", "")
    turn = F.element_at(F.array(*map(F.lit, ("0f8fad5b-d9cb-469f-a165-70867728950e-12-aB3d", "0f8fad5b-d9cb-469f-a165-70867728950e-12", "gen ", "", "0f8fad5b-d9cb-469f-a165-70867728950e-0-0000"))), (F.col("event_id") % 5 + 1).cast("int"))
    return rows.select("event_id", text.stop_status(doc).alias("status"), text.turn_of_generation(F.when(F.col("event_id") % 5 == 2, F.concat(turn, F.col("k").cast("string"))).otherwise(turn)).alias("turn"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'a' || k || '.py,b.py,C.py'", "''", "''")} AS patched, {by_shape("NULL", "'my-skill' || k", "NULL")} AS skill FROM e""")
def patches_and_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, doc = _texts(spark, sf_dir, "*** Begin Patch\n*** Add File: a{k}.py\n*** Move to: b.py \r\n*** Delete File: C.py\n*** Update File: B.PY\n *** Add File: no", "/home/x/my-skill{k}/SKILL.md", "/SKILL.txt")
    return rows.select("event_id", F.array_join(text.patch_paths(doc), ",").alias("patched"), text.skill_of_path(doc).alias("skill"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'one ' || k || chr(10) || 'two' || chr(10) || chr(10) || 'three'", "NULL")} AS prompt, {by_shape("'head …'", "'short ' || k")} AS shortened FROM e""")
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one prompt, and long fields compacted (their told length is left out here)."""
    e = shaped(spark, sf_dir, "\n \none {k}\r\ntwo\n\n", " \n")
    parts = F.when(F.col("event_id") % 2 == 0, F.array(F.col("doc"), F.lit(" "), F.lit("three\n"))).otherwise(F.array(F.col("doc")))
    long = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("head"), F.repeat(F.lit("x"), 40))).otherwise(F.concat(F.lit("short "), F.col("k").cast("string")))
    shown = F.regexp_replace(text.compact(long, 12), r"^(head)x*… \[44 characters\]$", "$1 …")
    return e.select("event_id", text.system_prompt(parts).alias("prompt"), shown.alias("shortened"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'Shell'", "'FileRead'", "'Mcp'", "'Agent'", "'Unknown'", "'TextSearch'")} AS kind, {by_shape("'ls -' || k", "'run it'", "NULL", "NULL", "repeat('y', 120) || '…'", "NULL")} AS command FROM e""")
def passive_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, '{"command":"ls  -{k}"}', '{"cmd":" run\\nit "}', '{"other":1}', '{"command":" "}', '{"script":"' + "y" * 130 + '"}', "[]")
    name = F.element_at(F.array(*map(F.lit, ("Run_In_Terminal", "cat", "whatever", "My-Agent", "frobnicate", "codegrep"))), (F.col("event_id") % 6 + 1).cast("int"))
    return rows.select("event_id", tools.passive_kind(name, F.col("event_id") % 6 == 2).alias("kind"), tools.command_text(parsed()).alias("command"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'Tidy ' || k", "'quoted: x'", "NULL")} AS name, {by_shape("'name:Tidy ' || k || chr(10) || 'overview:all of it' || chr(10) || 'todo:a=first thing' || chr(10) || 'todo:b=second'", "'name:quoted: x' || chr(10) || 'overview:'", "'name:' || chr(10) || 'overview:'")} AS key, {by_shape("'# Do' || chr(10)", "''", "'---' || chr(10) || 'open'")} AS body FROM e""")
def plan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(
        spark,
        sf_dir,
        "\ufeff---\r\nname: Tidy  {k}\r\noverview: 'all  of it'\r\ntodos:\r\n  - id: a\r\n    content: first thing\r\n    status: done\r\n  - content: \"second\"\r\n    id: b\r\nisProject: false\r\n---\r\n# Do\r\n",
        '---\nname: "quoted: x"\n---',
        "---\nopen",
    ).withColumn("p", plan_docs.front_matter(F.col("doc")))
    return rows.select("event_id", F.regexp_replace("p.name", " +", " ").alias("name"), plan_docs.structured_key(F.col("p.name"), F.col("p.overview"), F.col("p.todos")).alias("key"), F.col("p.body").alias("body"))


@query(f"""WITH {EVENTS} SELECT event_id, {by_shape("'/r/' || k || '.plan.md,c:/w/B.plan.md,D:' || chr(92) || 'x' || chr(92) || 'c.plan.md'", "'/own.plan.md,/own_b.plan.md'", "''", "'C:' || chr(92) || 'My Docs' || chr(92) || 'x' || k || '.plan.md'", "'/home/a b/y.plan.md,/n/A.plan.md,/no.plan.md'", "''")} AS plans,
    {by_shape("'c:/w/B.plan.md'", "'/a b/c'", "'D:' || chr(92) || 'work' || chr(92) || 'p q,e:/my code'", "''", "'/n/A.plan.md'", "''")} AS hints, CASE event_id % 6 WHEN 2 THEN '0f8fad5b-d9cb-469f-a165-70867728950e' END AS session FROM e""")
def plan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks are part of a path, quotes and line ends aren't; an id counts inside a leading comment only."""
    rows = shaped(
        spark,
        sf_dir,
        "see /r/{k}.plan.md, file:///c:/w/B.plan.md and D:\\x\\c.plan.md or /R/{k}.PLAN.MD, not c:/w/q.plan.md nor a.plan.m",
        "file:///a%20b/c only",
        "\ufeff<!-- 0f8fad5b-d9cb-469f-a165-70867728950e --> in `D:\\work\\p q` or [it](e:/my code) or C:/no or `/posix/no`",
        'see C:\\My Docs\\x{k}.plan.md now, or "C:\\MY DOCS\\X{k}.PLAN.MD"',
        "'/home/a b/y.plan.md' and x/no.plan.md\nfile:///n/A.plan.md //no.plan.md",
        "0f8fad5b-d9cb-469f-a165-70867728950e is no comment",
    )
    own = F.when(F.col("event_id") % 6 == 1, F.array(F.lit(" '/own_b.plan.md' "), F.lit("/own.plan.md"), F.lit("/no.md")))
    return rows.select("event_id", F.array_join(plan_docs.plan_paths(F.col("doc"), own), ",").alias("plans"), F.array_join(plan_docs.workspace_hints(F.col("doc")), ",").alias("hints"), plan_docs.session_hint(F.col("doc")).alias("session"))


@query(f"""WITH {EVENTS}, s AS (SELECT *, event_id % 10 AS i, ['Cursor', 'ClaudeCode', 'GitHubCopilot'][user_id % 3 + 1] AS provider, max(CASE WHEN event_id % 10 = 6 AND k < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AS told FROM e)
    SELECT event_id, 'Updated' AS activity, CASE i WHEN 1 THEN '/h/plans/' || k || '.md' WHEN 2 THEN '/h/plans/e.md' END AS path, CASE i WHEN 0 THEN 'go ' || k WHEN 1 THEN 'w' END AS body, k % 2 = 0 AS successful, false AS there FROM s WHERE provider = 'ClaudeCode' AND i < 3
    UNION ALL SELECT event_id, 'Referenced', '/h/plans/m' || k || '.md', NULL, true, i = 8 FROM s WHERE provider = 'ClaudeCode' AND i > 7
    UNION ALL SELECT event_id, CASE WHEN i = 6 AND k % 2 = 1 THEN 'Created' ELSE 'Updated' END, CASE WHEN user_id % 2 = 0 THEN '/h/Plan.md' END, NULL, CASE WHEN i = 6 THEN true ELSE k % 3 > 0 END FROM s
        WHERE provider = 'GitHubCopilot' AND ((i = 6 AND k < 5) OR (NOT told AND (i = 3 OR (i = 5 AND user_id % 2 = 0))))
    UNION ALL SELECT event_id, CASE i WHEN 4 THEN 'Created' WHEN 5 THEN 'Updated' WHEN 7 THEN 'Referenced' END, CASE i WHEN 5 THEN '/c/x.plan.md' WHEN 7 THEN '/c/y.plan.md' END, CASE i WHEN 4 THEN '# made' END, true, false FROM s WHERE provider = 'Cursor' AND i IN (4, 5, 7)""".replace("k % 3 > 0 END FROM s", "k % 3 > 0 END, false FROM s"))
def plan_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's events take all the shapes; what belongs to another one's dialect says nothing."""
    rows = shaped(spark, sf_dir, '{"plan":"go {k}\\n"}', '{"content":"w"}', "{}", "{}", '{"plan":"# made"}', '{"path":"/c/x.plan.md"}', "", "look at /c/y.plan.md", '{"type":"plan_mode","planFilePath":"/h/plans/m{k}.md","plan_exists":true}', '{"type":"plan_mode_exit","plan_path":"/h/plans/m{k}.md"}')
    i = F.col("event_id") % 10
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i + 1).cast("int"))
    paths = F.when(i == 1, F.array(F.concat(F.lit("/h/plans/"), F.col("k").cast("string"), F.lit(".md")), F.lit("/h/readme.md"))).when(i == 2, F.array(F.lit("/h/plans/e.md"))).when(i == 5, F.array(F.lit("/h/PLAN.md"))).otherwise(F.array().cast("array<string>"))
    provider = F.element_at(F.array(*map(F.lit, ("Cursor", "ClaudeCode", "GitHubCopilot"))), (F.col("user_id") % 3 + 1).cast("int"))
    events = rows.select(
        provider.alias("provider"),
        F.col("user_id").alias("session"),
        "event_id",
        F.when(i == 7, "PromptSubmitted").when(i.isin(6, 8, 9), "Generic").otherwise("ToolRequest").alias("role"),
        pick("ExitPlanMode", "Write", "Edit", "update_plan", "CreatePlan", "edit_file", None, None, None, None).alias("tool"),
        pick("Task", "FileWrite", "FileEdit", "Task", "Task", "FileEdit", None, None, None, None).alias("tool_kind"),
        F.col("doc").alias("text"),
        paths.alias("paths"),
        F.when(provider == "ClaudeCode", F.when(F.col("k") % 2 == 0, "ToolSuccess")).when(F.col("k") % 3 == 0, "ToolFailure").alias("outcome"),
        F.when((i == 6) & (F.col("k") < 5), "Session.Plan_Changed").alias("native"),
        F.when(F.col("user_id") % 2 == 0, "/h/Plan.md").alias("plan_path"),
        F.when(F.col("k") % 2 == 1, "Create").alias("status"),
        F.when(i > 7, F.col("doc")).alias("attachment"),
    )
    return plan_docs.plan_activities(events).select("event_id", "activity", "path", "body", "successful", F.col("exists").alias("there"))


@query(f"""WITH {EVENTS}, d AS (SELECT *, {by_shape("'addRules, setMode'", "'once'", "NULL", "NULL", "NULL")} AS detail, {by_shape("NULL", "NULL", "'2 calls'", "'1 call'", "NULL")} AS batch, {by_shape("k", "k * 1000", "k * 61001", "k * 3700000", "-5")} AS ms_ FROM e),
    t AS (SELECT *, greatest(ms_, 0) AS n FROM d)
    SELECT event_id, concat_ws(' · ', 'Event', detail, CASE WHEN event_id % 10 = 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE
        CASE WHEN n >= 3600000 THEN (n // 3600000) || 'h ' || lpad(CAST(n // 60000 % 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(n // 1000 % 60 AS VARCHAR), 2, '0') || 's ' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || 'ms'
            WHEN n >= 60000 THEN (n // 60000) || 'm ' || lpad(CAST(n // 1000 % 60 AS VARCHAR), 2, '0') || 's ' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || 'ms' WHEN n >= 1000 THEN (n // 1000) || 's ' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || 'ms' ELSE n || 'ms' END END) AS header,
        batch, {by_shape("CAST(k AS VARCHAR)", "'1.5k'", "'12.35k'", "'2M'", "'1.02M'")} AS tokens, CASE event_id % 3 WHEN 0 THEN 'Bash · ls' WHEN 1 THEN 'Read · /a' END AS tool FROM t""")
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, '{"permission_suggestions":[{"type":"addRules"},{"x":1},{"type":"setMode"}]}', '{"permission_suggestions":{"type":"once"}}', '{"tool_calls":[1,2]}', '{"tool_calls":[{}]}', "{}")
    of = lambda *v: F.element_at(F.array(*v), (F.col("event_id") % len(v) + 1).cast("int"))
    k, lit, none = F.col("k"), lambda n: F.lit(n).cast("long"), F.lit(None).cast("string")
    ms = of(k, k * 1000, k * 61001, k * 3_700_000, lit(-5)).cast("double")
    return rows.select(
        "event_id",
        labels.occurrence_header(F.lit("Event"), labels.permission_detail(parsed()), F.col("ts").cast("timestamp"), F.col("event_id") % 10 == 5, ms).alias("header"),
        labels.batch_detail(parsed()).alias("batch"),
        labels.token_label(of(k, lit(1500), lit(12_345), lit(2_000_000), lit(1_015_001))).alias("tokens"),
        labels.tool_detail(of(F.lit("Bash"), F.lit("Read"), none), of(none, F.lit("/a"), F.lit("/b")), of(F.lit("ls"), F.lit(""), none)).alias("tool"),
    )
