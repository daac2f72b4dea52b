"""Queries over texts, tools and native names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone import dims
from turnstone.functions import paths, text, times, tools
from turnstone.operators import catalog, plan_docs, search
from turnstone.plans.adapters import OBSERVATIONS_SQL, observations, table
from turnstone.plans.registry import query

#: A native event of each surface that an event type of the table stands for.
NATIVE = {
    "signup": ("beforeSubmitPrompt", "UserPromptSubmit", "userPromptSubmitted", "UserPromptSubmit"),
    "click": ("preToolUse", "PreToolUse", "preToolUse", "PreToolUse"),
    "purchase": ("postToolUse", "SubagentStart", "postToolUse", "PostToolUse"),
    "error": ("afterMCPExecution", "CwdChanged", "postToolUseFailure", "errorSeen"),
    "view": ("beforeTabFileRead", "SessionEnd", "afterWhatever", "beforeNothing"),
}
_NATIVE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(n) for n in v)}][user_id % 4 + 1]" for k, v in NATIVE.items()) + " END"
#: What each of the twenty has to give, written out: (surface, native event, role, scope override, direction, tone, match strategy, opens).
_EXPECTED = """('CursorIde', 'beforeSubmitPrompt', 'PromptSubmitted', '', 'Input', 'Normal', 'None', ''), ('ClaudeCode', 'UserPromptSubmit', 'PromptSubmitted', '', 'Input', 'Normal', 'None', ''),
    ('CopilotCli', 'userPromptSubmitted', 'PromptSubmitted', '', 'Input', 'Normal', 'None', ''), ('VsCodeAgentHooks', 'UserPromptSubmit', 'PromptSubmitted', '', 'Input', 'Normal', 'None', ''),
    ('CursorIde', 'preToolUse', 'ToolRequest', '', 'Input', 'Normal', 'None', 'tool'), ('ClaudeCode', 'PreToolUse', 'ToolRequest', '', 'Input', 'Normal', 'None', 'tool'),
    ('CopilotCli', 'preToolUse', 'ToolRequest', '', 'Input', 'Normal', 'None', 'tool'), ('VsCodeAgentHooks', 'PreToolUse', 'ToolRequest', '', 'Input', 'Normal', 'None', 'tool'),
    ('CursorIde', 'postToolUse', 'ToolSuccess', '', 'Output', 'Normal', 'ToolCallId', ''), ('ClaudeCode', 'SubagentStart', 'SubagentStart', '', 'Input', 'Normal', 'None', 'subagent'),
    ('CopilotCli', 'postToolUse', 'ToolSuccess', '', 'Output', 'Normal', 'ToolSignature', ''), ('VsCodeAgentHooks', 'PostToolUse', 'ToolSuccess', '', 'Output', 'Normal', 'ToolCallId', ''),
    ('CursorIde', 'afterMCPExecution', 'InnerExecutionEnd', '', 'Output', 'Mcp', 'ExecutionEvidence', ''), ('ClaudeCode', 'CwdChanged', 'WorkingDirectoryChange', '', 'None', 'Normal', 'None', ''),
    ('CopilotCli', 'postToolUseFailure', 'ToolFailure', '', 'Output', 'Failure', 'ToolSignature', ''), ('VsCodeAgentHooks', 'errorSeen', 'Generic', '', 'None', 'Normal', 'None', ''),
    ('CursorIde', 'beforeTabFileRead', 'Generic', 'Tab', 'Input', 'Normal', 'None', ''), ('ClaudeCode', 'SessionEnd', 'SessionEnd', 'SessionLifecycle', 'None', 'Normal', 'None', ''),
    ('CopilotCli', 'afterWhatever', 'Generic', '', 'None', 'Normal', 'None', ''), ('VsCodeAgentHooks', 'beforeNothing', 'Generic', '', 'None', 'Normal', 'None', '')"""


@query(f"""
    WITH e AS (SELECT event_id, ['CursorIde', 'ClaudeCode', 'CopilotCli', 'VsCodeAgentHooks'][user_id % 4 + 1] AS surface, {_NATIVE_SQL} AS native_event, CASE WHEN user_id % 3 > 0 THEN user_id END AS turn FROM events),
    d(surface, native_event, role, scope_override, direction, tone, match_strategy, opens) AS (VALUES {_EXPECTED})
    SELECT event_id, surface, native_event, role, coalesce(nullif(scope_override, ''), CASE WHEN turn IS NULL THEN 'Session' ELSE 'Turn' END) AS scope,
        direction, tone, match_strategy, opens = 'tool' AS opens_tool, opens = 'subagent' AS opens_subagent FROM e JOIN d USING (surface, native_event)""")
def event_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnstone.operators.interpret import interpret

    e = table(spark, sf_dir, "events")
    names = F.element_at(F.create_map(*[x for k, v in NATIVE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("event_type"))
    rows = e.select("event_id", F.element_at(F.array(*map(F.lit, dims.SURFACES[1:])), (F.col("user_id") % 4 + 1).cast("int")).alias("surface"), F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("native_event"), F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("turn"))
    return interpret(rows, "surface", "native_event", "turn").drop("turn")


#: All events of all surfaces, in order; each row of the table is one of them.
_ALL = [(surface, *row) for surface, rows in dims.EVENTS.items() for row in rows]


@query(f"""
    WITH d(i, surface, native_event, role, scope_override, direction, tone, match_strategy, opens) AS (VALUES {", ".join(f"({i}, " + ", ".join(f"'{v}'" for v in row) + ")" for i, row in enumerate(_ALL))})
    SELECT event_id, surface, native_event, role, coalesce(nullif(scope_override, ''), 'Turn') AS scope, direction, tone, match_strategy, opens = 'tool' AS opens_tool, opens = 'subagent' AS opens_subagent FROM events JOIN d ON i = event_id % {len(_ALL)}""")
def all_event_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that is known, interpreted; the table of traits stands on both sides, so this holds the lookup and the scope, not the table."""
    from turnstone.operators.interpret import interpret

    pick = lambda n: F.element_at(F.array(*[F.lit(r[n]) for r in _ALL]), (F.col("event_id") % len(_ALL) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(0).alias("surface"), pick(1).alias("native_event"), F.lit(1).cast("long").alias("turn"))
    return interpret(rows, "surface", "native_event", "turn").drop("turn")


#: Tool names in the spellings that the table's keys are dealt to.
SPELLINGS = ("Shell", "read_file_v2", "Write", "apply_patch", "mcp__git__log", "MCP:fetch", "GetDynamicTools", "grep", "Unheard", "edit_file_v2", "mcp-docs-search", "TodoWrite")


@query(f"""
    WITH e AS (SELECT event_id, {list(SPELLINGS)}[CAST(json_extract_string(props, '$.k') AS BIGINT) % {len(SPELLINGS)} + 1] AS tool FROM events),
    k AS (SELECT *, CASE WHEN lower(tool) LIKE 'mcp:%' OR lower(tool) LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'Mcp' WHEN tool = 'Shell' THEN 'Shell' WHEN tool = 'Write' THEN 'FileWrite' WHEN tool = 'apply_patch' THEN 'FileEdit'
        WHEN tool = 'grep' THEN 'TextSearch' WHEN tool = 'TodoWrite' THEN 'Task' ELSE 'Unknown' END AS kind,
        CASE tool WHEN 'read_file_v2' THEN 'FileRead' WHEN 'edit_file_v2' THEN 'FileEdit' END AS alias FROM e)
    SELECT event_id, tool, kind, coalesce(alias, kind) AS alias_kind, CASE tool WHEN 'mcp__git__log' THEN 'git' END AS server, CASE tool WHEN 'mcp__git__log' THEN 'log' END AS mcp_tool,
        CASE WHEN tool = 'GetDynamicTools' THEN 'discovery' WHEN tool = 'MCP:fetch' THEN 'mcp:fetch' WHEN tool = 'mcp__git__log' THEN 'mcp:log' WHEN coalesce(alias, kind) IN ('FileWrite', 'FileEdit') THEN 'file-mutate' ELSE 'kind:' || coalesce(alias, kind) END AS correlation_key FROM k""")
def tool_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, SPELLINGS)), (k % len(SPELLINGS) + 1).cast("int")).alias("tool"))
    name = F.col("tool")
    rows = rows.withColumns({"kind": tools.tool_kind(name), "alias_kind": tools.alias_kind(name), "server": tools.mcp_server(name), "mcp_tool": tools.mcp_tool(name)})
    return rows.withColumn("correlation_key", tools.correlation_key(F.col("kind"), name, F.col("server"), F.col("mcp_tool")))


#: Prompts and thoughts of the shapes that the rules tell apart; {n} stands for the row's number.
_SAID = (
    "/run-{n} now, /Review! /run-{n} x/y /REVIEW",
    "a/b/c //x /-no /yes_{n}? (/in) /end",
    "<user_query>do /this-{n}</user_query> /not",
    "http://host/path /ünï-{n}; /1st",
    "use code-review-{n} skill and Unit-test skills, my-own_x skill",
    "the fast-{n} **skill** and Fast-{n} skill; plain skill",
    "nothing here {n}",
)


@query("""
    WITH s AS (SELECT conv_id, turn, CAST(conv_id * 100 + turn AS VARCHAR) AS n, (conv_id * 100 + turn) % 7 AS i FROM conversations)
    SELECT conv_id, turn, ['/run-' || n || ',/Review', '/yes_' || n || ',/end', '/this-' || n, '/ünï-' || n || ',/1st', '', '', ''][i + 1] AS commands,
        ['', '', '', '', 'code-review-' || n || ',unit-test', 'fast-' || n, ''][i + 1] AS skills FROM s""")
def slash_and_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id") * 100 + F.col("turn")
    said = F.replace(F.element_at(F.array(*map(F.lit, _SAID)), (n % len(_SAID) + 1).cast("int")), F.lit("{n}"), n.cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("t"))
    return rows.select("conv_id", "turn", F.array_join(text.slash_commands(F.col("t")), ",").alias("commands"), F.array_join(text.skill_mentions(F.col("t")), ",").alias("skills"))


@query(r"""
    SELECT conv_id, turn, CASE WHEN length(f) > 60 THEN substr(f, 1, 60) || '…' ELSE f END AS preview, sha256(f) AS normal_hash, sha256(replace(text, chr(13), chr(10))) AS lines_hash
    FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM conversations)""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat("text", F.lit(" [REDACTED] [REDACTED]"))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.preview(F.col("text"), 60).alias("preview"), F.sha2(text.normal_text(marked), 256).alias("normal_hash"), F.sha2(text.lines_only(F.col("text")), 256).alias("lines_hash"))


@query(r"""
    SELECT doc_id, sha256(b) AS body_hash, length(b) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\n+', ''), '\n+$', '') AS b FROM documents) WHERE b <> ''""")
def plan_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("b", text.plan_body(F.col("text")))
    return docs.where("b IS NOT NULL").select("doc_id", F.sha2("b", 256).alias("body_hash"), F.length("b").cast("long").alias("n"))


@query("""
    WITH h AS (SELECT source, lang, doc_id, sha256(text) AS h, n_chars % 11 = 0 AS opaque FROM documents),
    k AS (SELECT *, lag(h) OVER (PARTITION BY source, lang ORDER BY n_chars_key, doc_id) AS p FROM (SELECT *, h AS n_chars_key FROM h) WHERE NOT opaque),
    r AS (SELECT source, lang, count(*) FILTER (p IS NULL OR p <> h) AS revisions FROM k GROUP BY ALL)
    SELECT source, lang, coalesce(revisions, 0) AS revisions, greatest(0, coalesce(revisions, 0) - 1) AS updates, partial FROM (SELECT source, lang, bool_or(opaque) AS partial FROM h GROUP BY ALL) LEFT JOIN r USING (source, lang)""")
def plan_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    found = plan_docs.plan_revisions(docs, ["source", "lang"], ["h", "doc_id"], "h", F.col("n_chars") % 11 == 0)
    return found.select("source", "lang", "revisions", "updates", "partial")


@query("""
    WITH c AS (SELECT CASE WHEN d.doc_id % 3 = 0 THEN d.source ELSE 'd' || (d.doc_id // 2) END AS plan, l.quality AS session, ['directory', 'path', 'key', 'event'][d.doc_id % 4 + 1] AS reason, d.doc_id % 4 + 1 AS r FROM documents d JOIN labels l USING (doc_id))
    SELECT plan, CASE WHEN count(DISTINCT session) = 1 THEN min(session) END AS session, CASE WHEN count(DISTINCT session) = 1 THEN 'Bound' ELSE 'Ambiguous' END AS state,
        CASE WHEN count(DISTINCT session) > 1 THEN 'Ambiguous' ELSE ['Observed', 'Observed', 'Corroborated', 'Derived'][min(r)] END AS evidence FROM c GROUP BY plan""")
def ambiguous_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    reason = F.element_at(F.array(*[F.lit(r) for r, _ in plan_docs.REASONS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return plan_docs.bind_owner(docs.select(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("plan"), F.col("quality").alias("session"), reason.alias("reason")), "plan", "session", "reason")


@query("""
    WITH p AS (SELECT user, min(doc_id) AS plan FROM (SELECT doc_id, doc_id % 200 AS user FROM labels) GROUP BY user HAVING count(*) = 1)
    SELECT d.doc_id, d.doc_id % 200 AS user, plan FROM documents d JOIN p ON d.doc_id % 200 = user""")
def sole_plan_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 200).alias("user"))
    plans = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("plan"), (F.col("doc_id") % 200).alias("user"))
    return plan_docs.sole_plan(docs, plans, "user", "plan").select("doc_id", "user", "plan")


@query(r"""
    WITH r AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.conv_id = a.conv_id AND b.turn % 3 = 1 AND b.t = a.t)""")
def response_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts less those that the turns of every third number say in the same words."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return catalog.drop_equal_responses(said, said.where("turn % 3 = 1"), ["conv_id"], text.normal_text(F.col("text"))).select("conv_id", "turn")


@query("""
    SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 'name' WHEN contains(lower(lang), 'src1') OR contains('lang', 'src1') THEN 'field' WHEN contains(lower(text), 'src1') THEN 'payload' END AS match_target FROM documents
    WHERE contains(lower(source), 'src1') OR contains(lower(text), 'src1')
    UNION ALL SELECT doc_id, 'payload-2' FROM documents WHERE contains(lower(text), 'token =')""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("fields", F.create_map(F.lit("lang"), F.col("lang")))
    one = search.find(docs, "SRC1", "source", "fields", "text").select("doc_id", "match_target")
    two = search.find(docs, "token =", "source", "fields", "text").select("doc_id", F.concat("match_target", F.lit("-2")).alias("match_target"))
    return one.unionByName(two)


@query(f"""
    WITH {OBSERVATIONS_SQL}, h AS (SELECT DISTINCT path FROM obs WHERE contains(lower(path), '/9')) SELECT DISTINCT session, path FROM obs WHERE path IN (SELECT path FROM h)""")
def raw_source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    raw = obs.select("path", F.col("path").alias("raw"))
    return search.find_sources(raw, obs.select("session", "path"), "/9", "path", "raw", "session")


@query("""
    SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS seconds, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS iso FROM events""")
def native_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A native clock as epoch milliseconds in odd rows and as ISO text in even ones; an epoch in a unit by its size."""
    e = table(spark, sf_dir, "events")
    us = times.micros("ts")
    iso = F.col("event_id") % 2 == 0
    raw = F.when(iso, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.floor(us / 1000).cast("string"))
    scaled = times.epoch_timestamp(F.floor(us / 1_000_000).cast("double"), "cursor")
    return e.select("event_id", F.unix_millis(times.native_timestamp(raw)).alias("ms"), F.unix_seconds(scaled).alias("seconds"), iso.cast("int").alias("iso"))


@query(r"""
    WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '') AS p FROM pages)
    SELECT page_id, upper(least(p, 'c:/' || host)) || '|' || upper(greatest(p, 'c:/' || host)) AS workspace_key FROM u""")
def workspace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    own = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    roots = F.array(F.concat(F.lit(" "), own), F.concat(F.lit("/c:/"), host, F.lit("/")), own)
    return pages.select("page_id", paths.workspace_key(roots, F.lit(None).cast("string")).alias("workspace_key"))
