"""Transcript files: JSON lines with coordinates, and what a row of each dialect is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions.payloads import FAILURE_WORDS, is_failure
from turnstone.functions.times import native_timestamp


def read_lines(spark: SparkSession, path: str, generation: int = 0) -> DataFrame:
    """path, generation, line_no, byte_offset, raw of every non-blank line. A byte-order mark and CR are dropped."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return split_lines(whole, generation)


def split_lines(whole: DataFrame, generation: int = 0) -> DataFrame:
    """The same of rows (path, value) that hold a file each. A last line without a line end is included."""
    rows = whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0)).cast("long"))
    clean = F.regexp_replace(F.regexp_replace("raw", "\\A\ufeff", ""), r"\r\z", "")
    return rows.select("path", F.lit(generation).cast("long").alias("generation"), "line_no", "byte_offset", clean.alias("raw")).where(F.trim("raw") != "")


def dedupe_key(path: Column, generation: Column, offset: Column, block: Column) -> Column:
    """What makes a row of a file one row, however often it is read."""
    return F.concat_ws("·", F.upper(path), generation.cast("string"), offset.cast("string"), block.cast("string"))


def with_meta(lines: DataFrame) -> DataFrame:
    """Adds row (VARIANT), ts, turn_id, interaction_id, type and role, of the root or else of `data`."""
    got = lines.withColumn("row", F.try_parse_json("raw"))
    pick = lambda *names: F.coalesce(*[F.try_variant_get("row", f"$.{at}{n}", "string") for at in ("", "data.") for n in names])
    return got.withColumns(
        {
            "ts": native_timestamp(pick("timestamp")),
            "turn_id": pick("turnId", "promptId"),
            "interaction_id": pick("interactionId"),
            "type": pick("type"),
            "role": F.coalesce(pick("role"), F.try_variant_get("row", "$.message.role", "string")),
        }
    )


def _blocks(rows: DataFrame, at: str) -> DataFrame:
    """A row per content block (VARIANT `block`, number `block_no`); a row whose content is text is one text block."""
    items = F.try_variant_get("row", at, "array<variant>")
    text = F.try_variant_get("row", at, "string")
    some = F.when(items.isNotNull(), items).when(text.isNotNull(), F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), text.alias("text")))))
    return rows.select("*", F.posexplode_outer(some).alias("block_no", "block"))


def claude_events(lines: DataFrame) -> DataFrame:
    """Transcript rows with content blocks to events: text, thinking, tool requests and results, and usage."""
    rows = _blocks(with_meta(lines), "$.message.content")
    of = lambda n: F.try_variant_get("block", f"$.{n}", "string")
    kind = of("type")
    role = (
        F.when(kind == "tool_use", "ToolRequest")
        .when((kind == "tool_result") & (of("is_error") == "true"), "ToolFailure")
        .when(kind == "tool_result", "ToolSuccess")
        .when(kind.isin("thinking", "redacted_thinking"), "AgentThought")
        .when((kind == "text") & (F.col("role") == "user"), "PromptSubmitted")
        .when(kind == "text", "AgentResponse")
        .otherwise("Generic")
    )
    return rows.select(
        "path",
        "line_no",
        F.coalesce("block_no", F.lit(0)).alias("block_no"),
        F.try_variant_get("row", "$.sessionId", "string").alias("session_id"),
        "ts",
        F.col("turn_id").alias("prompt_id"),
        role.alias("event_role"),
        F.coalesce(of("id"), of("tool_use_id")).alias("tool_call_id"),
        of("name").alias("tool_name"),
        F.coalesce(of("text"), of("thinking"), of("content")).alias("text"),
        ((kind == "redacted_thinking") | ((kind == "thinking") & (F.coalesce(F.trim(of("thinking")), F.lit("")) == ""))).alias("opaque"),
        F.try_variant_get("row", "$.message.usage.input_tokens", "bigint").alias("input_tokens"),
        F.try_variant_get("row", "$.message.usage.output_tokens", "bigint").alias("output_tokens"),
        dedupe_key(F.col("path"), F.col("generation"), F.col("byte_offset"), F.coalesce("block_no", F.lit(0))).alias("dedupe_key"),
    )


#: Transcript row types of the event-family dialect.
FAMILIES = {
    "session.start": "SessionStart",
    "session.resume": "SessionStart",
    "session.shutdown": "SessionEnd",
    "user.message": "PromptSubmitted",
    "assistant.message": "AgentResponse",
    "assistant.reasoning": "AgentThought",
    "tool.execution_start": "ToolRequest",
    "tool.execution_complete": "ToolSuccess",
    "subagent.started": "SubagentStart",
    "subagent.completed": "SubagentStop",
}


def copilot_events(lines: DataFrame) -> DataFrame:
    """Event-family rows to events; an assistant message gives its text and each of its tool requests."""
    rows = with_meta(lines)
    requests = F.try_variant_get("row", "$.data.toolRequests", "array<variant>")
    rows = rows.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("variant")), F.coalesce(requests, F.array().cast("array<variant>")))).alias("block_no", "block"))
    data = lambda n: F.try_variant_get("row", f"$.data.{n}", "string")
    req = lambda n: F.try_variant_get("block", f"$.{n}", "string")
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.col("type")), F.lit("Generic"))
    role = F.when(F.col("block_no") > 0, "ToolRequest").when((role == "ToolSuccess") & (data("success") == "false"), "ToolFailure").otherwise(role)
    return rows.select("path", "line_no", "block_no", "ts", "turn_id", "interaction_id", role.alias("event_role"), F.coalesce(req("toolCallId"), data("toolCallId")).alias("tool_call_id"), F.coalesce(req("name"), data("toolName")).alias("tool_name"), F.when(F.col("block_no") == 0, F.coalesce(data("content"), data("error"))).alias("text"), dedupe_key(F.col("path"), F.col("generation"), F.col("byte_offset"), F.col("block_no")).alias("dedupe_key"))


#: What rows of the event-family dialect are, by their type: whole, by its beginning, or by a part of it; the first that fits. "?" stands
#: for a rule below that looks at more than the type.
RECORDS = FAMILIES | {
    "system.message": "?system",
    "assistant.turn_start": "Generic",
    "assistant.turn_end": "TurnStop",
    "assistant.message": "?message",
    "tool.user_requested": "ToolRequest",
    "tool.execution_start": "InnerExecutionStart",
    "tool.execution_complete": "?result",
    "permission.requested": "PermissionRequest",
    "permission.completed": "?permission",
    "permission.denied": "PermissionDenied",
    "session.error": "RuntimeError",
}
RECORD_STARTS, RECORD_PARTS = {"subagent.": "?subagent", "skill.": "InstructionsLoaded", "model.": "?model"}, {"compact": "?compaction"}
#: Stages of a skill by the type that tells them; any other one invokes it.
SKILL_STAGES = {"skill.available": "Available", "skill.attached": "Attached", "skill.loaded": "Loaded", "skill.completed": "ExecutionCorroborated", "skill.execution_completed": "ExecutionCorroborated"}
#: Where rows tell what they say and how they went.
SAID = ("content", "text", "reasoningText", "prompt", "message", "error")
HOW = ("status", "kind", "stopReason", "errorType", "statusCode", "trigger", "reason", "result.kind", "result.status")


def _family(kind: Column) -> Column:
    low, out = F.lower(kind), F.lit("Generic")
    for part, name in RECORD_PARTS.items():
        out = F.when(low.contains(part), name).otherwise(out)
    for start, name in RECORD_STARTS.items():
        out = F.when(kind.startswith(start), name).otherwise(out)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RECORDS.items() for x in kv]), kind), out)


def copilot_records(lines: DataFrame) -> DataFrame:
    """(path, line_no, pos, ts, role, native, agent_id, tool_call_id, tool_name, skill, stage, text, status, opaque, failed) of all families of the second provider's rows.

    An assistant's message gives its thought (one that can't be read is opaque and says nothing), each of its tool requests, and its answer, in this order;
    one that says nothing at all is Generic. Results, permissions, models, sub-agents and compactions are told apart by success, status and the words of their type.
    """
    rows = with_meta(lines)
    get = lambda *names: F.coalesce(*[F.try_variant_get("row", f"$.data.{n}", "string") for n in names])
    said = lambda *names: F.coalesce(*[F.when(F.trim(c) != "", c) for c in (F.try_variant_get("row", f"$.data.{n}", "string") for n in names)])
    family, kind = _family(F.col("type")), F.lower("type")
    data = F.try_variant_get("row", "$.data", "variant")
    how = get(*HOW)
    bad = F.greatest(*[F.coalesce(F.lower(how).contains(w), F.lit(False)) for w in FAILURE_WORDS])
    failed = F.coalesce(is_failure(data), F.lit(False))
    says = lambda *words: F.greatest(*[kind.contains(w) for w in words], F.lit(False))
    starts = kind.endswith(".started") | kind.endswith(".start")
    role = (
        F.when(family == "?system", F.when(get("role") == "system", "SystemPrompt").otherwise("Message"))
        .when(family == "?result", F.when(failed, "ToolFailure").otherwise("ToolSuccess"))
        .when(family == "?permission", F.when(bad, "PermissionDenied").otherwise("Generic"))
        .when(family == "?subagent", F.when(starts, "SubagentStart").otherwise("SubagentStop"))
        .when(family == "?model", F.when(says("failure", "error"), "RuntimeError").otherwise("Generic"))
        .when(family == "?compaction", F.when(says("complete", "end"), "CompactionEnd").otherwise("CompactionStart"))
        .otherwise(family)
    )
    none, no = F.lit(None).cast("string"), F.lit(False)
    event = lambda role, text, call=none, tool=none, opaque=no: F.struct(role.alias("role"), text.alias("text"), call.alias("call"), tool.alias("tool"), opaque.alias("opaque"))
    hidden = F.coalesce(get("reasoningOpaque", "encryptedContent").isNotNull(), no)
    thought = F.when(said("reasoningText").isNotNull(), event(F.lit("AgentThought"), said("reasoningText"))).when(hidden, event(F.lit("AgentThought"), none, opaque=F.lit(True)))
    of = lambda v, *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])
    asked = F.transform(F.coalesce(F.try_variant_get("row", "$.data.toolRequests", "array<variant>"), F.array().cast("array<variant>")), lambda r: event(F.lit("ToolRequest"), none, of(r, "toolCallId", "id"), of(r, "name", "toolName")))
    answer = F.when(said("content").isNotNull(), event(F.lit("AgentResponse"), said("content")))
    parts = F.filter(F.concat(F.array(thought), asked, F.array(answer)), lambda e: e.isNotNull())
    message = F.when(F.size(parts) > 0, parts).otherwise(F.array(event(F.lit("Generic"), none)))
    unread = (F.col("type") == "assistant.reasoning") & said("content", "text", "reasoningText").isNull()
    plain = F.array(event(role, F.when(~unread, said(*SAID)), get("toolCallId", "callId"), get("permissionRequest.toolName", "toolName", "name"), unread & hidden))
    each = rows.select("path", "line_no", "ts", F.col("type").alias("native"), F.try_variant_get("row", "$.agentId", "string").alias("row_agent"), get("agentId").alias("data_agent"), get("name", "skillName").alias("named"), how.alias("how"), failed.alias("bad_result"), F.posexplode(F.when(family == "?message", message).otherwise(plain)).alias("pos", "e"))
    skill = F.col("native").startswith("skill.")
    stage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SKILL_STAGES.items() for x in kv]), F.col("native")), F.lit("Invoked"))
    told = each.where(~skill | F.col("named").isNotNull())
    tool = F.when(~skill & ~F.col("native").startswith("subagent."), F.col("e.tool"))
    return told.select(
        "path", "line_no", "pos", "ts", "e.role", "native", F.coalesce("row_agent", "data_agent").alias("agent_id"), F.col("e.call").alias("tool_call_id"), tool.alias("tool_name"), F.when(skill, F.col("named")).alias("skill"), F.when(skill, stage).alias("stage"), "e.text", F.col("how").alias("status"), "e.opaque",
        ((F.col("e.role").isin("ToolFailure", "RuntimeError")) | ((F.col("e.role") == "SubagentStop") & F.col("bad_result"))).alias("failed"),
    )


def cursor_events(lines: DataFrame) -> DataFrame:
    """Role rows without ids or clock: text beside tool calls of an assistant row is a (heuristic) thought."""
    rows = _blocks(with_meta(lines), "$.message.content")
    of = lambda n: F.try_variant_get("block", f"$.{n}", "string")
    has_tool = F.coalesce(F.exists(F.try_variant_get("row", "$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use"), F.lit(False))
    role = (
        F.when(F.col("type") == "turn_ended", "TurnStop")
        .when(of("type") == "tool_use", "ToolRequest")
        .when(F.col("role") == "user", "PromptSubmitted")
        .when((of("type") == "thinking") | ((of("type") == "text") & has_tool), "AgentThought")
        .when(of("type") == "text", "AgentResponse")
        .otherwise("Generic")
    )
    return rows.select("path", "line_no", F.coalesce("block_no", F.lit(0)).alias("block_no"), role.alias("event_role"), of("name").alias("tool_name"), F.coalesce(of("text"), of("thinking")).alias("text"), F.try_variant_get("row", "$.status", "string").alias("status"), dedupe_key(F.col("path"), F.col("generation"), F.col("byte_offset"), F.coalesce("block_no", F.lit(0))).alias("dedupe_key"))


DIALECTS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude": claude_events, "copilot": copilot_events, "cursor": cursor_events}


def register_dialect(name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """A further dialect: lines (see read_lines) to events."""
    DIALECTS[name] = parser
