"""How calls of each provider went, which thoughts can't be read, and what a call is attributed to, from VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.payloads import kind, text

#: Signs of a failed result of the first provider: part, property, and what it says.
FAILED = (
    ("block", "is_error", True), ("block", "isError", True), ("row", "is_error", True), ("row", "isError", True), ("row", "interrupted", True),
    ("result", "interrupted", True), ("result", "is_error", True), ("result", "isError", True), ("result", "success", False),
)
DENIED, RESULT, ERROR_START = "toolDenialKind", "toolUseResult", "error:"
#: Words of the third provider's statuses.
STATUS_WORDS = {"failure": ("error", "failed", "failure", "rejected"), "success": ("success", "succeeded", "completed", "complete")}
#: Where a thought's text is, and what stands in its place where it can't be read.
READABLE, OPAQUE = ("thinking", "text"), {"ClaudeCode": ("signature",), "GitHubCopilot": ("reasoningOpaque", "encryptedContent")}
#: Where a call names what it is attributed to, and the names of an object there.
ATTRIBUTED, NAMES = {"server": "attributionMcpServer", "tool": "attributionMcpTool", "skill": "attributionSkill"}, ("name", "skillName", "toolName", "serverName")
SKILL_ARGUMENTS, SKILL_NAMES = ("tool_input", "input", "toolArgs"), ("skill", "skillName", "skill_name")


def _flag(doc: Column, name: str, value: bool) -> Column:
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "boolean") == F.lit(value), F.lit(False))


def _told(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def result_failed(row: Column, block: Column) -> Column:
    """Whether a tool's result of the first provider tells a failure: row and block of its transcript."""
    parts = {"row": row, "block": block, "result": F.try_variant_get(row, f"$.{RESULT}", "variant")}
    signs = [_flag(parts[part], name, value) for part, name, value in FAILED]
    said = F.coalesce(F.lower(F.when(kind(row, RESULT) == "STRING", text(row, RESULT))).startswith(ERROR_START), F.lit(False))
    error = F.coalesce(kind(parts["result"], "error") != "VOID", F.lit(False))
    return F.greatest(*signs, _told(text(row, DENIED)), said, error)


def result_status(row: Column, block: Column) -> Column:
    """denied, interrupted, failure or success."""
    interrupted = F.greatest(_flag(block, "interrupted", True), _flag(row, "interrupted", True), _flag(F.try_variant_get(row, f"$.{RESULT}", "variant"), "interrupted", True))
    return F.when(_told(text(row, DENIED)), "denied").when(interrupted, "interrupted").when(result_failed(row, block), "failure").otherwise("success")


def status_outcome(status: Column) -> Column:
    """failure or success by a status of the third provider; null for other ones."""
    low = F.lower(status)
    out = F.lit(None).cast("string")
    for name, words in STATUS_WORDS.items():
        out = F.when(low.isin(*words), name).otherwise(out)
    return out


def is_opaque(provider: str, block_type: Column, block: Column) -> Column:
    """Whether a thought is there but can't be read."""
    readable = F.greatest(*[_told(text(block, n)) for n in (*READABLE, *(("content", "reasoningText") if provider == "GitHubCopilot" else ()))], F.lit(False))
    hidden = F.greatest(*[_told(text(block, n)) for n in OPAQUE[provider]], F.lit(False))
    return F.coalesce(block_type == "redacted_thinking", F.lit(False)) | (~readable & hidden)


def _attribution(doc: Column, name: str) -> Column:
    inner = F.coalesce(*[F.when(_told(text(doc, f"{name}.{n}")), text(doc, f"{name}.{n}")) for n in NAMES])
    return F.when(kind(doc, name) == "STRING", text(doc, name)).otherwise(inner)


def attributed(what: str, *parts: Column) -> Column:
    """What a call is attributed to (server, tool or skill): the first of its parts (block, message, row) that tells it."""
    return F.coalesce(*[_attribution(p, ATTRIBUTED[what]) for p in parts])


def mcp_identity(tool: Column, *parts: Column) -> Column:
    """server and tool of an MCP call of the first provider: by attribution, else by the parts of its name."""
    split = lambda i: F.nullif(F.regexp_extract(tool, r"(?s)^mcp__(.+?)__(.*)$", i), F.lit(""))
    rest = F.when(split(1).isNotNull(), F.regexp_extract(tool, r"(?s)^mcp__(.+?)__(.*)$", 2))
    return F.struct(F.coalesce(attributed("server", *parts), split(1)).alias("server"), F.coalesce(attributed("tool", *parts), rest).alias("tool"))


def invoked_skill(tool: Column, payload: Column) -> Column:
    """The skill that a call of the tool Skill (in any case) names in its arguments, an object or one that is written in a text."""
    args = [F.try_variant_get(payload, f"$.{a}", "variant") for a in SKILL_ARGUMENTS]
    objects = [F.coalesce(F.try_parse_json(F.when(kind(payload, a) == "STRING", text(payload, a))), v) for a, v in zip(SKILL_ARGUMENTS, args, strict=True)]
    name = F.coalesce(*[F.when(_told(text(o, n)), F.trim(text(o, n))) for o in objects for n in SKILL_NAMES])
    return F.when(F.lower(tool) == "skill", name)
