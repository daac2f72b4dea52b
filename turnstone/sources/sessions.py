"""Session side files: prompt history, indexes, sub-agent metadata, workspace manifests, key-value stores, plans."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import yaml_text
from turnstone.functions.outcomes import status_outcome
from turnstone.functions.text import plan_body, unwrap_all
from turnstone.functions.times import epoch_timestamp


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def prompt_history(lines: DataFrame) -> DataFrame:
    """History rows (raw JSON lines) to a shell per session: project, first prompt, first and last time."""
    row = F.try_parse_json("raw")
    get = lambda n: F.try_variant_get(row, f"$.{n}", "string")
    rows = lines.select(get("sessionId").alias("session_id"), get("project").alias("project"), get("display").alias("display"), epoch_timestamp(get("timestamp").try_cast("double"), "claude").alias("ts"), "line_no")
    return rows.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max_by("project", "line_no").alias("project"), F.min_by("display", "line_no").alias("first_prompt"), F.min("ts").alias("started"), F.max("ts").alias("active"))


def session_index(files: DataFrame) -> DataFrame:
    """Index documents with an `entries` array to catalog hints."""
    entries = F.try_variant_get(F.try_parse_json("value"), "$.entries", "array<variant>")
    e = files.select("path", F.explode(entries).alias("e"))
    get = lambda n: F.try_variant_get("e", f"$.{n}", "string")
    return e.select("path", get("sessionId").alias("session_id"), get("summary").alias("summary"), get("firstPrompt").alias("first_prompt"), get("projectPath").alias("project"))


#: What a cache document tells of a session, by the spellings it may have: in its session object, and in the entry around it.
CACHE_SESSION = {"session_id": ("actual_session_id", "actualSessionId"), "file": ("file_path", "filePath"), "project": ("project_name", "projectName"), "summary": ("summary",), "entry_point": ("entrypoint",), "first_message": ("first_message_time", "firstMessageTime"), "last_message": ("last_message_time", "lastMessageTime"), "messages": ("message_count", "messageCount")}
CACHE_ENTRY = {"first_user_content": ("first_user_content", "firstUserContent"), "last_user_content": ("last_user_content", "lastUserContent"), "sidechains": ("sidechain_count", "sidechainCount")}


def session_cache(files: DataFrame) -> DataFrame:
    """Cache documents (path, value) whose `entries` is an object, by file, to catalog hints; entries without a session's own id are left out.

    A session's file is the one that it names, else its entry's name; files below a `subagents` folder are sub-agents'.
    """
    docs = files.select("path", F.try_variant_get(F.try_parse_json("value"), "$.entries", "variant").alias("entries")).where(F.schema_of_variant("entries").startswith("OBJECT"))
    each = docs.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("entries").outer())).select("path", F.col("key").alias("name"), F.col("value").alias("e"))
    told = lambda prefix, names: F.coalesce(*[F.try_variant_get("e", f"$.{prefix}{n}", "string") for n in names])
    got = each.select("path", "name", *[told("session.", names).alias(c) for c, names in CACHE_SESSION.items()], *[told("", names).alias(c) for c, names in CACHE_ENTRY.items()])
    file = F.coalesce("file", "name")
    counts = {c: F.col(c).try_cast("long") for c in ("messages", "sidechains")}
    times = {c: F.try_to_timestamp(c) for c in ("first_message", "last_message")}
    kept = got.where(F.trim("session_id") != "").withColumns({"file": file, "is_subagent": F.lower(file).rlike(r"[\\/]subagents[\\/]")} | counts | times)
    return kept.drop("name")


def subagent_meta(files: DataFrame) -> DataFrame:
    """`<session>/subagents/agent-<id>.meta.json` to (session_id, agent_id, agent_type, description)."""
    doc = F.try_parse_json("value")
    got = files.select("path", F.regexp_extract("path", r"([^/]+)/subagents/agent-([^/]+)\.meta\.json$", 1).alias("session_id"), F.regexp_extract("path", r"/subagents/agent-([^/]+)\.meta\.json$", 1).alias("agent_id"), F.try_variant_get(doc, "$.agentType", "string").alias("agent_type"), F.try_variant_get(doc, "$.description", "string").alias("description"))
    return got.where("agent_id <> ''")


def workspace_manifests(files: DataFrame) -> DataFrame:
    """`<workspace id>/workspace.json` to (workspace_id, folder)."""
    doc = F.try_parse_json("value")
    get = lambda n: F.try_variant_get(doc, f"$.{n}", "string")
    folder = F.regexp_replace(F.url_decode(F.coalesce(get("folder"), get("workspace"), get("workspacePath"))), "^file://", "")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.json$", 1).alias("workspace_id"), folder.alias("folder")).where("folder IS NOT NULL")


def workspace_folders(sessions: DataFrame, manifests: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """sessions with the folder that the manifest of their workspace id names; the first by path where several have the id."""
    one = manifests.where(F.col("workspace_id") != "").groupBy(F.col("workspace_id").alias("__id")).agg(F.min("folder").alias("folder"))
    return sessions.join(one, sessions[workspace] == one["__id"], "left").drop("__id")


#: Metadata names by the spellings that a session's YAML may have, without case and signs between words.
YAML_NAMES = {
    "id": ("id", "sessionid"),
    "cwd": ("cwd", "workingdirectory"),
    "git_root": ("gitroot",),
    "repository": ("repository", "repositoryname", "repo"),
    "branch": ("branch", "gitbranch"),
    "name": ("name", "title"),
    "summary": ("summary",),
    "client_name": ("clientname",),
    "host_type": ("hosttype",),
    "user_named": ("usernamed",),
    "summary_count": ("summarycount",),
    "fork_count": ("forkcount",),
    "created_at": ("createdat", "creationtime"),
    "updated_at": ("updatedat", "updatetime"),
}
#: A line of a flat document: blank, a comment, or a key and a value on one line that is no sign of more.
_FLAT = r"""(?:[ \t]*(?:#.*)?|[A-Za-z_][\w-]*[ \t]*:(?:[ \t]+(?:[^\s|>\[{&*!"'#%@`][^#]*|"[^"\\]*"|'[^']*'))?[ \t]*)"""


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _yaml_scalars(text: pd.Series) -> pd.Series:
    """The texts at the top of a YAML document by name; those of maps inside it by dotted names."""

    def scalars(doc, prefix: str = "") -> dict[str, str]:
        out = {}
        for k, v in doc.items() if isinstance(doc, dict) else ():
            if isinstance(v, dict):
                out |= scalars(v, f"{prefix}{k}.")
            elif isinstance(v, str):
                out[f"{prefix}{k}"] = v
        return out

    return text.map(lambda t: None if t is None or (doc := yaml_text.parse(t)) is None else scalars(doc))


def workspace_yaml(files: DataFrame) -> DataFrame:
    """Session YAML files (path, value) to one column per known name (YAML_NAMES), and `scalars`, all texts by name.

    Flat documents are read by column expressions: keys in any case, quotes dropped, comments left out, the first of a repeated key.
    Documents with blocks, flow or nested maps go through a YAML reader, in Arrow batches; one that it can't read is read as a flat one.
    """
    pairs = F.regexp_extract_all("value", F.lit(r"(?m)^([A-Za-z_][\w-]*)[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$"), F.lit(0))
    key = lambda p: F.trim(F.substring_index(p, ":", 1))
    value = lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"^[^:]*:", "")), r"""^(["'])(.*)\1$""", "$2")
    plain = F.transform(pairs, lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))
    flat = F.col("value").rlike(rf"\A(?:{_FLAT}\r?\n)*{_FLAT}\z")
    read = files.select("path", plain.alias("plain"), _yaml_scalars(F.when(~flat, F.col("value"))).alias("map"))
    rows = read.select("path", F.coalesce(F.map_entries("map"), "plain").alias("kv"))
    bare = lambda k: F.regexp_replace(F.lower(k), "[_-]", "")
    first = lambda n: F.get(F.transform(F.filter("kv", lambda e: bare(e["key"]) == n), lambda e: e["value"]), F.lit(0))
    once = F.filter("kv", lambda e, i: F.array_position(F.transform("kv", lambda x: x["key"]), e["key"]) == i + 1)
    return rows.select("path", *[F.coalesce(*map(first, names)).alias(c) for c, names in YAML_NAMES.items()], F.map_from_entries(once).alias("scalars"))


def composers(kv: DataFrame) -> DataFrame:
    """Key-value rows (db_path, table_name, key, value) of conversations to (composer_id, bubble_id, number, created)."""
    doc = F.try_parse_json("value")
    heads = kv.where(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("composer_id"), F.try_variant_get(doc, "$.createdAt", "double").alias("created"), F.posexplode_outer(F.try_variant_get(doc, "$.fullConversationHeadersOnly", "array<variant>")).alias("number", "h"))
    return heads.select("composer_id", F.try_variant_get("h", "$.bubbleId", "string").alias("bubble_id"), "number", epoch_timestamp(F.col("created"), "cursor").alias("created"))


#: Where lists of conversations' headers stand: keys of the item table, and the properties that hold the list; how a header names its conversation.
HEADER_KEYS, HEADER_LISTS, COMPOSER_IDS = ("composer.composerHeaders", "composer.composerData"), ("allComposers", "composerHeaders", "headers"), ("composerId", "composer_id", "id")
HEADER_FIELDS = {"name": ("name", "title"), "mode": ("unifiedMode", "forceMode", "mode"), "created": ("createdAt", "created_at"), "updated": ("lastUpdatedAt", "last_updated_at", "updatedAt")}


def composer_headers(kv: DataFrame) -> DataFrame:
    """(composer_id, name, mode, created, updated, sources) of conversations by the headers that a key-value table (table_name, key, value) has of them.

    Headers stand in lists under HEADER_KEYS, or one by one in a table composerHeaders, whose key must then be the conversation's own id. Several
    headers of a conversation are one: of each field what the last updated one tells that tells it. Objects without an id are left out.
    """
    doc = F.try_parse_json("value")
    alone = F.col("table_name") == "composerHeaders"
    listed = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), *[F.try_variant_get(doc, f"$.{n}", "array<variant>") for n in HEADER_LISTS])
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    headers = F.coalesce(listed, F.when(is_object(doc), F.array(doc)), F.array().cast("array<variant>"))
    rows = kv.where(alone | F.col("key").isin(*HEADER_KEYS)).select(F.when(alone, F.col("key")).alias("own"), F.explode(headers).alias("h")).where(is_object(F.col("h")))
    get = lambda names: F.coalesce(*[F.try_variant_get("h", f"$.{n}", "string") for n in names])
    told = rows.withColumn("composer_id", F.coalesce(get(COMPOSER_IDS), "own")).where("trim(composer_id) <> '' AND (own IS NULL OR own = composer_id)")
    time = lambda c: epoch_timestamp(get(HEADER_FIELDS[c]).try_cast("double"), "cursor")
    each = told.select("composer_id", *[F.nullif(F.trim(get(HEADER_FIELDS[c])), F.lit("")).alias(c) for c in ("name", "mode")], *[time(c).alias(c) for c in ("created", "updated")])
    at = lambda c: F.struct(F.col(c).isNotNull(), F.coalesce(F.unix_micros("updated"), F.lit(-1)), F.col(c))
    return each.groupBy("composer_id").agg(*[F.max_by(c, at(c)).alias(c) for c in HEADER_FIELDS], F.count(F.lit(1)).alias("sources"))


def bubbles(kv: DataFrame) -> DataFrame:
    """Bubble rows to (composer_id, bubble_id, role, text, tool_name, tool_call_id)."""
    doc = F.try_parse_json("value")
    get = lambda n: F.try_variant_get(doc, f"$.{n}", "string")
    rows = kv.where(F.col("key").startswith("bubbleId:"))
    role = F.when(get("toolFormerData.name").isNotNull(), "ToolRequest").when(get("type") == "1", "PromptSubmitted").otherwise("AgentResponse")
    return rows.select(F.split("key", ":")[1].alias("composer_id"), F.split("key", ":")[2].alias("bubble_id"), role.alias("role"), get("text").alias("text"), get("toolFormerData.name").alias("tool_name"), get("toolFormerData.toolCallId").alias("tool_call_id"))


#: Where a conversation has its headers; how its rows spell what they tell; words of a tool's status.
HEADERS = ("fullConversationHeadersOnly", "conversationHeaders", "fullConversation", "conversation")
SPELLINGS = {
    "bubble_id": ("bubbleId", "bubble_id", "id"),
    "type": ("type", "bubbleType"),
    "request": ("requestId", "request_id", "generationId", "generation_id"),
    "step": ("modelCallId", "model_call_id", "messageId", "message_id"),
    "tool": ("name", "toolName", "tool_name"),
    "call": ("toolCallId", "tool_call_id", "toolUseId", "tool_use_id", "id"),
    "status": ("status", "state"),
    "arguments": ("rawArgs", "arguments", "input", "params"),
    "tool_ms": ("durationMs", "duration_ms", "duration"),
    "tool_result": ("result", "output", "error", "content"),
    "result": ("result", "output", "error", "text"),
}
TYPES, TEXTS = {"1": "user", "2": "assistant", "user": "user", "assistant": "assistant", "ai": "assistant"}, ("text", "richText", "thinking", "content", "message", "output")


def _said(v, depth: int = 0) -> str | None:
    """A text itself, the texts of an array by lines, of an object the first of TEXTS that says something; eight levels deep."""
    if depth > 8 or isinstance(v, str):
        return v if isinstance(v, str) and depth <= 8 else None
    if isinstance(v, list):
        lines = [t for x in v if (t := _said(x, depth + 1)) and t.strip()]
        return "\n".join(lines) or None
    if isinstance(v, dict):
        return next((t for n in TEXTS if n in v and (t := _said(v[n], depth + 1)) and t.strip()), None)
    return None


@F.pandas_udf(T.StringType())
def content_text(raw: pd.Series) -> pd.Series:
    """What a JSON text says."""

    def one(r: str | None) -> str | None:
        try:
            return None if r is None else _said(json.loads(r))
        except ValueError:
            return None

    return raw.map(one)


def bubble_events(kv: DataFrame) -> DataFrame:
    """(composer_id, turn_no, turn_id, pos, bubble_id, role, step, tool, call, status, text, duration_ms, aborted) of conversations in a key-value table.

    Headers give the order; a header without a row of its own is one itself. A user's row opens a turn, which its request names, else its number;
    rows before any belong to the first. An assistant's row tells its blocks of thought, then a tool's call and what came of it, or else its
    text, which may be a thought. Rows that say neither are left out. pos: from 0 in a conversation.
    """
    doc = F.try_parse_json("value")
    get = lambda v, *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])
    heads = kv.where(F.col("key").startswith("composerData:")).select(F.substring_index("key", ":", -1).alias("composer_id"), doc.alias("doc"))
    listed = heads.select("composer_id", F.posexplode(F.coalesce(*[F.try_variant_get("doc", f"$.{h}", "array<variant>") for h in HEADERS])).alias("number", "h"))
    own = kv.where(F.col("key").startswith("bubbleId:")).select(F.split("key", ":")[1].alias("composer_id"), F.regexp_extract("key", "^bubbleId:[^:]*:(.*)$", 1).alias("bubble_id"), doc.alias("row"))
    # sizes after lists are exploded are guessed far too low, so neither side may be broadcast
    joined = listed.withColumn("bubble_id", get("h", *SPELLINGS["bubble_id"])).join(own.hint("merge"), ["composer_id", "bubble_id"], "left")
    b = joined.withColumns({"b": F.coalesce("row", "h"), "bubble_id": F.coalesce("bubble_id", F.concat(F.lit("header:"), F.col("number").cast("string")))})
    typed = F.coalesce(get("h", *SPELLINGS["type"]), get("b", *SPELLINGS["type"]))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv_ in TYPES.items() for x in kv_]), F.lower(typed)), F.lower(F.coalesce(get("h", "role"), get("b", "role"))))
    kinds = b.withColumns({"kind": kind, "t": F.try_variant_get("b", "$.toolFormerData", "variant")}).where("kind IN ('user', 'assistant')")
    # only an object is read as one, whatever it has inside
    has_tool = F.col("t").isNotNull() & F.try_variant_get("t", "$", "struct<name: variant>").isNotNull()
    result = F.coalesce(*[F.when(F.trim(c) != "", c) for c in (get("t", *SPELLINGS["tool_result"]), get("b", *SPELLINGS["result"]))])
    thought = F.coalesce(get("b", "isThought", "is_thought") == "true", F.lit(False)) | F.coalesce(F.trim(get("b", "thinking")) != "", F.lit(False)) | F.coalesce(F.lower(get("b", "bubbleType", "kind")) == "thought", F.lit(False))
    # a text with a visible sign is what the row says; other rows are looked through by a reader, unless a tool's row, whose text isn't told
    own_text = F.try_variant_get("b", "$.text", "variant")
    plain = F.when(get("b", "text").rlike(r"[!-~]") & (F.schema_of_variant(own_text) == "STRING"), get("b", "text"))
    blocks = F.when(F.try_variant_get("b", "$.allThinkingBlocks", "array<variant>").isNotNull(), F.to_json(F.try_variant_get("b", "$.allThinkingBlocks", "variant")))
    # what variants tell is taken out of them once, so that windows and events below handle plain columns
    rows = kinds.select(
        "composer_id", "number", "bubble_id", "kind", has_tool.alias("has_tool"), plain.alias("plain"), thought.alias("thought"), result.alias("result"), F.when(plain.isNull() & ((F.col("kind") == "user") | ~has_tool), F.to_json("b")).alias("raw"), blocks.alias("blocks"),
        F.coalesce(get("h", *SPELLINGS["request"]), get("b", *SPELLINGS["request"])).alias("request"), F.coalesce(get("t", "modelCallId", "model_call_id"), get("b", *SPELLINGS["step"])).alias("step"),
        *[get("t", *SPELLINGS[c]).alias(c) for c in ("tool", "call", "status", "arguments")], get("t", *SPELLINGS["tool_ms"]).try_cast("double").alias("tool_ms"), get("b", "durationMs", "duration_ms").try_cast("double").alias("ms"),
    )
    rows = rows.withColumns({"text": content_text("raw"), "said": _block_texts("blocks")}).withColumns({"text": F.coalesce("plain", "text"), "said": F.coalesce(F.from_json("said", "array<string>"), F.array().cast("array<string>"))}).drop("plain", "raw", "blocks")
    status, outcome = F.col("status"), status_outcome(F.col("status"))
    none = F.lit(None).cast("string")
    event = lambda role, said, how=none, took=F.lit(None).cast("double"), of_tool=False: F.struct(role.alias("role"), said.alias("text"), how.alias("status"), took.alias("duration_ms"), F.lit(of_tool).alias("of_tool"))
    result_role = F.when(outcome == "failure", "ToolFailure").when(outcome == "success", "ToolSuccess").otherwise("Message")
    thoughts = F.transform("said", lambda x: event(F.lit("AgentThought"), x))
    by_tool = F.array(event(F.lit("ToolRequest"), F.col("arguments"), status, of_tool=True), F.when(outcome.isNotNull() | F.col("result").isNotNull(), event(result_role, F.col("result"), status, F.col("tool_ms"), True)))
    by_text = F.array(F.when(F.trim("text") != "", event(F.when(F.col("thought"), "AgentThought").otherwise("AgentResponse"), F.col("text"), took=F.when(F.col("thought"), F.col("ms")))))
    told = F.when(F.col("kind") == "user", F.array(event(F.lit("PromptSubmitted"), unwrap_all(F.coalesce("text", F.lit("")))))).otherwise(F.concat(thoughts, F.when(F.col("has_tool"), by_tool).otherwise(by_text)))
    rows = rows.select("composer_id", "number", "kind", "request", "bubble_id", "step", "tool", "call", F.filter(told, lambda e: e.isNotNull()).alias("told"))
    # one order for all: turns, the request of the row that opens each, and how many events come before
    w = Window.partitionBy("composer_id").orderBy("number")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    users = F.count_if(F.col("kind") == "user").over(upto)
    rows = rows.withColumns({"users": users, "nth_row": F.row_number().over(w), "before": F.sum(F.size("told")).over(upto) - F.size("told")})
    opens = (F.col("nth_row") == 1) | ((F.col("kind") == "user") & (F.col("users") > 1))
    rows = rows.withColumns({"turn_no": F.greatest(F.lit(1), "users"), "turn_request": F.last(F.when(opens, F.struct("request")), ignorenulls=True).over(upto)["request"]})
    each = rows.select("composer_id", "turn_no", "turn_request", "before", "bubble_id", "step", "tool", "call", F.posexplode("told").alias("nth", "e"))
    only = lambda c: F.when(F.col("e.of_tool"), F.col(c)).alias(c)
    return each.select(
        "composer_id", "turn_no", F.coalesce("turn_request", F.concat(F.lit("turn-"), F.col("turn_no").cast("string"))).alias("turn_id"), (F.col("before") + F.col("nth")).cast("int").alias("pos"), "bubble_id", "e.role", "step", only("tool"), only("call"), "e.status", "e.text", "e.duration_ms",
        (F.coalesce(F.lower("e.status") == "rejected", F.lit(False)) & (F.col("e.role") != "ToolRequest")).alias("aborted"),
    )


@F.pandas_udf(T.StringType())
def _block_texts(blocks: pd.Series) -> pd.Series:
    """What the blocks of a JSON array say, blank ones left out, as a JSON array."""
    return blocks.map(lambda raw: None if raw is None else json.dumps([t for x in json.loads(raw) if (t := _said(x)) and t.strip()]))


def plan_files(files: DataFrame) -> DataFrame:
    """Plan documents: path, modified, title (first heading), body (without front matter) and its hash."""
    text = F.regexp_replace("value", r"(?s)\A\x{feff}?---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    rows = files.select("path", "modified", plan_body(text).alias("body"), F.nullif(F.regexp_extract(text, r"(?m)^# +(.+?)[ \r]*$", 1), F.lit("")).alias("title"))
    return rows.withColumn("body_hash", F.sha2("body", 256))
