"""Session and turn summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import labels
from turnstone.functions.times import micros


def kpi_summary(events: DataFrame, by: list[str], turn: str, role: str, ts: str, duration: str, text: str, kind: str) -> DataFrame:
    """One row per session (or turn): turns, tools, failures, MCP calls, thoughts, compactions, durations, characters, wall time."""
    is_role = lambda *r: F.col(role).isin(*r)
    return events.groupBy(*by).agg(
        F.count_distinct(turn).alias("turns"),
        F.count_if(is_role("ToolRequest")).alias("tools"),
        F.count_if(is_role("ToolFailure")).alias("failures"),
        F.count_if(is_role("ToolRequest") & (F.col(kind) == "Mcp")).alias("mcp_calls"),
        F.count_if(is_role("AgentThought")).alias("thoughts"),
        F.count_if(is_role("CompactionStart", "CompactionEnd")).alias("compactions"),
        F.coalesce(F.sum(F.when(is_role("ToolSuccess", "ToolFailure"), F.col(duration))), F.lit(0.0)).alias("tool_ms"),
        F.coalesce(F.sum(F.when(is_role("PromptSubmitted"), F.length(text))), F.lit(0)).cast("long").alias("prompt_chars"),
        F.coalesce(F.sum(F.when(is_role("AgentResponse"), F.length(text))), F.lit(0)).cast("long").alias("response_chars"),
        ((micros(F.max(ts)) - micros(F.min(ts))) / 1000.0).alias("wall_ms"),
    )


def counted_durations(rows: DataFrame, by: list[str], name: str, request: Column, result: Column, duration: str) -> DataFrame:
    """by..., name, uses, duration_ms, share (percent of by's whole duration).

    uses: requests; a name that only its completions tell of counts once.
    """
    got = rows.groupBy(*by, name).agg(F.count_if(request).alias("__asked"), F.count_if(result).alias("__told"), F.sum(F.when(result, F.col(duration))).alias("__ms"))
    share = F.round(100 * F.col("__ms") / F.sum("__ms").over(Window.partitionBy(*by)), 2)
    uses = F.when(F.col("__asked") > 0, F.col("__asked")).otherwise(F.least(F.col("__told"), F.lit(1)))
    return got.select(*by, name, uses.alias("uses"), F.round("__ms", 2).alias("duration_ms"), share.alias("share"))


def file_access(rows: DataFrame, by: list[str], call: str, success: Column, request: Column, failure: Column, paths: str) -> DataFrame:
    """by..., paths: what calls that succeeded, or have no outcome yet, touched; distinct by case, sorted.

    A completion without a path has its request's, as both share the call.
    """
    calls = rows.groupBy(*by, call).agg(F.bool_or(success).alias("__ok"), F.bool_or(request).alias("__asked"), F.bool_or(failure).alias("__failed"), F.array_distinct(F.flatten(F.collect_list(paths))).alias("__paths"))
    kept = calls.where(F.col("__ok") | (F.col("__asked") & ~F.col("__failed"))).select(*by, F.explode("__paths").alias("__path"))
    one = kept.groupBy(*by, F.lower("__path").alias("__key")).agg(F.min("__path").alias("__path"))
    return one.groupBy(*by).agg(F.array_sort(F.collect_list("__path")).alias("paths"))


def access_by_kind(rows: DataFrame, by: list[str], kind: str, path: str) -> DataFrame:
    """Sorted distinct paths read, written or edited, and deleted."""
    pick = lambda *k: F.array_sort(F.collect_set(F.when(F.col(kind).isin(*k), F.col(path))))
    return rows.groupBy(*by).agg(pick("FileRead").alias("read"), pick("FileWrite", "FileEdit", "Notebook").alias("written"), pick("FileDelete").alias("deleted"))


#: Stages of a skill, in order.
STAGES = ("Available", "Mentioned", "Attached", "Loaded", "Invoked")


def skill_stages(evidence: DataFrame, by: list[str], skill: str, stage: str) -> DataFrame:
    """by..., skill (lower case), stages: distinct, in order of STAGES."""
    rank = F.array_position(F.array(*map(F.lit, STAGES)), F.col(stage))
    got = evidence.groupBy(*by, F.lower(skill).alias("skill")).agg(F.array_sort(F.collect_set(rank)).alias("__r"))
    return got.withColumn("stages", F.transform("__r", lambda r: F.element_at(F.array(*map(F.lit, STAGES)), r.cast("int")))).drop("__r")


def first_seen(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """by..., values: the distinct ones in the order they were first seen."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(F.struct(*order)).alias("__at"))
    got = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", value))).alias("__v"))
    return got.select(*by, F.transform("__v", lambda s: s[value]).alias("values"))


def subagents(rows: DataFrame, by: list[str], agent: str, order: list[str], type_: str, task: str, status: str, message: str, duration: str) -> DataFrame:
    """One row per sub-agent: first type and task, last status and message, last and summed duration."""
    at = F.struct(*order)
    have = lambda c: F.when(F.col(c).isNotNull(), at)
    return rows.groupBy(*by, agent).agg(
        F.min_by(type_, have(type_)).alias("type"),
        F.min_by(task, have(task)).alias("task"),
        F.max_by(status, have(status)).alias("status"),
        F.max_by(message, have(message)).alias("message"),
        F.max_by(duration, have(duration)).alias("last_ms"),
        F.sum(duration).alias("total_ms"),
    )


def badge(turns: Column, tools: Column, failures: Column) -> Column:
    """The short text of a session's figures; parts that are nought are left out."""
    part = lambda n, one, many: F.when(n == 1, F.lit(f"1 {one}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))
    return F.concat_ws(" · ", part(turns, "turn", "turns"), part(tools, "tool", "tools"), part(failures, "failure", "failures"))


def token_line(input_: Column, output: Column, cache_read: Column, cache_write: Column, reasoning: Column) -> Column:
    """A session's tokens in a line: those that it read (also none, where that is told), and the others that aren't none."""
    part = lambda name, n, told: F.when(told, F.concat(F.lit(f"{name} "), labels.token_label(n)))
    rest = (("out", output), ("cache r", cache_read), ("cache w", cache_write), ("reasoning", reasoning))
    return F.concat_ws(labels.SEPARATOR, part("in", input_, input_.isNotNull()), *[part(name, n, n > 0) for name, n in rest])


def kpi_list(figures: dict[str, Column], whole_session: bool) -> Column:
    """label and value of what a session or turn shows, in order; what is none is left out, but for turns and tools.

    figures: turns, aborted (turns; of a turn: 0 or 1), wall_ms, thoughts, thought_ms, thought_chars, mcp, tools, reads, writes, deletes, tokens (a line).
    """
    f = figures
    count = lambda n: n.cast("string")
    some = lambda n, value: F.when(n > 0, value)
    thoughts = F.concat(labels.token_label(f["thought_chars"]), F.lit(" ×"), count(f["thoughts"]), F.coalesce(some(f["thought_ms"], F.concat(F.lit(labels.SEPARATOR), labels.duration_label(f["thought_ms"]))), F.lit("")))
    items = [
        ("Turns", count(f["turns"]) if whole_session else None),
        ("Duration", some(f["wall_ms"], labels.duration_label(f["wall_ms"]))),
        ("Thoughts", some(f["thoughts"], thoughts)),
        ("MCP", some(f["mcp"], count(f["mcp"]))),
        ("Tools", count(f["tools"])),
        *[(name, some(f[name.lower()], count(f[name.lower()]))) for name in ("Reads", "Writes", "Deletes")],
        ("Tokens", F.nullif(f["tokens"], F.lit(""))),
        ("Aborted", some(f["aborted"], count(f["aborted"]))) if whole_session else ("Status", some(f["aborted"], F.lit("aborted"))),
    ]
    made = F.array(*[F.when(value.isNotNull(), F.struct(F.lit(name).alias("label"), value.alias("value"))) for name, value in items if value is not None])
    return F.filter(made, lambda x: x.isNotNull())


def aborted_turns(events: DataFrame, by: list[str], turn: str, stops: Column, aborted: Column) -> DataFrame:
    """by..., turns, aborted: how many turns a session has, and in how many a stop says that it was aborted."""
    bad = F.coalesce(stops & aborted, F.lit(False))
    return events.where(F.col(turn).isNotNull()).groupBy(*by).agg(F.count_distinct(turn).alias("turns"), F.count_distinct(F.when(bad, F.col(turn))).alias("aborted"))


def open_counts(rows: DataFrame, workspace: str) -> DataFrame:
    return rows.groupBy(workspace).agg(F.count(F.lit(1)).alias("opened"))


def hook_summary(observations: DataFrame, bindings: DataFrame, transcripts: DataFrame, by: list[str]) -> DataFrame:
    """by..., tools, failures, unmatched: figures of a session's hooks, with transcript tools that no hook stands for counted once.

    observations: by, event_id, role, excluded (out of the summary); bindings: by, call_id; transcripts: by, call_id, role.
    """
    seen = observations.where(~F.coalesce("excluded", F.lit(False))).groupBy(*by).agg(F.count_if(F.col("role") == "ToolRequest").alias("__t"), F.count_if(F.col("role") == "ToolFailure").alias("__f"))
    calls = transcripts.groupBy(*by, "call_id").agg(F.max((F.col("role") == "ToolFailure").cast("int")).alias("__failed"))
    alone = calls.join(bindings.select(*by, "call_id").distinct(), [*by, "call_id"], "left_anti")
    more = alone.groupBy(*by).agg(F.count(F.lit(1)).alias("unmatched"), F.sum("__failed").alias("__g"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return seen.join(more, by, "full").select(*by, (n("__t") + n("unmatched")).alias("tools"), (n("__f") + n("__g")).alias("failures"), n("unmatched").alias("unmatched"))


#: Which list of files a kind of tool, or of file access, enters its paths in.
FILE_LISTS = {"FileRead": "read", "FileWrite": "written", "FileEdit": "written", "FileDelete": "deleted"}


def mcp_key(server: Column, mcp_tool: Column, tool: Column) -> Column:
    """What an MCP call is counted under: server/tool; a name that begins with its server stays; one of them alone; else MCP."""
    bare = F.regexp_replace(tool, "^mcp__(?:(?!__).)+__(?=.)|^mcp__", "")
    name = F.coalesce(mcp_tool, bare)
    both = F.coalesce(server != "", F.lit(False)) & F.coalesce(name != "", F.lit(False))
    return F.when(both & name.startswith(F.concat(server, F.lit("-"))), name).when(both, F.concat_ws("/", server, name)).otherwise(F.coalesce(name, server, F.lit("MCP")))


def hook_figures(nodes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by..., and a hook session's figures: tools, mcp, commands, failures, thoughts (and their ms and characters), compactions, aborted,
    wall_ms, subagents, and the lists skills, slash_commands, read, written, deleted: distinct by case, the first spelling, sorted.

    nodes: by, order, ts, role, kind, tool, server, mcp_tool, inner, duration_ms, text, agent, excluded, transcript, secondary, aborted,
    failed, paths, skills, slash_commands. Excluded nodes count for skills and commands only, except that a transcript's tool request that no hook
    stands for (not secondary) counts once, whatever it is marked as. An MCP call is counted by its inner start where the tool's name begins with
    `MCP:`, as its request and result are then left out. A name whose completion came before any request counts one more.
    """
    of = lambda *r: F.col("role").isin(*r)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    counts = no(F.col("excluded"))
    prefixed = F.coalesce(F.col("tool").startswith("MCP:"), F.lit(False))
    native = (F.col("kind") == "Mcp") & ~prefixed
    native = F.coalesce(native, F.lit(False))
    own = F.coalesce(F.col("transcript"), F.lit(False)) & no(F.col("secondary")) & of("ToolRequest")
    key = mcp_key(F.col("server"), F.col("mcp_tool"), F.col("tool"))
    plain = F.when(~prefixed & ~native, F.col("tool"))
    inner_mcp = F.coalesce(F.col("inner") == "Mcp", F.lit(False))
    entry = lambda when, section, name, told: F.when(when & name.isNotNull(), F.struct(F.lit(section).alias("section"), name.alias("name"), F.lit(told).alias("told")))
    entries = F.array(
        entry(own & (F.col("kind") == "Mcp"), "mcp", key, False),
        entry(own & ~F.coalesce(F.col("kind") == "Mcp", F.lit(False)), "tools", F.coalesce("tool", "kind"), False),
        entry(counts & of("ToolRequest") & native, "mcp", key, False),
        entry(counts & of("ToolRequest") & ~native, "tools", plain, False),
        entry(counts & of("InnerExecutionStart") & inner_mcp, "mcp", key, False),
        entry(counts & of("ToolSuccess") & native, "mcp", key, True),
        entry(counts & of("ToolSuccess") & ~native, "tools", plain, True),
        entry(counts & of("InnerExecutionEnd") & inner_mcp, "mcp", key, True),
    )
    at = F.struct(*order)
    calls = nodes.select(*by, at.alias("at"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy(*by, "e.section", "e.name")
    uses = calls.agg((F.count_if(~F.col("e.told")) + F.min_by(F.col("e.told"), F.struct("at", "e.told")).cast("int")).alias("uses"))
    counted = uses.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("section") == s, F.col("uses"))), F.lit(0)).alias(s) for s in ("tools", "mcp")])

    touched = F.when(counts & of("ToolSuccess") & ~prefixed, F.col("kind")).when(counts & of("FileAccess"), F.col("inner"))
    touched = F.coalesce(touched, F.when(own & ~F.coalesce(F.col("kind") == "Mcp", F.lit(False)), F.col("kind")))
    file_list = F.element_at(F.create_map(*[F.lit(x) for kv in FILE_LISTS.items() for x in kv]), touched)
    tag = lambda name, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(name.alias("list"), v.alias("value")))
    said = F.concat(tag(F.lit("skills"), F.col("skills")), tag(F.lit("slash_commands"), F.col("slash_commands")), tag(file_list, F.when(file_list.isNotNull(), F.col("paths"))))
    words = nodes.select(*by, at.alias("__at"), F.posexplode(said).alias("pos", "w")).where("trim(w.value) <> ''").withColumn("at", F.struct("__at", "pos"))
    once = words.groupBy(*by, F.col("w.list").alias("list"), F.upper("w.value").alias("k")).agg(F.min_by("w.value", "at").alias("v"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == n, F.struct("k", "v")))), lambda x: x["v"]).alias(n) for n in ("skills", "slash_commands", "read", "written", "deleted")]
    listed = once.groupBy(*by).agg(*lists)

    n = lambda c: F.count_if(counts & c)
    thought = counts & of("AgentThought")
    seen = F.when(counts, F.col("ts"))
    main = nodes.groupBy(*by).agg(
        n(of("InnerExecutionStart") & (F.col("inner") == "Shell")).alias("commands"),
        n(F.coalesce(F.col("failed"), F.lit(False))).alias("failures"),
        F.count_if(thought).alias("thoughts"),
        F.coalesce(F.sum(F.when(thought, F.col("duration_ms"))), F.lit(0.0)).alias("thought_ms"),
        F.coalesce(F.sum(F.when(thought, F.length("text"))), F.lit(0)).cast("long").alias("thought_chars"),
        n(of("CompactionStart")).alias("compactions"),
        F.bool_or(counts & of("TurnStop") & F.coalesce(F.col("aborted"), F.lit(False))).alias("aborted"),
        F.coalesce((micros(F.max(seen)) - micros(F.min(seen))) / 1000.0, F.lit(0.0)).alias("wall_ms"),
        F.count_distinct(F.when(counts & of("SubagentStart", "SubagentStop"), F.col("agent"))).alias("subagents"),
    )
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    out = main.join(counted, by, "left").join(listed, by, "left")
    return out.select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tools", "mcp")], *main.columns[len(by) :], *[empty(c) for c in ("skills", "slash_commands", "read", "written", "deleted")])
