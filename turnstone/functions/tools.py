"""Tool names: kinds, MCP identities, correlation keys, commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.text import preview

#: Native tool names, lower-cased, of each kind.
EXACT_KINDS = {
    "Shell": ("shell", "bash", "powershell"),
    "FileRead": ("read", "view", "readfile", "read_file"),
    "FileWrite": ("write", "create", "writefile", "write_file"),
    "FileEdit": ("edit", "strreplace", "str_replace_editor", "apply_patch", "applypatch", "editfiles", "editfile", "edit_file"),
    "FileDelete": ("delete", "deletefile", "delete_file"),
    "TextSearch": ("grep", "rg"),
    "FileSearch": ("glob",),
    "Notebook": ("editnotebook", "notebookedit"),
    "Agent": ("task", "agent"),
    "Web": ("webfetch", "websearch", "web_fetch", "web_search"),
    "UserInteraction": ("askuserquestion", "ask_user"),
    "Task": ("todowrite", "update_todo", "createplan", "updateplan"),
}
#: Aliases that one provider's desktop store uses besides those.
ALIAS_KINDS = {
    "Shell": ("run_terminal_command_v2", "run_terminal_command"),
    "TextSearch": ("ripgrep_raw_search", "grep_search"),
    "FileSearch": ("glob_file_search",),
    "FileRead": ("read_file_v2", "read_file"),
    "FileEdit": ("edit_file_v2", "edit_file", "apply_patch_v2"),
    "FileWrite": ("write_file_v2", "write_file", "create_file_v2"),
    "FileDelete": ("delete_file_v2", "delete_file"),
}
#: Kinds of passively seen tools, the first that fits: (kind, names, parts, starts).
PASSIVE_KINDS = (
    ("Shell", ("bash", "shell", "powershell", "terminal", "exec", "run_command", "run_in_terminal"), ("shell", "terminal"), ()),
    ("FileRead", ("view", "read", "read_file", "readfile", "cat"), (), ()),
    ("FileWrite", ("create", "write", "write_file", "writefile"), (), ()),
    ("FileEdit", ("edit", "apply_patch", "str_replace", "replace", "multiedit"), (), ()),
    ("FileDelete", ("delete", "delete_file", "remove_file"), (), ()),
    ("TextSearch", ("grep", "rg", "search", "search_text", "code_search"), ("grep",), ()),
    ("FileSearch", ("glob", "find", "find_files", "list_files"), (), ()),
    ("Notebook", (), ("notebook",), ()),
    ("Agent", ("task", "agent", "read_agent", "subagent"), ("agent",), ()),
    ("Web", ("web", "web_search", "web_fetch", "fetch", "browse"), (), ("http",)),
    ("UserInteraction", ("ask_user", "user_input", "elicitation"), (), ()),
    ("Task", ("skill", "todo", "update_todo", "plan"), (), ()),
)


def is_mcp_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).startswith("mcp:") | F.lower(name).startswith("mcp__"), F.lit(False))


def _of(name: Column, kinds: dict[str, tuple[str, ...]], other: Column) -> Column:
    out = other
    for kind, names in reversed(kinds.items()):
        out = F.when(F.lower(name).isin(*names), kind).otherwise(out)
    return out


def tool_kind(name: Column) -> Column:
    """The provider-neutral kind of a native tool name; MCP names by their prefix."""
    return F.when(is_mcp_name(name), "Mcp").otherwise(_of(name, EXACT_KINDS, F.lit("Unknown")))


def alias_kind(name: Column) -> Column:
    """The same with the desktop store's aliases first."""
    return _of(name, ALIAS_KINDS, tool_kind(name))


def passive_kind(name: Column, is_mcp: Column) -> Column:
    """The kind of a tool seen in a passive transcript: an ordered list of names and parts of names."""
    n = F.lower(F.trim(name))
    out = F.lit("Unknown")
    for kind, names, parts, starts in reversed(PASSIVE_KINDS):
        fits = F.lit(False)
        if names:
            fits = fits | n.isin(*names)
        for p in parts:
            fits = fits | n.contains(p)
        for s in starts:
            fits = fits | n.startswith(s)
        out = F.when(fits, kind).otherwise(out)
    return F.when(F.coalesce(is_mcp, F.lit(False)), "Mcp").otherwise(out)


def mcp_server(name: Column) -> Column:
    part = F.regexp_extract(name, r"(?is)^mcp__(.+?)__(.*)$", 1)
    return F.when(part != "", part)


def mcp_tool(name: Column) -> Column:
    return F.when(mcp_server(name).isNotNull(), F.regexp_extract(name, r"(?is)^mcp__(.+?)__(.*)$", 2))


def is_discovery(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin("getdynamictools", "get_mcp_tools"), F.lit(False))


def is_mcp_execution(kind: Column, name: Column, server: Column) -> Column:
    """An MCP call itself, not the discovery of tools."""
    return ~is_discovery(name) & ((kind == "Mcp") | (F.trim(F.coalesce(server, F.lit(""))) != "") | F.coalesce(name == "CallDynamicTool", F.lit(False)))


def bare_mcp_tool(name: Column) -> Column:
    """The tool of `MCP:tool` and `mcp-server-tool` names, lower-cased."""
    n = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "(?i)^mcp:", "")
    return F.lower(F.regexp_replace(n, r"(?is)^mcp-.*-([^-]+)$", "$1"))


def correlation_key(kind: Column, name: Column, server: Column, tool: Column) -> Column:
    """What two stores' records of one call agree on; writes and edits share a key."""
    own = F.when(kind == "Unknown", alias_kind(name)).otherwise(kind)
    return (
        F.when(is_discovery(name), "discovery")
        .when(is_mcp_execution(kind, name, server), F.concat(F.lit("mcp:"), bare_mcp_tool(F.coalesce(tool, name))))
        .when(own.isin("FileWrite", "FileEdit"), "file-mutate")
        .otherwise(F.concat(F.lit("kind:"), own))
    )


def command_text(args: Column, most: int = 120) -> Column:
    """A preview of the command in an arguments VARIANT."""
    get = lambda k: F.try_variant_get(args, f"$.{k}", "string")
    return F.nullif(preview(F.coalesce(get("command"), get("cmd"), get("script")), most), F.lit(""))


#: Units by what a figure's name holds (anywhere, or at its end), or is; the first that fits.
UNITS = (
    ("nano-AIU", ("nanoaiu",), (), ()),
    ("premium requests", ("premiumrequest",), (), ()),
    ("ms", ("duration", "latency"), ("ms",), ()),
    ("tokens", ("token",), (), ("input", "output", "cache_read", "cache_write")),
    ("requests", (), (), ("count",)),
)
OTHER_UNIT = "provider units"


def usage_unit(name: Column) -> Column:
    """The unit of a provider's usage figure, by its name. Names as a whole compare with their case, but for "count"."""
    low, out = F.lower(name), F.lit(OTHER_UNIT)
    for unit, parts, ends, whole in reversed(UNITS):
        signs = [low.contains(p) for p in parts] + [low.endswith(e) for e in ends] + ([(low if unit == "requests" else name).isin(*whole)] if whole else [])
        out = F.when(F.greatest(*signs, F.lit(False)), unit).otherwise(out)
    return out


def mcp_key(server: Column, tool: Column, name: Column) -> Column:
    """What an MCP call counts under: "server/tool"; the tool alone where it is flat and begins with its server's name, or without a server."""
    rest = F.regexp_extract(name, r"(?s)^mcp__(?:.+?__)?(.*)$", 1)
    own = F.coalesce(tool, F.when(name.startswith("mcp__"), rest).otherwise(name))
    some = F.coalesce(server != "", F.lit(False)) & F.coalesce(own != "", F.lit(False))
    return F.when(some & own.startswith(F.concat(server, F.lit("-"))), own).when(some, F.concat(server, F.lit("/"), own)).otherwise(F.coalesce(own, server, F.lit("MCP")))


def token_family(name: Column) -> dict[str, Column]:
    """Whether a usage figure is of each family of tokens; one may be of several."""
    n = F.lower(F.replace(name, F.lit("-"), F.lit("_")))
    cache, reason = n.contains("cache"), n.contains("reason") | n.contains("thinking")
    return {
        "input": n.contains("input") & ~cache,
        "output": n.contains("output") & ~reason,
        "cache_read": cache & (n.contains("read") | n.contains("cached")),
        "cache_write": cache & (n.contains("write") | n.contains("creation")),
        "reasoning": reason,
    }
