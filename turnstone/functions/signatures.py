"""What records of one call agree on, by provider: a tool's identity, and the hash of what tells its calls apart."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions.payloads import _Number

#: Where a call's arguments are, and a call's own fields that stand in for them, in order.
CONTAINERS, DIRECT = ("arguments", "toolArgs", "tool_input", "input"), ("command", "path", "file_path", "pattern", "skill")
_PATH = ("path", ("file_path", "path", "target_directory", "target_notebook"))
_FILE = (_PATH,)
#: By kind of tool, what tells calls of the third provider apart, each with the properties that may hold it.
TELLING = {
    "Shell": (("command", ("command",)),),
    "FileRead": _FILE,
    "FileWrite": _FILE,
    "FileEdit": _FILE,
    "FileDelete": _FILE,
    "Notebook": _FILE,
    "TextSearch": (_PATH, ("pattern", ("pattern",)), ("glob", ("glob", "glob_pattern"))),
    "FileSearch": (_PATH, ("glob", ("glob_pattern", "glob", "pattern"))),
    "Web": (("query", ("query", "search_term")), ("url", ("url",))),
}
#: How the third provider tells an MCP call's server and tool, and tools that stand for any.
SERVERS, TOOLS, ANY_TOOL = ("namespace", "server", "serverName", "server_name"), ("toolName", "tool_name"), ("CallDynamicTool", "GetDynamicTools")


def _plain(s: str) -> str:
    """Texts that differ by case, slashes, line ends or blanks around them are one."""
    s = re.sub("\r\n|[\r\f\x85\u2028\u2029]", "\n", s).replace("/", "\\").strip()
    return "".join(u if len(u := c.upper()) == 1 else c for c in s)


def _canonical(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_canonical(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_canonical, v)) + "]"
    if isinstance(v, _Number):
        return v
    return json.dumps(_plain(v) if isinstance(v, str) else v, ensure_ascii=False)


def _read(text: str):
    return json.loads(text, parse_float=_Number)


def _value(v) -> str:
    """Canonical arguments, also of such as are written in a text."""
    if isinstance(v, str) and not isinstance(v, _Number):
        try:
            return _canonical(_read(v))
        except ValueError:
            return _plain(v)
    return _canonical(v)


def _first(names, *dicts) -> str | None:
    """The first text that isn't blank: of all names in one object, then in the next."""
    return next((d[n] for d in dicts for n in names if isinstance(d.get(n), str) and not isinstance(d[n], _Number) and d[n].strip()), None)


def _arguments(payload: dict) -> dict:
    """The object that holds a call's arguments, also one that is written in a text."""
    for name in CONTAINERS:
        v = payload.get(name)
        if isinstance(v, str):
            try:
                v = _read(v)
            except ValueError:
                continue
        if isinstance(v, dict):
            return v
    return {}


def _any_arguments(payload: dict, target: str | None) -> str:
    for name in CONTAINERS:
        if name in payload:
            return _value(payload[name])
    told = target if target is not None else _first(DIRECT, payload)
    return "" if told is None else _plain(told)


def _third(payload: dict, kind: str, tool: str | None, server: str | None, mcp_tool: str | None, target: str | None) -> tuple[str, str]:
    args = _arguments(payload)
    if kind == "Mcp":
        server = server or _first(SERVERS, args, payload) or ""
        named = tool[4:] if tool is not None and tool[:4].upper() == "MCP:" else None if tool in ANY_TOOL else tool
        name = mcp_tool or _first(TOOLS, args, payload) or named or ""
        identity = f"Mcp:{_plain(server[5:] if server[:5].lower() == 'user-' else server)}:{_plain(name)}"
        told = None if not args else _value(args["arguments"]) if "arguments" in args else _canonical(args)
    else:
        has = lambda *names: _first(names, args, payload) is not None
        by_name = kind == "FileSearch" or (kind == "TextSearch" and not has("pattern") and has("glob", "glob_pattern"))
        identity = "FileSearch" if by_name else kind
        parts = [(label, _first(names, args, payload)) for label, names in TELLING.get(kind, ())]
        told = "|".join(f"{label}={json.dumps(_plain(v), ensure_ascii=False)}" for label, v in parts if v is not None) or None
    return identity, _any_arguments(payload, target) if told is None else told


@F.pandas_udf(T.StructType([T.StructField("identity", T.StringType()), T.StructField("arguments", T.StringType())]))
def _told(provider: pd.Series, kind: pd.Series, tool: pd.Series, server: pd.Series, mcp_tool: pd.Series, target: pd.Series, payload: pd.Series) -> pd.DataFrame:
    def one(p, k, t, s, m, path, raw) -> tuple[str, str]:
        try:
            doc = _read(raw) if raw is not None else {}
        except ValueError:
            doc = {}
        doc = doc if isinstance(doc, dict) else {}
        if p == "Cursor":
            return _third(doc, k or "Unknown", t, s, m, path)
        return (f"{k}|{_plain(t or '')}" if p == "GitHubCopilot" else f"{k}|"), _any_arguments(doc, path)

    return pd.DataFrame([one(*r) for r in zip(provider, kind, tool, server, mcp_tool, target, payload, strict=True)], columns=["identity", "arguments"])


def call_signature(session: Column, provider: Column, kind: Column, tool: Column, server: Column, mcp_tool: Column, target: Column, payload: Column) -> Column:
    """session|identity|hash: equal for records of one call, whoever tells of it.

    The first two providers' calls agree on their kind (the second's on the tool's name, too) and their canonical arguments; the third's on
    what TELLING names for the kind, or an MCP call's server, tool and inner arguments. Without arguments the call's target path, or a
    field of its own, stands in. payload: a JSON text; texts in it are compared without case, slashes, line ends and blanks around them.
    """
    told = _told(provider, kind, tool, server, mcp_tool, target, payload)
    return F.concat_ws("|", session, told["identity"], F.sha2(told["arguments"], 256))
