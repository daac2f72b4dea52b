"""Detail rows of a payload: a table of specifications says which fields an event shows, and how each is laid out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a field may be laid out.
KINDS = ("Scalar", "ScalarPreferred", "ObjectMembers", "JsonStringMembers", "ArrayMembers", "FlattenedArrayMembers", "AllTopLevel", "PreCompactSummary")
#: Names under which a payload tells how long it took, the first that is there counts.
DURATIONS = ("duration_ms", "duration")
SPECS = "event string, ord int, kind string, names array<string>"
FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


class _Written(str):
    """A number as it is written."""


def _read(raw: str):
    return json.loads(raw, parse_float=_Written, parse_int=_Written)


def _shown(v) -> str:
    """A value as a row shows it: texts with double backslashes as one, everything else as JSON, numbers as they are written."""
    if isinstance(v, _Written):
        return v
    if isinstance(v, str):
        return v.replace("\\\\", "\\")
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_json, v)) + "]"
    return json.dumps(v)


def _json(v) -> str:
    return json.dumps(v, ensure_ascii=False) if isinstance(v, str) and not isinstance(v, _Written) else _shown(v)


def _members(prefix: str, v: dict) -> Iterator[tuple[str, str]]:
    for k, x in v.items():
        yield f"{prefix}{k}", _shown(x)


def _leaves(prefix: str, v) -> Iterator[tuple[str, str]]:
    if isinstance(v, dict):
        for k, x in v.items():
            yield from _leaves(f"{prefix}.{k}", x)
    else:
        yield prefix, _shown(v)


def _elements(name: str, v, leaves) -> Iterator[tuple[str, str]]:
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield from leaves(f"{name}[{i}]", x)
        if not v:
            yield name, "(none)"


def _json_members(name: str, v) -> Iterator[tuple[str, str]]:
    """Members of an object, or of one that is written in a text; any other value as it is."""
    inner = v
    if isinstance(v, str) and not isinstance(v, _Written):
        try:
            inner = _read(v)
        except ValueError:
            inner = None
    yield from _members(f"{name}.", inner) if isinstance(inner, dict) else [(name, _shown(v))]


def _short(n: int) -> str:
    """A count as functions.labels.token_label writes it."""
    for size, unit in ((1_000_000, "M"), (1000, "k")):
        if n >= size:
            hundredths = (200 * n + size) // (2 * size)
            return f"{hundredths // 100}.{hundredths % 100:02d}".rstrip("0").rstrip(".") + unit
    return str(n)


def _number(v) -> float | None:
    return float(v) if isinstance(v, _Written) else None


def _compaction(p: dict) -> Iterator[tuple[str, str]]:
    for name in ("is_first_compaction", "trigger"):
        if name in p:
            yield name, _shown(p[name])
    if (share := _number(p.get("context_usage_percent"))) is not None:
        yield "context usage percent", f"{share:.2f}".rstrip("0").rstrip(".") + "%"
    if (size := _number(p.get("context_window_size"))) is not None:
        yield "window size", _short(int(size))
    counts = [_number(p.get(n)) for n in ("message_count", "messages_to_compact")]
    if any(c is not None for c in counts):
        yield "messages count/to compact", "/".join("?" if c is None else str(int(c)) for c in counts)


#: What each kind gives for a payload and the names of its specification.
_LAYOUT = {
    "Scalar": lambda p, n: [(n[0], _shown(p[n[0]]))] if n[0] in p else [],
    "ScalarPreferred": lambda p, n: [(x, _shown(p[x])) for x in n if x in p][:1],
    "ObjectMembers": lambda p, n: _members("", p[n[0]]) if isinstance(p.get(n[0]), dict) else [],
    "JsonStringMembers": lambda p, n: _json_members(n[0], p[n[0]]) if n[0] in p else [],
    "ArrayMembers": lambda p, n: _elements(n[0], p.get(n[0]), lambda at, x: _members(f"{at}.", x) if isinstance(x, dict) else [(at, _shown(x))]),
    "FlattenedArrayMembers": lambda p, n: _elements(n[0], p.get(n[0]), _leaves),
    "PreCompactSummary": lambda p, n: _compaction(p),
}


def _rows(raw: str | None, specs) -> list[dict]:
    try:
        payload = _read(raw) if raw is not None else None
    except ValueError:
        payload = None
    if not isinstance(payload, dict):
        return []
    out: list[tuple[str, str]] = []
    for spec in sorted(specs if specs is not None else (), key=lambda s: s["ord"]):
        if spec["kind"] == "AllTopLevel":
            have = {n for n, _ in out}
            out += [(n, v) for n, v in _members("", payload) if n not in have]
        else:
            out += _LAYOUT[spec["kind"]](payload, spec["names"])
    out = [f for f in out if f[0] not in DURATIONS]
    out = [(n, _shown(payload[n])) for n in DURATIONS if n in payload][:1] + out
    return [{"name": n, "value": v} for n, v in out]


@F.pandas_udf(FIELDS)
def _flattened(raw: pd.Series, specs: pd.Series) -> pd.Series:
    return pd.Series([_rows(r, s) for r, s in zip(raw, specs, strict=True)], dtype=object)


def spec_table(spark: SparkSession, specs: dict[str, list[tuple]]) -> DataFrame:
    """specs: by event, (kind, names...) in order; as a table that detail_rows takes."""
    for kind in {s[0] for rows in specs.values() for s in rows} - set(KINDS):
        raise ValueError(kind)
    return spark.createDataFrame([(e, i, s[0], list(s[1:])) for e, rows in specs.items() for i, s in enumerate(rows)], SPECS)


def detail_rows(rows: DataFrame, key: str, event: str, payload: str, specs: DataFrame, derived: list[tuple[str, Column]] = ()) -> DataFrame:
    """(key, pos, name, value): the fields that an event's payload (a JSON text) shows, in order; how long it took comes first.

    specs: event, ord, kind, names; events without any show their duration only. derived: further fields by name, of other columns, that
    come behind unless they are blank or a field of the name, in any case, is there. What isn't an object shows only those.
    """
    of = specs.groupBy(event).agg(F.collect_list(F.struct("ord", "kind", "names")).alias("__specs"))
    told = F.coalesce(_flattened(F.col(payload), F.col("__specs")), F.array().cast(FIELDS))
    more = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in derived]).cast(FIELDS), lambda f: F.trim(f["value"]) != "")
    kept = F.filter(more, lambda f: ~F.exists("__told", lambda t: F.lower(t["name"]) == F.lower(f["name"])))
    joined = rows.join(F.broadcast(of), event, "left").withColumn("__told", told)  # a row per kind of event
    return joined.select(key, F.posexplode(F.concat("__told", kept)).alias("pos", "f")).select(key, "pos", "f.name", "f.value")
