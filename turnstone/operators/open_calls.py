"""Calls that are open when something else refers to them: by reused ids, by shared signals, by what a permission says."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions.payloads import _Number, canonical
from turnstone.operators.sequential import by_key


def sole_open(spans: DataFrame, probes: DataFrame, by: list[str]) -> DataFrame:
    """(by, probe_id, request_id): for each probe the one request that is open then, on the first level that has any; none where several are.

    spans: by, key, opened, closed (null: never), request_id (a long); a request may have several keys. probes: by, key, level, at,
    probe_id; one level's keys must not share a request. Open means opened < at < closed.

    Running sums per key, not pairs: how many are open, and the exclusive or of their ids, which is the id if it is one. So calls
    that stay open for good cost a row each, whatever refers to them.
    """
    none = F.lit(None)
    opens = spans.select(*by, "key", F.col("opened").alias("__at"), F.lit(2).alias("__kind"), F.lit(1).alias("__step"), "request_id", none.cast("int").alias("level"), none.cast(dict(probes.dtypes)["probe_id"]).alias("probe_id"))
    closes = spans.where("closed IS NOT NULL").select(*by, "key", F.col("closed").alias("__at"), F.lit(0).alias("__kind"), F.lit(-1).alias("__step"), "request_id", none.cast("int").alias("level"), none.cast(dict(probes.dtypes)["probe_id"]).alias("probe_id"))
    asks = probes.select(*by, "key", F.col("at").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).alias("__step"), none.cast("long").alias("request_id"), F.col("level").cast("int").alias("level"), "probe_id")
    w = Window.partitionBy(*by, "key").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ran = opens.unionByName(closes).unionByName(asks).withColumns({"__open": F.sum("__step").over(w), "__ids": F.bit_xor("request_id").over(w)}).where("__kind = 1")
    levels = ran.groupBy(*by, "probe_id", "level").agg(F.sum("__open").alias("n"), F.bit_xor(F.when(F.col("__open") == 1, F.col("__ids"))).alias("__id"))
    first = levels.where("n > 0").groupBy(*by, "probe_id").agg(F.min(F.struct("level", "n", "__id")).alias("f"))
    return first.where("f.n = 1").select(*by, "probe_id", F.col("f.__id").alias("request_id"))


def by_signals(requests: DataFrame, probes: DataFrame, by: list[str], signals: list[str]) -> DataFrame:
    """sole_open by the strongest signal that both sides have (signals, the strongest first): they agree on it, or don't match.

    requests: by, opened, closed, request_id and the signals; probes: by, at, probe_id and the signals. Each request is entered
    under the signal that it would be judged by, for each set of signals that a probe may have.
    """
    bit = {s: 1 << i for i, s in enumerate(signals)}

    def entry(mask: int) -> Column:
        out = F.lit(None).cast("string")
        for s in reversed([s for s in signals if mask & bit[s]]):
            out = F.when(F.col(s).isNotNull(), F.concat(F.lit(f"{mask}|{s}|"), F.col(s))).otherwise(out)
        return out

    keys = F.filter(F.array(*[entry(m) for m in range(1, 1 << len(signals))]), lambda k: k.isNotNull())
    spans = requests.select(*by, "opened", "closed", "request_id", F.explode(keys).alias("key"))
    has = sum((F.when(F.col(s).isNotNull(), b).otherwise(0) for s, b in bit.items()), F.lit(0))
    own = F.array(*[F.concat(F.lit("").cast("string"), has.cast("string"), F.lit(f"|{s}|"), F.col(s)) for s in signals])
    asks = probes.select(*by, "at", "probe_id", F.lit(0).alias("level"), F.explode(F.filter(own, lambda k: k.isNotNull())).alias("key"))
    return sole_open(spans, asks, by)


def by_input(requests: DataFrame, probes: DataFrame, by: list[str], name: str, given: str) -> DataFrame:
    """sole_open among requests of the probe's name: by equal input, else those without any; a probe without input may be of any.

    Two inputs that differ rule out.
    """
    named = requests.where(F.col(name).isNotNull())
    key = F.array(F.concat(F.lit("any|"), F.col(name)), F.when(F.col(given).isNull(), F.concat(F.lit("none|"), F.col(name))).otherwise(F.concat(F.lit("is|"), F.col(name), F.lit("|"), F.col(given))))
    spans = named.select(*by, "opened", "closed", "request_id", F.explode(key).alias("key"))
    level = lambda n, k: F.struct(F.lit(n).alias("level"), k.alias("key"))
    asks = F.when(F.col(given).isNull(), F.array(level(0, F.concat(F.lit("any|"), F.col(name))))).otherwise(
        F.array(level(0, F.concat(F.lit("is|"), F.col(name), F.lit("|"), F.col(given))), level(1, F.concat(F.lit("none|"), F.col(name))))
    )
    probed = probes.where(F.col(name).isNotNull()).select(*by, "at", "probe_id", F.explode(asks).alias("a")).select(*by, "at", "probe_id", "a.*")
    return sole_open(spans, probed, by)


def reused_ids(rows: DataFrame, by: list[str], order: list, is_request: Column, given: str, row_id: str) -> DataFrame:
    """(by, request_id, result_id): a completion closes the open request of its keys (by: session, call id, tool) with the same input.

    Equal inputs are worth 100, an input that one side lacks nothing, and inputs that differ rule out; of the open requests the only best one
    is taken, and none where several are best, so that what can't be told apart stays open. Sequential inside the keys.
    """
    kind = dict(rows.dtypes)[row_id]
    seen = rows.withColumns({"__asks": is_request, "__given": F.col(given).cast("string"), "__order": F.struct(*order)})

    def take():
        held: dict[str | None, dict] = {}  # open requests by input

        def step(asks, value, i):
            if asks:
                held.setdefault(value, {})[i] = None
                return ()
            if value is None:
                pools = [{x: None for p in held.values() for x in p} if len(held) > 1 else next(iter(held.values()), {})]
            else:
                pools = [held.get(value, {}), held.get(None, {})]
            best = next((p for p in pools if p), {})
            if len(best) != 1:
                return ()
            found = next(iter(best))
            for v in [v for v, p in held.items() if found in p]:
                del held[v][found]
                if not held[v]:
                    del held[v]
            return [(found, i)]

        return step

    return by_key(seen, by, ["__order"], ["__asks", "__given", row_id], take, f"request_id {kind}, result_id {kind}")


#: The words before what a permission's message names: a command, or a path.
COMMAND_WORDS = ("Run command:", "Execute command:")
PATH_WORDS = ("Path permission needed:", "Edit file:", "Read file:", "View file:", "Create file:", "Write file:", "Write to file:", "Delete file:")
PATCH_WORDS = ("Update File:", "Add File:", "Delete File:", "Move to:")
#: Where a call's arguments are, in order.
ARGUMENTS = ("toolArgs", "toolInput", "tool_input")


_SIGNALS = T.StructType([T.StructField(n, T.StringType()) for n in ("file", "command", "args")])


def _object(raw) -> dict | None:
    """An object, or one that is written in a text."""
    if isinstance(raw, str) and raw.lstrip().startswith("{"):
        try:
            raw = json.loads(raw, parse_float=_Number)
        except ValueError:
            return None
    return raw if isinstance(raw, dict) else None


def _signals(payload: str | None) -> tuple[str | None, str | None, str | None]:
    try:
        doc = json.loads(payload, parse_float=_Number) if payload is not None else None
    except ValueError:
        doc = None
    doc = doc if isinstance(doc, dict) else {}
    text = lambda d, n: d[n] if isinstance(d.get(n), str) and not isinstance(d[n], _Number) else None
    given = [doc[n] for n in ARGUMENTS if n in doc]
    args = next((o for o in map(_object, given) if o is not None), None)
    path, command = (text(args, "file_path") or text(args, "path"), text(args, "command")) if args is not None else (None, None)
    for patch in (g for g in given if path is None and isinstance(g, str) and not g.lstrip().startswith("{")):
        path = next((p for w in PATCH_WORDS if w in patch and (p := patch.split(w, 1)[1].split("\n", 1)[0].strip())), None)
    if path is None and command is None and args is None:
        message = (text(doc, "message") or "").strip()
        after = lambda words: next((message[len(w) :].strip() for w in words if message.lower().startswith(w.lower())), None)
        command = after(COMMAND_WORDS) or None
        path = (after(PATH_WORDS) or "").split(",")[0].strip() or None
    name = re.split(r"[\\/]", path)[-1].lower() if path else None
    lines = None if command is None else re.sub("\r\n|[\r\f\x85\u2028\u2029]", "\n", command).rstrip("\n")
    return name or None, lines, None if args is None else canonical(args)


@F.pandas_udf(_SIGNALS)
def call_signals(payload: pd.Series) -> pd.DataFrame:
    """file, command, args: what a call's request, a permission or a notification of the second provider tells of the call.

    payload: JSON texts. Arguments are an object, or one written in a string; a patch in their place tells its first file. Without any
    of these the message does, by its first words. A file counts by its name alone, in lower case; a command without line ends behind it.
    """
    return pd.DataFrame([_signals(p) for p in payload], columns=["file", "command", "args"], dtype=object)
