"""Interval and as-of joins, and waves of overlapping calls."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.times import micros
from turnstone.operators.sequential import by_key, two_sided


def turn_by_interval(rows: DataFrame, turns: DataFrame, by: list[str], ts: str, turn_id: str, start: str, stop: str, grace: str = "INTERVAL 5 SECONDS") -> DataFrame:
    """Adds the turn to rows that have only a clock: start <= ts < next start; the last turn ends `grace` after its stop.

    An as-of join by union and a running last value: one shuffle by the keys, no range comparison of pairs.
    """
    nxt = F.lead(start).over(Window.partitionBy(*by).orderBy(start, turn_id))
    spans = turns.select(*by, F.col(start).alias("__at"), F.struct(F.col(turn_id).alias("turn"), F.coalesce(nxt, F.col(stop) + F.expr(grace)).alias("until"), nxt.isNull().alias("last")).alias("__turn"))
    names = rows.columns
    marked = rows.select("*", F.col(ts).alias("__at"), F.lit(1).alias("__kind")).unionByName(spans.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__at", "__kind", F.col("__turn.turn")).rowsBetween(Window.unboundedPreceding, 0)
    got = marked.withColumn("__found", F.last("__turn", ignorenulls=True).over(w)).where("__kind = 1")
    late = F.col("__found.last") & (F.col("__at") > F.col("__found.until"))
    return got.withColumn(turn_id, F.when(~F.coalesce(late, F.lit(False)), F.col("__found.turn"))).select(*names, turn_id)


def reach_segments(rows: DataFrame, by: list[str], ts: str, seconds: float, name: str = "__segment") -> DataFrame:
    """Adds the number of the row's segment: one ends where nothing follows within `seconds`, so rows of two segments are out of reach.

    What is sequential inside a key then needs a segment at a time, not the key's whole history. The history isn't one task's, either: gaps are found
    inside spans of time, and only a row per key and span meets the key's others. Rows without a time are a segment's of their own.
    """
    gap, span = int(seconds * 1e6), int(max(3600, 16 * seconds) * 1e6)
    spans = rows.withColumn("__us", micros(ts)).withColumn("__span", F.floor(F.col("__us") / span))
    w = Window.partitionBy(*by, "__span").orderBy("__us")
    marked = spans.withColumn("__far", F.coalesce(F.col("__us") - F.lag("__us").over(w) > gap, F.lit(False)))
    marked = marked.withColumn("__inner", F.count_if("__far").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*by, "__span").agg(F.min("__us").alias("__a"), F.max("__us").alias("__z"), F.count_if("__far").alias("__n"))
    k = Window.partitionBy(*by).orderBy("__span")
    ends = ends.withColumn("__f", F.coalesce(F.col("__a") - F.lag("__z").over(k) > gap, F.col("__span").isNotNull()).cast("int"))
    before = F.coalesce(F.sum(F.col("__n") + F.col("__f")).over(k.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__f")
    starts = ends.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__span").alias("__of"), before.alias("__before"))
    same = marked["__span"].eqNullSafe(starts["__of"])
    for i, c in enumerate(by):
        same = same & marked[c].eqNullSafe(starts[f"__by{i}"])
    return marked.join(starts, same).withColumn(name, F.col("__inner") + F.col("__before")).select(*rows.columns, name)


def adopt_pending(prompts: DataFrame, pending: DataFrame, by: list[str], prompt_ts: str, pending_ts: str, prompt_id: str, pending_id: str, seconds: int = 30) -> DataFrame:
    """(prompt_id, pending_id): prompts, by time, take the nearest row in [ts, ts + seconds] that no prompt before has taken.

    The nearest row that is left is the first one, so rows go by time to the prompt that waits longest, if it still does. One
    segment of rows within reach of each other is worked on at once.
    """
    types = {prompt_id: dict(prompts.dtypes)[prompt_id], pending_id: dict(pending.dtypes)[pending_id]}
    a = prompts.select(*by, F.col(prompt_ts).alias("__ts"), F.lit(0).alias("__kind"), F.col(prompt_id).alias("__a"), F.lit(None).cast(types[pending_id]).alias("__b"))
    b = pending.select(*by, F.col(pending_ts).alias("__ts"), F.lit(1).alias("__kind"), F.lit(None).cast(types[prompt_id]).alias("__a"), F.col(pending_id).alias("__b"))

    def take():
        waiting: deque = deque()

        def step(at, kind, p, q):
            while waiting and at - waiting[0][0] > seconds * 1_000_000:
                waiting.popleft()
            if kind == 0:
                waiting.append((at, p))
            elif waiting:
                return [(waiting.popleft()[1], q)]
            return ()

        return step

    both = reach_segments(a.unionByName(b), by, "__ts", seconds).withColumn("__at", micros("__ts"))
    keys = [*by, "__segment"]
    got = by_key(two_sided(both, keys, "__kind"), keys, ["__at", "__kind", "__a", "__b"], ["__at", "__kind", "__a", "__b"], take, ", ".join(f"`{c}` {t}" for c, t in types.items()), placed=True)
    return got.drop("__segment")


def repeated_within(rows: DataFrame, keys: list[str], order: list[str], ts: str, seconds: float, resets: Column | None = None, segment_by: list[str] | None = None) -> DataFrame:
    """Adds is_repeat: an equal row (by keys) came at most `seconds` before, with no reset row between."""
    out = rows
    if resets is not None:
        upto = Window.partitionBy(*(segment_by or keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("__segment", F.count_if(F.coalesce(resets, F.lit(False))).over(upto))
        keys = [*keys, "__segment"]
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order))
    out = out.withColumn("is_repeat", F.coalesce(micros(ts) - micros(before) <= int(seconds * 1e6), F.lit(False)))
    return out.drop("__segment")


def duplicate_thoughts(rows: DataFrame, keys: list[str], order: list[str], ts: str, step_scoped: str, row_id: str, seconds: float = 5.0, resets: Column | None = None, segment_by: list[str] | None = None) -> DataFrame:
    """(keys, row_id, is_duplicate): a thought told twice, once for its step and once for its turn, at most `seconds` apart in any order.

    A row is compared with the last of its keys (session, turn, text) that wasn't a duplicate itself, and takes its place if it isn't one either.
    resets (with segment_by, the session): rows at which all that was told is forgotten; they are no thoughts themselves.
    """
    cut = F.lit(False) if resets is None else F.coalesce(resets, F.lit(False))
    at = F.struct(*order)
    upto = Window.partitionBy(*(segment_by or keys)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumns({"__cut": cut, "__order": at, "__at": micros(ts)}).withColumn("__segment", F.count_if("__cut").over(upto)).where(~F.col("__cut"))

    def compare():
        last: list = []

        def step(at_us, scoped, i):
            if last and last[1] != scoped and abs(at_us - last[0]) <= seconds * 1_000_000:
                return [(i, True)]
            last[:] = [at_us, scoped]
            return [(i, False)]

        return step

    found = by_key(told, [*keys, "__segment"], ["__order"], ["__at", step_scoped, row_id], compare, f"`{row_id}` {dict(rows.dtypes)[row_id]}, is_duplicate boolean")
    return found.drop("__segment")


def wave_bounds(calls: DataFrame, by: list[str], start: str, end: str, duration: str, anchored: Column) -> DataFrame:
    """by..., calls, started, ended, wall_ms, summed_ms: how long a wave of parallel calls took.

    Only calls with a clock of their own bound a wave; one without any has no bounds. A call without an end ends its duration after its start.
    summed_ms adds up what its calls say they took, which is what a catalog's parallel group shows.
    """
    last = F.coalesce(F.col(end), F.timestamp_micros(micros(start) + F.round(F.col(duration) * 1000).cast("long")).cast("timestamp"), F.col(start))
    fine = F.coalesce(anchored, F.lit(False))
    got = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.min(F.when(fine, F.col(start))).alias("started"), F.max(F.when(fine, last)).alias("ended"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("summed_ms"))
    return got.withColumn("wall_ms", (micros("ended") - micros("started")) / 1000.0)


def without_followers(rows: DataFrame, matched: DataFrame, by: list[str], ts: str, row_id: str, seconds: int = 30) -> DataFrame:
    """rows less the nearest one that follows each matched request within `seconds` (its fallback record)."""
    gone = adopt_pending(matched, rows, by, f"m_{ts}", ts, f"m_{row_id}", row_id, seconds)
    return rows.join(gone.select(row_id), row_id, "left_anti")


def waves(calls: DataFrame, by: list[str], start: str, end: str, call_id: str) -> DataFrame:
    """Calls that overlap in time (strictly), as groups of two or more: by..., wave, members, started, ended, call ids.

    Gaps and islands: a call that starts at or after all earlier ends opens a new island.
    """
    order = Window.partitionBy(*by).orderBy(start, end, call_id)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = calls.withColumn("__new", F.coalesce(F.col(start) >= reach, F.lit(True)))
    marked = marked.withColumn("__wave", F.count_if("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = marked.groupBy(*by, "__wave").agg(F.count(F.lit(1)).alias("members"), F.min(start).alias("started"), F.max(end).alias("ended"), F.array_sort(F.collect_list(call_id)).alias("calls")).where("members >= 2")
    return groups.withColumn("wave", F.row_number().over(Window.partitionBy(*by).orderBy("__wave")).cast("long")).drop("__wave")


def step_groups(requests: DataFrame, by: list[str], step: str) -> DataFrame:
    """Adds parallel: whether the assistant step that made the request made others, too."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, step))
    return requests.withColumn("parallel", F.col(step).isNotNull() & (n > 1))


def preceding(rows: DataFrame, by: list[str], order: list[str], wanted: Column, row_id: str, name: str) -> DataFrame:
    """Adds `name`: the id of the last wanted row before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(wanted, F.col(row_id)), ignorenulls=True).over(w))
