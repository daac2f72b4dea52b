"""Pairs of rows that describe one action: by id, by position, by what came last."""

from __future__ import annotations

import itertools
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.times import micros
from turnstone.operators.intervals import reach_segments
from turnstone.operators.sequential import by_key, two_sided


def pair_by_id(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Each request with its completion, or nulls. The ids must be unique on the results' side."""
    return requests.join(results, keys, "left")


def last_result(results: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """A call's outcome: its last result."""
    return results.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns], F.max(order).alias(order))


def earlier_request(rows: DataFrame, keys: list[str], order: list[str], is_request: Column, row_id: str) -> DataFrame:
    """Adds request_id to each row: the nearest request before it with the same keys (calls may reuse an id)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("request_id", F.last(F.when(is_request, F.col(row_id)), ignorenulls=True).over(w))


def carry_state(rows: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """Fills each of the columns from the last row of the keys that had it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fifo_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], left_id: str, right_id: str) -> DataFrame:
    """(keys, left_id, right_id): the n-th of a key on one side with the n-th on the other, as from two queues."""
    a = left.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order))).select(*keys, "__n", left_id)
    b = right.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order))).select(*keys, "__n", right_id)
    return a.join(b, [*keys, "__n"]).drop("__n")


def tiered_pairs(left: DataFrame, right: DataFrame, call_id: str, scope: list[str], keys: list[str], left_order: list[str], right_order: list[str], left_id: str, right_id: str) -> DataFrame:
    """fifo_pairs in two tiers: first by call id inside the scope, then what is left by the keys; `tier` says which."""
    has = F.col(call_id).isNotNull()
    one = fifo_pairs(left.where(has), right.where(has), [*scope, call_id], left_order, right_order, left_id, right_id).select(left_id, right_id)
    rest = fifo_pairs(left.join(one, left_id, "left_anti"), right.join(one, right_id, "left_anti"), [*scope, *keys], left_order, right_order, left_id, right_id)
    return one.withColumn("tier", F.lit(1)).unionByName(rest.select(left_id, right_id).withColumn("tier", F.lit(2)))


def brackets(rows: DataFrame, by: list[str], order: list[str], starts: Column, ends: Column, row_id: str) -> DataFrame:
    """(by, end id, start id): an end closes the latest start that is still open, as brackets do.

    With d the depth after each row, an end's partner is the last start before it at depth d + 1.
    """
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(starts, 1).when(ends, -1).otherwise(0)
    sums = rows.where(starts | ends).withColumn("__step", step)
    sums = sums.withColumn("__sum", F.sum("__step").over(upto)).withColumn("__low", F.least(F.lit(0), F.min("__sum").over(upto)))
    # ends without an open start don't count: depth above the lowest point so far
    depth = sums.withColumn("__depth", F.col("__sum") - F.col("__low"))
    low_before = F.coalesce(F.lag("__low").over(Window.partitionBy(*by).orderBy(*order)), F.lit(0))
    depth = depth.withColumn("__orphan", (F.col("__step") == -1) & (F.col("__low") < low_before))
    level = depth.withColumn("__level", F.when(F.col("__step") == 1, F.col("__depth")).otherwise(F.col("__depth") + 1)).where(~F.col("__orphan"))
    before = Window.partitionBy(*by, "__level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    partner = F.last(F.when(F.col("__step") == 1, F.col(row_id)), ignorenulls=True).over(before)
    return level.withColumn("start_id", partner).where((F.col("__step") == -1) & F.col("start_id").isNotNull()).select(*by, F.col(row_id).alias("end_id"), "start_id")


def inherit_time(rows: DataFrame, by: list[str], order: list[str], ts: str) -> DataFrame:
    """Rows without a clock get the time of the last one before them that has it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(ts, F.coalesce(ts, F.last(ts, ignorenulls=True).over(w)))


def greedy_by_skew(rows: DataFrame, keys: list[str], order: list[str], side: str, ts: str, row_id: str, most_seconds: float = 30.0) -> DataFrame:
    """(keys, left_id, right_id): in arrival order each row takes the free one of the other side with the least skew.

    Both sides ("left", "right" in the column `side`) come interleaved; a candidate is used once, and not
    beyond most_seconds; equal skews go to the earlier arrival. Sequential by nature: inside a segment of rows
    that are within reach of each other.
    """
    kind = dict(rows.dtypes)[row_id]
    kept = reach_segments(rows.select(*dict.fromkeys([*keys, *order, side, ts, row_id])), keys, ts, most_seconds).withColumn("__at", micros(ts))

    def take():
        free: dict[str, list] = {"left": [], "right": []}

        def step(s, at, i):
            pool = free["right" if s == "left" else "left"]
            best = min(((abs(at - u), n) for n, (u, _) in enumerate(pool)), default=None)
            if best is None or best[0] > most_seconds * 1_000_000:
                free[s].append((at, i))
                return ()
            j = pool.pop(best[1])[1]
            return [(i, j) if s == "left" else (j, i)]

        return step

    within = [*keys, "__segment"]
    got = by_key(two_sided(kept, within, side), within, order, [side, "__at", row_id], take, f"left_id {kind}, right_id {kind}", placed=True)
    return got.drop("__segment")


def queue_matches(rows: DataFrame, keys: list[str], order: list[str], kind: str, args: str, row_id: str) -> DataFrame:
    """(keys, request_id, result_id): a result takes the first open request with equal arguments, else the earliest open one.

    `kind` is "request" or "result"; sequential inside (keys), in arrival order. Only open requests are held, by arguments.
    """
    id_type = dict(rows.dtypes)[row_id]

    def take():
        waiting: dict = {}  # all open requests, the earliest first
        same: dict = defaultdict(deque)  # those with some arguments; taken ones are passed over
        number = itertools.count()

        def step(k, a, i):
            if k == "request":
                n = next(number)
                waiting[n] = i
                if a is not None:
                    same[a].append(n)
                return ()
            mine = same.get(a, ())
            while mine and mine[0] not in waiting:
                mine.popleft()
            n = mine.popleft() if mine else next(iter(waiting), None)
            return () if n is None else [(waiting.pop(n), i)]

        return step

    return by_key(rows, keys, order, [kind, args, row_id], take, f"request_id {id_type}, result_id {id_type}")


def stand_ins(rows: DataFrame, keys: list[str], order: list[str], is_hook: Column, row_id: str) -> DataFrame:
    """(keys, row_id, change, partner): calls that no hook tells yet get a stand-in, which a later hook of the same signature replaces.

    A transcript's row takes the first hook that is free (AttachEvidence), else it is Added as a stand-in; a hook takes the place
    of the first stand-in (PromotePrimary), else it is Added. Only one side can be waiting at a time, so the n-th of one side
    always meets the n-th of the other: two windows, no state.
    """
    at = F.struct(*order)
    side = rows.withColumn("__hook", is_hook)
    n = F.row_number().over(Window.partitionBy(*keys, "__hook").orderBy(at))
    before = F.lag(row_id).over(Window.partitionBy(*keys, "__n").orderBy(at))
    change = F.when(F.col("partner").isNull(), "Add").when(F.col("__hook"), "PromotePrimary").otherwise("AttachEvidence")
    return side.withColumn("__n", n).withColumn("partner", before).select(*keys, row_id, change.alias("change"), "partner")


def standing_in(rows: DataFrame, keys: list[str], order: list[str], is_hook: Column, row_id: str) -> DataFrame:
    """(keys, node_id, stand_in): the nodes that are left: one for each call, by its hook, or a stand-in that no hook has replaced."""
    side = rows.withColumn("__hook", is_hook)
    n = side.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__hook").orderBy(F.struct(*order))))
    nodes = n.groupBy(*keys, "__n").agg(F.max_by(row_id, F.col("__hook").cast("int")).alias("node_id"), (~F.bool_or("__hook")).alias("stand_in"))
    return nodes.drop("__n")


def learned_alias(rows: DataFrame, matches: DataFrame, by: list[str], alias: str, order: str, hook: str) -> DataFrame:
    """Adds `hook` to the rows of an alias (a transcript's own call id) that come after its first match.

    matches: by, alias, order and hook of rows that a signature has matched.
    """
    known = matches.where(F.col(alias).isNotNull()).groupBy(*by, alias).agg(F.min_by(hook, order).alias(hook), F.min(order).alias("__since"))
    return rows.join(known, [*by, alias], "left").withColumn(hook, F.when(F.col(order) > F.col("__since"), F.col(hook))).drop("__since")


def inner_executions(rows: DataFrame, keys: list[str], order: list[str], starts: Column, ends: Column, row_id: str, owner: str) -> DataFrame:
    """(keys, end id, start id, nested_in) of every end of an inner execution.

    An end takes the start of its keys if exactly one is open, which closes it; with none open, or several, it nests in its
    owner (null: an orphan). Several open ones stay open, so what comes after a second start is never told apart again: a
    window over the keys is enough.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    s = rows.where(starts | ends).withColumn("__start", starts).withColumn("__after", F.coalesce(F.lag("__start").over(w), F.lit(False)))
    s = s.withColumns({"__prior": F.lag(row_id).over(w), "__mixed": F.max(F.col("__start") & F.col("__after")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.when(F.col("__after") & ~F.col("__mixed"), F.col("__prior"))
    return s.where(~F.col("__start")).select(*keys, F.col(row_id).alias("end_id"), start.alias("start_id"), F.coalesce(start, F.col(owner)).alias("nested_in"))


def thought_steps(thoughts: DataFrame, bindings: DataFrame, by: list[str], step: str, order: str, hook: str) -> DataFrame:
    """thoughts with the hook that their assistant step is bound to: the first binding of the step, if it came before the thought."""
    first = bindings.where(F.col(step).isNotNull()).groupBy(*by, step).agg(F.min_by(hook, order).alias(hook), F.min(order).alias("__since"))
    return thoughts.join(first, [*by, step], "left").withColumn(hook, F.when(F.col("__since") < F.col(order), F.col(hook))).drop("__since")
