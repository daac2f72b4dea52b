"""Scored joins: the best candidate wins, equal best ones mean no match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What agreement on a field is worth; a field present on both sides that differs disqualifies.
SHELL = {"command": 100, "cwd": 20, "sandbox": 5}
MCP = {"tool": 20, "server": 40, "url": 30, "command": 20, "input": 100}
FILE = {"path": 100}
INPUT = {"input": 100}


def field_score(fields: dict[str, int], left: str = "l_", right: str = "r_") -> Column:
    """The score of a candidate pair with columns l_<field>, r_<field>; null when it is disqualified."""
    total, clash = F.lit(0), F.lit(False)
    for name, worth in fields.items():
        a, b = F.col(f"{left}{name}"), F.col(f"{right}{name}")
        total = total + F.when(a == b, worth).otherwise(0)
        clash = clash | F.coalesce(a != b, F.lit(False))
    return F.when(~clash, total)


def unique_best(candidates: DataFrame, key: list[str], score: str) -> DataFrame:
    """Of each key's candidates the one with the best score; none where two share it. Null scores are out.

    One aggregate: of a key's best rows the one of the largest and the one of the smallest number are the same if there is only one.
    """
    rest = [c for c in candidates.columns if c not in key and c != score]
    rows = candidates.where(F.col(score).isNotNull()).withColumn("__row", F.monotonically_increasing_id())
    best = rows.groupBy(*key).agg(F.max(F.struct(score, "__row", *rest)).alias("__high"), F.min(F.struct((-F.col(score)).alias("__s"), "__row")).alias("__low"))
    return best.where("__high.__row = __low.__row").select(*[c if c in key else F.col(f"__high.`{c}`").alias(c) for c in candidates.columns])


def sole(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Candidates of keys that have exactly one."""
    return candidates.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("__n = 1").drop("__n")


def best_or_sole(candidates: DataFrame, key: list[str], score: str) -> DataFrame:
    """unique_best over candidates that score above 0; for keys without any, the sole candidate that isn't disqualified."""
    scored = unique_best(candidates.where(F.col(score) > 0), key, score)
    had = candidates.where(F.col(score) > 0).select(*key).distinct()
    return scored.unionByName(sole(candidates.where(F.col(score) == 0).join(had, key, "left_anti"), key))


def match_ladder(left: DataFrame, right: DataFrame, scope: list[str], rungs: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, rung): a row matches by the first rung on which it has exactly one partner.

    rungs: names of key columns that both sides have, the strongest first.
    """
    out, rest = None, left
    for name in rungs:
        pairs = sole(rest.where(F.col(name).isNotNull()).join(right.select(*scope, name, right_id), [*scope, name]).select(left_id, right_id), [left_id])
        pairs = pairs.withColumn("rung", F.lit(name))
        out = pairs if out is None else out.unionByName(pairs)
        rest = rest.join(pairs.select(left_id), left_id, "left_anti")
    return out


def all_or_nothing(batches: DataFrame, calls: DataFrame, scope: list[str], batch_id: str, ids: str, call_id: str) -> DataFrame:
    """(scope, batch, calls, kind) of batches whose ids were all found: one id nests, several group."""
    wanted = batches.select(*scope, batch_id, F.explode(F.array_distinct(ids)).alias(call_id), F.size(F.array_distinct(ids)).alias("__n"))
    got = wanted.join(calls.select(*scope, call_id).distinct(), [*scope, call_id])
    groups = got.groupBy(*scope, batch_id, "__n").agg(F.count(F.lit(1)).alias("__found"), F.array_sort(F.collect_list(call_id)).alias("calls"))
    return groups.where("__found = __n").select(*scope, batch_id, "calls", F.when(F.col("__n") == 1, "nest").otherwise("group").alias("kind"))


def unique_both(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(keys, left_id, right_id) for keys that occur exactly once on each side."""
    once = lambda d, i: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(i).alias(i)).where("__n = 1").drop("__n")
    return once(left, left_id).join(once(right, right_id), keys)


def learned_names(rows: DataFrame, by: list[str], order: list[str], name: str, teaches: Column, server: Column, resets: Column) -> DataFrame:
    """Adds learned_server: the server last learned for the row's flat tool name in the session so far.

    Lifecycle rows forget. One window per (session, segment, name).
    """
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__segment", F.count_if(F.coalesce(resets, F.lit(False))).over(upto))
    w = Window.partitionBy(*by, "__segment", name).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("learned_server", F.last(F.when(F.coalesce(teaches, F.lit(False)), server), ignorenulls=True).over(w)).drop("__segment")


def priority_bind(*tiers: tuple[str, DataFrame], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, tier): the first tier of bindings that knows a row has it."""
    all_ = None
    for n, (name, pairs) in enumerate(tiers):
        part = pairs.select(left_id, right_id, F.lit(name).alias("tier"), F.lit(n).alias("__n"))
        all_ = part if all_ is None else all_.unionByName(part)
    w = Window.partitionBy(left_id).orderBy("__n", right_id)
    return all_.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__n")
