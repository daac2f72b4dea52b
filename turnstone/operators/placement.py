"""Which workspace a session, a plan or a path belongs to, and roll-ups over folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.paths import ancestors


def most_specific_root(paths: DataFrame, roots: DataFrame, path: str, root: str, key: str) -> DataFrame:
    """paths with the `key` of the longest root that contains them; null when two keys share that root.

    Paths are exploded to their ancestors and joined by equality: no prefix comparison of all pairs.
    """
    r = roots.select(F.lower(root).alias("__root"), key).distinct()
    r = r.groupBy("__root").agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias(key))
    one = paths.select(path).distinct()
    up = one.select(path, F.posexplode(ancestors(F.lower(path))).alias("__depth", "__root"))
    best = up.join(r, "__root").groupBy(path).agg(F.min_by(F.struct("__n", key), "__depth").alias("__b"))
    found = best.select(path, F.when(F.col("__b.__n") == 1, F.col(f"__b.{key}")).alias(key))
    return paths.join(found, path, "left")


#: What a kind of evidence is worth; what more kinds add; bounds of the verdict.
SIGNALS = {"native-id": 95, "project-key": 90, "tool-path": 75, "attachment": 70, "mention": 65}
PER_KIND, MOST, LEAST, MARGIN = 5, 99, 60, 15


def infer_workspace(signals: DataFrame, session: str, workspace: str, kind: str, score: str) -> DataFrame:
    """session, workspace (null when none or ambiguous), state, evidence, score, alternatives.

    Per workspace the best signal, 5 more per further kind, 99 at most; 60 are needed, and 15 more than
    the next. A native id or two kinds make it Corroborated, a project key Derived, else Heuristic.
    """
    per = signals.groupBy(session, workspace).agg(F.max(score).alias("__best"), F.count_distinct(kind).alias("__kinds"), F.bool_or(F.col(kind) == "native-id").alias("__native"), F.bool_or(F.col(kind) == "project-key").alias("__project"))
    per = per.withColumn("score", F.least(F.lit(MOST), F.col("__best") + PER_KIND * (F.col("__kinds") - 1)).cast("int")).where(F.col("score") >= LEAST)
    w = Window.partitionBy(session).orderBy(F.col("score").desc(), workspace)
    ranked = per.withColumns({"__r": F.row_number().over(w), "__next": F.lead("score").over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(session))}).where("__r = 1")
    clear = F.col("__next").isNull() | (F.col("score") - F.col("__next") >= MARGIN)
    evidence = F.when(F.col("__native") | (F.col("__kinds") >= 2), "Corroborated").when(F.col("__project"), "Derived").otherwise("Heuristic")
    return ranked.select(session, F.when(clear, F.col(workspace)).alias(workspace), F.when(clear, "Inferred").otherwise("Ambiguous").alias("state"), F.when(clear, evidence).otherwise("Ambiguous").alias("evidence"), "score", (F.col("__n") - 1).cast("long").alias("alternatives"))


def sole_workspace(signals: DataFrame, key: str, workspace: str) -> DataFrame:
    """key, workspace, candidates: the workspace where there is exactly one."""
    got = signals.groupBy(key).agg(F.count_distinct(workspace).alias("candidates"), F.min(workspace).alias("__w"))
    return got.select(key, F.when(F.col("candidates") == 1, F.col("__w")).alias(workspace), "candidates")


def root_conflicts(sessions: DataFrame, key: str, roots: str) -> DataFrame:
    """key, state, score: Ambiguous (90) where a session's roots lie in separate trees, else Single (95)."""
    shortest = F.array_sort(F.transform(roots, lambda r: F.lower(r)))
    first = F.element_at(shortest, 1)
    one = F.forall(shortest, lambda r: (r == first) | r.startswith(F.concat(first, F.lit("/"))))
    return sessions.select(key, F.when(one, "Single").otherwise("Ambiguous").alias("state"), F.when(one, 95).otherwise(90).alias("score"))


def folder_rollup(sessions: DataFrame, path: str, is_open: str, active: str) -> DataFrame:
    """folder, sessions, open, active, children of every folder above a session's.

    Chains of folders with a single child and the same sessions are one (the deepest); sessions without a
    folder count under `unknown`.
    """
    up = sessions.select(F.explode(F.coalesce(ancestors(F.col(path)), F.array(F.lit("unknown")))).alias("folder"), F.col(path).alias("__own"), is_open, active)
    got = up.groupBy("folder").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(is_open).alias("open"), F.max(active).alias("active"), F.count_if(F.coalesce(F.col("__own") == F.col("folder"), F.lit(True))).alias("__here"))
    parent = F.regexp_replace("folder", "/[^/]*$", "")
    kids = got.where(F.col("folder").contains("/")).groupBy(parent.alias("folder")).agg(F.count(F.lit(1)).alias("children"))
    out = got.join(kids, "folder", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return out.where(~((F.col("children") == 1) & (F.col("__here") == 0))).drop("__here")
