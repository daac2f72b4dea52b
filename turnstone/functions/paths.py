"""Paths and workspace keys. Paths compare without case; `/` and `\\` are one separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.text import distinct_by_case


def clean_root(path: Column) -> Column:
    """Trimmed, forward slashes, `/c:/x` as `c:/x`, no trailing slash but a root's own."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, r"^/([A-Za-z]:)", "$1")
    return F.when(F.length(p) > 1, F.regexp_replace(p, r"/+$", "")).otherwise(p)


def path_key(path: Column) -> Column:
    return F.lower(clean_root(path))


def workspace_key(roots: Column, cwd: Column) -> Column:
    """One key for a set of roots, or for the working directory without any: cleaned, first of each by case, sorted, upper case."""
    clean = F.filter(F.transform(F.coalesce(roots, F.array().cast("array<string>")), clean_root), lambda r: F.coalesce(r != "", F.lit(False)))
    some = F.when(F.size(clean) > 0, clean).when(F.coalesce(F.trim(cwd) != "", F.lit(False)), F.array(clean_root(cwd))).otherwise(clean)
    return F.nullif(F.upper(F.array_join(F.array_sort(distinct_by_case(some)), "|")), F.lit(""))


def workspace_kind(roots: Column, cwd: Column, told: Column) -> Column:
    """Normal with a root or directory; NoWorkspace where the event says it has none; else Unknown."""
    return F.when(workspace_key(roots, cwd).isNotNull(), "Normal").when(F.coalesce(told, F.lit(False)), "NoWorkspace").otherwise("Unknown")


def ancestors(path: Column) -> Column:
    """The path and all folders above it, longest first: `a/b/c` gives a/b/c, a/b, a."""
    parts = F.split(path, "/")
    n = F.size(parts)
    made = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(path.isNotNull() & (path != ""), F.filter(made, lambda p: p != ""))
