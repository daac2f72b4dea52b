"""Search over names, fields and raw payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(rows: DataFrame, needle: str, name: str, fields: str, payload: str) -> DataFrame:
    """Rows that contain the needle in any case, with match_target: the name before a field before the payload.

    fields: map column. A filter on the scan; nothing is shuffled.
    """
    low = needle.lower()
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    in_fields = F.coalesce(F.exists(F.map_entries(fields), lambda e: has(e["key"]) | has(e["value"])), F.lit(False))
    target = F.when(has(F.col(name)), "name").when(in_fields, "field").when(has(F.col(payload)), "payload")
    return rows.withColumn("match_target", target).where("match_target IS NOT NULL")


def find_event(rows: DataFrame, needle: str, native_event: str) -> DataFrame:
    return rows.where(F.contains(F.lower(native_event), F.lit(needle.lower())))


def find_sources(raw: DataFrame, owners: DataFrame, needle: str, source: str, text: str, owner: str) -> DataFrame:
    """(owner, source): owners of raw rows that hold the needle, each source once."""
    hits = raw.where(F.contains(F.lower(text), F.lit(needle.lower()))).select(source).distinct()
    return owners.join(hits, source, "left_semi").select(owner, source).distinct()
