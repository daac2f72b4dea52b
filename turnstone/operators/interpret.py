"""Interpretation of native events: provider-neutral traits beside the untouched event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone import dims


def by_name_or_ordinal(raw: Column, names: tuple[str, ...], default: str) -> Column:
    """An enumeration's value told by name (any case) or by ordinal; anything else is the default."""
    array = F.array(*map(F.lit, names))
    by_name = F.get(F.filter(array, lambda n: F.lower(n) == F.lower(F.trim(raw))), F.lit(0))
    at = F.trim(raw).try_cast("int")
    return F.coalesce(by_name, F.when((at >= 0) & (at < len(names)), F.get(array, at)), F.lit(default))


def normal_envelope(rows: DataFrame) -> DataFrame:
    """Adds provider, surface and source_kind names to envelopes (provider, configuredSurface, detectedSurface, sourceKind as told)."""
    provider = by_name_or_ordinal(F.col("provider"), dims.PROVIDERS, "Unknown")
    out = rows.withColumn("provider", provider)
    surface = by_name_or_ordinal(F.coalesce("detectedSurface", "configuredSurface"), dims.SURFACES, "Unknown")
    by_provider = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in dims.DEFAULT_SURFACE.items() for x in kv]), F.col("provider")), F.lit("Unknown"))
    return out.withColumns({"surface": F.when(surface == "Unknown", by_provider).otherwise(surface), "source_kind": by_name_or_ordinal(F.col("sourceKind"), dims.SOURCE_KINDS, "Hook")})


def accepted(rows: DataFrame, provider: str, surface: str) -> DataFrame:
    """Rows whose surface is one of the provider's."""
    pairs = [("Cursor", "CursorIde"), ("ClaudeCode", "ClaudeCode"), ("GitHubCopilot", "CopilotCli"), ("GitHubCopilot", "VsCodeAgentHooks")]
    fits = F.lit(False)
    for p, s in pairs:
        fits = fits | ((F.col(provider) == p) & (F.col(surface) == s))
    return rows.where(fits)


def interpret(rows: DataFrame, surface: str, native_event: str, turn: str) -> DataFrame:
    """Adds role, scope, direction, tone, match_strategy, opens_tool, opens_subagent. Unknown events are Generic, and stay.

    The few dozen events are a literal map in the plan: nothing is joined, so an event that a third of all rows have costs no more.
    """
    name = F.col(native_event)
    j = rows.withColumn("__traits", dims.event_traits(F.col(surface), name))
    of = lambda n: F.col(f"__traits.{n}")
    told = (F.col(surface) == "CursorIde") & of("role").isNull()
    guess = F.when(told & name.rlike("^(before|pre)"), "Input").when(told & name.rlike("^(after|post)"), "Output").otherwise("None")
    scope = F.coalesce(F.nullif(of("scope_override"), F.lit("")), F.when(F.col(turn).isNull(), "Session").otherwise("Turn"))
    return j.select(
        *rows.columns,
        F.coalesce(of("role"), F.lit("Generic")).alias("role"),
        scope.alias("scope"),
        F.coalesce(of("direction"), guess).alias("direction"),
        F.coalesce(of("tone"), F.lit("Normal")).alias("tone"),
        F.coalesce(of("match_strategy"), F.lit("None")).alias("match_strategy"),
        (F.coalesce(of("opens"), F.lit("")) == "tool").alias("opens_tool"),
        (F.coalesce(of("opens"), F.lit("")) == "subagent").alias("opens_subagent"),
    )
