"""Report labels: what a row of a report says in a few words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " · "


def joined(*parts: Column) -> Column:
    """The parts that say something, one after another; null when none does."""
    some = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(some) > 0, F.array_join(some, SEPARATOR))


def duration_label(ms: Column) -> Column:
    """Milliseconds as hours, minutes, seconds and the rest, from the first that isn't nought; never below 0."""
    n = F.greatest(F.lit(0), F.round(ms).cast("long"))
    part = lambda size, of: F.floor(n / size) % of
    h, m, s = F.floor(n / 3_600_000), part(60_000, 60), part(1000, 60)
    wide = lambda v, digits: F.lpad(v.cast("string"), digits, "0")
    tail = F.concat(wide(s, 2), F.lit("s "), wide(n % 1000, 3), F.lit("ms"))
    return F.when(
        ms.isNotNull(),
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), wide(m, 2), F.lit("m "), tail))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), tail))
        .when(s > 0, F.concat(s.cast("string"), F.lit("s "), wide(n % 1000, 3), F.lit("ms")))
        .otherwise(F.concat(n.cast("string"), F.lit("ms"))),
    )


def token_label(n: Column) -> Column:
    """A count as it is, or in thousands or millions with two digits behind the point at most."""
    short = lambda size, unit: F.concat(F.regexp_replace(F.round(n / size, 2).cast("decimal(20,2)").cast("string"), r"\.?0+$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "k")).otherwise(n.cast("string"))


def occurrence_header(event: Column, detail: Column, clock: Column, shows_clock: Column, ms: Column) -> Column:
    """An event's name, its detail, and its clock time where that is meant to show, else how long it took."""
    return joined(event, detail, F.when(shows_clock, F.date_format(clock, "yyyy-MM-dd HH:mm:ss")).otherwise(duration_label(ms)))


def permission_detail(payload: Column) -> Column:
    """The kinds of permission that a request suggests; one suggestion may stand alone."""
    many = F.transform(F.try_variant_get(payload, "$.permission_suggestions", "array<variant>"), lambda s: F.try_variant_get(s, "$.type", "string"))
    types = F.filter(F.coalesce(many, F.array(F.try_variant_get(payload, "$.permission_suggestions.type", "string"))), lambda t: t.isNotNull())
    return F.when(F.size(types) > 0, F.array_join(types, ", "))


def batch_detail(payload: Column) -> Column:
    n = F.size(F.try_variant_get(payload, "$.tool_calls", "array<variant>"))
    return F.when(n == 1, "1 call").when(n >= 0, F.concat(n.cast("string"), F.lit(" calls")))


def tool_detail(name: Column, path: Column, command: Column) -> Column:
    """A tool's name, its target, and its command, if it has one; null without a name."""
    return F.when(name.isNotNull(), joined(name, path, command))


def _figure(payload: Column, name: str, kind: str = "long") -> Column:
    return F.try_variant_get(payload, f"$.{name}", kind)


def compaction_detail(payload: Column) -> Column:
    """What set a compaction off, how full the context was, its size, and how many messages it has and gives up."""
    share = F.regexp_replace(F.format_string("%.2f", _figure(payload, "context_usage_percent", "double")), r"\.?0+$", "")
    count = lambda n: F.coalesce(_figure(payload, n).cast("string"), F.lit("?"))
    messages = F.when(F.coalesce(_figure(payload, "message_count"), _figure(payload, "messages_to_compact")).isNotNull(), F.concat_ws("/", count("message_count"), count("messages_to_compact")))
    return joined(_figure(payload, "trigger", "string"), F.when(_figure(payload, "context_usage_percent", "double").isNotNull(), F.concat(share, F.lit("%"))), token_label(_figure(payload, "context_window_size")), messages)


def failure_detail(payload: Column) -> Column:
    """A failed call's tool, its kind of failure, and the first line of what it says."""
    lines = F.regexp_replace(F.coalesce(_figure(payload, "error_message", "string"), _figure(payload, "error", "string")), r"\r\n?", "\n")
    first = F.when(lines.contains("\n"), F.concat(F.rtrim(F.substring_index(lines, "\n", 1)), F.lit("..."))).otherwise(lines)
    return joined(_figure(payload, "tool_name", "string"), _figure(payload, "failure_type", "string"), first)


def token_detail(payload: Column) -> Column:
    """The token counts that a payload tells."""
    part = lambda name, field: F.concat(F.lit(f"{name} "), token_label(_figure(payload, field)))
    return joined(part("in", "input_tokens"), part("out", "output_tokens"), part("cache r", "cache_read_tokens"), part("cache w", "cache_write_tokens"))
