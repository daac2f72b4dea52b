"""Usage accounting: from samples of many shapes to one figure.

Samples: session, bucket (of the scope), record_id, name, value, unit, scope (Request, Turn, Session),
behavior (Delta, Cumulative, Final, Unknown), ts, authoritative, ord (order of arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import payloads, tools
from turnstone.functions.tools import token_family

#: The last parts of names (letters and digits, lower-cased) that are one family; any other is its own.
FAMILIES = {
    "inputtokens": ("input", "inputtoken", "inputtokens"),
    "outputtokens": ("output", "outputtoken", "outputtokens"),
    "cachereadtokens": ("cacheread", "cachereadtoken", "cachereadtokens", "cachereadinputtokens"),
    "cachewritetokens": ("cachewrite", "cachewritetoken", "cachewritetokens", "cachecreationinputtokens"),
    "reasoningtokens": ("reasoning", "reasoningtoken", "reasoningtokens", "thinkingtoken", "thinkingtokens"),
}
#: First parts under which figures aren't a model's.
GENERAL = ("usage", "tokendetails")


def name_parts(name: Column) -> Column:
    """The parts of a dotted name, lower-cased, without blanks around and empty ones."""
    low = F.lower(F.trim(name))
    close = F.when(low.rlike(r"\s"), F.regexp_replace(low, r"\s*\.\s*", ".")).otherwise(low)
    return F.array_remove(F.split(close, r"\."), "")


def is_model_metric(parts: Column) -> Column:
    """Figures of one model: two parts at least, one of them modelMetrics, or the first agentMetrics or a model's own name."""
    return (F.size(parts) >= 2) & (F.array_contains(parts, "modelmetrics") | ~F.get(parts, F.lit(0)).isin(*GENERAL))


def metric_family(parts: Column) -> Column:
    """The kind of figure, by the last part of its name."""
    last = F.get(parts, F.size(parts) - 1)
    leaf = F.regexp_replace(last, r"[^\p{L}\p{Nd}]", "")
    known = F.create_map(*[F.lit(x) for family, leaves in FAMILIES.items() for n in leaves for x in (n, family)])
    # most are known as they stand or without strokes; only others need the pattern
    return F.coalesce(F.try_element_at(known, F.translate(last, "_-", "")), F.try_element_at(known, leaf), leaf, F.lit(""))


def metric_owner(parts: Column) -> Column:
    """Whose figure it is: a model's, an agent's, or an agent's model's."""
    at = F.array_position(parts, "modelmetrics").cast("int")
    model, agent = F.when(at > 0, F.get(parts, at)), F.get(parts, F.lit(0)) == "agentmetrics"
    return (
        F.when(model.isNotNull() & agent & (at >= 3), F.concat(F.lit("agent:"), F.get(parts, F.lit(1)), F.lit(":model:"), model))
        .when(model.isNotNull(), F.concat(F.lit("model:"), model))
        .when(agent, F.concat(F.lit("agent:"), F.get(parts, F.lit(1))))
        .otherwise(F.concat(F.lit("model:"), F.get(parts, F.lit(0))))
    )


def sample_micros(ts: Column) -> Column:
    return F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(-(10**17)))


def distinct_samples(samples: DataFrame, by: list[str]) -> DataFrame:
    """Samples without repeats of one measurement, names and units in lower case, as they are compared; the first stays. micros: its time."""
    keys = list(dict.fromkeys([*by, "record_id", "value", "scope", "behavior", "bucket", "name", "unit"]))
    sure = F.when(F.col("authoritative"), 2).when(~F.col("authoritative"), 1).otherwise(0)
    low = samples.withColumns({"name": F.lower("name"), "unit": F.lower("unit"), "__first": sample_micros(F.col("ts")) * 4 + sure})
    # one plain value for all that the first tells: what hash aggregation keeps in place
    first = low.groupBy(*keys).agg(F.min_by("__first", "ord").alias("__first"), F.min("ord").alias("ord"))
    code = F.pmod("__first", F.lit(4))
    return first.select(*keys, "ord", F.expr("(__first - pmod(__first, 4)) DIV 4").alias("micros"), F.when(code > 0, code == 2).alias("authoritative"))


def metric_kind(low: Column) -> Column:
    """What a lower-cased name stands for, as one text: 1 for an agent's copy of a model's figure, 2 without a name, else 0; then its metric, which has a colon if it is a model's."""
    parts = F.col("__parts")
    sign = F.when(low.isNull(), "2").when(low.startswith("agentmetrics.") & low.contains(".modelmetrics."), "1").otherwise("0")
    metric = F.when(is_model_metric(parts), F.concat(metric_owner(parts), F.lit(":"), metric_family(parts))).otherwise(metric_family(parts))
    return F.concat(sign, metric)


def with_kind(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__parts", name_parts(F.col("name"))).withColumn("__kind", metric_kind(F.col("name"))).drop("__parts")


def usage_total(samples: DataFrame, by: list[str], dealt: bool = False) -> DataFrame:
    """by..., total. The rules, in order:

    1. repeats of one measurement count once;
    2. Session samples, if any, stand alone, else Turn samples, else all; of Session samples those that aren't
       of single models, if any, stand alone, else agents' copies of models' figures go;
    3. per metric and bucket what one record tells by several names counts once; authoritative samples, if any,
       stand alone; the latest Final wins, else the largest Cumulative, else Deltas and Unknowns add up;
    4. metrics and buckets add up.

    Samples are dealt out once, by record, for both kinds of repeats, so a session may have any share of them. Names are taken apart
    where the samples are: a join with a table of names would deal out all samples by name, and then anew. Rule 3 needs no other
    bucket: its cells are summed, pre-aggregated, to a row per metric and scope, and only those few rows meet by `by` for rule 2.
    dealt: samples come partitioned by bucket and no record has several buckets; then neither samples nor cells are dealt out again.
    """
    s = distinct_samples(samples if dealt else samples.repartition(*by, "record_id", "bucket"), by)
    low = F.col("name")
    listed = F.coalesce(low.startswith("modelmetrics."), F.lit(False))
    s = s.withColumn("__rank", F.when(F.col("scope") == "Session", 2).when(F.col("scope") == "Turn", 1).otherwise(0))
    # by name, what a name stands for is read where there is a row per name
    late = "name" in by
    kind = ["__rank"] if late else ["__rank", "__kind"]
    s = s if late else with_kind(s)
    told = [*by, "record_id", "value", "scope", "behavior", "bucket", "authoritative", *kind]
    # when a sample was told as one number: its clock, then what its name is liked for, then its arrival
    s = s.withColumn("__clock", F.col("micros") * 4 + F.when(listed, 2).when(low.contains(".modelmetrics."), 1).otherwise(0)).withColumn("__listed", listed)
    s = s.groupBy(*told).agg(F.min_by("__clock", "ord").alias("__clock"), F.min("ord").alias("ord"), F.max("__listed").alias("__listed"))
    s = s.withColumn("__when", F.expr("CAST(__clock AS DECIMAL(38, 0)) * CAST(10000000000000000000 AS DECIMAL(20, 0)) + ord"))
    # a bucket of its scope, which the rank tells, or a request's record
    cell = F.when(F.col("__rank") > 0, F.col("bucket").cast("string")).otherwise(F.col("record_id").cast("string"))

    def value(fine: Column) -> Column:
        final = fine & (F.col("behavior") == "Final")
        return F.coalesce(
            F.max_by(F.when(final, F.col("value")), F.when(final, F.col("__when"))),
            F.max(F.when(fine & (F.col("behavior") == "Cumulative"), F.col("value"))),
            F.sum(F.when(fine & F.col("behavior").isin("Delta", "Unknown"), F.col("value"))),
            F.lit(0),
        )

    sure = F.coalesce(F.col("authoritative"), F.lit(False))
    cells = s.withColumn("__cell", cell).groupBy(*by, *(["bucket"] if dealt else []), "__cell", *kind).agg(F.when(F.max(sure), value(sure)).otherwise(value(F.lit(True))).alias("__value"), F.max("__listed").alias("__listed"))
    m = cells.groupBy(*by, *kind).agg(F.sum("__value").alias("__value"), F.max("__listed").alias("__listed"))
    m = with_kind(m) if late else m
    metric = F.substr("__kind", F.lit(2))
    m = m.withColumns({"__copy": F.col("__kind").startswith("1"), "__model": metric.contains(":"), "__of": F.regexp_extract(metric, "^(?:agent:.*?:)?model:(.*)$", 1)})
    w = Window.partitionBy(*by)
    m = m.withColumns({"__top": F.max("__rank").over(w), "__plain": F.coalesce(F.max((F.col("__rank") == 2) & ~F.col("__model")).over(w), F.lit(False))})
    m = m.withColumn("__told", F.collect_set(F.when((F.col("__rank") == 2) & F.col("__listed"), F.col("__of"))).over(w))
    session = F.when(F.col("__plain"), ~F.col("__model")).otherwise(~(F.col("__copy") & F.coalesce(F.array_contains("__told", F.col("__of")), F.lit(False))))
    kept = m.where((F.col("__rank") == F.col("__top")) & ((F.col("__top") != 2) | session))
    return kept.groupBy(*by).agg(F.sum("__value").cast("long").alias("total"))


def token_totals(samples: DataFrame, by: list[str], dealt: bool = False) -> DataFrame:
    """by..., input, output, cache_read, cache_write, reasoning: usage_total of each family of tokens. Without any input sample input is null; the others are 0."""
    families = token_family(F.col("name"))
    of = F.explode(F.array(*[F.when(fits, F.lit(f)) for f, fits in families.items()]))
    totals = usage_total(samples.where("unit = 'tokens'").withColumn("family", of).where("family IS NOT NULL"), [*by, "family"], dealt)
    pick = lambda f: F.max(F.when(F.col("family") == f, F.col("total")))
    return totals.groupBy(*by).agg(*[(pick(f) if f == "input" else F.coalesce(pick(f), F.lit(0))).cast("long").alias(f) for f in families])


def once_per_step(rows: DataFrame, by: list[str], step: str, raw: str, order: str) -> DataFrame:
    """Rows less those that tell a step's usage again in the same words; rows without a step or usage all stay."""
    told = F.col(step).isNotNull() & F.col(raw).isNotNull()
    first = F.row_number().over(Window.partitionBy(*by, step, raw).orderBy(order)) == 1
    return rows.withColumn("__first", first | ~told).where("__first").drop("__first")


def usage_by_name(samples: DataFrame, by: list[str], dealt: bool = False) -> DataFrame:
    """by..., name_key, unit_key, total: usage_total per name and unit (without case), zeros left out."""
    low = samples.withColumns({"name": F.lower("name"), "unit": F.lower("unit")})
    totals = usage_total(low, [*by, "name", "unit"], dealt).where("total <> 0")
    return totals.withColumnsRenamed({"name": "name_key", "unit": "unit_key"})


def session_rescope(samples: DataFrame, token_input: Column, cache_read: Column) -> DataFrame:
    """Authoritative input and cache-read samples as session snapshots, for a session's own view."""
    move = F.col("authoritative") & (token_input | cache_read)
    return samples.withColumns({"scope": F.when(move, "Session").otherwise(F.col("scope")), "behavior": F.when(move & (F.col("behavior") == "Unknown"), "Cumulative").otherwise(F.col("behavior"))})


def after_last_open(rows: DataFrame, by: list[str], order: str, opens: Column) -> DataFrame:
    """Rows after a session's last start or resume: final figures told before it no longer hold."""
    return rows.withColumn("__open", F.max(F.when(opens, F.col(order))).over(Window.partitionBy(*by))).where(F.col("__open").isNull() | (F.col(order) > F.col("__open"))).drop("__open")


_SAMPLE = "array<struct<name: string, value: bigint, unit: string, scope: string, behavior: string>>"


def _sample(name: Column | str, value: Column, unit: str, scope: str, behavior: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(name).alias("name"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(scope).alias("scope"), lit(behavior).alias("behavior"))


def _some(*samples: Column) -> Column:
    return F.filter(F.array(*samples).cast(_SAMPLE), lambda s: s["value"].isNotNull())


def assistant_usage(message: Column) -> Column:
    """Samples of an assistant message's `usage`: what it has read counts as a snapshot, what it wrote adds up; server tools by name."""
    n = lambda p: F.try_variant_get(message, f"$.usage.{p}", "bigint")
    read = [_sample(p, n(p), "tokens", "Turn", "Cumulative") for p in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
    written = [_sample("output_tokens", n("output_tokens"), "tokens", "Turn", "Delta"), _sample("thinking_tokens", n("output_tokens_details.thinking_tokens"), "tokens", "Turn", "Delta")]
    tools = F.map_entries(F.coalesce(F.try_variant_get(message, "$.usage.server_tool_use", "map<string, bigint>"), F.create_map().cast("map<string, bigint>")))
    more = F.transform(tools, lambda e: _sample(e["key"], e["value"], "requests", "Turn", "Delta"))
    return F.concat(_some(*read, *written), F.filter(more.cast(_SAMPLE), lambda s: s["value"].isNotNull()))


#: Figures of a cost row and their units, and those that it has of each model.
COST = {"totalAPIDuration": "ms", "totalAPIDurationWithoutRetries": "ms", "totalToolDuration": "ms", "totalDuration": "ms", "totalLinesAdded": "lines", "totalLinesRemoved": "lines"}
MODEL_COST = {"inputTokens": "tokens", "outputTokens": "tokens", "cacheReadInputTokens": "tokens", "cacheCreationInputTokens": "tokens", "webSearchRequests": "requests"}


def cost_state(row: Column) -> Column:
    """Samples of a session's cost row: final figures, dollars as whole millionths, and each model's under its name."""
    final = [_sample(p, F.try_variant_get(row, f"$.{p}", "bigint"), unit, "Session", "Final") for p, unit in COST.items()]
    dollars = F.coalesce(F.try_variant_get(row, "$.totalCostUSD", "double"), F.try_variant_get(row, "$.total_cost_usd", "double"))
    final.append(_sample("total_cost_usd", F.round(dollars * 1_000_000).cast("bigint"), "micro-usd", "Session", "Final"))
    models = F.map_entries(F.coalesce(F.try_variant_get(row, "$.modelUsage", "map<string, variant>"), F.create_map().cast("map<string, variant>")))
    per = F.flatten(F.transform(models, lambda m: F.array(*[_sample(F.concat(m["key"], F.lit(f".{p}")), F.try_variant_get(m["value"], f"$.{p}", "bigint"), unit, "Session", "Final") for p, unit in MODEL_COST.items()])))
    return F.concat(_some(*final), F.filter(per.cast(_SAMPLE), lambda s: s["value"].isNotNull()))


def token_fields(stop: Column, inputs: Column, outputs: Column, cache_read: Column, cache_write: Column) -> Column:
    """Samples of an event's own token fields: final on a stop; else what was read is a snapshot, and what was written adds up."""
    snapshot, added = F.when(stop, "Final").otherwise("Cumulative"), F.when(stop, "Final").otherwise("Delta")
    return _some(
        _sample("input_tokens", inputs, "tokens", "Turn", snapshot),
        _sample("output_tokens", outputs, "tokens", "Turn", added),
        _sample("cache_read_tokens", cache_read, "tokens", "Turn", snapshot),
        _sample("cache_write_tokens", cache_write, "tokens", "Turn", added),
    )


def metadata_usage(metadata: Column) -> Column:
    """Samples (name, value, unit, behavior) of a session's metadata map: its usage.final.* keys, without any its usage.latest.* keys."""
    entries = F.map_entries(metadata)
    of = lambda prefix: F.filter(entries, lambda e: e["key"].startswith(prefix) & ~e["key"].endswith(".unit"))
    final = F.size(of("usage.final.")) > 0
    some = F.filter(F.when(final, of("usage.final.")).otherwise(of("usage.latest.")), lambda e: e["value"].try_cast("bigint").isNotNull())
    return F.transform(
        some,
        lambda e: F.struct(
            F.regexp_replace(e["key"], r"^usage\.(?:final|latest)\.", "").alias("name"),
            e["value"].try_cast("bigint").alias("value"),
            F.coalesce(F.try_element_at(metadata, F.concat(e["key"], F.lit(".unit"))), F.lit("provider units")).alias("unit"),
            F.when(final, "Final").otherwise("Cumulative").alias("behavior"),
        ),
    )


def measures(rows: DataFrame, key: list[str], native: str, data: str, session_end: Column) -> DataFrame:
    """key..., name, value, unit, scope, behavior: the figures that rows of the second provider tell in their data (a JSON text).

    A session's end tells final figures of the session; a sub-agent's event tells of its turn, any other of a request. A figure's unit follows from
    the last part of its name.
    """
    ends = F.coalesce(session_end, F.lit(False))
    told = F.when(ends, payloads.session_measures(F.when(ends, F.col(data)))).otherwise(payloads.event_measures(F.when(~ends, F.col(data))))
    scope = F.when(ends, "Session").when(F.col(native).startswith("subagent."), "Turn").otherwise("Request")
    each = rows.select(*key, scope.alias("scope"), F.when(ends, "Final").otherwise("Delta").alias("behavior"), F.explode(told).alias("m"))
    leaf = F.regexp_extract("m.name", r"([^.\]]*)$", 1)
    return each.select(*key, "m.name", "m.value", F.coalesce("m.unit", tools.usage_unit(leaf)).alias("unit"), "scope", "behavior").distinct()
