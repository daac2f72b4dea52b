"""The session catalog: one row per session out of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.dims import EVIDENCE


def evidence_rank(name: Column) -> Column:
    """0 (Unavailable) to 6 (Observed); unknown names are Unavailable."""
    return F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, EVIDENCE)), F.coalesce(name, F.lit(EVIDENCE[0]))) - 1).cast("int")


def evidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EVIDENCE)), rank + 1)


def dedupe_least(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one that arrived first."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def merge_sessions(entries: DataFrame, key: str, source_rank: str) -> DataFrame:
    """Folds a session's entries in source order into one.

    Entries: key, source_rank, source, workspace, title, model, started, active, open, evidence, files (array),
    metadata (map), weight (events and session events). Earliest start, latest activity, open if any is,
    strongest evidence; first known workspace; last model; first title that isn't the bare id;
    per metadata key the last non-blank value, else the first; `richest`: the source of the weightiest entry.
    """
    rank = F.col(source_rank)
    have = lambda c, cond=None: F.when(F.col(c).isNotNull() & (F.lit(True) if cond is None else cond), rank)
    known = F.coalesce(F.col("workspace") != "Unknown", F.lit(False))
    merged = entries.groupBy(key).agg(
        F.min("started").alias("started"),
        F.max("active").alias("active"),
        F.bool_or("open").alias("open"),
        evidence_name(F.max(evidence_rank(F.col("evidence")))).alias("evidence"),
        F.coalesce(F.min_by("workspace", have("workspace", known)), F.lit("Unknown")).alias("workspace"),
        F.max_by("model", have("model")).alias("model"),
        F.coalesce(F.min_by("title", have("title", F.col("title") != F.col(key).cast("string"))), F.min_by("title", have("title"))).alias("title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.max_by("source", F.struct(F.col("weight") + F.when(known, 10).otherwise(0), -rank)).alias("richest"),
    )
    pairs = entries.select(key, rank.alias("__rank"), F.explode("metadata").alias("k", "v"))
    filled = F.coalesce(F.trim("v") != "", F.lit(False))
    one = pairs.groupBy(key, "k").agg(F.coalesce(F.max_by("v", F.when(filled, F.col("__rank"))), F.min_by("v", "__rank")).alias("v"))
    maps = one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return merged.join(maps, key, "left")


def merge_events(events: DataFrame, key: list[str], event_id: str, rank: str) -> DataFrame:
    """Events of several sources, the first source's of each id."""
    return dedupe_least(events, [*key, event_id], [rank])


def consolidate_turns(turns: DataFrame, by: list[str], number: str, prompt_key: Column, request_id: str, order: str) -> DataFrame:
    """Turns of one number and prompt as one: a turn with a request id stands for them, else the first."""
    pick = F.struct(F.col(request_id).isNotNull().cast("int"), -F.col(order))
    kept = [c for c in turns.columns if c not in {*by, number}]
    return turns.withColumn("__p", prompt_key).groupBy(*by, number, "__p").agg(*[F.max_by(c, pick).alias(c) for c in kept], F.count(F.lit(1)).alias("merged")).drop("__p")


def id_consensus(rows: DataFrame, file: str, row_id: str) -> DataFrame:
    """file, session_id, conflict: the one id that a file's rows tell, else the file's name and a warning."""
    ids = rows.groupBy(file).agg(F.collect_set(row_id).alias("__ids"))
    name = F.regexp_extract(file, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return ids.select(file, F.when(F.size("__ids") == 1, F.element_at("__ids", 1).cast("string")).otherwise(name).alias("session_id"), (F.size("__ids") > 1).alias("conflict"))


#: How far each source of a title goes before the others.
TITLE_PRIORITY = {"custom": 100, "ai": 90, "agent": 80, "index-summary": 60, "cache": 55, "index-prompt": 50, "cache-prompt": 45, "history": 40}


def priority_pick(candidates: DataFrame, by: list[str], value: str, priority: str, order: str, later: bool = True) -> DataFrame:
    """The value of the highest priority; ties go to the later row, or the earlier one."""
    at = F.struct(priority, F.col(order) if later else -F.col(order))
    some = candidates.where(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))
    return some.groupBy(*by).agg(F.max_by(value, at).alias(value), F.max(at)[priority].alias(priority))


def latest_snapshot(rows: DataFrame, by: list[str], order: list[str], *values: str) -> DataFrame:
    """The values of the last row by the order columns; nulls sort lowest."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select(*by, *[F.col(f"__v.{v}").alias(v) for v in values])


def latest_cost_state(rows: DataFrame, by: list[str], ts: str, start: str, duration_ms: str, recovered: Column, order: list[str], *values: str) -> DataFrame:
    """The values of a session's last cost state: by its time, else its start and duration; then rows of the session's own file before those of a
    recovery copy; then the last in order. A row without any time comes before all that have one."""
    told = F.coalesce(F.col(ts), F.when(F.abs(F.col(duration_ms)) < 1e15, F.timestamp_micros(F.unix_micros(F.col(start).cast("timestamp")) + F.round(F.col(duration_ms) * 1000).cast("long"))).cast(dict(rows.dtypes)[ts]))
    ranked = rows.withColumns({"__ts": told, "__own": F.when(recovered, 0).otherwise(1)})
    return latest_snapshot(ranked, by, ["__ts", "__own", *order], *values)


def lifecycle(rows: DataFrame, by: list[str], order: str, opens: Column, shuts: Column) -> DataFrame:
    """open: whether the last opening came after the last shutdown; how often it was opened again."""
    got = rows.groupBy(*by).agg(F.max(F.when(opens, F.col(order))).alias("__o"), F.max(F.when(shuts, F.col(order))).alias("__s"), F.count_if(opens).alias("__n"))
    is_open = F.col("__o").isNotNull() & (F.col("__s").isNull() | (F.col("__o") > F.col("__s")))
    return got.select(*by, is_open.alias("open"), F.greatest(F.lit(0), F.col("__n") - 1).cast("long").alias("resumes"))


def type_counts(rows: DataFrame, by: list[str], type_: str) -> DataFrame:
    """by..., counts: map of event type to how often it occurs."""
    n = rows.groupBy(*by, type_).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(type_, "n")))).alias("counts"))


def context_history(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """by..., number (from 1), the columns, rows, and first and last order: the contexts that a session was in, one after another.

    A row that tells any of the columns sets those and leaves the others as they were; rows in a row that leave all as it was are one
    context, and a return to an earlier one is a new one. Rows that tell nothing don't count.
    """
    at = F.struct(*order)
    told = rows.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    w = Window.partitionBy(*by).orderBy(at)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = told.select(*by, at.alias("__at"), F.struct(*[F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns]).alias("__now"))
    w = Window.partitionBy(*by).orderBy("__at")
    fresh = ~F.col("__now").eqNullSafe(F.lag("__now").over(w))
    numbered = carried.withColumn("__new", fresh).withColumn("number", F.count_if("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = numbered.groupBy(*by, "number").agg(F.first("__now").alias("__c"), F.count(F.lit(1)).alias("rows"), F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    return got.select(*by, "number", *[F.col(f"__c.{c}").alias(c) for c in columns], "rows", *[F.col(f"__{e}.{o}").alias(f"{e}_{o}") for e in ("first", "last") for o in order])


def last_known(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """by..., each of the columns as its last row that has it tells it."""
    at = F.struct(*order)
    return rows.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def _listed() -> list[Column]:
    return [F.lower("workspace"), F.col("active").desc(), F.lower("title"), F.col("session")]


def catalog_order(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(*_listed())


def catalog_positions(sessions: DataFrame, at: str) -> DataFrame:
    """sessions with `position`, their place in catalog_order; `at`: a new folder for what is sorted."""
    return positions(sessions, _listed(), at)


def positions(sessions: DataFrame, order: list[Column], at: str) -> DataFrame:
    """sessions with `position` (from 1) in an order over all of them. Sampled ranges are sorted and written to the folder `at` with each row's
    place; only the ranges' counts meet in one task."""
    sorted_ = sessions.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_.write.parquet(at)
    placed = sessions.sparkSession.read.parquet(at).withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n") - F.col("__first") + 1).alias("__shift"))
    return placed.join(starts, "__part").withColumn("position", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def most_recent(sessions: DataFrame, active: str, key: str, n: int = 500, selected: Column | None = None) -> DataFrame:
    """Adds detailed: whether a session is of the n most recent, or selected.

    The n-th activity comes from a top-n, not from a sort of all sessions.
    """
    top = sessions.orderBy(F.col(active).desc(), key).limit(n).select(key, F.lit(True).alias("__top"))
    got = sessions.join(F.broadcast(top), key, "left")  # n rows
    wanted = F.coalesce("__top", F.lit(False)) | (F.lit(False) if selected is None else F.coalesce(selected, F.lit(False)))
    return got.withColumn("detailed", wanted).drop("__top")


def capped(rows: DataFrame, by: list[str], order: list[str], most: int, raw: str | None = None, most_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects with a reason): a session's first rows, and no over-long ones."""
    long = F.lit(False) if raw is None else F.length(raw) > most_chars
    marked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    reason = F.when(long, "line too long").when(F.col("__n") > most, "too many records")
    marked = marked.withColumn("reason", reason).drop("__n")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def drop_equal_responses(transcript: DataFrame, desktop: DataFrame, turn: list[str], text: Column) -> DataFrame:
    """Transcript responses that a desktop response of the turn doesn't say in the same words."""
    said = desktop.select(*turn, text.alias("__t")).distinct()
    return transcript.withColumn("__t", text).join(said, [*turn, "__t"], "left_anti").drop("__t")


def inherited_turns(turns: DataFrame, seeds: DataFrame, by: list[str], order: list[str], seed_count: str) -> DataFrame:
    """Turns of a child session without the first `seed_count`, which it has from its parent."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return turns.withColumn("__n", n).join(seeds.select(*by, seed_count), by, "left").where(F.col("__n") > F.coalesce(seed_count, F.lit(0))).drop("__n", seed_count)


def match_sessions(left: DataFrame, right: DataFrame, key: str, workspace: str) -> DataFrame:
    """(left_id, right_id): sessions with one key and one workspace, or the only ones of their key on both sides.

    Pairs may be many more than sessions, so it is these that are made different, and no pair comes by both ways. The number of parts
    is fixed, as what the join makes doesn't show in the size of what goes in.
    """
    a, b = left.select(key, F.lower(workspace).alias("__w"), "left_id"), right.select(key, F.lower(workspace).alias("__w"), "right_id")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = a.distinct().repartition(parts, key, "__w").join(b.distinct().repartition(parts, key, "__w"), [key, "__w"]).select(key, "left_id", "right_id")
    sole = lambda d, i: d.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("__w").alias(f"__{i}"), F.min(i).alias(i)).where("__n = 1").drop("__n")
    only = sole(a, "left_id").join(sole(b, "right_id"), key).where("NOT coalesce(__left_id = __right_id, false)").select(key, "left_id", "right_id")
    return same.unionByName(only)


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: how many rows, and two sums over hashes of their contents, which the rows' order doesn't change and equal rows don't cancel in.

    A row's content are its columns by name, as texts; a null differs from any text.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(rows.columns)])
    digest = F.md5(text)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    total = lambda at: F.coalesce(F.sum(part(at)) % F.lit(10**15), F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), total(1).alias("content"), total(17).alias("sums"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, changed, removed) of two listings (path, length, modified)."""
    o, n = old.select("path", F.struct("length", "modified").alias("o")), new.select("path", F.struct("length", "modified").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def merge_manifests(manifests: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of captures: Missed wins over Backfilled over Live over anything else; files are united."""
    rank = F.when(F.col("coverage") == "Missed", 3).when(F.col("coverage") == "Backfilled", 2).when(F.col("coverage") == "Live", 1).otherwise(0)
    got = manifests.groupBy(*by).agg(F.max_by("coverage", F.struct(rank, "coverage")).alias("coverage"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
    return got


def strongest(rows: DataFrame, by: list[str], order: list[Column], values: list[str], most: int) -> DataFrame:
    """by..., top: the first `most` rows in an order, as structs; how evidence, alternatives and paths are cut. Only they are collected."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__n", *values))).alias("__top")).select(*by, F.transform("__top", lambda t: F.struct(*[t[v].alias(v) for v in values])).alias("top"))


def visible_events(rows: DataFrame) -> DataFrame:
    """Events that a session shows: no prompts (its turns tell them), and no bare records of a provider's own kind that say nothing."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    prompt = F.coalesce((F.col("role") == "PromptSubmitted") | (F.col("kind") == "PromptSubmitted"), F.lit(False))
    bare = F.col("role").isin("Generic", "Message") & (F.col("kind") == "ProviderSpecific") & blank("text") & blank("tool") & blank("status") & F.col("skill").isNull()
    return rows.where(~prompt & ~F.coalesce(bare, F.lit(False)))


#: Roles that count in a summary though their event is marked as left out.
STRUCTURAL = ("ToolRequest", "AgentThought", "CompactionStart", "CompactionEnd", "SubagentStart", "SubagentStop")


def summarised_events(rows: DataFrame) -> DataFrame:
    """Events that a summary counts."""
    return rows.where(~F.coalesce("excluded", F.lit(False)) | F.col("role").isin(*STRUCTURAL))


def without_shells(sessions: DataFrame) -> DataFrame:
    """Sessions less those without any turn whose workspace isn't a known one."""
    return sessions.where((F.coalesce("turns", F.lit(0)) > 0) | (F.col("workspace_kind") == "Normal"))
