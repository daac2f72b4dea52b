"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

A token budget goes down a tree of levels (domain, language, source). At every node it is dealt to the
children by weight, none above the tokens its subtree can give; what a child can't use goes to its
siblings, and only what a whole subtree can't use reaches the next level up. A leaf with a budget of e
whole epochs and a rest takes every document e times, and of epoch e, which has a seeded order of its
own, the prefix that holds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import stage_table

#: Fixed values of the registered query.
LEVELS = ("domain", "lang", "source")
DOMAINS = ("web", "books", "code", "news")
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "news": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
#: A leaf's order is cut into 16 ** this many slices at least.
LEAST_HEX = 3


def word_count(text: Column) -> Column:
    """Words between the six white-space characters of ASCII: the mixer's measure of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_levels(docs: DataFrame) -> DataFrame:
    """documents with a domain (by the number in its source), and no nulls among the levels."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return docs.withColumns(
        {
            "domain": F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1),
            "lang": F.coalesce("lang", F.lit("unknown")),
            "source": F.coalesce("source", F.lit("unknown")),
        }
    )


def slice_digits(rows: int) -> int:
    """Hexadecimal digits that name a slice: about as many slices as one of them may have rows, of the largest leaf that there can be."""
    digits = LEAST_HEX
    while 256**digits < rows:
        digits += 1
    return digits


def _weight(level: str, weights: dict) -> Column:
    known = weights.get(level, {})
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict, share: tuple[int, int], epochs: int) -> DataFrame:
    """Each leaf's budget in tokens, from a table of leaves (levels..., available).

    share: the whole budget as a fraction (numerator, denominator) of all available tokens; epochs: the
    most often that a document may be taken. Whole numbers throughout (a child's share is rounded
    down). Windows go over the children of one node: rows by the number of names, not of documents.
    """
    caps = leaves.withColumn("cap", F.col("available") * epochs)
    whole = caps.agg(F.sum("available").alias("all"), F.sum("cap").alias("cap"))
    total = (F.col("all") * share[0] - F.col("all") * share[0] % share[1]) / share[1]
    node = whole.select(F.least(total.cast("decimal(38,0)"), F.col("cap").cast("decimal(38,0)")).cast("long").alias("budget"))
    for depth, level in enumerate(levels, 1):
        path, up = list(levels[:depth]), list(levels[: depth - 1])
        children = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("available").alias("available")).withColumn("w", _weight(level, weights))
        children = children.join(node, up) if up else children.crossJoin(F.broadcast(node))  # one row
        order = Window.partitionBy(*up).orderBy(F.col("cap") / F.col("w"), level)
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        dealt = children.withColumns(
            {
                "left": F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "weights": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            }
        ).withColumn("full", wide("cap") * wide("weights") <= wide("w") * wide("left"))
        # children that are full come first in this order; the others share what those leave
        rest = Window.partitionBy(*up)
        dealt = dealt.withColumns(
            {
                "open_left": F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col(level), "left", "weights"))).over(rest),
            }
        )
        product = wide("w") * F.col("open_left.left").cast("decimal(19,0)")
        part = ((product - product % F.col("open_left.weights").cast("decimal(19,0)")) / F.col("open_left.weights").cast("decimal(19,0)")).cast("long")
        node = dealt.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), part)).alias("budget"), "available")
        if depth < len(levels):
            node = node.drop("available")
    return node


def mix(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    weights: dict = WEIGHTS,
    share: tuple[int, int] = (1, 2),
    epochs: int = 2,
    seed: int = 17,
    key: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """The documents that the mixture takes: key, levels..., n_tokens, full_epochs, tokens_taken.

    tokens_taken counts every epoch; the document at which a leaf's budget ends gives only its first
    tokens to it, so that a leaf's sum is its budget exactly. Documents that nothing is taken of are
    left out, thus empty and null texts always. Levels are names; a null one is `unknown`;
    repeated rows count as documents of their own; an empty table gives an empty one.

    A leaf may hold a third of all rows: its order is cut into slices by hash (see slice_digits), sums of slices tell
    which one the budget ends in, and only that slice's rows are sorted.
    """
    n = word_count(F.col("text")) if tokens is None else tokens
    base = stage_table(docs.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in levels], n.alias("n_tokens")).where("n_tokens > 0"))
    leaves = base.groupBy(*levels).agg(F.sum("n_tokens").alias("available"))
    plan = stage_table(budgets(leaves, levels, weights, share, epochs))
    plan = plan.withColumn("full_epochs", F.floor(F.col("budget") / F.col("available")).cast("long"))
    # a division of doubles may round up
    plan = plan.withColumn("full_epochs", F.when(F.col("full_epochs") * F.col("available") > F.col("budget"), F.col("full_epochs") - 1).otherwise(F.col("full_epochs")))
    plan = plan.select(*levels, "full_epochs", (F.col("budget") - F.col("full_epochs") * F.col("available")).alias("rest"))
    place = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("full_epochs").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows = base.join(plan, list(levels)).withColumn("place", place).withColumn("slice", F.substring("place", 1, slice_digits(base.count())))
    cut = [*levels, "slice"]
    upto = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = stage_table(
        rows.groupBy(*cut, "rest").agg(F.sum("n_tokens").alias("slice_tokens")).withColumn("before", F.coalesce(F.sum("slice_tokens").over(upto), F.lit(0))).drop("rest")
    )
    rows = rows.join(slices, cut)
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("slice_tokens") > F.col("rest"))
    sure = rows.where(~inside).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("n_tokens")).otherwise(0))
    order = Window.partitionBy(*cut).orderBy("place", key, "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(inside).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("at")))).drop("at")
    taken = F.col("full_epochs") * F.col("n_tokens") + F.col("part")
    return sure.unionByName(edge).withColumn("tokens_taken", taken.cast("long")).where("tokens_taken > 0").select(key, *levels, "n_tokens", "full_epochs", "tokens_taken")
