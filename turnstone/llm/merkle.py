"""A Merkle manifest of a table: leaves by key and order, subroots by key, one root, and a proof for each leaf.

Rows are numbered by sampled ranges, so that no key's rows meet in one task. A tree is then climbed in passes of
aligned blocks of PASS leaves: within a block every level is a lag and a lead of a fixed offset over the block's
rows, all in one partitioning, and a block's first row goes on to the next pass. 10^10 leaves of a key take three passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import stage_table

#: Children of a node, and levels of a pass: its windows hold ARITY ** LEVELS rows.
ARITY, LEVELS = 2, 12


def encoded(value: Column) -> Column:
    """`-` if null, else the value's UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def group_key(value: Column) -> Column:
    """A string that is never null and orders as the value's UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (with a column `group`) with idx, from 0 in each group by `order` (nulls first), and n, the group's rows.

    Sampled ranges are sorted and staged with each row's place; only counts per range and group are summed up. Rows that are
    equal in all of `order` are dealt out at random, so that one value can't fill a range.
    """
    keys = [F.col("group"), *[F.col(c).asc_nulls_first() for c in order], F.col("__deal")]
    ranged = rows.withColumn("__deal", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    staged = stage_table(ranged.drop("__deal"))
    part = F.shiftright("__at", 33)
    counts = staged.groupBy("group", part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # a row per range and group
    before = Window.partitionBy("group").orderBy("__part")
    starts = counts.select(
        F.col("group").alias("__group"),
        F.col("__part").alias("__of"),
        (F.sum("__n").over(before) - F.col("__n") - F.col("__first")).alias("__shift"),
        F.sum("__n").over(Window.partitionBy("group")).alias("n"),
    )
    return staged.join(starts, (F.col("group") == F.col("__group")) & (part == F.col("__of"))).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__group", "__of", "__shift")


def _climbed(rows: DataFrame, levels: int) -> DataFrame:
    """One pass of so many levels over rows (group, idx, n, digest): each with steps, the siblings met on its way up, and up, its block's digest.

    Every row carries the digest of the node it is under. At a level whose nodes span s rows its siblings stand s rows before and
    behind it, masked by the node's slot among its parent's children and by how many children that parent has. Rows without
    a leaf fill the last block of a group up to a power of ARITY, so that a row that far off is always there.
    """
    size = ARITY**levels
    have = F.col("n") - F.expr(f"(n - 1) div {size}") * size
    full = F.lit(size)
    for level in reversed(range(levels)):
        full = F.when(have <= ARITY**level, ARITY**level).otherwise(full)
    fill = rows.where("idx = 0").select("group", "n", (full - have).alias("__short")).where("__short > 0").select("group", F.explode(F.sequence("n", F.col("n") + F.col("__short") - 1)).alias("idx"), "n")
    out = rows.unionByName(fill, allowMissingColumns=True).withColumn("block", F.expr(f"idx div {size}"))
    w = Window.partitionBy("group", "block").orderBy("idx")
    steps = []
    for level in range(levels):
        span = ARITY**level
        node, nodes = F.expr(f"idx div {span}"), F.expr(f"(n + {span - 1}) div {span}")
        slot = node % ARITY
        run = F.least(F.lit(ARITY), nodes - node + slot)
        left = [F.when(slot >= o, F.lag("digest", o * span).over(w)) for o in reversed(range(1, ARITY))]
        right = [F.when(slot + o < run, F.lead("digest", o * span).over(w)) for o in range(1, ARITY)]
        l, r = f"__left{level}", f"__right{level}"
        steps.append(F.when(nodes > 1, F.struct(F.col(l).alias("left"), F.col(r).alias("right"))))
        parent = F.when((nodes > 1) & (run > 0), F.sha2(F.concat_ws("", l, "digest", r), 256)).otherwise(F.col("digest"))
        out = out.withColumns({l: F.concat_ws("", *left), r: F.concat_ws("", *right)}).withColumn("digest", parent)
    kept = [F.col(c) for c in rows.columns if c != "digest"]
    return out.where("idx < n").select(*kept, "block", F.filter(F.array(*steps), lambda s: s.isNotNull()).alias("steps"), F.col("digest").alias("up"))


def tree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (group, idx, n, digest): them with steps and top, their group's root; and the table (group, digest) of those roots."""
    passes, at = [], rows
    while True:
        most, levels = at.agg(F.max("n")).first()[0] or 0, 1
        while levels < LEVELS and ARITY**levels < most:
            levels += 1
        size = ARITY**levels
        passes.append(_climbed(at, levels))
        nodes = stage_table(passes[-1].where(f"idx = block * {size}").select("group", F.col("block").alias("idx"), F.col("up").alias("digest"), F.expr(f"(n + {size - 1}) div {size}").alias("n")))
        if most <= size:
            break
        at = nodes
    above = nodes.select("group", "idx", F.expr("filter(array(named_struct('left', '', 'right', '')), s -> false)").alias("steps"), F.col("digest").alias("top"))
    for low in reversed(passes):
        up = above.select(F.col("group").alias("__group"), F.col("idx").alias("__block"), F.col("steps").alias("__steps"), "top")
        joined = low.join(up, (F.col("group") == F.col("__group")) & (F.col("block") == F.col("__block")))
        above = joined.withColumn("steps", F.concat("steps", "__steps")).drop("__group", "__block", "__steps", "block", "up")
    return above, nodes.select("group", "digest")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest leads to, by its steps."""
    return F.aggregate(steps, start, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def manifest(rows: DataFrame, key: Column, group: Column, digest: Column, claimed: Column | None = None) -> DataFrame:
    """A row per row: key, leaf, subroot, root, steps, folded_root, verified.

    digest: a row's leaf; claimed: the leaf that is held against the root (default: the same). Leaves of a group ascend by key, null
    first, then by digest, so that rows of one key have a defined order; roots ascend by group, null first, bytewise. Every
    ARITY consecutive nodes become a parent, a last run of fewer, even one, too; a lone leaf is its group's root. steps has the
    siblings left and right of each level, through the group's root to the root. An empty table gives an empty manifest.
    """
    leaves = stage_table(rows.select(key.alias("key"), group_key(group).alias("group"), digest.alias("digest"), (digest if claimed is None else claimed).alias("claimed")))
    found, subroots = tree(numbered(leaves, ["key", "digest"]).withColumn("leaf", F.col("digest")))
    tops = subroots.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest")
    named, _ = tree(numbered(tops, ["of"]))
    roots = stage_table(named.select("of", F.col("steps").alias("__more"), F.col("top").alias("root")))
    whole = found.join(roots, F.col("group") == F.col("of")).withColumn("steps", F.concat("steps", "__more"))
    return whole.select("key", "leaf", F.col("top").alias("subroot"), "root", "steps", folded(F.col("claimed"), F.col("steps")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_sha256(steps: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(steps, lambda s: F.array(s["left"], s["right"]))), ""), 256)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang and doc_id, with one in seven claimed to have a character more (where n_chars isn't null)."""
    of = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    claimed = F.when(tampered, of(F.col("n_chars") + 1)).otherwise(of(F.col("n_chars")))
    found = manifest(docs, F.col("doc_id"), F.col("lang"), of(F.col("n_chars")), claimed)
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_sha256(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")
