"""Exact copies by content-defined chunk recipes: texts are told apart by ordered lists of chunk identifiers.

DataFrame functions only. One scan turns each text into its recipe; texts themselves are never shuffled, so that a
long document is read once and moves as 40 bytes a chunk, and later as 12.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import stage_table

#: Code points of a chunk: a cut is looked for after LEAST of them and made at MOST.
LEAST, MOST = 512, 16384
#: A chunk ends behind a blank between letters of these two thirds of the alphabet, wherever that is in a text; texts without
#: such places (other scripts) are cut at MOST.
BEFORE, AFTER = string.ascii_lowercase[::3], string.ascii_lowercase[1::3]
CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?(?<=[{BEFORE}][ \n])(?=[{AFTER}])|.{{1,{MOST}}}"
#: Code points of a text above which it isn't split at its capitals: a piece of memory for each would be too many.
LONG = 1 << 20


def folded(text: Column) -> Column:
    """text (null: empty) with A-Z, and nothing else, in lower case."""
    t = F.coalesce(text, F.lit(""))
    lower = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    short = F.array_join(F.transform(F.split(t, "(?=[A-Z])"), lambda p: F.overlay(p, lower(F.substring(p, 1, 1)), F.lit(1))), "")
    return F.when(F.length(t) > LONG, lower(t)).otherwise(short)


def recipe(text: Column, bits: int = 64) -> Column:
    """The chunks of a folded text in order, each as (name, digest): a short hash, and SHA-256 of its bytes."""
    name = lambda c: F.xxhash64(c) if bits == 64 else F.pmod(F.xxhash64(c), F.lit(1 << bits))
    chunks = F.regexp_extract_all(text, F.lit(CHUNK), 0)
    return F.transform(chunks, lambda c: F.struct(name(c).alias("name"), F.unhex(F.sha2(c, 256)).alias("digest")))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """A staged row per document: row (its own number), key, text_sha256, recipe."""
    made = docs.select(F.col(key).alias("key"), folded(F.col(text)).alias("t"))
    return stage_table(made.select(F.monotonically_increasing_id().alias("row"), "key", F.sha2("t", 256).alias("text_sha256"), recipe(F.col("t"), bits).alias("recipe")))


def chunk_store(made: DataFrame) -> DataFrame:
    """(name, digest, uses) of every different chunk of some recipes."""
    return made.select(F.explode("recipe").alias("c")).groupBy(F.col("c.name").alias("name"), F.col("c.digest").alias("digest")).agg(F.count(F.lit(1)).alias("uses"))


def verified(made: DataFrame) -> DataFrame:
    """made with `ids`, the ordered identifiers (name, turn) of its chunks.

    A name that all its chunks' digests agree on is an identifier as it stands (turn 0). Names that stand for several
    chunks are found by one grouping of all; only the documents that hold such a name are taken apart again.
    """
    store = chunk_store(made)
    clashing = stage_table(store.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    plain = F.transform("recipe", lambda c: F.struct(c["name"].alias("name"), F.lit(0).alias("turn")))
    if clashing.isEmpty():
        return made.withColumn("ids", plain)
    many = store.join(clashing, "name").select("name", "digest")
    # few: a 64-bit name stands for more than two or three chunks only by chance
    by_digest = Window.partitionBy("name").orderBy("digest")
    turns = store.join(clashing, "name").select("name", "digest", (F.row_number().over(by_digest) - 1).alias("turn"))
    parts = made.select("row", F.posexplode("recipe").alias("pos", "c")).select("row", "pos", F.col("c.name").alias("name"), F.col("c.digest").alias("digest"))
    hold = parts.join(clashing, "name", "left_semi").select("row").distinct()
    told = parts.join(hold, "row", "left_semi").join(turns, ["name", "digest"], "left").select("row", F.struct("pos", "name", F.coalesce("turn", F.lit(0)).alias("turn")).alias("p"))
    again = told.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["name"].alias("name"), p["turn"].alias("turn"))).alias("__ids"))
    return made.join(again, "row", "left").withColumn("ids", F.coalesce("__ids", plain)).drop("__ids")


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """A row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row of the largest
    key stays (a null key is smaller than any; of rows that repeat key and text one stays). Texts are compared by their
    identifier lists, which are equal exactly if the texts are, as far as SHA-256 tells chunks apart. bits: of a chunk's
    name; fewer only cost more. A group is counted before it is shuffled, and groups of one are not joined.
    """
    ids = verified(recipes(docs, key, text, bits))
    counted = ids.groupBy("ids").agg(F.max(F.struct("key", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # staged, so that Spark knows its size and can split a large group's rows
    groups = stage_table(counted.withColumnRenamed("ids", "same"))
    found = ids.join(groups, F.col("ids") == F.col("same"), "left")
    return found.select(
        F.col("key").alias(key),
        F.when(F.col("n") > 1, F.col("best.key")).otherwise(F.col("key")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat key and text stay or go together."""
    stay = find_copies(docs, key, text).where("kept").select(F.col(key).alias("__key"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(folded(docs[text]), 256)
    return docs.join(stay, docs[key].eqNullSafe(stay["__key"]) & (sha == stay["__sha"]), "left_semi")
