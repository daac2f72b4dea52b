"""Exact copies against brute force, with names short enough to clash, and on odd tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from turnstone.llm import exact, queries

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_force(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            out.append((i, best, len(ids), i == best and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept |= i == best
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_copies_equal_brute_force(spark, bits):
    rows = [(1, None), (2, ""), (3, "One"), (4, "oNE"), (None, "one"), (4, "one"), (4, "one"), (5, "Ünder"), (6, "ünder"), (7, LONG), (8, LONG.upper()), (9, LONG + "x"), (10, "y" + LONG), (None, "alone"), (None, "alone"), (11, "文" * 40_000), (12, "文" * 40_000), (13, "文" * 39_999 + "字")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, recipe string").repartition(3)
    assert result(exact.find_copies(df, bits=bits)) == by_force(rows)
    assert exact.find_copies(df.limit(0)).count() == 0


def test_copies_of_documents_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op13_exact_dedup(spark, DATA)
    want = con.execute(queries.ORACLE_SQL["op13_exact_dedup"])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert result(got) == sorted(want.fetchall(), key=str)


def test_chunks_follow_content(spark):
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(1, 9))) for _ in range(30_000))
    made = {r["key"]: r["recipe"] for r in exact.recipes(spark.createDataFrame([(1, text), (2, "some words before " + text)], "doc_id long, text string")).collect()}
    assert len(made[1]) > 20 and len(set(made[1]) & set(made[2])) >= len(made[1]) - 9
    assert exact.chunk_store(exact.recipes(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))).agg(F.min("uses")).first()[0] == 2


def test_long_texts_fold_alike(spark):
    df = spark.createDataFrame([("AbÉz " * 10,), ("AbÉz " * 300_000,), ("ABC",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(exact.folded(F.col("text"))).collect()] == [low(r[0]) for r in df.collect()]


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(1, "a b", "u"), (3, "A B", "v"), (None, "c", "w"), (2, None, "x"), (5, "", "y")], "doc_id long, text string, lang string")
    assert {r["lang"] for r in exact.without_copies(df).collect()} == {"v", "w", "y"}
