"""Merkle manifests against a plain recursion, over several passes, on odd tables, and as SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from turnstone.llm import merkle, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, block int, steps string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def enc(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes, arity):
    """The root, and each node's (left, right) siblings by level."""
    steps, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + arity, len(nodes))) for a in range(0, len(nodes), arity)]
        for run in runs:
            for j in run:
                for i in under[j]:
                    steps[i].append(("".join(nodes[x] for x in run if x < j), "".join(nodes[x] for x in run if x > j)))
        nodes, under = [h(*(nodes[x] for x in run)) for run in runs], [[i for x in run for i in under[x]] for run in runs]
    return nodes[0], steps


def by_force(rows, arity=2):
    groups = {}
    for i, s, l, n, t in rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        groups.setdefault(l, []).append((i, h(enc(i, s, l, n, t)), h(enc(i, s, l, n + 1, t)) if bad else None))
    langs = sorted(groups, key=lambda l: (l is not None, (l or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [climb([r[1] for r in groups[l]], arity) for l in langs]
    root, tops = climb([t[0] for t in trees], arity)
    out = []
    for l, (sub, steps), top in zip(langs, trees, tops, strict=True):
        for (i, leaf, bad), own in zip(groups[l], steps, strict=True):
            x = bad or leaf
            for left, right in own + top:
                x = h(left, x, right)
            out.append((i, leaf, sub, root, h(*(y for s in own + top for y in s)), x, x == root))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("arity, levels", [(2, 12), (3, 2)])
def test_manifest_equals_recursion(spark, monkeypatch, arity, levels):
    monkeypatch.setattr(merkle, "ARITY", arity)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(arity)
    rows = [(rnd.randrange(500), "s", rnd.choice(["a", "a", "a", "é", "B", None]), rnd.choice([None, 3]), f"t{k} é") for k in range(101)]
    rows += [(None, None, None, None, None), (None, "x", "a", 1, ""), (7, "s", "lone", 2, "long " * 50_000)] + [(9, "s", "a", 1, "same")] * 5
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    assert result(merkle.document_manifest(df)) == by_force(rows, arity)


def test_manifest_of_few_rows(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(3, None, None, None, None)], [(3, "s", "a", 1, "t"), (4, "s", "a", 1, "t"), (5, "s", "a", 1, "t")]):
        assert result(merkle.document_manifest(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))) == by_force(rows)


def test_one_value_can_fill_the_table(spark):
    df = spark.createDataFrame([(1, "s", "a", 1, "t", 1, "x")] * 3000, SCHEMA).repartition(4)
    got = merkle.document_manifest(df)
    assert got.where("verified").count() == 3000 and got.select("root", "leaf").distinct().count() == 1


def test_manifest_of_documents_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op11_merkle_manifest(spark, DATA)
    want = con.execute(queries.ORACLE_SQL["op11_merkle_manifest"])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    rows = result(got.select(*[c[0] for c in want.description]))
    assert rows == sorted(want.fetchall(), key=str) and {r[-1] for r in rows} == {True, False}
