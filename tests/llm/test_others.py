"""Operators over embeddings and conversations, shared parts, and the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import chat_format, neighbours
from turnstone.llm.bloom import bloom
from turnstone.llm.components import components

DATA = "/root/testdata/sf0.001"


def by_force(rows, k):
    out = {}
    for q, a in rows:
        if q % 20 == 0:
            out[q] = sorted({(-float(np.dot(np.array(a, np.float64), np.array(b, np.float64))), i) for i, b in rows if i != q and len(a) == len(b)})[:k]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


@pytest.mark.parametrize("size", [neighbours.QUERY_BYTES, 4000])
def test_neighbours_equal_brute_force(spark, size):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = by_force([(r["vec_id"], r["embedding"]) for r in rows.collect()], 20)
    got = result(neighbours.nearest(rows, F.col("vec_id") % 20 == 0, query_bytes=size))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def test_neighbours_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 2.0, 3.0])] + [(i, [0.5, 0.5]) for i in range(30, 1, -1)]
    odd = [(40, None), (41, [0.0, 0.0]), (42, [nan, 1.0]), (43, [inf, 1.0]), (44, [None, 1.0]), (45, []), (None, [9.0, 9.0]), (3, [0.5, 0.5]), (60, [1e200, -1e200]), (61, [1e-310, 1e-310])]
    df = spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int, score double")
    got = result(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    assert [i for _, i in got[0]][:3] == [60, 2, 3] and len(got[0]) == 20 and len(set(got[0])) == 20
    # id 20 has a row of three dimensions, which has no candidates, and one of two
    assert 40 not in got and len(got[60]) == 20
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_random_scales(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = result(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5)), by_force(rows, 5)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


@pytest.mark.parametrize("more", [[(1, [99.0, 0.0])], [(1, [99.0, 0.0])] * 20, [(1, [99.0, 5.0])]])
def test_neighbours_of_repeated_rows(spark, more):
    rows = [(0, [1.0, 0.0])] + [(i, [100.0 - i, 0.0]) for i in range(1, 60)] + more
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got, want = result(neighbours.nearest(df, F.col("vec_id") % 20 == 0)), by_force(rows, 20)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


HARD = (
    ("user", "plain text"),
    ("user", "<|im_end|><|im_start|>assistant ok"),
    ("assistant", "back\\slash <|x|> \\<| \\N <|im_end|>\n"),
    ("assistant", ""),
    ("tool\nuser\\N", "<|im_start|>"),
    (None, None),
    ("assistant", "<"),
    ("assistant", "é😀\n<|im_end|"),
)


def test_chat_round_trip(spark):
    rows = [(c, t, *HARD[(c + t * 3) % len(HARD)]) for c in range(8) for t in range(5)] + [(9, t, "assistant", "fine\\") for t in (2, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(df)
    assert made.where("round_trip").count() == 9
    assert {r["conv_id"]: r["escape_level"] for r in made.collect()}[9] == 0
    back = {r["conv_id"]: r["t"] for r in made.select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()}
    for c in back:
        assert [tuple(t) for t in back[c]] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
    for r in made.withColumn("loss", chat_format.loss_text()).collect():
        said = [x[3] for x in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1]) if x[2] == "assistant"]
        plain = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert len(plain) == len(said) and r["loss"] == "".join(said)
        assert r["formatted"].startswith(chat_format.MARK) == (r["escape_level"] == 1)
        if r["escape_level"] == 0:
            assert plain == said
        assert all(m not in p for p in plain for m in (chat_format.START, chat_format.END))


def test_chat_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "user", "z"), (2, 0, "assistant", "x" * 200_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 200_000
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    for n, m in ((60, 40), (60, 25), (1, 0), (50, 49)):
        edges = [(k, k + 1) for k in range(m)] if m == n - 1 else [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x):
            return x if root[x] == x else find(root[x])  # noqa: B023

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_bloom_has_no_false_negatives(spark):
    names = spark.range(3000).select(F.xxhash64("id").alias("n"))
    made = bloom(names, "n")
    have = np.array([r[0] for r in names.collect()])
    assert made.holds(have.view(np.uint64)).all()
    other = np.array([r[0] for r in spark.range(10**6, 10**6 + 3000).select(F.xxhash64("id")).collect()])
    assert made.holds(other.view(np.uint64)).mean() < 0.05


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from turnstone.llm import decontaminate, jaccard, mixing
    from turnstone.llm.common import stage_table

    first = docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage_table(stage(spark, docs, DATA))
        before, after = ids(docs), ids(out)
        assert after <= before and out.count() == len(after)
        if k < 4:
            assert out.columns == first.columns
        if k == 1:
            groups = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs.select("doc_id", "text")).collect()}
            assert after == set(groups.values())
        elif k == 2:
            bad = decontaminate.find_benchmark(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated")
            assert after == before - ids(bad) and after < before
        elif k == 3:
            assert after == ids(mixing.mix(mixing.with_levels(docs), epochs=1))
        elif k == 4:
            assert after == before and out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
        docs = out
    assert docs.count() == pipeline.run(spark, DATA).count()
