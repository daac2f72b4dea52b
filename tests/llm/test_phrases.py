"""Collocations against brute force, with few ranks, small tiles, short parts and filters of a part each, and as SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from turnstone.llm import bloom, phrases, queries

DATA = "/root/testdata/sf0.001"


def by_force(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, ws), a in f.items():
        if len(ws) > 1:
            longer = [v for (x, y), v in f.items() if x == lang and len(y) > len(ws) and any(y[i : i + len(ws)] == ws for i in range(len(y)))]
            if not any(100 * v >= 80 * a for v in longer):
                score, _, l, r = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
                out.setdefault(lang, []).append((-score, -a, " ".join(ws), l, r))
    return sorted((lang, k + 1, p, -a, l, r, n[lang], -s) for lang, x in out.items() for k, (s, a, p, l, r) in enumerate(sorted(x, key=lambda y: (*y[:2], y[2].encode()))[:top]))


def some_texts(seed, n=300):
    rnd = random.Random(seed)
    words = ["the", "of", "Émile", "new", "york", "x-ray", "文字", "a", "san", "b", "é", "THE"] + [f"w{k}" for k in range(40)]
    fixed = ["new york city hall", "of the", "san san san san", "a\tb"]
    rows = []
    for _ in range(n):
        said = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words[: rnd.choice([4, 12, len(words)])]) for _ in range(rnd.randrange(30))]
        rows.append((rnd.choice(["en", "en", "fr", "und", None]), "".join(s + rnd.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\r\n", " ? "]) for s in said)))
    return rows + [("en", None), ("en", ""), (None, "one"), ("de", " .,;"), ("en", "san " * 3000), ("en", "z" * 5000 + " the end"), ("en", "en fr en fr en " * 4), ("fr", "fr en fr " * 9)]


@pytest.mark.parametrize("ranks, side, dense, held, bits, size", [(1 << 16, 1 << 8, 1 << 13, 1 << 21, None, 1 << 20), (16, 4, 3, 500, None, 700), (16, 4, 3, 500, 64, 97)])
def test_collocations_equal_brute_force(spark, monkeypatch, ranks, side, dense, held, bits, size):
    for name, value in {"RANKS": ranks, "SIDE": side, "DENSE": dense, "HELD": held, "HELD_WORDS": held // 8}.items():
        monkeypatch.setattr(phrases, name, value)
    if bits:
        monkeypatch.setattr(bloom, "MOST_BITS", bits)
    rows = some_texts(1)
    df = spark.createDataFrame([(x, t, 1, "x") for x, t in rows], "lang string, text string, n int, phrase string").repartition(3)
    for least, top in ((4, 30),) if bits else ((6, 1000),):
        got = sorted(map(tuple, phrases.collocations(df, least=least, top=top, size=size).collect()))
        assert got == by_force(rows, least, top) and len(got) > 20
    assert phrases.collocations(df.limit(0)).count() == 0


def test_pairs_in_dense_and_sparse_tiles():
    rng = np.random.default_rng(2)
    left = np.concatenate([rng.integers(0, 300, 200_000), rng.integers(0, 1 << 16, 5000), -rng.integers(1, 50, 5000)])
    right = np.concatenate([rng.integers(0, 300, 200_000), rng.integers(0, 1 << 16, 5000), rng.integers(-5, 5, 5000)])
    got = {(a, b): n for a, b, n in zip(*(x.tolist() for x in phrases.count_pairs(left, right)), strict=True)}
    assert got == Counter(zip(left.tolist(), right.tolist(), strict=True))


def test_ranks_of_names_that_share_a_slot():
    names = np.arange(1, 2000, dtype=np.uint64) << np.uint64(20)
    known = phrases.Known(names[:1000], None)
    assert known.ranks(names).tolist() == [*range(1000), *[-1] * 999]
    assert phrases.Known(names[:0], None).ranks(names).tolist() == [-1] * 1999


def test_collocations_of_documents_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op12_collocations(spark, DATA)
    want = con.execute(queries.ORACLE_SQL["op12_collocations"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
