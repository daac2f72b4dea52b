"""Operators over documents, against brute force and on odd tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstone.llm import decontaminate, encode, jaccard, language, lines, mixing, pii, sstable, suffix_dedup
from turnstone.llm.common import shared_dir

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pii string, removed string, n_words int, score int, s string"
LONG = "lorem ipsum dolor sit amet " * 4000


def table(spark, *rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, None, None, "p", "r", 1, 2, "q") for r in rows], SCHEMA)


ODD = ((1, None), (2, ""), (3, "one"), (4, LONG), (5, "same words stand here in a row twice"), (5, "same words stand here in a row twice"), (None, "same words stand here in a row twice"), (7, " \t\n"))


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def groups_by_force(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 600])
def test_jaccard_equals_brute_force(spark, docs, texts, block):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, block=block).collect()}
    assert got == groups_by_force(texts)


def test_jaccard_threshold_is_met_exactly(spark):
    words = [f"w{i}" for i in range(104)]
    a = " ".join(words)  # 100 shingles
    b = " ".join([*words[:94], *[f"x{i}" for i in range(10)]])
    c = " ".join([*words[:93], *[f"y{i}" for i in range(11)]])
    d = " ".join(words[:84])  # 80 shingles, all of a's
    e = " ".join(words[:83])  # 79
    rows = spark.createDataFrame([(9, a), (8, d), (7, e), (6, b), (5, c)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(rows).collect()}
    assert got == {i: v[1] for i, v in groups_by_force({9: a, 8: d, 7: e, 6: b, 5: c}).items()}


def test_jaccard_strangers_with_passages_in_common_make_no_group(spark, monkeypatch):
    """A chain of pairs of near copies, each with a passage of the pair before and one of the pair behind it: that is work for small groups."""
    words = lambda name, n: " ".join(f"{name}w{i}" for i in range(n))
    texts = {}
    for k in range(120):
        text = f"{words(f'p{k}', 20)} {words(f'own{k}', 150)} {words(f'p{k + 1}', 20)}"
        texts |= {2 * k: text, 2 * k + 1: text + " at the end"}
    monkeypatch.setattr(jaccard, "_large_groups", lambda *_: pytest.fail("all pairs are one group"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame([*texts.items()], "doc_id long, text string"), block=2_000).collect()}
    assert got == groups_by_force(texts) and len({c for _, c in got.values()}) == 120


def test_jaccard_stages_no_whole_sets_of_texts_without_partners(spark, monkeypatch):
    """Of strangers only prefixes are written."""
    texts = [(k, " ".join(f"k{k}w{i}" for i in range(500))) for k in range(200)]
    staged = []
    monkeypatch.setattr(jaccard, "stage_table", lambda df, real=jaccard.stage_table: staged.append(real(df)) or staged[-1])
    monkeypatch.setattr(jaccard, "drop_staged", lambda df: None)
    assert jaccard.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string")).where("doc_id <> component_id").count() == 0
    written = sum(df.agg(F.sum(F.octet_length("s"))).first()[0] or 0 for df in staged if "s" in df.columns)
    assert 0 < written < 200 * 496 * 8 / 2


def test_jaccard_of_long_texts_at_exactly_the_threshold(spark):
    long = " ".join(f"w{i}" for i in range(400_004))  # 400,000 shingles, of which `short` has 320,000
    short = " ".join(f"w{i}" for i in range(320_004))
    less = " ".join(f"w{i}" for i in range(1, 320_003))
    rows = spark.createDataFrame([(1, long), (2, short), (3, less + " x"), (4, long[::-1])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(rows).collect()}
    assert got == {1: (400_000, 1), 2: (320_000, 1), 3: (319_999, 1), 4: (400_000, 4)}  # 3 reaches 1 by way of 2 only


def test_shingles_of_a_text_cut_into_windows(spark):
    text = ("Some words, é and\tothers " * 130_000)[: 2 * (1 << 20) + 77] + "x" * (1 << 20) + " the end"
    for words in (1, 5):
        assert np.array_equal(jaccard._long_set(np.frombuffer(text.encode(), np.uint8), words), jaccard.shingle_sets([text, None], words)[0])
    one = "y" * 3_000_000
    assert [len(s) for s in jaccard.shingle_sets([one + " z"])] == [1] and np.array_equal(jaccard.shingle_sets([one + " z"])[0], jaccard.shingle_sets([one + " z", ""])[0])


def test_counts_of_shared_shingles(spark):
    """Every given row of a class counts each of its shingles that another class has, however batches fall."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 4000, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    given = [(i, s) for i, s in enumerate(sets)] + [(3, sets[3])] * 2
    owners = {}
    for i, s in given:
        for h in s.tolist():
            owners.setdefault(h, set()).add(i)
    want = {i: sum(len(owners[h]) > 1 for h in s.tolist()) * (3 if i == 3 else 1) for i, s in enumerate(sets)}
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in given], "fp long, s binary").repartition(3)
    for most in (100_000, 900):
        made = jaccard.shared_counts(rows, 7, lambda n: n, most)
        assert {r["fp"]: r["n"] for r in made.where("NOT often").collect()} == want
        # rows of one class may count several times here
        rows_of = {h: len(own) + 2 * (3 in own) for h, own in owners.items()}
        sure, maybe = ({*jaccard._name(np.array([h for h, n in x.items() if n >= jaccard.FEW], np.uint64), 7).tolist()} for x in ({h: len(own) for h, own in owners.items()}, rows_of))
        assert sure <= {r["fp"] for r in made.where("often").collect()} <= maybe


def test_jaccard_of_odd_rows(spark):
    got = sorted(map(str, jaccard.jaccard_groups(table(spark, *ODD)).collect()))
    assert len(got) == len(ODD)
    by = {}
    for r in jaccard.jaccard_groups(table(spark, *ODD)).collect():
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[7] == {(0, 7)} and by[3] == {(1, 3)}
    assert by[5] == {(4, 5)} and by[None] == {(4, 5)}
    assert jaccard.jaccard_groups(table(spark)).count() == 0


def test_jaccard_of_more_short_texts_than_a_batch_numbers(spark):
    pair = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda j: F.concat_ws("x", F.lit("w"), F.floor(F.col("id") / 2), F.when((j == 24) & (F.col("id") % 2 == 1), 99).otherwise(j)))
    paired = F.col("id").between(65_000, 71_999)
    docs = spark.range(0, 80_000, 1, 1).select(F.col("id").alias("doc_id"), F.when(paired, F.array_join(pair, " ")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = jaccard.jaccard_groups(docs).toPandas().set_index("doc_id")["component_id"]
    assert len(got) == 80_000
    assert [i for i, c in got.items() if c != (i // 2 * 2 if 65_000 <= i < 72_000 else i)] == []


def removed_by_force(bodies, size):
    seen = {}
    for i, b in enumerate(bodies):
        for p in range(len(b) - size + 1):
            seen.setdefault(b[p : p + size], []).append((i, p))
    gone = [bytearray(len(b)) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + size] = b"\1" * size
    return gone


def counted(docs):
    shared = suffix_dedup.shared_runs(docs.select(suffix_dedup.row_name().alias("row"), "text"))
    return suffix_dedup.digest(suffix_dedup.remove_repeats(docs), shared).drop("longest_shared")


def test_shared_runs(spark):
    rng = np.random.default_rng(9)
    noise = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(9)]
    rows = []
    for i, size in enumerate((249, 250, 300, 399)):  # a string of that size in two texts, at other places
        part = noise[i][500 : 500 + size]
        rows += [(2 * i, noise[i][:500] + part + "."), (2 * i + 1, noise[i + 4][: 77 * i + 3] + part + "!" + noise[i + 4][1000:])]
    rows += [(20, noise[8][:400] * 2), (21, None), (22, "")]
    docs = table(spark, *rows).select(F.col("doc_id").alias("row"), "text")
    got = {r["row"]: r["longest_shared"] for r in suffix_dedup.shared_runs(docs).collect()}
    for i, size in enumerate((249, 250, 300, 399)):
        for row in (2 * i, 2 * i + 1):
            assert got.get(row, 0) <= size and (size < 250 or got[row] >= max(150, size - 2 * 100))
    assert not {20, 21, 22} & set(got)


def test_suffix_dedup_equals_brute_force(spark, docs, texts):
    ids = sorted(texts)
    bodies = [(texts[i] or "").encode() for i in ids]
    want = {}
    for i, b, g in zip(ids, bodies, removed_by_force(bodies, suffix_dedup.LENGTH), strict=True):
        kept = bytes(c for c, x in zip(b, g, strict=True) if not x)
        runs = len(re.findall(b"\1+", bytes(g)))
        want[i] = (len(b), sum(g), runs, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in counted(docs).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


def test_suffix_dedup_of_a_text_in_parts():
    """Every window of a long text belongs to one part, and has the same rank there."""
    text = "".join(map(chr, np.random.default_rng(6).integers(97, 100, 5000)))
    texts = pa.array(["first", text, None, "last"])

    def windows(chunk):
        out = {}
        for i, _, s in suffix_dedup._parts(texts, chunk):
            of, low, high, *_ = s.groups(np.arange(len(s.at)))
            for t, a, z in zip(of.tolist(), low.tolist(), high.tolist(), strict=True):
                for at in range(a, z + 1):
                    place = (i + t, at - int(s.b.start[t]) + s.base)
                    assert place not in out
                    out[place] = tuple(int(x[0]) for x in s.rank400(np.array([at])))
        return out

    whole = windows(1 << 20)
    assert set(whole) == {(1, at) for at in range(5000 - suffix_dedup.LENGTH + 1)}
    assert windows(700) == windows(1000) == whole


def test_suffix_dedup_edges_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    noise = ["".join(map(chr, rng.integers(97, 122, 900))) for _ in range(6)]
    part = noise[0][100:500]
    rows = [(1, noise[0]), (2, noise[1][:300] + part + noise[2]), (3, noise[3] + part[1:]), (4, "é" * 450), (5, "ab" * 400), (6, noise[4]), (6, noise[4]), (7, None), (8, ""), (9, "short")]
    bodies = [(t or "").encode() for _, t in rows]
    want = sorted((i, len(b), sum(g)) for (i, _), b, g in zip(rows, bodies, removed_by_force(bodies, suffix_dedup.LENGTH), strict=True))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in counted(table(spark, *rows)).collect()) == want
    assert suffix_dedup.remove_repeats(table(spark)).count() == 0


def test_line_dedup(spark):
    a = "The first line of them all\nshared line with  Six plain words\nshort"
    b = "Shared line with six plain words\nanother line that nobody else has\nshort"
    rows = [(2, b), (1, a), (3, "shared LINE with six plain words"), (4, None), (5, ""), (1, a)]
    got = {(r["doc_id"], r["text"]) for r in lines.remove_repeats(table(spark, *rows)).collect()}
    assert got == {(1, a), (2, "another line that nobody else has\nshort"), (3, ""), (4, None), (5, "")}
    spans = {r["doc_id"]: r["removed"] for r in lines.remove_repeats(table(spark, *rows)).collect()}
    assert [tuple(s) for s in spans[2]] == [(0, 33)] and spans[1] == []
    assert lines.remove_repeats(table(spark)).count() == 0


def test_line_dedup_cuts_each_text_of_a_key_by_itself(spark):
    shared = "shared line with six plain words"
    clean = "other words that stand in no second text\nand one more line of this kind"
    for key in (None, 7):
        rows = [(1, shared), (key, f"first line of this text alone\n{shared}"), (key, clean)]
        got = sorted((r["text"], [tuple(s) for s in r["removed"]]) for r in lines.remove_repeats(table(spark, *rows)).where("NOT doc_id <=> 1").collect())
        assert got == [("first line of this text alone\n", [(30, 62)]), (clean, [])]


def test_shared_passages(spark):
    inner = "One sentence of the passage here. Another of it stands behind!\nAnd a third one. Fin"
    rows = [(1, f"Own words begin. and lead in {inner} to other things."), (2, f"Foreign start {inner}. the rest"), (3, "Nothing at all of that."), (None, "another OF it  stands\tbehind"), (4, None), (5, ""), (6, "twice twice. twice twice."), (6, "twice twice")]
    got = {(r["doc"], r["shared_words"], r["longest_shared_words"]) for r in lines.shared_passages(table(spark, *rows)).collect()}
    unkeyed = [x for x in got if x[0] not in (1, 2)]
    # the first sentence begins inside one of other words, and the last ends so
    assert got - set(unkeyed) == {(1, 9, 9), (2, 9, 9)} and [x[1:] for x in unkeyed] == [(5, 5)]
    assert lines.shared_passages(table(spark)).count() == 0


def test_decontamination_equals_brute_force(spark, docs, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    items = [(str(r["item_id"]), find(r["text"])) for r in bench.collect()] + [("s", ["of", "the"]), ("none", [])]
    windows = {}
    for i, w in items:
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {}
    for d, t in texts.items():
        w = find(t)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [1] * n
        want[d] = (len(w), sum(hit), sorted(found))
    more = bench.select(F.col("item_id").cast("string"), "text").unionByName(spark.createDataFrame([("s", "Of THE"), ("none", "--")], "item_id string, text string"))
    for size in (decontaminate.PHRASE_BYTES, 3000):  # the latter takes several turns
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.find_benchmark(docs, more, phrase_bytes=size).collect()}
        assert got == want


def test_decontamination_spans_and_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omikron"
    bench = spark.createDataFrame([(1, item), (2, None), (3, item)], "item_id long, text string")
    doc = "Élan: " + item.replace("beta", "Beta") + "!"
    got = {r["doc_id"]: r for r in decontaminate.find_benchmark(table(spark, *ODD, (9, doc)), bench).collect()}
    assert [doc[s["start"] : s["end"]] for s in got[9]["spans"]] == [doc[6:-1]]
    assert list(got[9]["items"]) == ["1", "3"] and got[9]["contaminated"] and got[9]["n_hit"] == 15
    assert got[1]["n_words"] == 0 and not got[2]["contaminated"] and got[4]["n_hit"] == 0
    none = decontaminate.find_benchmark(table(spark, *ODD), bench.where("item_id = 2"))
    assert none.count() == len(ODD) and not none.where("contaminated").count()
    assert decontaminate.find_benchmark(table(spark), bench).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    got = language.identify(docs, model).withColumn("h", language.held_out())
    scored = got.where("h").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()["a"]
    assert scored > 0.98
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(table(spark, *ODD, (9, "12 !! 34 —"), (10, "12 —… 34")), model).collect()}
    assert odd[1] == odd[2] == odd[7] == odd[9] == odd[10] == (language.UNKNOWN, 0.0)
    assert language.identify(table(spark), model).count() == 0
    assert language.fit(table(spark)).langs == []
    assert {r["lang_pred"] for r in language.identify(table(spark, (1, "words here")), language.fit(table(spark))).collect()} == {language.UNKNOWN}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    for k, lengths in ((2, [4, 3, 1]), (3, [5, 5, 2]), (1, [3])):
        steps = max(lengths)
        emit, trans, begin = rng.normal(size=(len(lengths), steps, k)), rng.normal(size=(k, k)), rng.normal(size=k)
        post, pairs = language.forward_backward(emit, np.array(lengths), trans, begin)
        want, want_pairs = np.zeros_like(post), np.zeros((k, k))
        for c, n in enumerate(lengths):
            paths = list(itertools.product(range(k), repeat=n))
            weight = np.array([np.exp(begin[p[0]] + sum(emit[c, t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))) for p in paths])
            for p, x in zip(paths, weight / weight.sum(), strict=True):
                for t, y in enumerate(p):
                    want[c, t, y] += x
                for a, b in itertools.pairwise(p):
                    want_pairs[a, b] += x
        assert np.allclose(post, want) and np.allclose(pairs, want_pairs)


def test_language_labels_switching_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    pick = {x: docs.where((F.col("lang") == x) & language.held_out()).orderBy("doc_id").first()["text"] for x in ("en", "fr")}
    half = " ".join([*pick["en"].split()[:60], *pick["fr"].split()[:60]])
    shares = language.identify(spark.createDataFrame([(1, half)], "doc_id long, text string"), model).first()["shares"]
    assert 0.3 < shares["en"] < 0.7 and 0.3 < shares["fr"] < 0.7


def test_mixture_keeps_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i % 3 else "b", f"src{i % 4}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lv = mixing.with_levels(docs)
    n = {k: v for k, v in lv.groupBy("domain").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    got = mixing.mix(lv, share=(1, 2), epochs=1)
    total = sum(n.values()) // 2
    taken = got.agg(F.sum("tokens_taken")).first()[0]
    assert total - 20 < taken <= total
    by = dict(got.groupBy("domain").agg(F.sum("tokens_taken")).collect())
    assert all(by[d] <= n[d] for d in by)
    assert abs(by["web"] - total * 4 // 10) <= 2
    more = dict(mixing.mix(lv, share=(9, 10), epochs=1).groupBy("domain").agg(F.sum("tokens_taken")).collect())
    assert more["web"] == n["web"]  # 4/10 of that are more than it has; its siblings get the rest
    assert abs(sum(more.values()) - sum(n.values()) * 9 // 10) < 20
    twice = mixing.mix(lv, share=(3, 2), epochs=2)
    assert twice.where("full_epochs > 0").count() > 0
    assert mixing.mix(mixing.with_levels(table(spark))).count() == 0
    odd = mixing.mix(mixing.with_levels(table(spark, *ODD)), share=(1, 1), epochs=1)
    assert odd.agg(F.sum("tokens_taken")).first()[0] == 1 + 20000 + 3 * 8


def test_mixture_of_null_levels(spark):
    rows = [(1, "a b c", None, "s"), (2, "d e f", "de", None), (3, "g", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", F.lit(None).cast("string"))
    got = {r["doc_id"]: r["tokens_taken"] for r in mixing.mix(docs, share=(1, 1), epochs=1).collect()}
    assert got == {1: 3, 2: 3, 3: 1}
    assert [mixing.slice_digits(n) for n in (0, 256**3, 256**3 + 1, 10**12)] == [3, 3, 4, 5]


def test_token_tables_round_trip(spark, docs, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = shared_dir(spark)
    hard = {10_001: "İstanbul ﬁne ẞ don't we'll <|endoftext|>x\x1cy a b é Å", 10_002: None, 10_003: "", 10_004: "#hash *** (x) 12,5 naïve. naïve.,", -5: "minus"}
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(hard.items()), "doc_id long, text string"))
    manifest = sstable.write_shards(more, path, public_tokenizers.path("word_bpe_49k.json"), 2, True)
    got = {r["doc_id"]: r for r in sstable.digest(sstable.read_shards(spark, path, manifest)).collect()}
    start = 0
    for i, text in sorted({**texts, **hard}.items()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    rows = [r.asDict() for r in manifest.collect()]
    assert sstable.lookup(path, rows, 10_003)[0].tolist() == [2]
    assert sstable.lookup(path, rows, -5)[0].tolist()[-1] == 2
    assert sstable.lookup(path, rows, 777_777) == []


ALPHABET = ["\u0331", "\x0b", "\x0c", "\r", *"aabcdeeHIsts  \n\t'-.,#0123456789AZ", "don't", "we'LL", "'s", "İ", "ß", "ẞ", "ﬁ", "Σ", "ς", "é", "e\u0301", "\u0307", "\u0327", "क", "्", "日本", "ⅷ", "½", "😀", "👩‍👩‍👧", "\u200b", "\u00ad", "\xa0", "\x1c", "\u2028", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "K", "ſ", "Å", "\x00", "\ufeff"]


def test_encoder_equals_the_library_on_random_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, t, rng = encode.Encoder(path, 2, True), Tokenizer.from_file(path), np.random.default_rng(8)
    texts = ["".join(ALPHABET[i] for i in rng.integers(0, len(ALPHABET), rng.integers(1, 12))) for _ in range(20_000)]
    texts += ["<|ENDOFTEXT|> <|endoftext|>", "H\u0331 h\u0331 I\u0307x", "x" * 300 + " " + "Ab" * 200, "", None, " \x0b\x0c\r"]
    for k in range(0, len(texts), 500):
        for text, ids in zip(texts[k : k + 500], enc.encode(texts[k : k + 500]), strict=True):
            assert np.frombuffer(ids, np.uint16).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


def test_starts_of_many_shards(spark):
    rows = [(r, f"s{r:06d}-{i}", r, 1, 10 * r + i) for r in range(2500) for i in range(2)]
    made = sstable._with_starts(spark.createDataFrame(rows, "range int, file string, first_key long, n_docs long, n_tokens long").repartition(3))
    got, start = {r["file"]: r["start"] for r in made.collect()}, 0
    for _, file, _, _, n in rows:
        assert got[file] == start
        start += n


def test_token_tables_of_odd_rows(spark):
    for rows in (ODD, ()):
        path = shared_dir(spark)
        manifest = sstable.write_shards(table(spark, *rows), path, public_tokenizers.path("word_bpe_49k.json"), 2, True)
        got = sstable.digest(sstable.read_shards(spark, path, manifest)).collect()
        assert len(got) == len(rows)
        if rows:
            first = min(got, key=lambda r: r["start"])
            assert first["doc_id"] is None and first["start"] == 0


def test_shards_of_many_blocks():
    w = sstable.ShardWriter(2)
    values = [bytes(2 * (i * 37 % 3000)) for i in range(300)]
    for i, v in enumerate(values):
        w.add(sstable.pack_key(i * 3), v)
    body = w.finish()
    r = sstable.ShardReader(lambda at, n: body[at : at + n], len(body))
    assert len(r.blocks) > 3 and r.docs == 300
    assert len(r.get(sstable.pack_key(297))[0]) == len(values[99]) // 2
    assert r.get(sstable.pack_key(298)) == []


def spans_by_force(t):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    out = []
    for k, (name, pattern, ok) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, t or "", re.ASCII) if ok(m[0])]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_pii_equals_brute_force(spark, docs, texts):
    hard = {
        1001: "a@b.c_d@e.f x.y+z@host-1.example.org, @no a@b",
        1002: "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3",
        1003: "4111 1111 1111 1111 and 4111-1111-1111-1112; 0000000000000000000 00000000000000000000",
        1004: "+49 (30) 123-4567 890 +1 2 + 3 +12345678 ++123456789",
        1005: "é€😀 me@ho.st 😀 10.0.0.1",
        1006: "9" * 50_000 + " " + "a" * 50_000 + "@",
        1007: None,
        1008: "",
    }
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(hard.items()), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(more)).collect()}
    for i, t in {**texts, **hard}.items():
        assert got[i]["base_sha256"] == hashlib.sha256(spans_by_force(t).encode()).hexdigest(), i


def test_pii_validators_context_and_redaction(spark):
    rows = table(spark, *ODD, (9, "my bank account DE89 3704 0044 0532 0130 00 but not DE89 3704 0044 0532 0130 01"), (10, "call me: +49 30 1234567."), (11, "4111111111111111"))
    got = {r["doc_id"]: r for r in pii.find_pii(rows).collect()}
    assert [(s["kind"], s["start"]) for s in got[9]["pii"] if s["kind"] == "iban"] == [("iban", 16)]
    assert got[10]["pii"][0]["score"] > got[11]["pii"][0]["score"] - 0.3 and got[10]["pii"][0]["score"] == pytest.approx(0.6)
    assert got[1]["pii"] == [] and got[4]["pii"] == []
    assert pii.redact(pii.find_pii(rows)).where("doc_id = 10").first()["text"] == "call me: <phone>."
    assert pii.find_pii(table(spark)).count() == 0


def test_pii_account_numbers_before_and_after_other_words(spark):
    code, spaced, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [
        f"IBAN {code} The account",
        f"{spaced} Bitte",
        f"é😀 {spaced} BITTE ZAHLEN SIE BIS MORGEN",
        f"{code} 1234567",
        f"{code} ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        f"{code} {other}.",
        f"AB12 {code}",
        f"{spaced[:-1]}1 Bitte",
        f"{code}x",
    ]
    want = [[code], [spaced], [spaced], [code], [code], [code, other], [code], [], [code]]
    got = {r["doc_id"]: r for r in pii.find_pii(table(spark, *enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        assert [t[s["start"] : s["end"]] for s in got[i]["pii"] if s["kind"] == "iban"] == want[i], t
    near = [s["score"] for i in (0, 1) for s in got[i]["pii"] if s["kind"] == "iban"]
    assert near == [pytest.approx(1.0), pytest.approx(0.9)]
