"""Turn ladders, open calls, texts in texts, stores of several writers, incremental results, YAML and detail rows."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from turnstone.functions import details, yaml_text
from turnstone.operators import containment, intervals, open_calls, pairing, sequential, turns
from turnstone.sources import captures, incremental

TURNS = "s string, i long, kind string, agent string, call string, talk string, own string"


def resolved(spark, *rows):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], TURNS).repartition(2)
    got = turns.ladder_turns(df, ["s"], ["i"], "i", "kind", "agent", "call", "talk", "own").collect()
    return {r["i"]: (r["resolved"], r["turn_id"]) for r in got}


def test_ladder_goes_by_agent_call_interaction_and_state(spark):
    got = resolved(
        spark,
        ("message", None, None, None, "n1"),  # nothing to belong to
        ("user", None, None, None, "n1"),
        ("request", None, "c", None, None),
        ("user", None, None, "x", None),
        ("result", None, "c", None, None),  # its call's turn
        ("start", None, None, None, "n3"),  # the last user's comes before its own id
        ("agent", "a", "c", None, None),
        ("message", "a", None, "x", None),  # its agent's parent comes first
        ("end", None, None, None, None),
        ("user", None, None, None, "n1"),  # taken, so a new one
        ("message", "b", None, "y", None),  # an interaction that nothing is known of
    )
    names = {i: r for i, (r, _) in got.items()}
    assert names == {0: None, 1: "n1", 2: "n1", 3: "interaction:x", 4: "n1", 5: "interaction:x", 6: "n1", 7: "n1", 8: "interaction:x", 9: "user:9", 10: None}
    assert all(t == r for r, t in got.values())


def test_merges_carry_earlier_and_later_rows(spark):
    got = resolved(
        spark,
        ("user", None, None, "x", None),
        ("request", None, "c", None, None),
        ("merge", None, None, "x", "n1"),
        ("result", None, "c", None, None),
        ("merge", None, "c", None, "n2"),
        ("message", None, None, "x", None),
        ("user", None, None, None, "n1"),  # the name is free again
        ("merge", None, None, None, "n2"),
    )
    assert {i: t for i, (_, t) in got.items()} == {i: "n2" for i in range(8)}
    assert [got[i][0] for i in range(8)] == ["interaction:x", "interaction:x", "interaction:x", "n1", "n1", "n2", "n1", "n1"]


def test_ladder_of_odd_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turns.ladder_turns(empty, ["s"], ["i"], "i", "kind", "agent", "call", "talk", "own").count() == 0
    df = spark.createDataFrame([(None, 1, "user", None, None, None, None), (None, 2, None, None, None, None, None), ("s", 3, "other", None, None, None, "n")], TURNS)
    got = {r["i"]: r["turn_id"] for r in turns.ladder_turns(df, ["s"], ["i"], "i", "kind", "agent", "call", "talk", "own").collect()}
    assert got == {1: "user:1", 2: "user:1", 3: None}


def test_sequential_pass_starts_anew_at_each_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)

    def total():
        sums = [0]

        def step(v):
            sums[0] += v
            return [(sums[0],)]

        return step

    got = sorted(map(tuple, sequential.by_key(df, ["k"], ["i"], ["v"], total, "sum long").collect()), key=str)
    want, run = [], {}
    for k, _, v in rows:
        run[k] = run.get(k, 0) + v
        want.append((k, run[k]))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_open_calls_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice(v)
    asked = [("s", i, i + rnd.randrange(1, 14) if rnd.random() < 0.93 else None, i, pick(None, "f", "g"), pick(None, "c", "d"), pick(None, "1", "2", "3")) for i in range(0, 80, 2)]
    asks = [("s", i, i, pick(None, "f", "g"), pick(None, "c", "d"), pick(None, "1", "2", "3")) for i in range(1, 120, 2)]
    a = spark.createDataFrame(asked, "s string, opened long, closed long, request_id long, file string, command string, args string")
    p = spark.createDataFrame(asks, "s string, at long, probe_id long, file string, command string, args string")

    def is_open(q, at):
        return q[1] < at and (q[2] is None or at < q[2])

    def fits(q, r):
        for x, y in zip(q[4:], r[3:], strict=True):
            if x is not None and y is not None:
                return x == y
        return False

    want = {r[2]: ids[0] for r in asks if len(ids := [q[3] for q in asked if is_open(q, r[1]) and fits(q, r)]) == 1}
    got = {r["probe_id"]: r["request_id"] for r in open_calls.by_signals(a, p, ["s"], ["file", "command", "args"]).collect()}
    assert got == want and len(want) > 3

    want = {}
    for r in asks:
        mine = [q for q in asked if is_open(q, r[1]) and q[4] is not None and q[4] == r[3] and (q[6] is None or r[5] is None or q[6] == r[5])]
        score = lambda q: int(q[6] is not None and q[6] == r[5])  # noqa: B023, E731
        best = [q for q in mine if score(q) == max(map(score, mine))]
        if len(best) == 1:
            want[r[2]] = best[0][3]
    got = {r["probe_id"]: r["request_id"] for r in open_calls.by_input(a, p, ["s"], "file", "args").collect()}
    assert got == want and len(want) > 3


def test_reused_ids_need_one_best_request(spark):
    def pairs(*rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, asks boolean, input string").withColumn("k", F.lit("k"))
        return {(r["request_id"], r["result_id"]) for r in open_calls.reused_ids(df, ["k"], ["i"], F.col("asks"), "input", "i").collect()}

    assert pairs((True, "x"), (True, "y"), (False, "y"), (False, "x")) == {(1, 2), (0, 3)}
    assert pairs((True, "x"), (True, "x"), (False, "x")) == set()  # a tie
    assert pairs((True, None), (False, "x")) == {(0, 1)}  # missing scores nothing, and is the only one
    assert pairs((True, None), (True, "x"), (False, "x"), (False, "x")) == {(1, 2), (0, 3)}
    assert pairs((True, "x"), (False, "y")) == set()  # a clash
    assert pairs((True, "x"), (True, None), (False, None), (False, "x")) == {(0, 3)}
    assert pairs((False, "x"), (True, "x")) == set()


def test_signals_of_payloads(spark):
    told = [
        '{"toolArgs":{"file_path":"a/B.txt","command":"x"}}',
        '{"toolInput":"{\\"path\\":\\"C:\\\\\\\\q\\\\\\\\R\\"}"}',
        '{"tool_input":"*** Delete File: z/q.py\\nrest"}',
        '{"message":"Execute command: a\\r\\nb\\n"}',
        '{"message":"Delete file: x y.md, and more"}',
        '{"message":"Delete it: x"}',
        "[]",
        None,
        "{",
    ]
    df = spark.createDataFrame([(t,) for t in told], "p string")
    got = [tuple(r[0]) for r in df.select(open_calls.call_signals(F.col("p"))).collect()]
    assert got == [("b.txt", "x", '{"command":"x","file_path":"a/B.txt"}'), ("r", None, '{"path":"C:\\\\q\\\\R"}'), ("q.py", None, None), (None, "a\nb", None), ("x y.md", None, None), *[(None, None, None)] * 4]


def test_texts_in_texts_equal_brute_force(spark):
    rnd = random.Random(4)
    whole = [(k % 3, k, "".join(rnd.choices("ab é文", k=rnd.randrange(0, 90)))) for k in range(40)]
    short = [(k % 3, k, rnd.choice(whole)[2][: rnd.randrange(40)]) for k in range(60)] + [(0, 60, None), (1, 61, ""), (2, 62, "never there at all")]
    w = spark.createDataFrame([*whole, (1, 99, None)], "g int, wid long, body string")
    s = spark.createDataFrame(short, "g int, sid long, said string")
    got = {tuple(r) for r in containment.contained(s, w, ["g"], "sid", "said", "wid", "body").collect()}
    assert got == {(g, i, j) for g, i, t in short for h, j, b in whole if g == h and t and t in b}


def test_stand_ins_are_replaced_in_order(spark):
    rows = [(0, "t"), (1, "t"), (2, "h"), (3, "h"), (4, "h"), (5, "t")]
    df = spark.createDataFrame(rows, "i long, side string").withColumn("k", F.lit(1))
    got = {r["i"]: (r["change"], r["partner"]) for r in pairing.stand_ins(df, ["k"], ["i"], F.col("side") == "h", "i").collect()}
    assert got == {0: ("Add", None), 1: ("Add", None), 2: ("PromotePrimary", 0), 3: ("PromotePrimary", 1), 4: ("Add", None), 5: ("AttachEvidence", 4)}
    left = {(r["node_id"], r["stand_in"]) for r in pairing.standing_in(df.where("i < 3"), ["k"], ["i"], F.col("side") == "h", "i").collect()}
    assert left == {(2, False), (1, True)}


def test_thoughts_told_twice(spark):
    rows = [(0, 0.0, True, False), (1, 3.0, False, False), (2, 4.0, False, False), (3, 20.0, False, False), (4, 24.0, True, False), (5, 25.0, True, True), (6, 26.0, False, False)]
    df = spark.createDataFrame(rows, "i long, t double, step boolean, stop boolean").withColumns({"ts": F.timestamp_micros((F.col("t") * 1_000_000).cast("long")), "k": F.lit("k")})
    got = {r["i"]: r["is_duplicate"] for r in intervals.duplicate_thoughts(df, ["k"], ["i"], "ts", "step", "i", resets=F.col("stop"), segment_by=["k"]).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 6: False}


def test_two_writers_leave_each_key_once(spark, tmp_path):
    store, n = f"file://{tmp_path}/store", {}
    rows = spark.range(400).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("dedupe_key"), (F.col("id") % 4).alias("part"))

    def write(name, low, high):
        n[name] = captures.append_new(rows.where(f"dedupe_key >= 'k{low}' AND dedupe_key <= 'k{high}'"), store, partition_by=("part",))

    for _ in range(2):
        both = [threading.Thread(target=write, args=("a", 1, 3)), threading.Thread(target=write, args=("b", 2, 4)), threading.Thread(target=write, args=("c", 1, 4))]
        for t in both:
            t.start()
        for t in both:
            t.join()
        have = captures.stored(spark, store)
        assert have.count() == have.select("dedupe_key").distinct().count() == rows.where("dedupe_key >= 'k1' AND dedupe_key <= 'k4'").count()
        assert set(have.columns) == {"dedupe_key", "part"}
    assert n == {"a": 0, "b": 0, "c": 0}


def test_batches_by_name_are_appended_once(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "dedupe_key string, v long")
    assert captures.append_new(rows, store, batch="epoch-1") == 2
    assert captures.append_new(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), store, batch="epoch-1") == 0
    # what a lost writer leaves isn't read
    rows.write.parquet(f"{store}/__batch=lost")
    assert captures.append_new(spark.createDataFrame([("c", 3)], rows.schema), store, batch="epoch-2") == 1
    assert sorted(r["v"] for r in captures.stored(spark, store).collect()) == [1, 2, 3]


def test_refresh_reads_touched_sources_only(spark, tmp_path):
    root, store = tmp_path / "in", f"file://{tmp_path}/store"
    root.mkdir()
    asked = []

    def put(name, *rows):
        (root / name).write_text("".join(f'{{"k":"{k}","v":{v}}}\n' for k, v in rows))

    def read(paths):
        asked.append(paths if isinstance(paths, str) else sorted(p.rpartition("/")[2] for p in paths))
        return spark.read.schema("k string, v long").json(paths).withColumn("source", F.col("_metadata.file_path"))

    def refresh():
        result, n = incremental.refresh(spark, f"file://{root}", store, read, lambda d: d.groupBy("k").agg(F.sum("v").alias("v")), "k")
        return {r["k"]: r["v"] for r in result.collect()}, n

    put("a.json", ("x", 1), ("y", 2))
    put("b.json", ("y", 3))
    put("c.json", ("z", 4))
    assert refresh() == ({"x": 1, "y": 5, "z": 4}, 3)
    assert refresh() == ({"x": 1, "y": 5, "z": 4}, 0)
    put("b.json", ("y", 30), ("w", 9))
    asked.clear()
    assert refresh() == ({"x": 1, "y": 32, "z": 4, "w": 9}, 2)
    assert asked == [["b.json"], ["a.json", "b.json"]]
    (root / "a.json").unlink()
    put("d.json", ("z", 5))
    assert refresh() == ({"y": 30, "z": 9, "w": 9}, 3)


def test_yaml_of_hard_documents():
    assert yaml_text.parse("a: |\n  x\n   y\n\n  z\nb: >-\n  p\n  q\n\n  r\n") == {"a": "x\n y\n\nz\n", "b": "p q\nr"}
    assert yaml_text.parse("t:\n- {id: a, c: 'it''s'}\n- id: b\n  c: \"q\\n\"\nl: [1, [x, y], {k: v}]\n") == {"t": [{"id": "a", "c": "it's"}, {"id": "b", "c": "q\n"}], "l": ["1", ["x", "y"], {"k": "v"}]}
    assert yaml_text.parse("a:\n  b:\n    c: d # no\n  e:\nf: ~\n") == {"a": {"b": {"c": "d"}, "e": None}, "f": None}
    assert yaml_text.parse("plain text\n goes on") == "plain text goes on"
    for bad in ("a: b: c", "a: [1", "a: &x 1", "\ta: 1", "a: 1\na: 2", 'a: "\\q"', None):
        assert yaml_text.parse(bad) is None


def test_detail_rows_of_odd_payloads(spark):
    specs = details.spec_table(spark, {"e": [("Scalar", "a"), ("AllTopLevel",)]})
    df = spark.createDataFrame([(1, "e", '{"b":null,"a":1.0,"duration":3}', "v"), (2, "e", "no", "w"), (3, "none", '{"a":1}', " "), (4, None, None, None)], "i long, event string, p string, extra string")
    got = {}
    for r in details.detail_rows(df, "i", "event", "p", specs, [("A", F.col("extra")), ("more", F.col("extra"))]).orderBy("i", "pos").collect():
        got.setdefault(r["i"], []).append((r["name"], r["value"]))
    assert got == {1: [("duration", "3"), ("a", "1.0"), ("b", "null"), ("more", "v")], 2: [("A", "w"), ("more", "w")]}
    with pytest.raises(ValueError):
        details.spec_table(spark, {"e": [("Other", "a")]})


def test_segments_end_where_nothing_follows(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for key in ("a", "b", None):
        at = segment = 0
        for k in range(300):
            gap = rnd.choice([0, 5, 29, 30, 31, 4000, 90_000])
            segment += gap > 30 and k > 0
            at += gap
            rows.append((key, len(rows), at))
            want[len(rows) - 1] = (key, segment)
    df = spark.createDataFrame(rows, "k string, i long, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(4)
    got = {}
    for r in intervals.reach_segments(df, ["k"], "ts", 30, "seg").collect():
        got.setdefault((r["k"], r["seg"]), set()).add(r["i"])
    expected = {}
    for i, w in want.items():
        expected.setdefault(w, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    untimed = spark.createDataFrame([("a", None), ("a", 5)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert len({r["seg"] for r in intervals.reach_segments(untimed, ["k"], "ts", 30, "seg").collect()}) == 2


def test_roots_of_deep_chains_and_cycles(spark):
    from turnstone.operators import relations

    rows = [(i, i - 1 if i else None) for i in range(300)] + [(500, 501), (501, 500), (502, 501), (600, 999)]
    got = {r["n"]: (r["root"], r["depth"]) for r in relations.root_of(spark.createDataFrame(rows, "n long, p long"), "n", "p").collect()}
    assert got[299] == (0, 299) and got[500] == (500, -1) and got[502] == (502, -1) and got[600] == (999, 1)


def test_requests_open_for_too_long_are_forgotten(spark, tmp_path):
    from turnstone.streaming import observe

    rows = [("s", 0, "ToolRequest", "a"), ("s", 50, "ToolRequest", "a"), ("s", 100, "ToolSuccess", "a"), ("s", 101, "ToolSuccess", "a")]
    df = spark.createDataFrame([(k, at, r, t, None) for k, at, r, t in rows], "session string, at long, role string, tool string, server string").withColumns({"ts": F.timestamp_seconds(F.col("at") + 10**6), "event_id": F.col("at")}).drop("at")
    df.write.parquet(str(tmp_path / "in"))
    for open_for, want in (("60 seconds", {"100": "50", "101": None}), (None, {"100": "0", "101": "50"})):
        at = tmp_path / f"{open_for}"
        stream = observe.session_steps(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), open_for=open_for)
        q = stream.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        got = {r["event_id"]: r["request_id"] for r in spark.read.schema(stream.schema).parquet(str(at / "out")).collect() if r["role"] == "ToolSuccess"}
        assert got == want
