"""What keeps queries within their limits on large tables: plans, and results where rules were rewritten for it."""

import contextlib
import io
import re
import time
import unicodedata

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from turnstone.functions import text
from turnstone.operators import catalog, containment, plan_docs, usage
from turnstone.plans import registry
from turnstone.sources import sessions
from turnstone.streaming import observe

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_bubbles_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(registry.QUERIES["desktop_bubbles"](spark, DATA))


def test_bubbles_are_read_in_one_pass(spark):
    """Texts that are plain need no reader, and what needs one goes there once."""
    bodies = {"a": '{"type":2,"text":5,"content":"c"}', "b": '{"type":2,"text":"\\u2003","thinking":["x","y"]}', "c": '{"type":1,"text":"q"}', "d": '{"type":2,"allThinkingBlocks":["t",{"text":" "},7],"toolFormerData":{}}'}
    head = '{"conversation":[' + ",".join(f'{{"bubbleId":"{b}"}}' for b in bodies) + "]}"
    kv = spark.createDataFrame([("composerData:k", head), *[(f"bubbleId:k:{b}", v) for b, v in bodies.items()]], "key string, value string")
    events = sessions.bubble_events(kv)
    got = [tuple(r) for r in events.orderBy("pos").select("turn_no", "turn_id", "pos", "bubble_id", "role", "text").collect()]
    assert got == [(1, "turn-1", 0, "a", "AgentResponse", "c"), (1, "turn-1", 1, "b", "AgentThought", "x\ny"), (1, "turn-1", 2, "c", "PromptSubmitted", "q"), (1, "turn-1", 3, "d", "AgentThought", "t"), (1, "turn-1", 4, "d", "ToolRequest", None)]
    assert len(re.findall(r"\+- ArrowEvalPython", plan(events))) == 1


def test_streams_keep_state_by_session(spark, tmp_path):
    """Calls and signatures are no groups of their own, and each is still forgotten by its own time."""
    rows = [("s", "a", "2024-01-01 00:00:00", "1", "transcript"), ("s", "b", "2024-01-01 03:30:00", "2", "transcript"), ("s", "b", "2024-01-01 09:00:00", "3", "hook"), ("s", "a", "2024-01-01 09:00:01", "4", "hook"), ("s", "a", "2024-01-01 09:00:01", "5", "hook")]
    for n, part in enumerate((rows[:1], rows[1:2], rows[2:3], rows[3:])):
        spark.createDataFrame(part, "session string, call_id string, t string, event_id string, origin string").selectExpr("session", "call_id", "call_id AS signature", "CAST(t AS TIMESTAMP) AS ts", "event_id", "origin").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for made, want in ((observe.change_kinds, {"1": "Added", "2": "Added", "3": "PromotePrimary", "4": "Added", "5": "Merged"}), (observe.stand_in_changes, {"1": "Add", "2": "Add", "3": "PromotePrimary", "4": "Add", "5": "Add"})):
        stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), timeout="2 hours")
        at = tmp_path / made.__name__
        run = stream.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
        got = {r[0]: r[1] for r in spark.read.parquet(str(at / "out")).select("event_id", "change_kind" if made is observe.change_kinds else "change").collect()}
        assert got == want and run.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_summaries_are_entered_in_bounded_batches(spark):
    """Only sizes that are sought are entered, and 3000 long texts don't make one batch."""
    whole = spark.range(3).selectExpr("id", "CASE id WHEN 0 THEN 'abcdef' WHEN 1 THEN repeat('x', 50) ELSE 'zz' END AS t", "CASE id WHEN 0 THEN 6 ELSE 1 END AS size")
    assert sorted(tuple(r) for r in containment._entries(whole, "t", "size").groupBy("id").count().collect()) == [(0, 1), (1, 1), (2, 1)]
    short = spark.createDataFrame([("k", 1, "b" * 3), ("k", 2, "needle in a long haystack"), ("l", 3, "q")], "k string, id int, t string")
    texts = spark.createDataFrame([("k", 7, "abbbc"), ("k", 8, "a needle in a long haystack."), ("k", 9, None), ("l", 7, "bbb")], "k string, w int, t2 string")
    assert sorted(tuple(r) for r in containment.contained(short, texts, ["k"], "id", "t", "w", "t2").collect()) == [("k", 1, 7), ("k", 2, 8)]


def test_pairs_are_not_made_different(spark):
    df = registry.QUERIES["session_matches"](spark, DATA)
    last = plan(df).split("Union")[0]
    assert "HashAggregate" not in last
    a = spark.createDataFrame([(1, "W", 1), (1, "W", 1), (2, "x", 2), (3, "x", 3), (4, None, 4)], "k int, w string, left_id int")
    b = spark.createDataFrame([(1, "w", 5), (2, "y", 6), (3, "X", 7), (4, None, 8)], "k int, w string, right_id int")
    assert sorted(tuple(r) for r in catalog.match_sessions(a, b, "k", "w").collect()) == [(1, 1, 5), (2, 2, 6), (3, 3, 7), (4, 4, 8)]


def test_bodies_go_to_python_only_to_be_composed(spark):
    inside = text.uncomposed().split("&&")[1].removesuffix("]")
    signs = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", inside))
    changed = [c for n in range(0x110000) if not 0xD800 <= n < 0xE000 and unicodedata.normalize("NFC", c := chr(n)) != c]
    assert all(signs.match(c) for c in changed) and signs.search("e\u0301") and signs.search("\u1100\u1161") and not signs.search("Größe é – 漢字")
    rows = spark.createDataFrame([("Größe",), ("e\u0301",), ("\u1100\u1161",), (None,), ("\n",)], "t string")
    assert [r[0] for r in rows.select(text.plan_body(F.col("t"))).collect()] == ["Größe", "é", "가", None, None]


def test_long_texts_are_cut_by_what_is_looked_at(spark):
    cut = len(text.CUT)
    rows = spark.createDataFrame([("é" * n,) for n in (99, 100, 101, 300, 900)] + [("x" * 401,), ("😀" * 100,), ("😀" * 101,), (None,)], "t string")
    got = [r[0] for r in rows.select(text.limited(F.col("t"), 100)).collect()]
    assert got == [t if t is None or len(t) <= 100 else t[: 100 - cut] + text.CUT for (t,) in [tuple(r) for r in rows.collect()]]
    assert "octet_length" in plan(rows.select(text.limited(F.col("t"), 100)))


def test_edges_are_made_once(spark):
    assert len(re.findall(r"FileScan parquet.*l_partkey", plan(registry.QUERIES["relation_degrees"](spark, DATA)))) == 1


def test_equal_documents_are_read_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(plan_docs.yaml_text, "parse", lambda raw: asked.append(raw))
    plan_docs._yaml_head.func(pd.Series(["a: b"] * 5 + [None, "c: d"]))
    assert len(asked) == 3


def test_bodies_of_one_time_give_the_largest(spark):
    rows = [("p", 1, b, True) for b in ("b1", "b3", "b2")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "p string, ord int, body string, ok boolean").coalesce(1)
        assert plan_docs.recover_missing(df, df.select("p").where("false"), "p", "ord", "body", F.col("ok")).first()["body"] == "b3"


def test_bodies_of_one_time_give_the_first_line_as_the_sql_does(spark, tmp_path):
    """Lines 1 and 2 of an order meet in `ord` where their parts are 100,000 apart."""
    pairs = [(k, n, part) for k in range(40) for n, part in ([(1, 150_000 + k), (2, 50_000 + k)] if k % 2 else [(2, 50_000 + k), (1, 150_000 + k)])]
    rows = {"l_orderkey": [p[0] for p in pairs], "l_linenumber": pa.array([p[1] for p in pairs], pa.int32()), "l_partkey": [p[2] for p in pairs], "l_quantity": [20.0] * 80, "l_discount": [0.1] * 80}
    pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": [39], "o_orderstatus": ["O"]}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = dict(con.execute(registry.ORACLE_SQL["recovered_plans"]).fetchall())
    assert want == {k: f"b{150_000 + k}" if k % 2 else f"b{50_000 + k}" for k in range(39)}
    assert {r["p"]: r["body"] for r in registry.QUERIES["recovered_plans"](spark, str(tmp_path)).collect()} == want


def test_names_are_taken_apart_where_samples_are(spark):
    """By name, neither samples nor cells are dealt out again, and the tables are read once."""
    said = plan(registry.QUERIES["usage_by_name"](spark, DATA))
    assert len(re.findall(r"FileScan parquet.*l_partkey", said)) == 1 and len(re.findall("Join", said)) == 1
    assert len(re.findall("Exchange hashpartitioning", said)) <= 4


def test_usage_by_name_keeps_names_apart_without_case(spark):
    rows = [("s", 1, "r1", "Input", 5), ("s", 1, "r1", "input", 5), ("s", 1, "r1", "usage.input", 5), ("s", 1, "r2", "INPUT", 7), ("s", 2, "r3", None, 4), ("s", 2, "r4", "modelMetrics.m.input", 3), ("s", 2, "r4", "agentMetrics.a.modelMetrics.m.input", 3)]
    samples = spark.createDataFrame(rows, "session string, bucket long, record_id string, name string, value long").selectExpr("*", "'Tokens' AS unit", "'Session' AS scope", "'Delta' AS behavior", "CAST(NULL AS TIMESTAMP) AS ts", "false AS authoritative", "monotonically_increasing_id() AS ord")
    want = {"input": 12, "usage.input": 5, None: 4, "modelmetrics.m.input": 3, "agentmetrics.a.modelmetrics.m.input": 3}
    for part, dealt in ((samples, False), (samples.repartition(3, "bucket"), True)):
        got = usage.usage_by_name(part, ["session"], dealt).collect()
        assert {r["name_key"]: r["total"] for r in got} == want and {r["unit_key"] for r in got} == {"tokens"}


def test_families_of_tokens_are_no_row_by_row_lambda(spark):
    said = plan(registry.QUERIES["token_totals"](spark, DATA))
    assert "lambda" not in said and len(re.findall(r"FileScan parquet.*l_partkey", said)) == 1 and len(re.findall("Exchange hashpartitioning", said)) <= 5


def test_usage_total_deals_out_sums_only(spark):
    said = plan(registry.QUERIES["usage_total"](spark, DATA))
    assert len(re.findall(r"FileScan parquet.*l_partkey", said)) == 1 and len(re.findall("Join", said)) == 1
    assert len(re.findall("Exchange hashpartitioning", said)) <= 4
