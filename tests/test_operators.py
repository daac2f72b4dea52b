"""Single rules on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from turnstone.functions import paths, text, times, tools
from turnstone.operators import intervals, interpret, matching, pairing, placement, plan_docs, relations, turns, usage
from turnstone.sources import captures, envelopes, sessions, transcripts
from turnstone.streaming import observe

SAMPLE = "session string, bucket string, record_id string, name string, value long, unit string, scope string, behavior string, ts timestamp, authoritative boolean, ord long"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


def total(spark, *samples):
    rows = [("s", b, r, n, v, "tokens", sc, bh, None, a, i) for i, (b, r, n, v, sc, bh, a) in enumerate(samples)]
    return usage.usage_total(spark.createDataFrame(rows, SAMPLE), ["session"]).first()["total"]


def test_usage_counts_what_a_record_tells_by_several_names_once(spark):
    alias = [("t", "r1", n, 50, "Turn", "Delta", False) for n in ("usage.input_tokens", "inputTokens", "input")]
    assert total(spark, *alias) == 50
    assert total(spark, *alias, ("t", "r2", "input-token", 7, "Turn", "Delta", False)) == 57
    assert total(spark, *alias, ("t", "r1", "inputTokens", 50, "Turn", "Delta", True)) == 50  # told with authority, too: only that counts


def test_usage_families_are_whole_last_parts(spark):
    rows = [("t", "r", n, v, "Turn", "Cumulative", False) for n, v in (("input", 5), ("maxInputTokens", 900), ("inputAudioTokens", 30), ("cacheReadInputTokens", 11), ("cache_read", 10))]
    assert total(spark, *rows) == 5 + 900 + 30 + 11


def test_usage_scopes_and_behaviors(spark):
    turn = lambda n, v, b, auth=False, t="t1", name="output": (t, n, name, v, "Turn", b, auth)
    assert total(spark, turn("a", 4, "Cumulative"), turn("b", 9, "Cumulative"), turn("c", 6, "Cumulative", t="t2")) == 15
    assert total(spark, turn("a", 4, "Delta"), turn("b", 9, "Unknown"), ("q", "z", "output", 1000, "Request", "Delta", False)) == 13
    assert total(spark, turn("a", 4, "Delta"), turn("b", 9, "Cumulative"), turn("c", 2, "Final")) == 2
    assert total(spark, turn("a", 80, "Final"), turn("b", 3, "Delta", True), turn("c", 5, "Delta", True)) == 8
    assert total(spark, turn("a", 70, "Delta"), ("s", "b", "usage.output", 12, "Session", "Final", False), ("s", "c", "gpt.output", 500, "Session", "Final", False)) == 12


def test_usage_of_models_and_agents(spark):
    final = lambda n, v, name: ("s", n, name, v, "Session", "Final", False)
    assert total(spark, final("a", 3, "modelMetrics.big.input"), final("b", 4, "small.inputTokens")) == 7
    # an agent's copy of a listed model's figure goes; what is only the agent's stays
    assert total(spark, final("a", 3, "modelMetrics.big.input"), final("b", 2, "agentMetrics.x.modelMetrics.big.inputTokens"), final("c", 9, "agentMetrics.x.modelMetrics.tiny.input")) == 12
    assert total(spark, final("a", 3, "big.input"), final("b", 2, "agentMetrics.x.modelMetrics.big.input")) == 5


def test_waves(spark):
    base = "c long, s timestamp, e timestamp"
    at = lambda x: f"1970-01-01 00:00:0{x}"
    mk = lambda rows: spark.createDataFrame([(i, at(s), at(e)) for i, (s, e) in enumerate(rows)], "c long, s string, e string").select(F.lit(1).alias("k"), "c", F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    got = intervals.waves(mk([("3.2", "4.0"), ("3.9", "7.7"), ("4.4", "5.1")]), ["k"], "s", "e", "c").collect()
    assert len(got) == 1 and got[0]["members"] == 3 and (got[0]["ended"] - got[0]["started"]).total_seconds() == 4.5
    assert intervals.waves(mk([("5.0", "5.4"), ("5.4", "6.0")]), ["k"], "s", "e", "c").count() == 0
    assert base


def test_plan_revisions(spark):
    rows = [("p", i, h, False) for i, h in enumerate(["A", "A", "B", "B", "A"])] + [("q", 0, None, True)]
    got = {r["p"]: (r["revisions"], r["updates"], r["partial"]) for r in plan_docs.plan_revisions(spark.createDataFrame(rows, "p string, n long, h string, opaque boolean"), ["p"], ["n"], "h", F.col("opaque")).collect()}
    assert got == {"p": (3, 2, False), "q": (0, 0, True)}


def test_unique_best_leaves_ties(spark):
    rows = spark.createDataFrame([("a", 1, 100), ("a", 2, 100), ("b", 1, 0), ("c", 1, 20), ("c", 2, 40), ("d", 1, None)], "k string, c long, s long")
    assert {(r["k"], r["c"]) for r in matching.unique_best(rows, ["k"], "s").collect()} == {("b", 1), ("c", 2)}
    assert {(r["k"], r["c"]) for r in matching.best_or_sole(rows, ["k"], "s").collect()} == {("b", 1), ("c", 2)}


def test_placement(spark):
    rows = [("u", "w1", "project-key", 90), ("v", "w1", "project-key", 90), ("v", "w1", "tool-path", 75), ("x", "w1", "tool-path", 75), ("x", "w2", "tool-path", 75), ("y", "w1", "native-id", 95)]
    got = {r["s"]: (r["w"], r["evidence"], r["score"]) for r in placement.infer_workspace(spark.createDataFrame(rows, "s string, w string, kind string, score int"), "s", "w", "kind", "score").collect()}
    assert got == {"u": ("w1", "Derived", 90), "v": ("w1", "Corroborated", 95), "x": (None, "Ambiguous", 75), "y": ("w1", "Corroborated", 95)}


def test_brackets_and_queues(spark):
    rows = spark.createDataFrame([("s", i, k) for i, k in enumerate("ESSEESE")], "s string, i long, k string")
    got = {(r["end_id"], r["start_id"]) for r in pairing.brackets(rows, ["s"], ["i"], F.col("k") == "S", F.col("k") == "E", "i").collect()}
    assert got == {(3, 2), (4, 1), (6, 5)}
    calls = spark.createDataFrame([("s", 0, "request", "a"), ("s", 1, "request", "b"), ("s", 2, "result", "b"), ("s", 3, "result", "z"), ("s", 4, "result", "z")], "s string, i long, kind string, args string")
    assert {(r["request_id"], r["result_id"]) for r in pairing.queue_matches(calls, ["s"], ["i"], "kind", "args", "i").collect()} == {(1, 2), (0, 3)}


def test_greedy_skew_takes_the_nearest_in_reach(spark):
    rows = [(1, "left", "2024-01-01 00:00:00"), (2, "left", "2024-01-01 00:31:00"), (3, "right", "2024-01-01 00:31:05"), (4, "right", "2024-01-01 02:00:00")]
    df = spark.createDataFrame([("k", i, s, t) for i, s, t in rows], "k string, i long, side string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [tuple(r) for r in pairing.greedy_by_skew(df, ["k"], ["t", "i"], "side", "t", "i").collect()] == [("k", 2, 3)]


def test_parent_cycles_stand_alone(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "n long, p long")
    got = {r["n"]: (r["root"], r["depth"]) for r in relations.root_of(rows, "n", "p").collect()}
    assert got[3] == (1, 2) and got[1] == (1, 0) and got[4] == (4, -1) and got[5] == (5, -1) and got[6][0] == 99


@pytest.mark.parametrize(
    ("rule", "value", "want"),
    [
        (lambda c: text.preview(c, 5), " a  bcd \n", "a bcd"),
        (lambda c: text.preview(c, 4), "a bcd e", "a bc…"),
        (text.normal_text, "x  y [REDACTED] [REDACTED] ", "x y"),
        (text.normal_text, "[REDACTED]", None),
        (text.normal_text, "x[REDACTED]", "x[REDACTED]"),
        (text.unwrap_prompt, "a<user_query>b</user_query>c", "b"),
        (text.slash_commands, "/Fix it /fix. a/b /x!y /ok", ["/Fix", "/x", "/ok"]),
        (text.skill_mentions, "the Code-Review skill, x-y skills; plain skill", ["code-review", "x-y"]),
        (text.skill_of_path, "/a/skills/deep/SKILL.md", "deep"),
        (text.patch_paths, "*** Update File: a/b.py\n*** Move to: c.py\n*** Add File: A/B.py", ["a/b.py", "c.py"]),
        (text.stop_status, " END_turn ", "completed"),
        (text.turn_of_generation, "0123abcd-0123-0123-0123-0123456789ab-7-aB3d", "0123abcd-0123-0123-0123-0123456789ab"),
        (text.plan_body, "\ufeff\r\n# e\u0301\r\n\r\n", "# é"),
        (tools.tool_kind, "MCP:x", "Mcp"),
        (tools.bare_mcp_tool, "mcp-docs-search", "search"),
        (paths.clean_root, "/c:/Work/", "c:/Work"),
        (lambda c: F.unix_seconds(times.epoch_timestamp(c, "copilot")), "1700000000000000000", 1700000000),
    ],
)
def test_text_rules(spark, rule, value, want):
    assert one(spark, value, rule) == want


def test_derived_turns(spark):
    rows = spark.createDataFrame([("s", i, r) for i, r in enumerate("xpxsxpp")], "s string, i long, r string")
    got = [r["turn_id"] for r in turns.derived_turns(rows, ["s"], ["i"], F.col("r") == "p", F.col("r") == "s").orderBy("i").collect()]
    assert got == [None, "derived-1", "derived-1", "derived-1", None, "derived-2", "derived-3"]


def test_envelopes_and_enumerations(spark, tmp_path):
    good = {"eventId": "e1", "observedAtUtc": "2024-01-01T00:00:00Z", "provider": "2", "sourceKind": "hook", "payload": {"hook_event_name": "PreToolUse", "session_id": "s", "timestamp": "2024-01-02T00:00:00Z", "tool_name": "Bash", "transcript_path": "/T/a.jsonl"}}
    (tmp_path / "a_20240131_235959_123_0a1b2c3d.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    rows, rejects = envelopes.read(spark, str(tmp_path))
    r = interpret.normal_envelope(rows).first()
    assert (r["event_id"], r["native_event"], r["provider"], r["surface"], r["source_kind"]) == ("e1", "PreToolUse", "ClaudeCode", "ClaudeCode", "Hook")
    assert str(r["ts"]).startswith("2024-01-02") and rejects.count() == 1
    assert envelopes.discover_transcripts(rows).first()["transcript"] == "/T/a.jsonl"
    assert {x["name"] for x in envelopes.detail_fields(rows, "event_id", "payload").collect()} >= {"tool_name", "session_id"}
    assert str(one(spark, "a_20240131_235959_123_0a1b2c3d.json", envelopes.file_time)).startswith("2024-01-31 23:59:59")


def test_transcript_dialects(spark, tmp_path):
    lines = [
        {"type": "user", "sessionId": "s", "promptId": "p", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "do it"}},
        {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": ""}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {}}], "usage": {"input_tokens": 7}}},
        {"type": "user", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "no"}]}},
    ]
    (tmp_path / "m.jsonl").write_text("\ufeff" + "\r\n".join(map(json.dumps, lines)) + "\n\n")
    got = transcripts.claude_events(transcripts.read_lines(spark, str(tmp_path))).orderBy("line_no", "block_no").collect()
    assert [r["event_role"] for r in got] == ["PromptSubmitted", "AgentThought", "ToolRequest", "ToolFailure"]
    assert got[1]["opaque"] and got[2]["input_tokens"] == 7 and len({r["dedupe_key"] for r in got}) == 4
    cli = [{"type": "assistant.message", "timestamp": 1700000000000, "data": {"content": "x", "toolRequests": [{"toolCallId": "c", "name": "bash"}]}}, {"type": "tool.execution_complete", "data": {"toolCallId": "c", "success": False}}]
    whole = spark.createDataFrame([("f", "\n".join(map(json.dumps, cli)))], "path string, value string")
    assert [r["event_role"] for r in transcripts.copilot_events(transcripts.split_lines(whole)).orderBy("line_no", "block_no").collect()] == ["AgentResponse", "ToolRequest", "ToolFailure"]
    ide = [{"role": "user", "message": {"content": [{"type": "text", "text": "q"}]}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "hm"}, {"type": "tool_use", "name": "Shell"}]}}, {"type": "turn_ended", "status": "success"}]
    whole = spark.createDataFrame([("f", "\n".join(map(json.dumps, ide)))], "path string, value string")
    assert [r["event_role"] for r in transcripts.cursor_events(transcripts.split_lines(whole)).orderBy("line_no", "block_no").collect()] == ["PromptSubmitted", "AgentThought", "ToolRequest", "TurnStop"]


def test_session_files(spark):
    yaml = spark.createDataFrame([("w.yaml", "id: 'a'\nCWD: /x\n# no: 1\nrepo: r\n")], "path string, value string")
    r = sessions.workspace_yaml(yaml).first()
    assert (r["id"], r["cwd"], r["repository"], r["name"]) == ("a", "/x", "r", None)
    kv = spark.createDataFrame([("d", "t", "composerData:c", json.dumps({"createdAt": 1700000000000, "fullConversationHeadersOnly": [{"bubbleId": "b"}]})), ("d", "t", "bubbleId:c:b", json.dumps({"type": 1, "text": "hi"}))], "db_path string, table_name string, key string, value string")
    assert sessions.composers(kv).join(sessions.bubbles(kv), ["composer_id", "bubble_id"]).first()["role"] == "PromptSubmitted"
    plan = spark.createDataFrame([("p.md", None, "---\nname: x\n---\n\n# Title\nbody\n")], "path string, modified timestamp, value string")
    assert tuple(sessions.plan_files(plan).select("title", "body").first()) == ("Title", "# Title\nbody")


def test_captures_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("a", "s1")], "dedupe_key string, session_id string")
    store = str(tmp_path / "store")
    assert captures.append_new(rows, store) == 2
    assert captures.append_new(rows, store) == 0
    assert captures.delete_sessions(spark, store, rows.where("session_id = 's2'"), str(tmp_path / "left")) == 1


def run_stream(df, out, cp, mode="append"):
    """Runs a stream over all of its input and gives what it wrote."""
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(cp)).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(240), "the stream doesn't end"
    return df.sparkSession.read.schema(df.schema).parquet(str(out))


def landed(spark, df, at, parts, by):
    for k in range(parts):
        df.where(f"{by} = {k}").coalesce(1).write.parquet(str(at / f"{k}"))
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(at))


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", i, r, t) for i, (r, t) in enumerate([("ToolRequest", "a"), ("ToolRequest", "b"), ("ToolSuccess", "b"), ("ToolRequest", "a"), ("ToolFailure", "a"), ("ToolSuccess", "a")])]
    df = spark.createDataFrame(rows, "session string, event_id long, role string, tool string").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 10**6))
    stream = landed(spark, df, tmp_path / "in", 3, "floor(event_id / 2)")
    got = {(r["request_id"], r["result_id"]) for r in run_stream(observe.pair_requests(stream), tmp_path / "out", tmp_path / "cp").collect()}
    assert got == {("1", "2"), ("0", "4"), ("3", "5")}
    seen = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert run_stream(observe.idempotent(seen.withColumn("dedupe_key", F.col("tool"))), tmp_path / "out2", tmp_path / "cp2").count() == 2


def test_stream_state_of_a_session(spark, tmp_path):
    told = [
        ("PromptSubmitted", None, None, 0), ("ToolRequest", "a", "srv", 1), ("TurnStop", None, None, 2), ("ToolSuccess", "a", None, 3),
        ("PromptSubmitted", None, None, 4), ("ToolRequest", "a", None, 5), ("SessionEnd", None, None, 6), ("ToolSuccess", "a", None, 6),
        ("PromptSubmitted", None, None, 8), ("ToolRequest", "a", None, 9),
    ]
    df = spark.createDataFrame([("s", i, r, t, v, at) for i, (r, t, v, at) in enumerate(told)], "session string, event_id long, role string, tool string, server string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 10**6)).drop("at")
    for parts in (1, 5):
        at = tmp_path / f"p{parts}"
        stream = landed(spark, df, at / "in", parts, f"floor(event_id * {parts} / 10)")
        got = {int(r["event_id"]): (r["turn_id"], r["request_id"], r["server"]) for r in run_stream(observe.session_steps(stream), at / "out", at / "cp").collect()}
        assert got == {
            0: ("derived-1", None, None), 1: ("derived-1", None, "srv"), 2: ("derived-1", None, None), 3: (None, None, "srv"),
            4: ("derived-2", None, None), 5: ("derived-2", None, "srv"), 6: ("derived-2", None, None) if parts == 5 else got[6], 7: got[7],
            8: ("derived-1", None, None), 9: ("derived-1", None, None),
        }
        assert got[7][1] == "5"  # in one batch before the end, in several drained behind it


def test_stream_of_segments(spark, tmp_path):
    whole = "\ufefffirst\r\n\nzweite Zeile é\nthird"
    raw = whole.encode()
    cuts = [0, 4, 15, 26, len(raw)]
    parts = [(0, "f", 0, cuts[i], raw[cuts[i] : cuts[i + 1]].decode()) for i in range(4)] + [(4, "f", 0, 15, raw[15:26].decode()), (5, "f", 0, len(raw), " line\nfourth\n"), (6, "f", 1, 0, "anew\nrest")]
    df = spark.createDataFrame(parts, "n long, path string, generation long, offset long, chunk string")
    stream = landed(spark, df, tmp_path / "in", 7, "n")
    got = sorted((r["generation"], r["byte_offset"], r["raw"]) for r in run_stream(observe.tail_lines(stream), tmp_path / "out", tmp_path / "cp").collect())
    files = spark.createDataFrame([("f", whole + " line\nfourth\n")], "path string, value string")
    want = sorted((0, r["byte_offset"], r["raw"]) for r in transcripts.split_lines(files).collect())
    assert [x[2] for x in got] == [x[2] for x in want] + ["anew"] and [x[1] for x in got][1:] == [x[1] for x in want][1:] + [0]


def test_stream_of_late_rows(spark, tmp_path):
    rows = [(0, "c1", 5, "t1", "transcript"), (1, "c1", 3, "h1", "hook"), (1, "c1", 6, "h2", "hook"), (0, "c2", 1, "h3", "hook"), (2, "c2", 9, "t2", "transcript")]
    df = spark.createDataFrame(rows, "n long, call_id string, at long, event_id string, origin string").withColumns({"ts": F.timestamp_seconds(F.col("at") + 10**6), "session": F.lit("s")})
    got = {r["event_id"]: r["change_kind"] for r in run_stream(observe.change_kinds(landed(spark, df, tmp_path / "in", 3, "n")), tmp_path / "out", tmp_path / "cp").collect()}
    assert got == {"t1": "Added", "h1": "PromotePrimary", "h2": "Merged", "h3": "Added", "t2": "Merged"}
    seen = spark.createDataFrame([("s", 10_000)], "session string, at long").select("session", F.timestamp_seconds(F.col("at") + 10**6).alias("last_ts"))
    late = spark.createDataFrame([("s", 1), ("s", 9_000), ("new", 1)], "session string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 10**6))
    assert sorted((r["session"], r["at"], r["late"]) for r in observe.with_late_marked(late, "ts", seen).collect()) == [("new", 1, False), ("s", 1, True), ("s", 9000, False)]


def test_activity_windows_and_refresh(spark, tmp_path):
    df = spark.createDataFrame([(0, "s", 0), (0, "s", 60), (0, "s", 7200), (1, "s", 90_000)], "n long, session string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 10**6))
    stream = landed(spark, df, tmp_path / "in", 2, "n")
    got = run_stream(observe.activity_windows(stream), tmp_path / "out", tmp_path / "cp").collect()
    assert sorted(r["events"] for r in got) == [1, 2]
    written = []
    each = observe.refresh_touched(lambda: df, lambda d: d.groupBy("session").count(), lambda d, epoch: written.append((epoch, [tuple(r) for r in d.collect()])))
    each(df.limit(1), 3)
    assert written == [(3, [("s", 4)])]
