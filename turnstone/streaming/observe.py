"""The same rules over streams: idempotent rows, tailed files, keyed session state, late rows, refresh of touched sessions.

Stateful parts take event time with a watermark. Their timers are event-time timers: they fire when the watermark passes,
and ask for no batches without data, so a run with trigger(availableNow=True) ends.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"


def idempotent(rows: DataFrame, ts: str = "ts", key: str = "dedupe_key", delay: str = WATERMARK) -> DataFrame:
    """Each row once, however often it is delivered within the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _rows(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """A group's rows as (microseconds, values of columns...). Groups are many and small, so no table is made of each."""
    out = []
    for b in batches:
        out += zip(b["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), *[b[c].tolist() for c in columns], strict=True)
    return out


def _by_time(row: tuple) -> tuple:
    """Rows go by time, then by the id that stands behind it."""
    return row[0], row[1] is None, row[1] or ""


def _frame(out: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(columns, zip(*out, strict=True), strict=True)) if out else {c: [] for c in columns})


def _keep_live(live: dict, idle: int, state: GroupState) -> None:
    """Stores what a session has live (key to values, the last one the time of its last row) and sets the timer of the first that is due; without any, forgets it."""
    now = state.getCurrentWatermarkMs()
    kept = [[k, *v] for k, v in live.items() if v[-1] + idle > now]
    if kept:
        state.update((json.dumps(kept),))
        state.setTimeoutTimestamp(max(min(x[-1] for x in kept) + idle, now + 1))
    elif state.exists:
        state.remove()


def _live(state: GroupState) -> dict:
    return {k: v for k, *v in json.loads(state.get[0])} if state.exists else {}


LINES = "path string, generation long, byte_offset long, raw string"


def tail_lines(segments: DataFrame) -> DataFrame:
    """Whole lines (path, generation, byte_offset, raw) of a stream of landed segments (path, generation, offset, chunk).

    A segment is what was appended to a file since the last one, `offset` bytes into it. The part behind the last line feed is
    held back until a later segment ends it; a segment told again gives nothing new; a file that was truncated comes as a
    new generation and starts anew. Blank lines are left out, a byte-order mark and CR are dropped. State is a line's beginning per file.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, at, rest = state.get if state.exists else (-1, 0, b"")
        rows = pd.concat(list(batches)).sort_values(["generation", "offset"])
        out = []
        for g, offset, chunk in zip(rows["generation"], rows["offset"], rows["chunk"], strict=True):
            if g > generation:
                generation, at, rest = int(g), int(offset), b""
            raw = chunk.encode()
            known = at + len(rest) - int(offset)
            if g < generation or known < 0 or known >= len(raw):
                continue  # an old generation, a gap, or nothing new
            *whole, last = (rest + raw[known:]).split(b"\n")
            for line in whole:
                text = line.decode().removeprefix("\ufeff" if at == 0 else "").removesuffix("\r")
                if text.strip():
                    out.append((key[0], generation, at, text))
                at += len(line) + 1
            rest = last
        state.update((generation, at, rest))
        yield pd.DataFrame(out, columns=["path", "generation", "byte_offset", "raw"])

    return segments.groupBy("path").applyInPandasWithState(step, LINES, "generation long, at long, rest binary", "append", GroupStateTimeout.NoTimeout)


STEPS = "session string, event_id string, role string, tool string, turn_id string, request_id string, server string"
_CLOSING = ("TurnStop", "SessionEnd")


def session_steps(rows: DataFrame, ts: str = "ts", delay: str = WATERMARK, drain: str = "5 seconds", timeout: str = "2 hours", open_for: str | None = "1 day") -> DataFrame:
    """What a session's state tells about each event of a stream of (session, ts, event_id, role, tool, server).

    turn_id: derived-n after the n-th prompt; request_id: for a result, the earliest open request of its tool; server: the one last
    told for the tool. A turn's stop forgets the open requests; a session's end forgets all, and numbers turns from one again.

    Rows of a micro-batch go by time, those that close something behind others of the same time. The end of a session is
    drained: rows of its time that come later still find its state, until the watermark is `drain` past it. Rows older than the
    watermark are dropped, as everywhere. A session without rows for `timeout` is forgotten, and so is a request that is open for
    longer than `open_for` (None: never), which bounds the state of a session that never stops.
    """
    wait, idle = (int(pd.Timedelta(t).total_seconds() * 1000) for t in (drain, timeout))
    oldest = None if open_for is None else int(pd.Timedelta(open_for).total_seconds() * 1000)
    columns = [c.split()[0] for c in STEPS.split(", ")]
    fresh = lambda: {"turn": 0, "in_turn": False, "open": [], "servers": {}, "end": None, "last": 0}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = json.loads(state.get[0]) if state.exists else fresh()
        new = sorted(_rows(batches, "event_id", "role", "tool", "server"), key=lambda r: (r[0] // 1000, r[2] in _CLOSING, r[1] is None, r[1] or ""))
        out = []
        for us, event_id, role, tool, server in new:
            ms = us // 1000
            if s["end"] is not None and ms > s["end"]:
                s = fresh()
            s["last"] = max(s["last"], ms)
            if oldest is not None:
                # requests stand in the order they came in
                while s["open"] and s["open"][0][2] < ms - oldest:
                    s["open"].pop(0)
            request = None
            if role == "PromptSubmitted":
                s["turn"], s["in_turn"] = s["turn"] + 1, True
            if server is not None and tool is not None:
                s["servers"][tool] = server
            if role == "ToolRequest":
                s["open"].append([event_id, tool, ms])
            elif role in ("ToolSuccess", "ToolFailure"):
                at = next((i for i, (_, t, _) in enumerate(s["open"]) if t == tool), None)
                request = s["open"].pop(at)[0] if at is not None else None
            turn = f"derived-{s['turn']}" if s["in_turn"] else None
            out.append((key[0], event_id, role, tool, turn, request, s["servers"].get(tool)))
            if role in _CLOSING:
                s["in_turn"] = False
                if role == "TurnStop":
                    s["open"] = []
                else:
                    s["end"] = ms
        state.update((json.dumps(s),))
        due = s["end"] + wait if s["end"] is not None else s["last"] + idle
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield _frame(out, columns)

    timed = rows.withWatermark(ts, delay).select("session", F.col(ts).alias("ts"), F.col("event_id").cast("string").alias("event_id"), "role", "tool", "server")
    return timed.groupBy("session").applyInPandasWithState(step, STEPS, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def pair_requests(rows: DataFrame, ts: str = "ts", delay: str = WATERMARK, timeout: str = "2 hours", open_for: str | None = "1 day") -> DataFrame:
    """(session, request_id, result_id, tool, outcome) of a stream of (session, ts, event_id, role, tool): session_steps' pairs."""
    steps = session_steps(rows.withColumn("server", F.lit(None).cast("string")), ts, delay, timeout=timeout, open_for=open_for)
    return steps.where("request_id IS NOT NULL").select("session", "request_id", F.col("event_id").alias("result_id"), "tool", F.col("role").alias("outcome"))


def change_kinds(rows: DataFrame, ts: str = "ts", delay: str = WATERMARK, timeout: str = "2 hours") -> DataFrame:
    """(session, call_id, event_id, change_kind) of a stream of (session, call_id, ts, event_id, origin: hook or transcript).

    The first row of a call is Added. A hook that comes behind its transcript row takes the primary place, which a
    PromotePrimary row tells whoever keeps the earlier one; any other later row is Merged. A call is forgotten when the watermark
    is `timeout` past its last row. State are a session's live calls: there are many more calls than sessions, and each group has its price.
    """
    idle = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls = _live(state)
        if state.hasTimedOut:
            _keep_live(calls, idle, state)
            return
        out = []
        for us, event_id, call, origin in sorted(_rows(batches, "event_id", "call_id", "origin"), key=_by_time):
            primary, last = calls.get(call, (None, 0))
            kind = "Added" if primary is None else "PromotePrimary" if (primary, origin) == ("transcript", "hook") else "Merged"
            calls[call] = origin if kind != "Merged" else primary, max(last, us // 1000)
            out.append((key[0], call, event_id, kind))
        _keep_live(calls, idle, state)
        yield _frame(out, ["session", "call_id", "event_id", "change_kind"])

    timed = rows.withWatermark(ts, delay).select("session", "call_id", F.col(ts).alias("ts"), F.col("event_id").cast("string").alias("event_id"), "origin")
    return timed.groupBy("session").applyInPandasWithState(step, "session string, call_id string, event_id string, change_kind string", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def stand_in_changes(rows: DataFrame, ts: str = "ts", delay: str = WATERMARK, timeout: str = "2 hours") -> DataFrame:
    """(session, signature, event_id, change, partner) of a stream of (session, signature, ts, event_id, origin: hook or transcript).

    What operators.pairing.stand_ins tells of a whole table: an Added transcript row is a stand-in until a PromotePrimary row names it.
    State are, by a session's signatures, the ids of the rows that wait, of one side at a time; without rows for `timeout` they wait no longer.
    """
    idle = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = {k: (side, deque(waiting), last) for k, (side, waiting, last) in _live(state).items()}
        out = []
        for us, event_id, signature, origin in () if state.hasTimedOut else sorted(_rows(batches, "event_id", "signature", "origin"), key=_by_time):
            side, waiting, last = live.get(signature) or ("hook", deque(), 0)
            partner = None
            if waiting and side != origin:
                partner = waiting.popleft()
            else:
                side = origin
                waiting.append(event_id)
            live[signature] = side, waiting, max(last, us // 1000)
            out.append((key[0], signature, event_id, "Add" if partner is None else "PromotePrimary" if origin == "hook" else "AttachEvidence", partner))
        timed_out = state.hasTimedOut
        _keep_live({k: (side, list(waiting), last) for k, (side, waiting, last) in live.items()}, idle, state)
        if not timed_out:
            yield _frame(out, ["session", "signature", "event_id", "change", "partner"])

    timed = rows.withWatermark(ts, delay).select("session", "signature", F.col(ts).alias("ts"), F.col("event_id").cast("string").alias("event_id"), "origin")
    return timed.groupBy("session").applyInPandasWithState(step, "session string, signature string, event_id string, change string, partner string", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def activity_windows(rows: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = WATERMARK) -> DataFrame:
    """Spans of activity of each session, ended by a gap."""
    got = rows.withWatermark(ts, delay).groupBy("session", F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))
    return got.select("session", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def refresh_touched(read: Callable[[], DataFrame], summarise: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], key: str = "session") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: summarises the sessions that a micro-batch touched anew, from all of their stored rows."""

    def each(batch: DataFrame, epoch: int) -> None:
        touched = batch.select(key).distinct()
        write(summarise(read().join(touched, key, "left_semi")), epoch)

    return each


def with_late_marked(rows: DataFrame, ts: str, seen: DataFrame, key: str = "session", delay: str = WATERMARK) -> DataFrame:
    """For foreachBatch: rows with `late`, whether they are older than their session's last seen time (key, last_ts) less `delay`.

    A stream's stateful parts drop such rows; a batch that stores them first finds here which sessions to compute anew.
    """
    return rows.join(seen.select(key, "last_ts"), key, "left").withColumn("late", F.coalesce(F.col(ts) < F.col("last_ts") - F.expr(f"INTERVAL {delay}"), F.lit(False))).drop("last_ts")
