"""Turns: how rows of a session, in arrival order, fall into turns.

Arrival order is what every rule here goes by, never the effective time. Each function takes the session's key
columns and the ordering columns, and adds columns. Windows are per session; rows without a session id
must have been split by source first (see sources.envelopes.scoped_session).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.times import micros
from turnstone.operators.sequential import by_key


def _upto(by: list[str], order: list[str], last: int = 0):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def derived_turns(rows: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Adds turn_no and turn_id for surfaces without turn ids: a prompt opens `derived-n`, a stop closes it.

    The stop itself is still inside; rows outside any turn have nulls.
    """
    marked = rows.withColumns({"__open": F.coalesce(opens, F.lit(False)), "__close": F.coalesce(closes, F.lit(False))})
    edge = F.when(F.col("__open"), True).when(F.col("__close"), False)
    marked = marked.withColumns(
        {
            "__n": F.count_if("__open").over(_upto(by, order)),
            "__here": F.last(edge, ignorenulls=True).over(_upto(by, order)),
            "__before": F.last(edge, ignorenulls=True).over(_upto(by, order, -1)),
        }
    )
    inside = F.coalesce(F.when(F.col("__close"), F.col("__before")).otherwise(F.col("__here")), F.lit(False))
    out = marked.withColumn("turn_no", F.when(inside, F.col("__n")))
    return out.withColumn("turn_id", F.concat(F.lit("derived-"), F.col("turn_no").cast("string"))).drop("__open", "__close", "__n", "__here", "__before")


def transcript_turns(rows: DataFrame, by: list[str], order: list[str], opens: Column, ends: Column) -> DataFrame:
    """Adds turn_no: a user row opens a turn, an end row is its turn's last; rows without an opening get a turn, too."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.coalesce(opens, F.lit(False)) | F.coalesce(F.lag(F.coalesce(ends, F.lit(False))).over(w), F.lit(True))
    return rows.withColumn("__new", fresh).withColumn("turn_no", F.count_if("__new").over(_upto(by, order))).drop("__new")


def interaction_turns(rows: DataFrame, by: list[str], order: list[str], interaction: str, turn: str, resets: Column) -> DataFrame:
    """Adds interaction_turn: the first turn that an interaction id had since the last lifecycle row."""
    marked = rows.withColumn("__segment", F.count_if(F.coalesce(resets, F.lit(False))).over(_upto(by, order)))
    first = F.first(turn, ignorenulls=True).over(_upto([*by, "__segment", interaction], order))
    return marked.withColumn("interaction_turn", F.when(F.col(interaction).isNotNull(), first)).drop("__segment")


def carried_prompt(rows: DataFrame, by: list[str], order: list[str], prompt_id: str, opens: Column, row_id: str) -> DataFrame:
    """Adds prompt_key: the row's prompt id, else the last one before; an opening row without one has `inferred:<row id>`."""
    own = F.coalesce(F.col(prompt_id), F.when(F.coalesce(opens, F.lit(False)), F.concat(F.lit("inferred:"), F.col(row_id).cast("string"))))
    return rows.withColumn("__own", own).withColumn("prompt_key", F.coalesce("__own", F.last("__own", ignorenulls=True).over(_upto(by, order)))).drop("__own")


def resolve_turn(rows: DataFrame, by: list[str], order: list[str], ladder: list[Column]) -> DataFrame:
    """Adds turn_id: the first of a ladder of turn columns that has one, else the last resolved in the session."""
    return rows.withColumn("__t", F.coalesce(*ladder)).withColumn("turn_id", F.coalesce("__t", F.last("__t", ignorenulls=True).over(_upto(by, order)))).drop("__t")


def ladder_turns(rows: DataFrame, by: list[str], order: list[str], row_id: str, kind: str, agent: str, call: str, interaction: str, native: str) -> DataFrame:
    """(by, row_id, resolved, turn_id): the turn that each row resolves to as it comes, and the turn that this one ends up in after merges.

    kind: user, start, end, request, result, agent, message or merge. A row's turn is its agent's, else its call's, else its
    interaction's, else the active one, else the last user's, else its own by id, else a new one; users' rows go by interaction
    and id only. results, agents and messages make no turn of their own; without any they have nulls. A merge joins the turn it resolves to
    to the one that it names: whatever pointed there points to the other one from now on, and so do its rows.

    Sequential inside a session, in arrival order; what is held are the ids in use. Final turns come from a second pass,
    backwards over the merges, so chains of any length need no iteration.
    """
    plain = [row_id, kind, agent, call, interaction, native]
    seen = rows.withColumn("__seq", F.struct(*order)).withColumns({c: F.col(c).cast("string") for c in plain[1:]})

    def resolve():
        names: list[str] = []  # of turns by number; one that was merged and is named again has a new number
        into: list[int] = []
        turns: dict[str, int] = {}
        agents, calls, talks, active, last_user = {}, {}, {}, {}, {}
        number = itertools.count()

        def root(t: int | None) -> int | None:
            while t is not None and into[t] != t:
                into[t] = into[into[t]]
                t = into[t]
            return t

        def make(name: str) -> int:
            if name not in turns:
                turns[name] = len(names)
                into.append(len(names))
                names.append(name)
            return turns[name]

        def of_user(i, talk, own) -> int:
            if talk is not None:
                return root(talks[talk]) if talk in talks else talks.setdefault(talk, make(f"interaction:{talk}"))
            return make(own if own is not None and own not in turns else f"user:{i}")

        def of_other(k, who, c, talk, own) -> int | None:
            may_make = k in ("start", "end", "request")
            for known, key in ((agents, who), (calls, c), (talks, talk)):
                if key is not None and key in known:
                    return root(known[key])
            if talk is not None and may_make:
                return talks.setdefault(talk, make(f"interaction:{talk}"))
            here = root(active.get(who, last_user.get(who)))
            if talk is not None and here is not None:
                talks[talk] = here
            if here is not None or talk is not None:
                return here
            if own is not None and (may_make or own in turns):
                return make(own)
            return make(f"{k}:{len(names)}") if may_make else None

        def step(i, k, who, c, talk, own):
            t = of_user(i, talk, own) if k == "user" else of_other(k, who, c, talk, own)
            seq = next(number)
            if t is None:
                return [(i, seq, None, None, None, None)]
            if k == "user":
                last_user[who] = t
            elif k == "start":
                active[who] = t
            elif k == "end" and root(active.get(who)) == t:
                del active[who]
            elif k in ("request", "result") and c is not None:
                calls[c] = t
            elif k == "agent" and who is not None:
                agents[who] = t
            to = None
            if k == "merge" and own is not None and names[t] != own:
                to = make(own)
                into[t] = to
                del turns[names[t]]
            return [(i, seq, names[t], t, to, None if to is None else names[to])]

        return step

    kinds = dict(rows.dtypes)
    first = by_key(seen, by, ["__seq"], plain, resolve, f"`{row_id}` {kinds[row_id]}, seq int, resolved string, turn int, into int, target string")

    def settle():
        final: dict[int, str] = {}

        def step(i, name, t, to, target):
            if to is not None:
                final[t] = final.get(to, target)
            return [(i, name, final.get(t, name))]

        return step

    return by_key(first, by, [F.desc("seq")], [row_id, "resolved", "turn", "into", "target"], settle, f"`{row_id}` {kinds[row_id]}, resolved string, turn_id string", placed=True)


def number_turns(turns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return turns.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def turn_bounds(rows: DataFrame, by: list[str], start: str, end: str | None = None) -> DataFrame:
    """started, ended and wall_ms of each turn; rows without a clock are ignored."""
    last = F.max(F.coalesce(end, start)) if end else F.max(start)
    got = rows.groupBy(*by).agg(F.min(start).alias("started"), last.alias("ended"))
    return got.withColumn("wall_ms", (micros("ended") - micros("started")) / 1000.0)


def session_status(rows: DataFrame, by: list[str], order: list[str], role: str, skip: Column | None = None) -> DataFrame:
    """status of each session by its last row in arrival order: Ended, Stopped or Active."""
    seen = rows if skip is None else rows.where(~skip)
    last = seen.groupBy(*by).agg(F.max_by(role, F.struct(*order)).alias("last_role"))
    return last.withColumn("status", F.when(F.col("last_role") == "SessionEnd", "Ended").when(F.col("last_role").isin("TurnStop", "RuntimeError"), "Stopped").otherwise("Active"))


def prompt_revisions(rows: DataFrame, by: list[str], order: list[str], body_hash: str) -> DataFrame:
    """Adjacent equal bodies as one revision: by..., revision (from 1), body hash, occurrences, first order."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = ~F.col(body_hash).eqNullSafe(F.lag(body_hash).over(w)) | (F.row_number().over(w) == 1)
    numbered = rows.withColumn("__new", changed).withColumn("revision", F.count_if("__new").over(_upto(by, order)))
    return numbered.groupBy(*by, "revision").agg(F.first(body_hash).alias(body_hash), F.count(F.lit(1)).alias("occurrences"), *[F.min(c).alias(f"first_{c}") for c in order[:1]])


def place_system_prompts(prompts: DataFrame, turns: DataFrame, by: list[str], turn_id: str, ts: str, turn_start: str) -> DataFrame:
    """prompts with `before_turn`: the turn that they stand just before: their own by id, else the latest that began by their time."""
    known = turns.select(*by, F.col(turn_id).alias("__id"), F.lit(True).alias("__known"))
    own = prompts.join(known, [*[prompts[c] == known[c] for c in by], prompts[turn_id] == known["__id"]], "left").select(*[prompts[c] for c in prompts.columns], "__known")
    marks = own.select(*by, F.col(ts).alias("__at"), F.lit(1).alias("__kind"), F.struct(*prompts.columns, "__known").alias("__row"), F.lit(None).cast(dict(turns.dtypes)[turn_id]).alias("__turn"))
    begun = turns.select(*by, F.col(turn_start).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(marks.schema["__row"].dataType).alias("__row"), F.col(turn_id).alias("__turn"))
    w = Window.partitionBy(*by).orderBy("__at", "__kind", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    asof = marks.unionByName(begun).withColumn("__last", F.last("__turn", ignorenulls=True).over(w)).where("__kind = 1")
    return asof.select("__row.*", "__last").withColumn("before_turn", F.when(F.coalesce("__known", F.lit(False)), F.col(turn_id)).otherwise(F.col("__last"))).drop("__known", "__last")


def display_order(rows: DataFrame, by: list[str], ts: str, ordinal: str, row_id: str, starts: Column, ends: Column) -> DataFrame:
    """Adds position (from 1) in a session's chronological order: starts first, ends last, else by effective time, ordinal and id. A late row takes the place of its time."""
    edge = F.when(starts, 0).when(ends, 2).otherwise(1)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(edge, ts, ordinal, row_id)).cast("long"))
