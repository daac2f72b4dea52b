"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as turns `<|im_start|>role NL text <|im_end|> NL`. The deterministic
parser below reads the rendered text back; when the turns it recovers differ from the source (a text
or role holds a control string), the conversation is rendered again one escape level higher and
parsed again. Level 1 always survives: it leaves no `<|` in any text, and no line feed in any role. Its rendered
text says so itself: it begins with the line `<|escaped|>`, which no plain one can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NL = "<|im_start|>", "<|im_end|>", "\n"
#: The first line of an escaped conversation.
MARK = "<|escaped|>" + NL


def escape_text(text: Column) -> Column:
    """`\\` becomes `\\\\`, then `<|` becomes `<\\|`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As for texts; besides, a line feed becomes `\\N`."""
    return F.replace(escape_text(role), F.lit(NL), F.lit("\\N"))


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(role: Column) -> Column:
    """`\\N` after an even number of backslashes is a line feed."""
    return unescape_text(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\N", "$1\n"))


def render(turns: Column) -> Column:
    """The text of an array of (role, text) structs."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(NL), t["text"], F.lit(END + NL))), "")


def is_escaped(rendered: Column) -> Column:
    return rendered.startswith(MARK)


def parse(rendered: Column) -> Column:
    """The (role, text) structs of a rendered text, unescaped where its first line asks for it; null where it isn't of the grammar."""
    escaped = is_escaped(rendered)
    turns = _turns(F.when(escaped, rendered.substr(F.lit(len(MARK) + 1), F.length(rendered))).otherwise(rendered))
    plain = F.transform(turns, lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape_text(t["text"]).alias("text")))
    return F.when(escaped, plain).otherwise(turns)


def _turns(rendered: Column) -> Column:
    """The (role, text) structs as they stand; null where the text isn't of the grammar."""
    pieces = F.split(F.concat(F.lit(NL), rendered), r"<\|im_end\|>", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    lead = NL + START
    fine = (F.element_at(pieces, -1) == NL) & F.forall(turns, lambda p: p.startswith(lead) & p.substr(F.lit(len(lead) + 1), F.length(p)).contains(NL) & ~p.substr(F.lit(len(lead) + 1), F.length(p)).contains(START))

    def turn(p: Column) -> Column:
        rest = p.substr(F.lit(len(lead) + 1), F.length(p))
        at = F.locate(NL, rest)
        return F.struct(rest.substr(F.lit(1), at - 1).alias("role"), rest.substr(at + 1, F.length(rest)).alias("text"))

    return F.when(fine, F.transform(turns, turn))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per conversation, ready to train on.

    Output: conv_id, formatted, escape_level (0 or 1), round_trip (true: reading it fails on a conversation that doesn't
    come back), loss_spans: (start, end) code points of each assistant text within `formatted`.

    Null texts and roles count as empty; a null conv_id is a conversation of its own; null turns come
    first; equal turns go by role, then text, and repeated rows stay. An empty table gives no rows.
    Other columns are ignored. A conversation is one row, so its text has to fit a row.
    """
    r = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"role1": escape_role(F.col("role")), "text1": escape_text(F.col("text"))})
    frame = len(START) + len(NL) + len(END) + len(NL)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    for k, (role, text) in enumerate((("role", "text"), ("role1", "text1"))):
        before = F.coalesce(F.sum(F.length(role) + F.length(text) + frame).over(order), F.lit(0)) + k * len(MARK)
        start = before + len(START) + F.length(role) + len(NL)
        r = r.withColumn(f"span{k}", F.struct(start.alias("start"), (start + F.length(text)).alias("end")))
    turns = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "role1", "text1", "span0", "span1"))).alias("t"))
    both = turns.select(
        "conv_id",
        "t",
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        render(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("plain"),
    ).withColumn("fine", F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    escaped = F.concat(F.lit(MARK), render(F.transform("t", lambda t: F.struct(t["role1"].alias("role"), t["text1"].alias("text")))))
    out = both.select(
        "conv_id",
        "source",
        F.when(F.col("fine"), F.col("plain")).otherwise(escaped).alias("formatted"),
        F.when(F.col("fine"), 0).otherwise(1).alias("escape_level"),
        F.transform(F.filter("t", lambda t: t["role"] == "assistant"), lambda t: F.when(F.col("fine"), t["span0"]).otherwise(t["span1"])).alias("loss_spans"),
    )
    back = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    sure = F.when(back, True).otherwise(F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean"))
    return out.select("conv_id", "formatted", "escape_level", sure.alias("round_trip"), "loss_spans")


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the mask, unescaped: what the spans cut out of the formatted text."""
    text = F.col(formatted)
    cut = F.transform(spans, lambda s: text.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.when(is_escaped(text), F.transform(cut, unescape_text)).otherwise(cut), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what reads back from format_conversations' rows: turns by the parser, loss by the mask."""
    read = formatted.withColumns({"turns": parse(F.col("formatted")), "loss": loss_text()})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(NL), t["text"], F.lit(NL))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
