"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

DataFrame functions only. Spark's regular expressions give the matched strings but no offsets, so
a kind's offsets come from two views of one text: its matches, and what `split` leaves between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """pattern: as Java reads it; score: what a confirmed span is worth without context words; context: words nearby that raise it;
    sign: a plain string, or else a pattern, that every text with a match has; group: of the pattern, what is proposed."""

    name: str
    pattern: str
    score: float
    context: str
    sign: str
    base: bool = True
    group: int = 0


def _from(chars: str) -> str:
    """A match starts where a run of chars starts, or where the last match ended: no other start can be
    leftmost, and a long run isn't tried again from each of its characters."""
    return rf"(?:(?<![{chars}])|\G)"


LOCAL = "A-Za-z0-9._%+-"
#: Code points on either side of a span that are searched for context words, and what one adds.
NEARBY, RAISE = 40, 0.1
#: The longest run that an account number can be the start of; the words after it look the same.
ACCOUNT = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+"
KINDS = (
    Kind("email", rf"{_from(LOCAL)}[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write|reply", "@"),
    Kind("ip", rf"{_from('0-9')}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|addr|address|login", r"[0-9]\.[0-9]"),
    Kind("card", r"(?:(?<![0-9])(?<![0-9][ -])|\G)[0-9](?:[ -]?[0-9])++", 0.8, "card|visa|mastercard|amex|credit|debit|payment", "[0-9](?:[ -]?[0-9]){11}"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.5, "phone|tel|call|mobile|fax|whatsapp", "+"),
    Kind("iban", rf"(?<![A-Z0-9])(?=({ACCOUNT}[\s\S]{{0,{NEARBY}}}))", 0.9, "iban|account|bank|transfer|konto|compte|cuenta", "[A-Z]{2}[0-9]{2}", base=False, group=1),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    chars = F.reverse(F.split(digits, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code of letters and digits leaves 1 modulo 97."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def confirmed(kind: str, m: Column) -> Column:
    """The kind's validator for a proposed match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(code) >= 15, mod97(code)).otherwise(False)
    return F.lit(True)


def _matches(kind: Kind) -> str:
    """The column of a kind's proposed strings; no table of text names one so."""
    return f"\x00{kind.name}_matches"


def _gaps(kind: Kind) -> str:
    """The column of what is left between them."""
    return f"\x00{kind.name}_gaps"


_NONE = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,base:boolean>>"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _near(kind: Kind, g: Column) -> Column:
    """Whether a context word stands in g, as a word of letters and digits of ASCII."""
    return F.translate(g, _UPPER, _LOWER).rlike(rf"(?:^|[^a-z0-9_])(?:{kind.context})(?:[^a-z0-9_]|$)")


def _may_hold(kind: Kind, body: Column) -> Column:
    """A cheap look before the pattern is tried."""
    return body.contains(kind.sign) if len(kind.sign) == 1 else body.rlike(kind.sign)


def _span(kind: Kind, start: Column, end: Column, near: Column) -> Column:
    return F.struct(
        start.alias("start"),
        F.lit([k.name for k in KINDS].index(kind.name)).alias("rank"),
        end.alias("end"),
        F.lit(kind.name).alias("kind"),
        F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, RAISE).otherwise(0.0)).alias("score"),
        F.lit(kind.base).alias("base"),
    )


def _cuts(run: Column, after: Column) -> Column:
    """What of a run of groups can be the account number: its first groups, more of them first; the whole of a run that ends inside a word comes last, or not at all."""
    groups = F.split(run, " ")
    n = F.size(groups)
    whole = F.array(run)
    fewer = F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, 1, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(after.rlike("^[A-Z0-9]"), fewer).when(after.rlike("^[a-z_]"), F.concat(fewer, whole)).otherwise(F.concat(whole, fewer))


def _account_spans(kind: Kind) -> Column:
    """Confirmed spans from _matches (runs from every possible start, with what follows them) and _gaps (one blank
    and the text, cut at those starts): at each start the longest cut that is confirmed, if no span before reaches it.
    """
    m, gaps = F.col(_matches(kind)), F.col(_gaps(kind))
    split = F.transform(m, lambda x: F.struct(x.alias("x"), F.regexp_extract(x, f"^{ACCOUNT}", 0).alias("run")))
    cuts = F.transform(split, lambda s: F.struct(s["x"].alias("x"), _cuts(s["run"], s["x"].substr(F.length(s["run"]) + 1, F.lit(1))).alias("cuts")))
    best = F.transform(cuts, lambda s: F.struct(s["x"].alias("x"), F.length(F.get(F.filter(s["cuts"], lambda c: confirmed(kind.name, c)), 0)).alias("len")))
    item = F.transform(
        best,
        lambda s, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"),
            s["len"].alias("len"),
            (_near(kind, F.right(F.get(gaps, i), F.lit(NEARBY))) | _near(kind, s["x"].substr(s["len"] + 1, F.lit(NEARBY)))).alias("near"),
        ),
    )
    none = F.array().cast(_NONE)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        fine = x["len"].isNotNull() & (start >= acc["end"])
        end = start + x["len"]
        return F.struct(start.alias("at"), F.when(fine, end).otherwise(acc["end"]).alias("end"), F.when(fine, F.concat(acc["found"], F.array(_span(kind, start, end, x["near"])))).otherwise(acc["found"]).alias("found"))

    # the blank before the text isn't counted
    begin = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("end"), none.alias("found"))
    return F.when(F.size(m) > 0, F.aggregate(item, begin, step, lambda acc: acc["found"])).otherwise(none)


def _spans(kind: Kind) -> Column:
    """Confirmed spans from the columns _matches and _gaps."""
    if kind.group:
        return _account_spans(kind)
    m, gaps = F.col(_matches(kind)), F.col(_gaps(kind))
    item = F.transform(
        m,
        lambda x, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"),
            F.length(x).alias("len"),
            confirmed(kind.name, x).alias("ok"),
            (_near(kind, F.right(F.get(gaps, i), F.lit(NEARBY))) | _near(kind, F.left(F.get(gaps, i + 1), F.lit(NEARBY)))).alias("near"),
        ),
    )
    none = F.array().cast(_NONE)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = _span(kind, start, start + x["len"], x["near"])
        return F.struct((start + x["len"]).alias("at"), F.when(x["ok"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.when(F.size(m) > 0, F.aggregate(item, F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), step, lambda acc: acc["found"])).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more column, `pii`: array of (start, end, kind, score, base), by start, then kind.

    Offsets are code points of the whole text, the end exclusive. A null text counts as empty; rows stay
    as they are, repeated ones too; an empty table gives an empty one. One scan, no shuffle. A column
    of the table named `pii` is replaced. Work is linear in the text; in the number of one text's spans
    it is quadratic, with a small constant (each span is appended to an array).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c != "pii"]
    proposed = lambda k: F.when(_may_hold(k, body), F.regexp_extract_all(body, F.lit(k.pattern), F.lit(k.group)))
    found = docs.select(*[F.col(f"`{c}`") for c in kept], *[proposed(k).alias(_matches(k)) for k in KINDS])
    # a text without a match is not split
    found = found.withColumns({_gaps(k): F.when(F.size(_matches(k)) > 0, F.split(F.concat(F.lit(" "), body) if k.group else body, k.pattern, -1)) for k in KINDS})
    spans = F.array_sort(F.concat(*[_spans(k) for k in KINDS]))
    return found.select(*[F.col(f"`{c}`") for c in kept], F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score"), s["base"].alias("base"))).alias("pii"))


def redact(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """find_pii's rows with the text's spans of at least that score replaced by `<kind>`.

    Of overlapping spans the first wins. Null texts stay null.
    """
    spans = F.filter("pii", lambda s: s["score"] >= least)
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.col(text).substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out")),
    ).otherwise(acc)
    done = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step)
    made = docs.withColumn("__done", done)
    rest = F.col(text).substr((F.col("__done.at") + 1).cast("int"), F.length(text))
    return made.withColumn(text, F.when(F.col(text).isNotNull(), F.concat(F.col("__done.out"), rest))).drop("__done")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_pii's rows."""
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(joined(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform(F.filter("pii", lambda s: s["base"]), lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("base_scores"),
    )
