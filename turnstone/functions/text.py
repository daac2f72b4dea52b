"""Text rules of prompts, thoughts, previews, system prompts and plan bodies, as Column expressions."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the rules mean it: Unicode's, in a form that Java's regular expressions read.
SPACE = r"[\s\x{85}\p{Z}]"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null when nothing is left."""
    flat = F.trim(F.regexp_replace(text, SPACE + "+", " "))
    return F.when(flat != "", flat)


def drop_redaction(text: Column) -> Column:
    """Without trailing `[REDACTED]` marks that stand alone or after white space."""
    return F.regexp_replace(text, rf"(?:(?:^|{SPACE}+)\[REDACTED\])*{SPACE}*\z", "")


def normal_text(text: Column) -> Column:
    """What texts are compared by: no trailing redaction, white space collapsed; null when empty."""
    return collapse(drop_redaction(text))


def unwrap_prompt(text: Column) -> Column:
    """The first `<user_query>` span, to its end or the text's; the text itself without one."""
    inside = F.regexp_extract(text, r"(?s)<user_query>(.*?)(?:</user_query>|\z)", 1)
    return F.when(text.contains("<user_query>"), inside).otherwise(text)


def unwrap_all(text: Column) -> Column:
    """All closed `<user_query>` spans, trimmed, a blank line between them; the text itself without one."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<user_query>(.*?)</user_query>"), F.lit(1)), lambda s: F.regexp_replace(s, rf"\A{SPACE}+|{SPACE}+\z", ""))
    return F.when(F.size(spans) > 0, F.array_join(spans, "\n\n")).otherwise(text)


def preview(text: Column, most: int) -> Column:
    """White space collapsed and cut to `most` characters, an ellipsis behind only if real text was cut; "" for null."""
    flat = F.coalesce(collapse(text), F.lit(""))
    cut = F.substring(flat, 1, most)
    return F.when(F.length(flat) > most, F.concat(cut, F.lit("…"))).otherwise(flat)


def distinct_by_case(words: Column) -> Column:
    """The first of each value that differs from the others by more than case, in order."""
    return F.filter(words, lambda w, i: F.array_position(F.transform(words, lambda x: F.lower(x)), F.lower(w)) == i + 1)


def slash_commands(prompt: Column) -> Column:
    """`/name` tokens of a prompt that stand at its start or after white space, first of each by case, in order."""
    found = F.regexp_extract_all(unwrap_prompt(prompt), F.lit(r"""(?<![^\s\x{85}\p{Z}])/[\p{L}\p{Nd}][\p{L}\p{Nd}_-]*+(?=\z|[\s\x{85}\p{Z}.,;!?)\]}"'])"""), F.lit(0))
    return F.coalesce(distinct_by_case(found), F.array().cast("array<string>"))


def skill_mentions(text: Column) -> Column:
    """Names of two parts or more that stand before the word skill or skills, lower-cased, first of each, in order.

    A name is of ASCII letters and digits joined by hyphens, and nothing of a word or hyphen stands before it; marks of
    emphasis may follow it before the blanks.
    """
    part, emphasis = "[a-z0-9]++", "[*_`]*+"
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{Nd}}_-])({part}(?:-{part})++){emphasis}\s++skills?+\b"), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def skill_of_path(path: Column) -> Column:
    """The parent folder of a path that ends in SKILL.md."""
    name = F.regexp_extract(path, r"(?i)([^/\\]+)[/\\][^/\\]*SKILL\.md\z", 1)
    return F.when(collapse(name).isNotNull(), name)


#: A patch's lines that name a file, as Java and Python read them.
PATCH_HEADER = r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File|Move to): *(.+?)[ \r]*$"


def patch_paths(patch: Column) -> Column:
    """Paths in the headers of a patch, first of each."""
    found = F.regexp_extract_all(patch, F.lit(PATCH_HEADER), F.lit(1))
    return F.coalesce(distinct_by_case(found), F.array().cast("array<string>"))


#: A stop's status by the words that providers use.
STOP_STATUS = {"completed": ("success", "completed", "complete", "end_turn"), "aborted": ("error", "failed", "failure", "aborted")}


def stop_status(status: Column) -> Column:
    flat = F.lower(normal_text(status))
    out = flat
    for name, words in STOP_STATUS.items():
        out = F.when(flat.isin(*words), name).otherwise(out)
    return out


def turn_of_generation(generation: Column) -> Column:
    """A step's generation id (turn id, step, four characters) as its turn's; other ids as they are."""
    turn = F.regexp_extract(generation, r"^([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})-[0-9]+-[A-Za-z0-9]{4}$", 1)
    return F.when(turn != "", turn).otherwise(generation)


def lines_only(text: Column) -> Column:
    """Line feeds for all line ends."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def system_prompt(parts: Column) -> Column:
    """An array of parts as one text: line ends normalised, blank lines around parts dropped, blank parts left out."""
    clean = F.transform(parts, lambda p: F.regexp_replace(lines_only(p), r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", ""))
    kept = F.filter(clean, lambda p: p.isNotNull() & p.rlike(r"\S"))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n"))


@functools.cache
def uncomposed() -> str:
    """A pattern of the characters that may change when a text is composed: those that aren't composed, combine with others, or are put in order. None is below U+0300."""
    seconds = {int(d.split()[1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    jamo = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    found = [c for c in range(0x300, 0x110000) if not 0xD800 <= c < 0xE000 and (c in seconds or c in jamo or unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)))]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return r"[\x{300}-\x{10FFFF}&&[" + "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in runs) + "]]"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def plan_body(text: Column, compose: bool = True) -> Column:
    """A plan's comparable body: no byte-order mark, line feeds only, no newlines around, NFC; null when empty.

    Composition needs Python, which only texts see that have a sign to compose; compose=False leaves it out, for text known to be composed.
    """
    body = F.regexp_replace(lines_only(F.regexp_replace(text, "\\A\ufeff", "")), r"\A\n+|\n+\z", "")
    if compose:
        body = F.coalesce(_composed(F.when(body.rlike(uncomposed()), body)), body)
    return F.when(body != "", body)


def compact(text: Column, most: int) -> Column:
    """A text above `most` characters cut there, its whole length told behind; others as they are."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.format_string("… [%d characters]", F.length(text)))).otherwise(text)


#: Characters that an event's text, a system prompt and a value of a session's metadata may have, and what is put behind a text that is cut.
EVENT_CHARS, PROMPT_CHARS, VALUE_CHARS = 32 * 1024, 64 * 1024, 8 * 1024
CUT = "\n… [truncated; open Raw source for the complete record]"


def limited(text: Column, most: int) -> Column:
    """A text of at most `most` characters, CUT among them where it was longer. Of a long text only the bytes that these characters may have are looked at."""
    head = F.substring(text.cast("binary"), 1, 4 * most).cast("string")
    return F.when((F.octet_length(text) > 4 * most) | ((F.octet_length(text) > most) & (F.length(text) > most)), F.concat(F.substring(head, 1, most - len(CUT)), F.lit(CUT))).otherwise(text)


def compacted(rows: DataFrame, texts: list[str], prompt: str | None = None, metadata: str | None = None) -> DataFrame:
    """rows whose long fields are cut: texts, a system prompt (its whole length told in `original_chars`, null where it stays), and the values of a map."""
    changed = {t: limited(F.col(t), EVENT_CHARS) for t in texts}
    if prompt is not None:
        changed |= {"original_chars": F.when(F.length(prompt) > PROMPT_CHARS, F.length(prompt)), prompt: limited(F.col(prompt), PROMPT_CHARS)}
    if metadata is not None:
        changed[metadata] = F.transform_values(metadata, lambda k, v: limited(v, VALUE_CHARS))
    return rows.withColumns(changed)
