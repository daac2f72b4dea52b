"""The YAML that session files and plans are written in, for documents that column expressions can't read.

Maps and lists in blocks or in flow, scalars plain (over several lines, too), quoted, literal (`|`) or folded (`>`) with their chomping and
indentation signs, comments, document marks. Scalars stay texts; `~`, `null` and nothing are None. Anchors, tags and
several documents are not read: such a document is None, as one that isn't YAML.
"""

from __future__ import annotations

import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},"'&*!|>%@`-][^#:]*?(?:(?::(?!\s|$)|(?<!\s)#)[^#:]*?)*|-[^\s:][^:]*?)\s*:(?:\s+|$)""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "/": "/", "\\": "\\", '"': '"', " ": " ", "N": "\x85", "_": "\xa0"}


class Odd(ValueError):
    """Not YAML, or none that is read here."""


def parse(text: str | None):
    """The document's maps, lists and texts; None where it can't be read."""
    if text is None:
        return None
    try:
        return _Reader(text).document()
    except (Odd, RecursionError):
        return None


def _unquoted(s: str) -> str:
    if s[0] == "'":
        return s[1:-1].replace("''", "'")

    def one(m: re.Match) -> str:
        code = m[1]
        if code[0] in "xuU":
            return chr(int(code[1:], 16))
        if code not in _ESCAPES:
            raise Odd(code)
        return _ESCAPES[code]

    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s[1:-1], flags=re.S)


def _plain(s: str):
    s = s.strip()
    if s[:1] in ("&", "*", "!", "%", "@", "`"):
        raise Odd(s)
    return None if s in ("", "~", "null", "Null", "NULL") else s


def _uncommented(s: str) -> str:
    """A line's rest without its comment."""
    return re.split(r"(?:^|\s)#", s, maxsplit=1)[0].rstrip()


class _Reader:
    def __init__(self, text: str):
        self.lines = re.split(r"\r\n|\r|\n", text.removeprefix("\ufeff"))
        self.n = 0

    def skip(self) -> int | None:
        """To the next line that says something; its indentation."""
        while self.n < len(self.lines):
            line = self.lines[self.n]
            bare = line.strip()
            if bare and not bare.startswith("#"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise Odd("tab")
                return len(line) - len(line.lstrip(" "))
            self.n += 1
        return None

    def document(self):
        at = self.skip()
        while at == 0 and self.lines[self.n].rstrip() == "---":
            self.n += 1
            at = self.skip()
        if at is None:
            return None
        out = self.block(at)
        at = self.skip()
        if at is not None and self.lines[self.n].rstrip() not in ("---", "..."):
            raise Odd(self.lines[self.n])
        return out

    def block(self, at: int):
        line = self.lines[self.n][at:]
        if line == "-" or line.startswith("- "):
            return self.items(at)
        if _KEY.match(line):
            return self.map(at)
        self.n += 1
        return self.scalar(line, at - 1)

    def items(self, at: int) -> list:
        out = []
        while self.skip() == at and (self.lines[self.n][at:] == "-" or self.lines[self.n].startswith("- ", at)):
            rest = self.lines[self.n][at + 1 :]
            inner = at + 1 + len(rest) - len(rest.lstrip(" "))
            if _uncommented(rest).strip() and (_KEY.match(rest.strip()) or rest.strip() == "-" or rest.strip().startswith("- ")):
                self.lines[self.n] = " " * inner + rest.strip()  # what stands behind the dash is a block by itself
                out.append(self.block(inner))
            else:
                out.append(self.value(rest, at))
        return out

    def map(self, at: int) -> dict:
        out = {}
        while self.skip() == at and (m := _KEY.match(self.lines[self.n], at)):
            name = _unquoted(m[1]) if m[1][0] in "\"'" else m[1].strip()
            value = self.value(self.lines[self.n][m.end() :], at)
            if name in out:
                raise Odd(f"{name} twice")
            out[name] = value
        if (left := self.skip()) is not None and left > at:
            raise Odd(self.lines[self.n])
        return out

    def value(self, rest: str, at: int):
        """What stands behind a key or a dash at column `at`, on its line or below it."""
        self.n += 1
        bare = rest.strip()
        if re.match(r"[|>][0-9+-]{0,2}\s*(?:#.*)?$", bare):
            return self.text(bare, at)
        if not _uncommented(rest).strip():
            inner = self.skip()
            if inner is not None and (inner > at or (inner == at and self.lines[self.n].startswith(("- ", "-"), at) and self.lines[self.n][at + 1 : at + 2] in ("", " "))):
                return self.block(inner) if not self.lines[self.n].startswith("---") else None
            return None
        return self.scalar(bare, at)

    def text(self, sign: str, at: int) -> str:
        """A literal or folded text."""
        told = re.search(r"[1-9]", sign)
        rows, depth = [], at + int(told[0]) if told and at >= 0 else None
        while self.n < len(self.lines):
            line = self.lines[self.n]
            if line.strip():
                own = len(line) - len(line.lstrip(" "))
                depth = own if depth is None else depth
                if own <= at or own < depth:
                    break
            rows.append(line[depth:] if depth is not None and len(line) > depth else "")
            self.n += 1
        body = self.folded(rows) if sign[0] == ">" else "\n".join(rows)
        kept = body.rstrip("\n")
        if "+" in sign:
            return body + "\n" if rows else ""
        return kept if "-" in sign or not kept else kept + "\n"

    @staticmethod
    def folded(rows: list[str]) -> str:
        """One line feed between lines of text is a blank; more of them are one fewer; lines that are indented keep theirs."""
        out, blank, before = "", 0, None
        for row in rows:
            if not row:
                blank += 1
                continue
            if before is None:
                out += "\n" * blank
            elif before[0] in " \t" or row[0] in " \t":
                out += "\n" * (blank + 1)
            else:
                out += "\n" * blank if blank else " "
            out, blank, before = out + row, 0, row
        return out + "\n" * blank

    def scalar(self, first: str, at: int):
        """A value in flow, quoted or plain, that may go on in lines below that are further in than `at`."""
        if first[0] in "[{\"'":
            text = first if any(q in first for q in "\"'") else _uncommented(first)
            while True:
                try:
                    value, end = _flow(text, 0)
                    break
                except IndexError:
                    if self.n >= len(self.lines):
                        raise Odd(first) from None
                    line = self.lines[self.n] if any(q in text + self.lines[self.n] for q in "\"'") else _uncommented(self.lines[self.n])
                    text += ("\n" if not self.lines[self.n].strip() else " ") + line.strip()
                    self.n += 1
            if _uncommented(text[end:]).strip():
                raise Odd(text)
            return value
        rows, blank = [_uncommented(first)], 0
        while self.n < len(self.lines) and rows[-1] == rows[-1].split(" #")[0]:
            line = self.lines[self.n]
            if not line.strip():
                blank += 1
            elif len(line) - len(line.lstrip(" ")) <= at or line.strip().startswith("#"):
                break
            elif _KEY.match(line.strip()):
                raise Odd(line)
            else:
                rows.append("\n" * blank + _uncommented(line).strip() if blank else _uncommented(line).strip())
                blank = 0
            self.n += 1
        out = rows[0]
        for row in rows[1:]:
            out += row if row.startswith("\n") else " " + row
        if re.search(r":\s", out) or out.endswith(":"):
            raise Odd(out)
        return _plain(out)


def _flow(s: str, i: int):
    """The value in flow that starts at s[i], and where it ends; IndexError if s is too short."""
    while s[i].isspace():
        i += 1
    if s[i] in "\"'":
        m = re.compile(r'"(?:[^"\\]|\\.)*"' if s[i] == '"' else r"'(?:[^']|'')*'(?!')", re.S).match(s, i)
        if m is None:
            raise IndexError
        return _unquoted(m[0]), m.end()
    if s[i] == "[":
        out, i = [], i + 1
        while True:
            while s[i].isspace() or s[i] == ",":
                i += 1
            if s[i] == "]":
                return out, i + 1
            value, i = _flow(s, i)
            out.append(value)
    if s[i] == "{":
        out, i = {}, i + 1
        while True:
            while s[i].isspace() or s[i] == ",":
                i += 1
            if s[i] == "}":
                return out, i + 1
            if s[i] in "\"'":
                key, i = _flow(s, i)
            else:
                m = re.compile(r"[^,:\[\]{}]+|:(?!\s)").match(s, i)
                if m is None:
                    raise Odd(s)
                key, i = m[0].strip(), m.end()
            while s[i].isspace():
                i += 1
            if s[i] == ":":
                i += 1
                while s[i].isspace():
                    i += 1
                value, i = (None, i) if s[i] in ",}" else _flow(s, i)
            else:
                value = None
            out[key] = value
    m = re.compile(r"(?:[^,\[\]{}:#]|:(?![\s,\]}])|(?<!\s)#)+").match(s, i)
    if m is None:
        raise Odd(s)
    if m.end() >= len(s):
        raise IndexError
    return _plain(re.sub(r"\s*\n\s*|\s+", " ", m[0])), m.end()
