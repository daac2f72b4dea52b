"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import re
import string
from array import array

from tokenizers import Tokenizer

#: Words in each of the two generations that a task remembers the ids of (speed only).
REMEMBERED = 160_000
#: White space that this module doesn't cut words at itself: a text with any is encoded in one go.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Letters and marks that words may be told apart by, where the tokenizer does so, too.
_LETTERS = [chr(c) for c in range(0x250) if chr(c).isalpha()]


class Encoder:
    """ids(text): packed ids, `width` bytes each, without special tokens, the end id behind them.

    by_word: the tokenizer never joins what stands on two sides of white space, so that a text's ids are its
    words' ids behind one another, and frequent words needn't be encoded again. A word is encoded as a text, but for
    words of plain letters and marks behind them: what the library's normalizer and pre-tokenizer make of each such
    letter and mark is asked once, and only those that they treat alone and alike are plain.
    """

    def __init__(self, path: str, end_id: int | None, by_word: bool):
        self.t = Tokenizer.from_file(path)
        self.model = self.t.model
        self.kind = "H" if self.t.get_vocab_size(True) <= 1 << 16 and (end_id or 0) < 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.end = b"" if end_id is None else array(self.kind, [end_id]).tobytes()
        self.by_word = by_word
        self.letters: dict[str, str] = {}
        marks = self._prove() if by_word and self.t.pre_tokenizer else ""
        # a first letter is always there; without plain letters nothing matches
        self.cut = re.compile(f"([{re.escape(''.join(self.letters)) or 'a-a'}]+)([{re.escape(marks)}]*)" if marks else r"(?!)").fullmatch
        self.known = _Known(self)

    def _pieces(self, text: str) -> list[str]:
        return [p for p, _ in self.t.pre_tokenizer.pre_tokenize_str(self.t.normalizer.normalize_str(text) if self.t.normalizer else text)]

    def _prove(self) -> str:
        """Fills `letters`: plain ones and how the pre-tokenizer writes them, in lower case; gives the plain marks."""
        a = self._pieces("a")
        for c in _LETTERS:
            low = c.lower()
            own = self._pieces(low) if len(low) == 1 else []
            # one piece with other letters, whatever its case, and parted from a mark
            if len(a) == len(own) == 1 and all(self._pieces(f"a{x}a{m}")[:1] == [a[0] + own[0] + a[0]] for x in (c, low) for m in ("", ".", "'", "-")):
                self.letters[c] = own[0]
        return "".join(m for m in string.punctuation if all(self._pieces(f"a{m}{n}")[:1] == a for n in ("", *string.punctuation)))

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, w: str) -> bytes:
        """Of a word without white space."""
        if not (plain := self.cut(w)):
            return self.whole(w)
        core, tail = plain.groups()
        if tail:
            return self.known[core] + self.known[tail]
        low = core.lower()
        if low != core:
            return self.known[low]
        piece = core if core.isascii() else "".join(map(self.letters.__getitem__, core))
        return array(self.kind, [x.id for x in self.model.tokenize(piece)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_word or _ODD_SPACE.search(text):
            return self.whole(text) + self.end
        return b"".join(map(self.known.__getitem__, text.split())) + self.end

    def forget(self) -> None:
        """Gives up the words: a task's worker lives on, and what it remembers would stand beside what others need."""
        self.known.clear()
        self.known.old.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.ids(t) for t in texts]


class _Known(dict):
    """Ids by word, in two generations: words of the old one that come again pass into the new one."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.old: dict[str, bytes] = {}

    def __missing__(self, w: str) -> bytes:
        out = self.old.get(w)
        if out is None:
            out = self.encoder.word(w)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[w] = out
        return out


_made: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None, by_word: bool) -> Encoder:
    """One for each of a worker process's tokenizers."""
    key = (path, end_id, by_word)
    if key not in _made:
        _made[key] = Encoder(*key)
    return _made[key]
