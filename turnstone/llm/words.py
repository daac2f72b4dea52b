"""Words, and hashes of any substring, of a batch of texts at once, as arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that are worked on at once inside a task; one longer text is a piece by itself.
PIECE = 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

#: Bytes of words, for the two definitions in use.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, PIECE + 4096), base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if len(p) <= 4 * PIECE:
            _powers[name] = have
    return have[:n]


class Bytes:
    """Texts' UTF-8 bytes behind each other, a blank after each; start[i], size[i]: of text i.

    texts: a list, or an Arrow array of strings, whose bytes are taken as they lie.
    """

    def __init__(self, texts: list[str | None] | pa.Array, fold: bool = True):
        raw = [memoryview(x.as_buffer()) if x.is_valid else b"" for x in texts] if isinstance(texts, pa.Array) else [t.encode() if t else b"" for t in texts]
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        self.raw = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        self.folded = LOWER[self.raw] if fold else self.raw
        self._sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.folded)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_CODE[self.folded] * _power("up", _BASE, n), out=self._sums[1:])
        return self._sums

    def hashes(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the folded substrings [at, end)."""
        sums, inv = self.sums(), _power("down", _INV, len(self.folded) + 1)
        return mix((sums[end] - sums[at]) * inv[at] + (end - at).astype(np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        """The hashes of all substrings of that size, by their first byte."""
        sums, inv = self.sums(), _power("down", _INV, len(self.folded) + 1)
        n = len(self.folded) - size + 1
        return mix((sums[size:] - sums[:-size]) * inv[:n] + U(size))

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words; for each text its first word's number (and one more at the end)."""
        edge = np.diff(np.concatenate([[False], table[self.folded], [False]]).view(np.int8))
        at, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return at, end, np.append(np.searchsorted(at, self.start), len(at))


#: Batches after which a task gives memory back.
TIDY = 16
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that this Python worker has freed to the system; it lives on from task to task, and its executor's others need it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back now and then, and at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, out in enumerate(run(batches)):
            yield out
            if n % TIDY == TIDY - 1:
                give_back()
        give_back()

    return tidied


def pieces(texts: list[str | None] | pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about `most` characters at most (bytes, of an Arrow array)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t) if t else 0 for t in texts]
    i = total = 0
    for j, n in enumerate(sizes):
        if total and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(texts):
        yield i, len(texts)


def with_columns(docs: DataFrame, text: str, fields: T.StructType, work: Callable[[list], list[pa.Array]], drop: tuple[str, ...] = ()) -> DataFrame:
    """docs without `drop` and with more columns, that `work` makes of lists of texts (whole ones, in bounded pieces).

    Columns of docs with the new ones' names are replaced. All else passes as it is.
    """
    kept = [f for f in docs.schema.fields if f.name not in {*fields.names, *drop}]
    names = [f.name for f in kept]
    out = T.StructType([*kept, *fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("\x00text"))
            for i, j in pieces(texts, PIECE // 2):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + work(texts.slice(i, j - i).to_pylist()), names=[*names, *fields.names])

    return docs.select(*[docs[f"`{n}`"] for n in names], docs[f"`{text}`"].alias("\x00text")).mapInArrow(tidy(run), out)
