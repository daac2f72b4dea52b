"""N-gram Jaccard join by T-occurrence search (DivideSkip).

1. Every text becomes its set of word shingles; what step 2 needs of the sets is staged, packed. Equal sets are one class,
   which later stands for all its copies.
2. A set that has a partner shares most of itself. With the shingles in order of hash, two sets that reach the
   threshold share l of their first |s| - ceil(t |s|) + l ones, for any l. So such prefixes, for an l of a tenth of
   the set, tell which sets can have a partner at all: the ones of whose prefix enough is in other sets, too.
   Those left are made again from their texts, staged whole, and asked the same.
3. Among those, such prefixes bring sets together. Their order is by how often step 2 saw a shingle in whole sets (from a
   bounded list of the most frequent ones, which costs or saves time only), then by hash. A shingle that many sets hold
   joins all of them as a star. Of those that few sets hold it is counted how many any two sets of like size share: below
   l they don't join. So passages and turns of phrase that documents have in common don't join strangers.
4. T-occurrence search inside the groups, in blocks of a bounded mass: an inverted index over whole sets; for
   a set that needs T shared shingles, its short lists are heap-merged, long ones are only probed by
   bisection for the sets found, and those that reach the exact overlap are linked.
5. Components of the links.

Lists of over SHORT sets give stars, shorter ones fewer than SHORT / 2 pairs an entry, and a block gives each set's root.
No text is shuffled.

In steps 2 and 3 shingles meet by slices of the space of hashes. There are as many as the mass asks for, and a task
takes one after the other. A shingle that several sets of a task's batch hold is counted there and goes on once, so
one that is in a third of all sets costs its slice one entry a batch.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.bloom import bloom, fits, keep_named
from turnstone.llm.common import drop_staged, stage_table
from turnstone.llm.components import components
from turnstone.llm.words import PIECE, SPACED, U, Bytes, mix, pieces, tidy

WORDS, PERCENT = 5, 80
#: Shingles that at most are put last for being frequent.
FREQUENT = 1 << 20
#: Shingles in a block of the search at most (one larger set is a block by itself).
BLOCK = 1_000_000
#: Classes in groups up to which their table is broadcast (40 bytes each); beyond, it is joined by a shuffle.
BROADCAST = 1_000_000
#: Shingles of a batch that a task deals out, and of a slice in which they meet, about.
BATCH, SLICE = 500_000, 1_000_000
#: Sets of a prefix shingle's list up to which its pairs are counted; longer lists are stars.
SHORT = 8
#: Sets in which a prefix shingle must be seen to be a candidate for that list.
FEW = 6
#: Classes that a task remembers having given.
SEEN = 200_000


def _word_hashes(raw: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and for each text its first word's number (and one more at the end)."""
    at, end, first = raw.words(SPACED)
    return raw.hashes(at, end), first


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    run = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words if len(run) else 0):
        run = mix(run + h[k : len(h) - words + 1 + k])
    return run


def _few(h: np.ndarray) -> np.ndarray:
    """The set of a text of fewer words than a shingle: the whole sequence as one, or none."""
    x = np.full(min(1, len(h)), len(h), np.uint64)
    for k in range(len(h)):
        x = mix(x + h[k : k + 1])
    return x


def _long_set(text: np.ndarray, words: int) -> np.ndarray:
    """The set of one long text (its bytes), by windows that are cut between words and overlap by a shingle less one word."""
    blank = ~SPACED[text]
    out, at, carry = np.zeros(0, np.uint64), 0, np.zeros(0, np.uint64)
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            back = np.flatnonzero(blank[at:end])
            more = np.flatnonzero(blank[end:]) if not len(back) else back
            end = at + int(back[-1]) + 1 if len(back) else end + int(more[0]) + 1 if len(more) else len(text)
        h = np.concatenate([carry, _word_hashes(Bytes(pa.array([text[at:end].tobytes()], pa.binary())))[0]])
        run = _runs(h, words)
        out = np.union1d(out, run)
        carry, at = h[max(0, len(h) - words + 1) :], end
    return out if len(out) else _few(carry)


def shingle_sets(texts: list[str | None] | pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted set of 64-bit shingle hashes; with fewer words than a shingle, the whole sequence is one."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    if len(texts) == 1 and texts[0].is_valid and texts[0].as_buffer().size > 2 * PIECE:
        return [_long_set(np.frombuffer(texts[0].as_buffer(), np.uint8), words)]
    h, first = _word_hashes(Bytes(texts))
    run = _runs(h, words)
    return [np.unique(run[i : j - words + 1]) if j - i >= words else _few(h[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def fingerprint(s: np.ndarray) -> int:
    """64 bits of a set, as a signed number; what stands for its class."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


def _filter(names: DataFrame, column: str) -> Broadcast | None:
    """A broadcast filter of a staged column of names, where they fit one."""
    return names.sparkSession.sparkContext.broadcast(bloom(names, column)) if fits(names) else None


def _held(only: Broadcast | None, names: pa.Array) -> np.ndarray:
    """Which of the names (longs) may be in the filter; all, where there is none."""
    return np.ones(len(names), bool) if only is None else only.value.holds(names.to_numpy().view(np.uint64))


def packed_sets(docs: DataFrame, part: Callable[[int], int] = lambda n: n, rows: Broadcast | None = None, classes: Broadcast | None = None) -> DataFrame:
    """row (a hash of the text), doc_id, n (set size), fp (class) of every document, and s: the first part(n) of its set, where a task sees the class first.

    A task that has seen many classes forgets them, so a class may be given several times; `given` marks it.
    rows, classes: filters; texts outside the first are left out, and sets of classes outside the second aren't given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            b = b if rows is None else b.filter(pa.array(_held(rows, b.column(0))))
            texts = b.column(2)
            for i, j in pieces(texts, PIECE // 2):
                sets = shingle_sets(texts.slice(i, j - i))
                fp = [fingerprint(s) if len(s) else None for s in sets]
                held = _held(classes, pa.array([f or 0 for f in fp], pa.int64())).tolist()
                new = [f is not None and x and not (f in seen or seen.add(f)) for f, x in zip(fp, held, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(new), pa.array([s[: part(len(s))].tobytes() if x else None for s, x in zip(sets, new, strict=True)], pa.binary())],
                    names=["row", "doc_id", "n", "fp", "given", "s"],
                )
                if len(seen) > SEEN:
                    seen.clear()

    return docs.select("row", "doc_id", "text").mapInArrow(tidy(run), "row long, doc_id long, n long, fp long, given boolean, s binary")


def shared_depth(n):
    """How many shingles of their prefixes two sets have to share, the smaller of them of size n."""
    return F.floor(n / 10) if isinstance(n, Column) else n // 10


def _dealt(sets: Iterator[tuple[int, int, np.ndarray]], slices: int, local: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = BATCH, apart: int = 1, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """(fp, set size, shingles) of a task as rows by slices of the space of hashes.

    A row holds a slice's part of a batch: h, 32 bits of each hash (all, where `whole`); of, which of the fps; size, those
    sets' sizes (where `whole`); w, in how many sets of the batch it is. What more than one class and more than `apart`
    sets of the batch hold comes once, with w over 1, and `local` says of it what is known already: (head, fp by hash, of
    each hash's number) to two columns of longs, which go on as rows without w.
    """

    def batch(h: list[np.ndarray], fp: list[int], size: list[int]) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(h), dtype=np.uint32), [len(x) for x in h])
        h, fp, size = np.concatenate(h), np.array(fp, np.int64), np.array(size, np.uint32)
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(head, len(h)))
        by = fp[of]
        many = (count > apart) & (np.minimum.reduceat(by, head) != np.maximum.reduceat(by, head))
        inside = np.repeat(many, count)
        known = local(by[inside], np.repeat(np.arange(int(many.sum())), count[many]))
        goes = ~inside
        goes[head[many]] = True
        w = np.ones(len(h), np.uint16)
        w[head[many]] = np.minimum(count[many], 65_535)
        h, of, w = h[goes], of[goes], w[goes]
        at = ((h >> U(32)) * U(slices) >> U(32)).astype(np.int64)
        edge = np.searchsorted(at, np.arange(slices + 1))
        low, rows = h if whole else (h & U(0xFFFFFFFF)).astype(np.uint32), []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            i, j = int(edge[k]), int(edge[k + 1])
            used, new = np.unique(of[i:j], return_inverse=True)
            rows.append((k, low[i:j].tobytes(), w[i:j].tobytes(), new.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(), fp[used].tobytes(), size[used].tobytes() if whole else None))
        if len(known[0]):
            rows.append((int(known[0][0]) % slices, known[1].astype(np.int64).tobytes(), None, None, known[0].astype(np.int64).tobytes(), None))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["slice", "h", "w", "of", "fp", "size"])

    hs, fps, sizes, mass = [], [], [], 0
    for f, n, s in sets:
        hs.append(s)
        fps.append(f)
        sizes.append(n)
        mass += len(s)
        if mass >= most:
            yield batch(hs, fps, sizes)
            hs, fps, sizes, mass = [], [], [], 0
    if mass:
        yield batch(hs, fps, sizes)


_DEALT = "slice int, h binary, w binary, of binary, fp binary, size binary"


def _met(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray]]:
    """Of a task's rows, by slice: (slice, h, fp, w, size) ordered by h and fp, for one slice at a time; and pairs of columns, as `local` gave them.

    Where a hash isn't `whole`, it is known by 32 bits inside its slice: of two that fall together each still counts, so a
    set or a group may be one too many, never one too few; and there are no sizes.
    """

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    for k, group in itertools.groupby(rows(), key=lambda r: r[0]):
        hs, fps, ws, sizes = [], [], [], []
        for _, h, w, of, fp, size in group:
            if w is None:
                yield np.frombuffer(fp, np.int64), np.frombuffer(h, np.int64)
                continue
            hs.append(np.frombuffer(h, np.uint64 if whole else np.uint32))
            ws.append(np.frombuffer(w, np.uint16))
            at = np.frombuffer(of, np.uint16 if len(of) == len(w) else np.uint32)
            fps.append(np.frombuffer(fp, np.int64)[at])
            if whole:
                sizes.append(np.frombuffer(size, np.uint32)[at])
        if hs:
            h, fp, w = np.concatenate(hs), np.concatenate(fps), np.concatenate(ws)
            order = np.lexsort((fp, h))
            yield k, h[order], fp[order], w[order], np.concatenate(sizes)[order] if whole else np.zeros(0, np.uint32)


def _deal(sets: DataFrame, slices: int, emit: Callable, meet: Callable, schema: str) -> DataFrame:
    return sets.select("fp", "s").mapInArrow(tidy(emit), _DEALT).repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(meet), schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for f, s in zip(b.column(0), b.column(1), strict=True):
            yield f.as_py(), np.frombuffer(s.as_buffer(), np.uint64)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its values."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(values), len(key)).astype(np.int64)


def shared_counts(sets: DataFrame, slices: int, part: Callable[[int], int], most: int = BATCH) -> DataFrame:
    """Of rows (fp, s), of whose shingles the first part(n) count, rows of two kinds.

    (fp, n): how many of them sets of other classes have among theirs, too, for all rows of the class together;
    and with `often` set, (slice and 32 bits of a hash, n): shingles in FEW or more sets.
    """

    def counted(by: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(by, return_counts=True)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(((f, len(s), s[: part(len(s))]) for f, s in _rows(batches)), slices, counted, most)

    def packed(f: np.ndarray, n: np.ndarray, often: bool) -> pa.RecordBatch:
        """Counts by slices of the classes, as the shingles went by slices of theirs."""
        at = f.view(np.uint64) % U(slices)
        order = np.argsort(at, kind="stable")
        at, f, n = at[order], f[order], n[order]
        edge = np.searchsorted(at, np.arange(slices + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(edge)).tolist()
        parts = [x[edge[k] : edge[k + 1]].tobytes() for x in (f, n) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(parts[: len(some)], pa.binary()), pa.array(parts[len(some) :], pa.binary()), pa.array([often] * len(some), pa.bool_())], names=["slice", "key", "n", "often"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, ns, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for got in _met(batches):
            if len(got) == 2:
                f, n = got
            else:
                k, h, fp, w, _ = got
                first = np.concatenate([[True], h[1:] != h[:-1]])
                head = np.flatnonzero(first)
                size = np.diff(np.append(head, len(h)))
                kinds = np.add.reduceat(first | np.concatenate([[True], fp[1:] != fp[:-1]]), head, dtype=np.int64)
                total = kinds + np.add.reduceat(w.astype(np.int64) - 1, head)
                f, n = np.unique(fp[np.repeat(total > 1, size) & (w == 1)], return_counts=True)
                many = total >= FEW
                yield packed((np.int64(k) << np.int64(32)) | h[head[many]].astype(np.int64), total[many], True)
            # a task sums up over its slices
            fs.append(f)
            ns.append(n)
            held += len(f)
            if held > SLICE:
                yield packed(*_summed(fs, ns), False)
                fs, ns, held = fs[:1], ns[:1], 0
        yield packed(*_summed(fs, ns), False)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = ((k, np.frombuffer(f, np.int64), np.frombuffer(n, np.int64), o) for b in batches for k, f, n, o in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (_, often), group in itertools.groupby(whole, key=lambda r: (r[0], r[3])):
            parts = list(group)
            f, n = _summed([r[1] for r in parts], [r[2] for r in parts])
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n), pa.array(np.full(len(f), often))], names=["fp", "n", "often"])

    met = _deal(sets, slices, emit, meet, "slice int, key binary, n binary, often boolean")
    return met.repartition("slice").sortWithinPartitions("slice", "often").mapInArrow(tidy(add), "fp long, n long, often boolean")


def _name(h: np.ndarray, slices: int) -> np.ndarray:
    """A hash as shared_counts tells it."""
    return (((h >> U(32)) * U(slices) >> U(32)) << U(32) | h & U(0xFFFFFFFF)).astype(np.int64)


def _stars(hub: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([hub, fp], axis=1)[fp != hub], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _pairs(h: np.ndarray, fp: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of one hash each (ordered by h and fp, each fp once in a list) all pairs of sets whose sizes allow a link: (a, b, how many shingles they have to share)."""
    out, at = [], np.arange(len(h))
    for k in range(1, SHORT):
        at = at[: np.searchsorted(at, len(h) - k)]
        at = at[h[at] == h[at + k]]
        low, high = np.minimum(size[at], size[at + k]).astype(np.int64), np.maximum(size[at], size[at + k]).astype(np.int64)
        like = 100 * low >= percent * high
        out.append((fp[at[like]], fp[at[like] + k], np.maximum(1, shared_depth(low[like]))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prefix_edges(sets: DataFrame, slices: int, named: int, frequent: np.ndarray, times: np.ndarray, percent: int = PERCENT, only: Broadcast | None = None) -> DataFrame:
    """(a, b) of sets (fp, s) that may be linked, so many at least that linked sets are connected.

    Of the prefixes' shingles, one that over SHORT sets hold gives a star of its smallest set (in a batch, of its first).
    Of the others it is counted how many two sets share, and fewer than shared_depth of the smaller one are no edge.
    frequent: sorted names of shingles that go last, as shared_counts told them by `named` slices, in the order of `times`.
    only: a filter of the classes that count.
    """
    sent = sets.sparkSession.sparkContext.broadcast((frequent, times))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        often, seen = sent.value
        for f, s in _rows(b.filter(pa.array(_held(only, b.column(0)))) for b in batches):
            n = len(s)
            if len(often):
                name = _name(s, named)
                at = np.minimum(np.searchsorted(often, name), len(often) - 1)
                s = s[np.argsort(np.where(often[at] == name, seen[at], 0), kind="stable")]
            yield f, n, s[: prefix_size(n, percent) - 1 + max(1, shared_depth(n))]

    def starred(by: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        return _stars(by[head][of] if len(of) else by, by)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(prefixes(batches), slices, starred, BATCH // 2, SHORT, True)

    def summed(parts: list[tuple]) -> pa.RecordBatch:
        """Pairs (a, b, need), each once with its count n."""
        a, b, need = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(np.diff(np.append(head, len(a)))), pa.array(need[head])], names=["a", "b", "n", "need"])

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.array(np.full(len(a), x)) for x in (1, 0)]], names=["a", "b", "n", "need"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mass = [], 0
        for got in _met(batches, whole=True):
            if len(got) == 2:
                yield stars(*got)
                continue
            _, h, fp, w, size = got
            first = np.concatenate([[True], h[1:] != h[:-1]])
            new = first | np.concatenate([[True], fp[1:] != fp[:-1]])
            head = np.flatnonzero(first)
            length = np.diff(np.append(head, len(h)))
            total = np.add.reduceat(new, head, dtype=np.int64) + np.add.reduceat(w.astype(np.int64) - 1, head)
            long = np.repeat(total > SHORT, length)
            yield stars(*_stars(np.repeat(fp[head], length)[long], fp[long]))
            few = new & ~long & np.repeat(total > 1, length)
            held.append(_pairs(h[few], fp[few], size[few], percent))
            mass += len(held[-1][0])
            # a task sums up over its slices
            if mass > SLICE:
                yield summed(held)
                held, mass = [], 0
        if held:
            yield summed(held)

    met = _deal(sets, slices, emit, meet, "a long, b long, n long, need long")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")


class Block:
    """The inverted index of some sets, and the search in it.

    Shingles with the same list of sets are one list with a weight. label: the class of each set so far.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets])
        self.label = np.arange(len(sets))
        self.members = {k: [k] for k in range(len(sets))}
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        del order
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(head, len(h)))
        del h
        code = np.random.default_rng(11).integers(1, 1 << 63, len(sets), dtype=np.uint64)
        shared = np.flatnonzero(count > 1)
        _, one, self.weight = np.unique(np.add.reduceat(code[doc], head)[shared], return_index=True, return_counts=True)
        self.length = count[shared[one]]
        # lists one after another, and for each set its lists, the shortest first
        self.edge = np.concatenate([[0], np.cumsum(self.length)])
        place = np.repeat(head[shared[one]] - self.edge[:-1], self.length) + np.arange(self.edge[-1])
        self.docs = doc[place]
        del doc, place
        which = np.repeat(np.arange(len(self.length), dtype=np.int32), self.length)
        order = np.lexsort((self.length[which], self.docs))
        self.of = which[order]
        self.of_edge = np.searchsorted(self.docs[order], np.arange(len(sets) + 1))
        self.shared = np.bincount(self.docs, self.weight[which], len(sets)).astype(np.int64)
        self.reach = np.bincount(self.docs, (self.weight * (self.length - 1))[which], len(sets))

    def needed(self, n):
        """Shared shingles that any partner of a set of n must have: ceil(t n)."""
        return -(-self.percent * n // 100)

    def unite(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved
        return True

    def _merge(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sets, weights) of the union of short lists: by a heap, or where they are many by one sort of the same runs."""
        runs = [self.docs[self.edge[j] : self.edge[j + 1]] for j in lists]
        if sum(map(len, runs)) <= 64:
            sets, sums = [], []
            for c, w in heapq.merge(*[[(c, int(self.weight[j])) for c in r.tolist()] for j, r in zip(lists, runs, strict=True)]):
                if sets and sets[-1] == c:
                    sums[-1] += w
                else:
                    sets.append(c)
                    sums.append(w)
            return np.array(sets, np.int64), np.array(sums, np.int64)
        sets, at = np.unique(np.concatenate(runs), return_inverse=True)
        return sets, np.bincount(at, np.repeat(self.weight[lists], [len(r) for r in runs])).astype(np.int64)

    def search(self, d: int) -> np.ndarray:
        """The sets outside d's class that reach the threshold with set d."""
        need = int(self.needed(self.size[d]))
        lists = self.of[self.of_edge[d] : self.of_edge[d + 1]]
        # the longest lists, as long as a set found in none of the others can't reach the need
        tail = np.cumsum(self.weight[lists][::-1])
        k = int(np.searchsorted(tail, need))
        spare, cut = (int(tail[k - 1]) if k else 0), len(lists) - k
        if not cut:
            return np.zeros(0, np.int64)
        found, n = self._merge(lists[:cut])
        for j in [-1, *lists[cut:].tolist()]:
            if j >= 0:
                own = self.docs[self.edge[j] : self.edge[j + 1]]
                at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                n = n + self.weight[j] * (own[at] == found)
                spare -= int(self.weight[j])
                fine = n + spare >= need
            else:
                fine = (n + spare >= need) & (self.label[found] != self.label[d])
            if not fine.all():
                found, n = found[fine], n[fine]
                if not len(found):
                    return found
        return found[100 * n >= self.percent * (self.size[d] + self.size[found] - n)]

    def link(self, members: list[int], queries: set[int] | None = None) -> None:
        """Unites all linked sets of a group; of pairs inside one class no link is looked for.

        A link has to be found from one of its ends: classes are done once all but one were searched whole.
        Sets that share most come first, as they unite most. queries: search these only, and all of them.
        """
        at = np.array(members)
        at = at[self.shared[at] >= self.needed(self.size[at])]
        todo = at[np.argsort(-self.reach[at], kind="stable")].tolist()
        if queries is not None:
            todo = [d for d in todo if d in queries]
        classes, largest = len(at), None
        while todo and classes > 1:
            put_off = []
            for d in todo:
                if classes == 1:
                    return
                if queries is None and largest is not None and self.label[d] == self.label[largest]:
                    put_off.append(d)
                    continue
                for c in self.search(d).tolist():
                    classes -= self.unite(c, d)
                if largest is None or len(self.members[int(self.label[d])]) > len(self.members[int(self.label[largest])]):
                    largest = d
            todo = put_off if len({int(self.label[d]) for d in put_off}) > 1 else []


def _link_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, fp, role, s) ordered by group, to links (a, b). role 0: searched for and searched with; 1: only to be found."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        block = Block(sets, percent)
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            mixed = any(r[2] for r in rows[i:j])
            block.link(list(range(i, j)), {k for k in range(i, j) if not rows[k][2]} if mixed else None)
            i = j
        pairs = [(rows[k][1], rows[r][1]) for k, r in enumerate(block.label.tolist()) if rows[r][1] != rows[k][1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    held: list[tuple] = []
    mass, last = 0, (None, None, None)
    for b in batches:
        for *key, s in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
            row = (*key, s.as_py())
            if row[:3] == last:
                continue  # a class that was given several times
            if row[0] != last[0] and mass > BLOCK // 2:
                yield solve(held)
                held, mass = [], 0
            last = row[:3]
            held.append(row)
            mass += len(row[3]) // 8
    if held:
        yield solve(held)


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links of rows (group, fp, role, s), each group in one task."""
    dealt = rows.select("group", "fp", "role", "s").repartition("group").sortWithinPartitions("group", "fp", "role")
    return dealt.mapInArrow(tidy(lambda batches: _link_groups(batches, percent)), "a long, b long")


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct 5-word
    shingles; component_id is the smallest doc_id reachable by links, the document's own included.
    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than five is one
    shingle; a null or empty text, or one without words, has none and is linked with nothing. Equal
    texts, repeated rows too, share a component; a null doc_id counts only where its component has no other.
    An empty table gives an empty one. docs is read twice.

    A group of sets above `block` shingles is searched in blocks: first each block in itself, together with the
    group's first set; then the sets that this has not united with the group's largest class against
    every block. Links inside one class can't change a component and aren't looked for.
    """
    docs = docs.select(F.xxhash64("text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # whole sets would take twice the disk of the documents, so they wait until it is known which ones are needed
    packed = stage_table(packed_sets(docs, lambda n: prefix_size(n, percent) - 1 + max(1, shared_depth(n))))
    known = stage_table(packed.select("row", "doc_id", "n", "fp"))
    own = stage_table(packed.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.sum(F.col("given").cast("long")).alias("times")))
    mass = own.agg(F.sum(F.col("n") * F.col("times"))).first()[0] or 0
    slices = 1 + mass * (100 - percent + 10) // (100 * SLICE)
    parts = stage_table(shared_counts(packed.where("given"), slices, lambda n: n))
    depth = parts.where("NOT often").select("fp", F.col("n").alias("depth"))
    partner = F.ceil(F.col("n") * percent / 100)
    hopeful = own.join(depth, "fp").where(F.col("depth") >= F.col("times") * F.greatest(F.lit(1), shared_depth(partner))).select("fp")
    hopeful = stage_table(hopeful)
    drop_staged(packed)
    rows = stage_table(known.join(hopeful, "fp").select("row").distinct())
    sets = packed_sets(docs, rows=_filter(rows, "row"), classes=_filter(hopeful, "fp")).where("given").select("fp", "s")
    sets = stage_table(sets if fits(hopeful) else keep_named(sets, "fp", hopeful))
    # among those, a set has to have its share of whole sets, not only of prefixes
    parts = stage_table(shared_counts(sets, slices, lambda n: n))
    often = parts.where("often").orderBy(F.col("n").desc(), "fp").limit(FREQUENT).orderBy("fp").select("fp", F.col("n").cast("int")).toArrow()
    frequent, seen = (c.to_numpy() for c in often.columns)
    whole = parts.where("NOT often").select("fp", F.col("n").alias("whole"))
    times = sets.groupBy("fp").agg(F.count(F.lit(1)).alias("times"))
    likely = stage_table(times.join(own.select("fp", "n"), "fp").join(whole, "fp").where(F.col("whole") >= F.col("times") * partner).select("fp", (F.col("n") * F.col("times")).alias("mass")))
    mass = likely.agg(F.sum("mass")).first()[0] or 0
    few = 1 + mass * (100 - percent + 10) // (100 * SLICE // 4)  # an entry may make several pairs
    near = prefix_edges(sets if fits(likely) else keep_named(sets, "fp", likely), few, slices, frequent, seen, percent, _filter(likely, "fp"))
    groups = stage_table(components(stage_table(near)))
    member = own.join(groups, own["fp"] == groups["node"]).select("fp", "n", F.col("root").alias("near"))
    mass = stage_table(member.groupBy("near").agg(F.sum("n").alias("mass"), F.min("fp").alias("hub")))
    member = stage_table(member.join(mass, "near").drop("n"))
    if member.count() <= BROADCAST:
        member = F.broadcast(member)
    small = sets.join(member.where(F.col("mass") <= block), "fp").select(F.col("near").alias("group"), "fp", F.lit(0).alias("role"), "s")
    links = stage_table(_links(small, percent))
    large = member.where(F.col("mass") > block)
    if not large.isEmpty():
        placed = sets.join(large, "fp").select("near", "fp", "hub", F.ceil(F.col("mass") / (block // 2)).alias("blocks"), "s")
        roots = components(_large_groups(stage_table(placed), links, percent, block))
    else:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    roots = stage_table(roots)
    drop_staged(sets)
    least = roots.join(own, roots["node"] == own["fp"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = own.join(roots.join(least, "root"), own["fp"] == F.col("node"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return known.join(of_class, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _large_groups(sets: DataFrame, links: DataFrame, percent: int, block: int) -> DataFrame:
    """The links of groups that are searched in blocks, besides `links`."""
    placed = sets.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    group = lambda *c: F.xxhash64("near", *c).alias("group")
    hub = placed.where(F.col("fp") == F.col("hub")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    once = placed.unionByName(hub).select(group("block"), "fp", F.lit(0).alias("role"), "s")
    links = stage_table(links.unionByName(_links(once, percent)))
    roots = stage_table(components(links))
    at = placed.join(roots, placed["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    counts = at.groupBy("near", "root").agg(F.count(F.lit(1)).alias("n"))
    main = stage_table(counts.groupBy("near").agg(F.max_by("root", F.struct("n", "root")).alias("main")))
    rest = at.join(main, "near").where(F.col("root") != F.col("main")).drop("main", "root", "block")
    parts = rest.groupBy("near").agg(F.ceil(F.sum(F.octet_length("s")) / (8 * (block // 2))).alias("parts"))
    rest = rest.join(stage_table(parts), "near").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")))
    rest = stage_table(rest)
    asked = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).select(group("block", "part"), "fp", F.lit(0).alias("role"), "s")
    found = placed.join(rest.groupBy("near").agg(F.max("parts").alias("parts")), "near").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = asked.unionByName(found.select(group("block", "part"), "fp", F.lit(1).alias("role"), "s"))
    return stage_table(links.unionByName(_links(both, percent)))
