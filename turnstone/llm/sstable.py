"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of keys, ascending: data blocks, a sparse block index, a Bloom
filter and a footer.

    block    entries of varints (bytes shared with the last key, further key bytes, value bytes), the
             further key bytes, the value (packed little-endian ids); then the block's crc32
    index    per block: varint key length, first key, <QIIQ (offset, bytes, documents, ids before it in the shard)
    Bloom    bits; PROBES positions per key by double hashing
    footer   <QQQQQQHH8s: index offset and bytes, filter offset and bytes, documents, ids, bytes of an
             id, probes, MAGIC

Key: 8 bytes, big-endian, sign bit flipped, so that bytes sort as numbers; a null key is empty and first.
A lookup reads the footer, asks the filter, bisects the index and scans one block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import stage_table
from turnstone.llm.encode import encoder
from turnstone.llm.words import pieces, tidy

MAGIC = b"TSSTAB01"
FOOTER = struct.Struct("<QQQQQQHH8s")
ENTRY = struct.Struct("<QIIQ")
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 16 << 20
#: Key ranges to a shuffle partition, and at most; keys of a range in the sample that sets its bounds, about.
RANGES, MOST_RANGES, SAMPLED = 4, 20_000, 50
#: Key ranges whose shards' ids are summed up together.
RUN = 1000
PROBES, BITS_PER_KEY = 7, 10


def pack_key(key: int | None) -> bytes:
    return b"" if key is None else ((key + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def unpack_key(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(probes)]


class ShardWriter:
    """Takes (key, packed ids) in ascending order of keys."""

    def __init__(self, width: int):
        self.width = width
        self.data, self.block, self.index = bytearray(), bytearray(), []
        self.keys: list[bytes] = []
        self.last = b""
        self.tokens = self.block_tokens = self.block_docs = 0
        self.first = b""

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self.flush()
        shared = 0
        if self.block_docs:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.block_docs += 1
        self.block_tokens += len(value) // self.width

    def flush(self) -> None:
        if self.block_docs:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append(varint(len(self.first)) + self.first + ENTRY.pack(len(self.data), len(self.block), self.block_docs, self.tokens))
            self.data += self.block
            self.tokens += self.block_tokens
            self.block, self.block_docs, self.block_tokens = bytearray(), 0, 0

    def size(self) -> int:
        return len(self.data) + len(self.block)

    def finish(self) -> bytes:
        self.flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _probes(k, bits, PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        at = len(self.data)
        bloom_at = at + len(index)
        tail = FOOTER.pack(at, len(index), bloom_at, len(bloom), len(self.keys), self.tokens, self.width, PROBES, MAGIC)
        return bytes(self.data) + index + bytes(bloom) + tail


class ShardReader:
    """read(offset, bytes): gives a part of the shard; size: all its bytes."""

    def __init__(self, read, size: int):
        self.read = read
        at, n, self.bloom_at, self.bloom_bytes, self.docs, self.tokens, self.width, self.probes, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, i, self.blocks = read(at, n), 0, []
        while i < n:
            k, i = read_varint(raw, i)
            key = bytes(raw[i : i + k])
            self.blocks.append((key, *ENTRY.unpack(raw[i + k : i + k + ENTRY.size])))
            i += k + ENTRY.size

    def entries(self, block: int) -> Iterator[tuple[bytes, memoryview, int]]:
        """(key, packed ids, ids of the shard before it) of a block."""
        _, offset, size, docs, before = self.blocks[block]
        raw = memoryview(self.read(offset, size))
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        i, key = 0, b""
        for _ in range(docs):
            shared, i = read_varint(raw, i)
            more, i = read_varint(raw, i)
            size, i = read_varint(raw, i)
            key = key[:shared] + bytes(raw[i : i + more])
            i += more
            yield key, raw[i : i + size], before
            i += size
            before += size // self.width

    def may_hold(self, key: bytes) -> bool:
        bloom = self.read(self.bloom_at, self.bloom_bytes)
        bits = max(64, self.docs * BITS_PER_KEY)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits, self.probes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of each document of that key."""
        if not self.blocks or not self.may_hold(key):
            return []
        out, kind = [], f"<u{self.width}"
        block = max(0, bisect.bisect_left([b[0] for b in self.blocks], key) - 1)
        while block < len(self.blocks) and self.blocks[block][0] <= key:
            out += [np.frombuffer(v, kind).copy() for k, v, _ in self.entries(block) if k == key]
            block += 1
        return out


def range_bounds(keys: DataFrame, ranges: int) -> np.ndarray:
    """The last keys of all but one of so many ranges of about as many rows, from a bounded sample of keys (by hash, so that it is the same every time)."""
    k = keys.where("k IS NOT NULL")
    share = min(1.0, SAMPLED * ranges / max(1, k.count()))
    some = k.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().toArrow().column(0).to_numpy()
    some = np.sort(some)
    return np.unique(some[(np.arange(1, ranges) * len(some)) // ranges]) if len(some) else some


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, by_word: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each row's whole text and writes shards below `path`; returns their manifest.

    Manifest, a row per shard, itself a table in the shared folder: file, first_key, n_docs, n_tokens,
    start (ids in all shards before it, by key). A null or empty text has the end id only; null keys come
    first; rows of one key stand next to each other, by ids; repeated rows all stay; an empty
    table has no shards. Other columns are ignored.

    Texts are encoded where they are, once; only ids are shuffled, by ranges of the key, of which there are some to each
    of the session's shuffle partitions; a shard is SHARD_BYTES, and holds keys of one range. A task writes each file
    under a name of its attempt and renames it when it's complete, so a task that runs again writes the same files again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    bounds = range_bounds(rows.select("k"), min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    width = encoder(tokenizer, end_id, by_word).width

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id, by_word)
        for b in batches:
            keys = b.column(0)
            of = np.searchsorted(bounds, keys.fill_null(0).to_numpy()).astype(np.int32)
            of[~keys.is_valid().to_numpy(zero_copy_only=False)] = 0
            for i, j in pieces(b.column(1)):
                ids = enc.encode(b.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(of[i:j]), keys.slice(i, j - i), pa.array(ids, pa.binary())], names=["range", "k", "ids"])
        enc.forget()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        made: list[dict] = []
        shard, at, n = ShardWriter(width), None, 0

        def close() -> None:
            name = f"shard-{at:06d}-{n:04d}.sst"
            part = f"{root}/_{name}.{attempt}"
            first = unpack_key(shard.keys[0])
            body = shard.finish()
            with fs.open_output_stream(part) as f:
                f.write(body)
            fs.move(part, f"{root}/{name}")
            made.append({"range": at, "file": name, "first_key": first, "n_docs": len(shard.keys), "n_tokens": shard.tokens})

        for b in batches:
            for of, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if of != at or shard.size() >= SHARD_BYTES:
                    if shard.keys:
                        close()
                        shard = ShardWriter(width)
                    at, n = of, n + 1 if of == at else 0
                shard.add(pack_key(k), v.as_py())
        if shard.keys:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("range", pa.int32()), ("file", pa.string()), ("first_key", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    dealt = rows.mapInArrow(tidy(encode), "range int, k long, ids binary").repartition("range").sortWithinPartitions("range", "k", "ids")
    return _with_starts(stage_table(dealt.mapInArrow(tidy(write), "range int, file string, first_key long, n_docs long, n_tokens long")))


def _with_starts(shards: DataFrame) -> DataFrame:
    """A manifest with `start`: ids in all shards before.

    Shards are in order of range and name. Sums go up in two steps, so that no task has a row of every shard: of runs of
    RUN ranges, and within each.
    """
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.withColumn("run", F.floor(F.col("range") / RUN))
    runs = shards.groupBy("run").agg(F.sum("n_tokens").alias("n_tokens"))
    base = runs.select("run", before(Window.orderBy("run")).alias("base"))  # a row per RUN ranges
    within = shards.withColumn("within", before(Window.partitionBy("run").orderBy("range", "file")))
    return within.join(base, "run").withColumn("start", F.col("base") + F.col("within")).drop("run", "base", "within", "range")


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The documents of a manifest's shards: doc_id, start (ids of all documents before it), n_tokens, ids (packed), width."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("width", pa.int32())])
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = memoryview(body.as_buffer()).cast("B")
                shard = ShardReader(lambda at, n, body=body: body[at : at + n], len(body))
                for i in range(len(shard.blocks)):
                    rows = [(unpack_key(k), at, len(v) // shard.width, bytes(v)) for k, v, at in shard.entries(i)]
                    n = len(rows)
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array([shard.width] * n, pa.int32())], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path) if not manifest.isEmpty() else spark.createDataFrame([], "path string, content binary")
    docs = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(tidy(decode), "file string, doc_id long, within long, n_tokens long, ids binary, width int")
    return docs.join(manifest.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids", "width")


def lookup(path: str, manifest_rows: list, key: int | None) -> list[np.ndarray]:
    """The ids of the documents of one key: reads footers, filters, one block of a shard that may hold it."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    out: list[np.ndarray] = []
    low = lambda r: pack_key(r["first_key"])
    order = sorted(manifest_rows, key=lambda r: (low(r), r["file"]))
    at = max(0, bisect.bisect_left([low(r) for r in order], pack_key(key)) - 1)
    while at < len(order) and low(order[at]) <= pack_key(key):
        name = f"{root}/{order[at]['file']}"
        with fs.open_input_file(name) as f:
            out += ShardReader(lambda i, n, f=f: f.read_at(n, i), f.size()).get(pack_key(key))
        at += 1
    return out


def digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [zlib.crc32(np.frombuffer(v.as_buffer(), f"<u{w}").astype("<u4").tobytes()) for v, w in zip(b.column(3), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.select("doc_id", "start", "n_tokens", "ids", "width").mapInArrow(tidy(crc), "doc_id long, start long, n_tokens long, ids_crc32 long")
