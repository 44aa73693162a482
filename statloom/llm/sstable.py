"""Token-ID output as sorted-string-table shards.

A shard is one file::

    data block*  index block  Bloom filter  footer

A data block is a zstd frame over entries (shared key length, rest length, value length as variable-length
numbers, rest of the key, value); keys are prefix-compressed against the one before. The index block has
one entry for each data block: its last key, offset and length. The footer has a fixed size and is read
first. Keys are 13 bytes that sort as (doc_id is not null, doc_id, ordinal of a repeated doc_id); values
are the little-endian ids, 2 or 4 bytes each. A lookup reads the footer, tests the Bloom filter, searches
the index by bisection and reads one block.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import AtomicFile, filesystem, small, texts_of, work_dir, written
from .tokens import encoded_texts, encoder, wide

FOOTER = struct.Struct("<QQQQQQQII8s")
MAGIC = b"STLMSST1"
BLOCK_BYTES = 256 << 10
SHARD_BYTES = 256 << 20
#: Rows beyond which a doc_id is spread over ranges; its ordinals then start anew, PART_ORDINALS apart, in each.
HOT_ROWS, PART_ORDINALS = 10_000, 1 << 32
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7

MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long, first_key binary, last_key binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None, ordinal: int) -> bytes:
    return b"\x00" + struct.pack(">QQ", 0, ordinal) if doc_id is None else b"\x01" + struct.pack(">QQ", doc_id + (1 << 63), ordinal)


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[:1] == b"\x01" else None


def put_number(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_entries(entries: list[tuple[bytes, bytes]]) -> bytes:
    out, last = bytearray(), b""
    for key, value in entries:
        shared = 0
        for x, y in zip(key, last):
            if x != y:
                break
            shared += 1
        put_number(out, shared)
        put_number(out, len(key) - shared)
        put_number(out, len(value))
        out += key[shared:]
        out += value
        last = key
    return bytes(out)


def entries_of(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    at, last = 0, b""
    while at < len(block):
        shared, at = get_number(block, at)
        rest, at = get_number(block, at)
        size, at = get_number(block, at)
        last = last[:shared] + block[at : at + rest]
        at += rest
        yield last, block[at : at + size]
        at += size


def bloom_positions(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Double hashing: the bit positions of each 64-bit hash, one row for each of the hash functions."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low[None, :] + np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None] * high[None, :]) % np.uint64(n_bits)


class ShardWriter:
    """Takes (key, ids) in ascending key order. Memory: one block, and about 50 bytes for each block and 8 for each document."""

    def __init__(self, uri: str, itemsize: int, block_bytes: int = BLOCK_BYTES):
        self.uri, self.itemsize, self.block_bytes = uri, itemsize, block_bytes
        self.file, self.zip = AtomicFile(uri), zstandard.ZstdCompressor(level=1)
        self.block: list[tuple[bytes, bytes]] = []
        self.held = self.n_tokens = 0
        self.index: list[tuple[bytes, bytes]] = []
        self.hashes = array("Q")
        self.first = self.last = b""

    def add(self, key: bytes, ids: bytes) -> None:
        self.first = self.first or key
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        self.block.append((key, ids))
        self.n_tokens += len(ids) // self.itemsize
        self.held += len(ids) + len(key)
        if self.held >= self.block_bytes:
            self.cut()

    def cut(self) -> None:
        if self.block:
            at = self.file.tell()
            size = self.file.write(self.zip.compress(pack_entries(self.block)))
            self.index.append((self.block[-1][0], struct.pack("<QQ", at, size)))
            self.block, self.held = [], 0

    def close(self) -> tuple:
        self.cut()
        index = self.zip.compress(pack_entries(self.index))
        index_at, index_size = self.file.tell(), self.file.write(index)
        n_bits = max(64, len(self.hashes) * BLOOM_BITS_PER_KEY + 7 & ~7)
        bits = np.zeros(n_bits, bool)
        bits[bloom_positions(np.frombuffer(self.hashes, np.uint64), n_bits).ravel().astype(np.int64)] = True
        bloom = np.packbits(bits, bitorder="little").tobytes()
        bloom_at, bloom_size = self.file.tell(), self.file.write(bloom)
        self.file.write(FOOTER.pack(index_at, index_size, bloom_at, bloom_size, n_bits, len(self.hashes), self.n_tokens, self.itemsize, zlib.crc32(index), MAGIC))
        self.file.close()
        return self.uri, len(self.hashes), self.n_tokens, self.file.size, self.first, self.last


class Shard:
    """Reads one shard by ranges."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(FOOTER.size, size - FOOTER.size)
        self.index_at, index_size, self.bloom_at, self.bloom_size, self.n_bits, self.n_docs, self.n_tokens, self.itemsize, crc, magic = FOOTER.unpack(tail)
        index = self.file.read_at(index_size, self.index_at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{uri} is not a whole shard")
        self.unzip = zstandard.ZstdDecompressor()
        found = list(entries_of(self.unzip.decompress(index)))
        self.last_keys = [k for k, _ in found]
        self.ranges = [struct.unpack("<QQ", v) for _, v in found]

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, size = self.ranges[i]
        return entries_of(self.unzip.decompress(self.file.read_at(size, at)))

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.ranges)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        bits = self.file.read_at(self.bloom_size, self.bloom_at)
        at = bloom_positions(np.array([xxhash.xxh64_intdigest(key)], np.uint64), self.n_bits).ravel()
        return all(bits[int(p) >> 3] >> (int(p) & 7) & 1 for p in at)

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of a document, or None."""
        key = key_of(doc_id, ordinal)
        if not self.may_hold(key):
            return None
        i = bisect_left(self.last_keys, key)
        for k, v in self.block(i) if i < len(self.ranges) else ():
            if k == key:
                return np.frombuffer(v, f"<u{self.itemsize}")
        return None


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every document, append ``end_id`` and write shards in ascending doc_id order below ``out``.

    Returns the manifest, one row per shard, itself written below ``out``. Null texts are empty (the end id
    alone). A null doc_id sorts first. Rows that repeat a doc_id are all kept, in the order of their texts'
    hash and text; identical ones are interchangeable. An empty table gives no shard. Only doc_id and text
    are read, whatever other columns there are. One range shuffle of the texts; a task streams its range and
    holds one block. A doc_id with more than HOT_ROWS rows may span ranges, by the hash of its texts; the
    ordinals in its keys then ascend with gaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, size = enc.number(end_id), enc.dtype.itemsize
        part, seq, shard, made, last, ordinal = TaskContext.get().partitionId(), 0, None, [], (), 0
        for batch in small(batches):
            for doc_id, spread, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoded_texts(enc, texts_of(batch.column(1)))):
                ordinal = ordinal + 1 if last == (doc_id,) else part * PART_ORDINALS if spread else 0
                last = (doc_id,)
                if shard is None:
                    shard = ShardWriter(f"{out}/shards/part-{part:06d}-{seq:04d}.sst", size)
                shard.add(key_of(doc_id, ordinal), ids + end)
                if shard.file.size >= shard_bytes and not shard.block:
                    made.append((part, seq, *shard.close()))
                    shard, seq = None, seq + 1
        if shard is not None:
            made.append((part, seq, *shard.close()))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("spread"))
    hot = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).select(F.col("doc_id").alias("hot_id"), F.lit(True).alias("many")), f"{out}/hot")
    if not hot.isEmpty():  # at most a row for HOT_ROWS rows
        rows = rows.join(hot, rows["doc_id"].eqNullSafe(hot["hot_id"]), "left").select("doc_id", "text", F.coalesce("many", F.lit(False)).alias("spread"))
    # Other doc_ids stay in one range: their ordinals are counted there.
    h = F.when(F.col("spread"), F.xxhash64("text")).otherwise(F.lit(0))
    ordered = rows.withColumn("h", h).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(ordered.select("doc_id", "text", "spread").mapInArrow(run, MANIFEST), f"{out}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The shards' starts are a running sum over the manifest (a row per shard); then each shard is one task.
    """
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, at = Shard(path), base or 0
                dtype = np.dtype(f"<u{shard.itemsize}")
                for i in range(len(shard.ranges)):
                    ids, starts, counts, crcs = [], [], [], []
                    for key, value in shard.block(i):
                        ids.append(doc_of(key))
                        starts.append(at)
                        counts.append(len(value) // shard.itemsize)
                        crcs.append(zlib.crc32(wide(value, dtype)))
                        at += counts[-1]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select("path", "base").repartition(n).mapInArrow(run, ROWS)


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, out: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` and return what is read back from them."""
    out = out or work_dir(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, out, tokenizer, end_id))
