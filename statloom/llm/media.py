"""Media columns: byte payloads as PNG members of archives, read by a Python data source.

A payload is an image of 64 RGB pixels a row (192 samples of 8 bits), lossless. Members are stored in ZIP
archives whose directory stands at the end. The data source plans byte ranges over the archives from their
sizes alone; a task reads its archive's directory, takes the members whose header offset lies in its
range, streams them as Arrow batches through a read-ahead window, checks each member's CRC and, if it
does not match or the read fails, reads that member alone again by its offset.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import AtomicFile, filesystem, small, texts_of, work_dir, written

ROW = 192
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 32 << 20
WINDOW_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of ROW."""
    return data + b" " * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """A payload of whole rows as PNG; the unpadded length is kept as text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of a PNG that to_png() made; ValueError if it is damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, parts, n, rows = 8, [], 0, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", data)[1]
        elif kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n = int(data[8:])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("unknown row filter")
    return raw[:, 1:].tobytes(), n


def difference_hash(payload: bytes) -> str:
    """64 bits: brighter or not than the next of 9 cells in each of 8 bands; then mean and deviation of the samples."""
    a = np.frombuffer(payload, np.uint8)
    edges = np.arange(72) * len(a) // 72
    mean = np.add.reduceat(a, edges, dtype=np.int64) / np.diff(np.append(edges, len(a)))
    cells = mean.reshape(8, 9)
    bits = np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()
    return f"{bits}:{a.mean():.4f}:{a.std():.4f}"


def write_archives(docs: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store every row's text (null: empty) as one member below ``out``; returns archive and members, a row per archive.

    A member's name holds its doc_id ("null" for none) and its place, so repeated ids stay apart. Archives are
    named by task, and a repeated task writes the same bytes again under the same name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, file, members, made = TaskContext.get().partitionId(), 0, None, 0, []

        def close() -> None:
            box.close()
            file.close()
            made.append((f"{out}/media/part-{part:06d}-{seq:04d}.zip", members))

        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                if file is None:
                    file, members = AtomicFile(f"{out}/media/part-{part:06d}-{seq:04d}.zip"), 0
                    box = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED)
                data = text.encode("utf-8", "surrogatepass")
                box.writestr(zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{members}.png"), to_png(padded(data), len(data)))
                members += 1
                if file.size >= archive_bytes:
                    close()
                    file, seq = None, seq + 1
        if file is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["archive", "members"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "archive string, members long"), f"{out}/archives")


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveSource(DataSource):
    """``spark.read.format("statloom_archives").load(folder)``: one row per member of the folder's ZIP archives.

    Options: rangeBytes, retries (2), onError: "fail" (default) or "null" (a member that stays unreadable
    gives a row without media).
    """

    @classmethod
    def name(cls) -> str:
        return "statloom_archives"

    def schema(self) -> str:
        return "archive string, name string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        low = {k.lower(): v for k, v in options.items()}
        self.range_bytes = int(low.get("rangebytes", RANGE_BYTES))
        self.retries = int(low.get("retries", 2))
        self.on_error = low.get("onerror", "fail")

    def partitions(self) -> list[ByteRange]:
        fs, at = filesystem(self.path)
        files = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.is_file and f.base_name.endswith(".zip") and not f.base_name.startswith("."):
                out += [ByteRange(f"{self.path}/{f.base_name}", a, min(f.size, a + self.range_bytes)) for a in range(0, f.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, at = filesystem(part.archive)
        with fs.open_input_file(at) as file:
            with zipfile.ZipFile(file) as box:
                members = [m for m in box.infolist() if part.start <= m.header_offset < part.end]
            members.sort(key=lambda m: m.header_offset)
            held, held_at, rows, size = b"", 0, [], 0
            for m in members:
                need = 30 + len(m.filename.encode()) + len(m.extra) + m.compress_size + 64
                if m.header_offset < held_at or m.header_offset + need > held_at + len(held):
                    try:
                        held, held_at = file.read_at(max(need, WINDOW_BYTES), m.header_offset), m.header_offset
                    except OSError:
                        held, held_at = b"", m.header_offset
                data = self.member(held[m.header_offset - held_at :], m)
                for k in range(self.retries):
                    if data is not None:
                        break
                    time.sleep(0.1 * 2**k)
                    try:
                        data = self.member(file.read_at(need, m.header_offset), m)
                    except OSError:
                        data = None
                if data is None and self.on_error != "null":
                    raise OSError(f"{part.archive}: member at {m.header_offset} can't be read")
                rows.append((part.archive, m.filename, m.header_offset, data))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def member(data: bytes, m: zipfile.ZipInfo) -> bytes | None:
        """The member's bytes if the local header and the CRC agree with the directory."""
        if len(data) < 30 or data[:4] != b"PK\x03\x04":
            return None
        name, extra = struct.unpack_from("<HH", data, 26)
        found = data[30 + name + extra : 30 + name + extra + m.compress_size]
        return found if len(found) == m.file_size and zlib.crc32(found) == m.CRC else None

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["archive", "name", "offset", "media"])


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """archive, name, offset and media of every member of the archives in ``folder``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).options(**options).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """doc_id and the features of every stored member: what is read back, decoded, hashed and summarised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for name, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = name.split("/")[0]
                payload, n = from_png(stored)
                rows.append((None if doc == "null" else int(doc), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(payload)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", *(x.split()[0] for x in FEATURES.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return media.select("name", "media").mapInArrow(run, "doc_id long, " + FEATURES)


def stored_media(docs: DataFrame, out: str | None = None) -> DataFrame:
    """Store every document's text as media, read the archives back and describe each: one row per input row."""
    spark = docs.sparkSession
    out = out or work_dir(spark, "media")
    write_archives(docs, out)
    return media_features(read_archives(spark, f"{out}/media"))
