"""Shared folders, byte-level helpers and hashing used by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker; bounds the NumPy temporaries of every operator.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; if unset, a folder of the warehouse, which they share too."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, empty place of its own in the shared folder."""
    bounded_batches(spark)
    return f"{shared_dir(spark)}/statloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write once and read again: cuts the lineage, so that a lost executor repeats nothing before this."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and the path inside it of a file:, hdfs: or object-store URI."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only once it is whole, so attempts of a task can't mix."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        parent, _, name = self.path.rpartition("/")
        self.fs.create_dir(parent, recursive=True)
        self.temp = f"{parent}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)

    def tell(self) -> int:
        return self.size

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)
        self.temp = ""

    def __del__(self):
        """A file that was not closed, as its task failed, leaves nothing behind."""
        if getattr(self, "temp", ""):
            with contextlib.suppress(OSError, ValueError):
                self.out.close()
                self.fs.delete_file(self.temp)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Have Spark cut the Arrow batches for Python by bytes too, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def released(run):
    """``run`` for mapInArrow; when it ends, the worker gives freed memory back to the system, as it serves later stages too."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def small(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (views, no copies)."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings, nulls as empty texts."""
    return [t or "" for t in column.to_pylist()]


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``limit``; one large item is a range of its own."""
    start = total = at = 0
    for at, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, at
            start, total = at, 0
        total += n + 1
    if total:
        yield start, at + 1


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without copying the text; nulls have length 0."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], b[o[0] : o[-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base's and its inverse's powers 0 to n - 1 modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolled:
    """Polynomial hashes modulo 2**64 of any ranges of a byte buffer, from one running sum."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sum[ends] - self.sum[starts]) * self.down[starts]


def ascii_lower(col):
    """Lower-cases A-Z only, unlike ``lower``."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that no column of ``df`` has (Spark compares without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
