"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so repeats count. Each numbered k-mer falls into
one of ``BINS`` bins by its hash; a bin selects its ``PICK`` minimal k-mers and keeps them in text order,
and the tuple's hash is the bin's part of the signature. Bins stand for independent hash functions (one
permutation, divided), so a text is hashed once. Two signatures' likeness is the share of equal parts
among bins that are not empty in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, small, texts_of

K, BINS, PICK = 8, 64, 2
#: K-mers that are numbered and sorted at once: those of a longer text go by groups of their hashes' first bits.
GROUP = 1 << 22
#: Code points whose k-mers are hashed at once.
CHUNK = 1 << 20
_LOW = np.uint64(24)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64((1 << 64) - 1)
_EDGES = np.array([b << 34 for b in range(BINS + 1)], np.uint64)

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Text bytes of a range of documents, about.
RANGE_BYTES = 128 << 20


def _ordered(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(40-bit hashes, positions) by hash, then position; positions up to 24 bits share a sort key with the hash."""
    if not len(at) or at[-1] < 1 << 24 and at.max() < 1 << 24:
        s = (h & ~np.uint64(0xFFFFFF)) | at
        s.sort()
        return s >> _LOW, s & np.uint64(0xFFFFFF)
    h = h >> _LOW
    order = np.lexsort((at, h))
    return h[order], at[order]


def _hashed(codes: np.ndarray, k: int, lo: int, hi: int) -> np.ndarray:
    """Hashes of the k-mers that start at lo to hi."""
    h = np.zeros(hi - lo, np.uint64)
    for j in range(k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += codes[lo + j : hi + j]
        h += np.uint64(1)
    h += np.uint64(k)
    return mix64(h)


def _grouped(codes: np.ndarray, k: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of all k-mers, those with equal hashes in one group of about GROUP."""
    bits = max(0, (n - 1) // GROUP).bit_length()
    if not bits:
        yield _hashed(codes, k, 0, n), np.arange(n, dtype=np.uint64)
        return
    for g in range(1 << bits):
        hs, ats = [], []
        for lo in range(0, n, CHUNK):
            h = _hashed(codes, k, lo, min(n, lo + CHUNK))
            pick = np.flatnonzero(h >> np.uint64(64 - bits) == g)
            hs.append(h[pick])
            ats.append(pick.astype(np.uint64) + np.uint64(lo))
        yield np.concatenate(hs), np.concatenate(ats)


def _smallest(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(BINS, PICK) numbered hashes and positions: the smallest of a group's k-mers in each bin, _NONE where there are fewer."""
    v, at = _ordered(h, at)
    del h
    same = v[1:] == v[:-1]
    if same.any():
        index = np.arange(len(v))
        index -= np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), index, 0))
        nth = index.astype(np.uint64)
        del index
        v, at = _ordered(np.where(nth > 0, mix64(v + nth * _STEP), v << _LOW), at)
    first = np.searchsorted(v, _EDGES)
    place = first[:-1, None] + np.arange(PICK)
    has = place < first[1:, None]
    place = np.minimum(place, max(len(v) - 1, 0))
    return (np.where(has, v[place], _NONE), np.where(has, at[place], _NONE)) if len(v) else (np.full((BINS, PICK), _NONE), np.full((BINS, PICK), _NONE))


def signature(text: str) -> np.ndarray:
    """BINS numbers of 16 bits, 0 for an empty bin; a text shorter than K is one k-mer, an empty one has none.

    Temporaries: about 60 bytes for each of at most GROUP k-mers, and the text's code points.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(BINS, np.uint16)
    k = min(K, len(codes))
    with np.errstate(over="ignore"):
        v, at = np.full((BINS, 0), _NONE), np.full((BINS, 0), _NONE)
        for h, p in _grouped(codes, k, len(codes) - k + 1):
            gv, gp = _smallest(h, p)
            v, at = np.concatenate((v, gv), 1), np.concatenate((at, gp), 1)
            order = np.lexsort((at, v))[:, :PICK]
            v, at = np.take_along_axis(v, order, 1), np.take_along_axis(at, order, 1)
        two = at[:, 1] != _NONE
        swap = two & (at[:, 0] > at[:, 1])
        x, y = np.where(swap, v[:, 1], v[:, 0]), np.where(two, np.where(swap, v[:, 0], v[:, 1]), 0)
        s = mix64(x * _STEP + y * np.uint64(0xC2B2AE3D27D4EB4F) + two)
    return np.where(at[:, 0] != _NONE, s % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal parts; two empty texts are alike."""
    used = (a > 0) | (b > 0)
    return float((a[used] == b[used]).mean()) if used.any() else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _edges(ids: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends (k, h) of all ranges but the last of about ``n``, ascending: approximate quantiles of k, and of h within a k that several fall on."""
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], F.lit(100 * n + 10_000))).first()[0] or []
    ks, times = np.unique(np.array(found, np.int64), return_counts=True)
    hot, top = ks[times > 1].tolist(), (1 << 63) - 1
    inner: dict[int, list[int]] = {}
    if hot:
        m = int(times.max())
        parts = ids.filter(F.col("k").isin(hot)).groupBy("k").agg(F.percentile_approx("h", [i / m for i in range(1, m)], F.lit(100 * m + 10_000)).alias("q"))
        inner = {r["k"]: r["q"] for r in parts.collect()}
    out = []
    for k, t in zip(ks.tolist(), times.tolist()):
        q = inner.get(k, [])
        out += [(k, h) for h in sorted({q[(i * len(q)) // t] for i in range(1, t)} - {top})] if t > 1 and q else []
        out.append((k, top))
    return np.array([k for k, _ in out], np.int64), np.array([h for _, h in out], np.int64)


def fingerprint_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness, one row per input row.

    The following document is the next by doc_id (null first), then by a hash of the text; behind the last
    comes the first. Null texts are empty; equal texts have equal fingerprints, whatever their length; rows
    that repeat are a row each; an empty table gives no rows. Ranges of (doc_id, text hash) go to one task
    each (bounds: approximate quantiles of doc_id, and of the text hash for a doc_id with many rows; as many
    ranges as bytes ask for), with the first document of the next range as a guest, so the texts are
    shuffled once. A task streams its range and holds two documents besides its Arrow batch. Rows that
    repeat a doc_id and its text stay together; their results are made once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key, h = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")
    n = partitions
    if n is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ids = docs.select(key.alias("k"), h.alias("h"))
    edge_k, edge_h = _edges(ids, n)

    def range_of(k: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many edges lie before each (k, h)."""
        lo, hi = np.searchsorted(edge_k, k, side="left"), np.searchsorted(edge_k, k, side="right")
        out = lo.copy()
        for i in np.unique(lo[hi > lo]):
            at = np.flatnonzero((lo == i) & (hi > lo))
            out[at] += np.searchsorted(edge_h[i : hi[at[0]]], h[at], side="left")
        return out

    @F.pandas_udf("int")
    def numbered(k, h):
        import pandas as pd

        return pd.Series(range_of(k.to_numpy(), h.to_numpy()).astype(np.int32))

    firsts = ids.select("k", "h", numbered("k", "h").alias("p")).groupBy("p").agg(F.min(F.struct("k", "h")).alias("m"))
    smallest = sorted((r["p"], r["m"]["k"], r["m"]["h"]) for r in firsts.collect())
    guest_of = {(k, h): smallest[i - 1][0] for i, (_, k, h) in enumerate(smallest)}
    first_k = np.array([k for _, k, _ in smallest], np.int64)

    @F.pandas_udf("array<int>")
    def ranges(k, h):
        import pandas as pd

        k, h = k.to_numpy(), h.to_numpy()
        own, maybe = range_of(k, h), np.isin(k, first_k)
        return pd.Series([[p, guest_of[x, y]] if m and (x, y) in guest_of else [p] for p, m, x, y in zip(own.tolist(), maybe.tolist(), k.tolist(), h.tolist())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None  # (range, doc_id, text, signature) whose following document is still to come
        made: tuple = (None, None, ())  # the last text, what followed it, and their row

        def finish(following: str, mark: np.ndarray) -> None:
            nonlocal made
            _, doc_id, text, own = last
            if made[0] != text or made[1] != following:
                new = edited(text, following)
                s = signature(new)
                made = text, following, (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u2").tobytes().hex(), s.astype(">u2").tobytes().hex(), likeness(own, s), likeness(own, mark))
            rows.append((doc_id, *made[2]))

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in OUT.split(", ")])

        for b in small(batches):
            for p, guest, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), texts_of(b.column(3))):
                if guest and (last is None or last[0] != p):
                    continue  # a further row of a guest's doc_id
                mark = last[3] if last is not None and last[2] == text else signature(text)
                if last is not None and last[0] == p:
                    finish(text, mark)
                last = None if guest else (p, doc_id, text, mark)
            if rows:
                yield batch()
                rows = []

    rows = docs.select(key.alias("k"), h.alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = rows.select("k", "h", "doc_id", "text", F.posexplode(ranges("k", "h")).alias("guest", "p"))
    ordered = placed.repartitionById(len(edge_k) + 1, F.col("p")).sortWithinPartitions("p", "guest", "k", "h", "text")
    return ordered.select("p", "guest", "doc_id", "text").mapInArrow(run, OUT)
