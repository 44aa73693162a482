"""Near duplicates by SimHash: exact search for fingerprints within a Hamming distance, by vantage points.

Copies of a fingerprint collapse first, so a group of exact copies is one point. Vantage-point trees then
partition the points by Hamming distance: a node's inner shard takes distances up to its cut m, the outer
those above, and points just beyond the cut visit both shards, whose boundary they overlap. In the full
metric that prunes little: unrelated points lie 32 +- 4 apart, so that at radius 4 most of a node lies by
its boundary (figures in the README). The trees therefore measure distance in projections: of three
disjoint sets of bits, two points within 4 bits are within 1 in one set at least, and at radius 1 few
points lie by a boundary. There is a tree for each projection; every pair meets in a leaf of one of them.
Leaves follow from a bounded sample; shards that hold too many points are divided again by trees of
their own samples, in their own projection or in ones of the bits in which their points still differ.

Inside a shard a vantage-point search prunes branches by the triangle inequality and, as only components
matter, those that are one component already; what is left is compared in all 64 bits. A shard gives a star
per component found, never all pairs; stars are joined to components by minimum labels with pointer
jumping, checkpointed each round.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, mix64, released, small, texts_of, work_dir, written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Text bytes taken apart at once, and what separates words.
CHUNK_BYTES, SPACE = 2 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: Points of a shard beyond which it is divided, rounds of that, and pairs compared at once.
CAPACITY, LEVELS, BLOCK_PAIRS = 8192, 12, 1 << 18
#: Points that the trees of a shard are fitted on, vantage points tried for a node, points of a shard that one task deals.
SAMPLE, TRIED, ROUTED = 4096, 6, 1 << 18
#: Points compared with each other without a further vantage point.
LEAF = 128
ALL = (1 << 64) - 1


def shingle_hashes(text: str, words: int, most: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles in order, repeats included, a chunk at a time; a shorter text is one shingle, one without words none.

    Words are cut at ASCII white space, ASCII letters in lower case.
    """
    data, digest, at, w, some = text.encode("utf-8", "surrogatepass").lower(), xxhash.xxh64_intdigest, 0, [], False
    while at < len(data):
        end = len(data)
        if end - at > most and (m := SPACE.search(data, at + most)):
            end = m.start()
        w += data[at:end].split()
        at = end
        n = len(w) - words + 1
        if n < 1:
            continue
        joined, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
        starts, last = np.concatenate(([0], ends[: n - 1])), ends[words - 1 :] - 1
        for i in range(0, n, 1 << 15):
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)].tolist(), last[i : i + (1 << 15)].tolist())], np.uint64)
        w, some = w[n:], True
    if w and not some:
        yield np.array([digest(b" ".join(w), SEED)], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the hashes, as an unsigned number; 0 for none."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """SimHash of a text's word shingles as an unsigned number; 0 without words. Texts of any length, a chunk at a time."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), fp (the 64 bits as a signed long) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = np.array([fingerprint(t) for t in texts_of(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(released(run), "doc_id long, text_hash long, fp long")


class Components:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def of(self, at: np.ndarray) -> np.ndarray:
        r = self.root[at]
        while True:
            up = self.root[r]
            if (up == r).all():
                self.root[at] = r
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of(a), self.of(b)
            go = x != y
            a, b, x, y = a[go], b[go], x[go], y[go]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))


class VantageSearch:
    """Links all points within ``radius`` of each other, up to links inside one component.

    Branches are cut in the metric that counts the bits of ``mask``; points whose distances there differ
    by more than ``reach`` are not compared. The full metric (the default) loses nothing; a shard's own
    projection loses only pairs that another projection has.
    """

    def __init__(self, points: np.ndarray, radius: int, mask: int = ALL, reach: int | None = None):
        self.p, self.radius, self.found = points, radius, Components(len(points))
        self.mask, self.reach = np.uint64(mask), radius if reach is None else reach
        self.pairs_seen = 0

    def run(self) -> np.ndarray:
        """The component of each point: the position of its first member."""
        stack = [(np.arange(len(self.p)), None)]
        while stack:
            a, b = stack.pop()
            stack += self.self_pairs(a) if b is None else self.cross_pairs(a, b)
        return self.found.of(np.arange(len(self.p)))

    def brute(self, a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, BLOCK_PAIRS // len(b))
        for at in range(0, len(a), step):
            x = a[at : at + step]
            self.pairs_seen += len(x) * len(b)
            i, j = np.nonzero(np.bitwise_count(self.p[x][:, None] ^ self.p[b][None, :]) <= self.radius)
            self.found.link(x[i], b[j])

    def one(self, *parts: np.ndarray) -> bool:
        return len(np.unique(np.concatenate([self.found.of(x) for x in parts]))) == 1

    def distances(self, v: int, a: np.ndarray) -> np.ndarray:
        """Distances from the vantage point in the search's metric; points near it in the full one are linked to it."""
        x = self.p[a] ^ self.p[v]
        near = a[np.bitwise_count(x) <= self.radius]
        self.found.link(near, np.full(len(near), v))
        return np.bitwise_count(x & self.mask).astype(np.int64)

    def self_pairs(self, a: np.ndarray) -> list:
        if len(a) < 2:
            return []
        if len(a) <= LEAF:
            self.brute(a, a)
            return []
        d = self.distances(a[len(a) // 2], a)
        if self.one(a):
            return []
        m = int(np.median(d))
        inside = d <= m
        if inside.all():
            m = int(d.max()) - 1
            inside = d <= m
        if not inside.any():
            self.brute(a, a)
            return []
        out = [(a[inside], None), (a[~inside], None)]
        return out + self.boundary(a[inside & (d > m - self.reach)], a[~inside & (d <= m + self.reach)])

    @staticmethod
    def boundary(a: np.ndarray, b: np.ndarray) -> list:
        return [(a, b)] if len(a) and len(b) else []

    def cross_pairs(self, a: np.ndarray, b: np.ndarray) -> list:
        if len(a) * len(b) <= LEAF * LEAF:
            self.brute(a, b)
            return []
        if self.one(a, b):
            return []
        v = a[len(a) // 2]
        da, db = self.distances(v, a), self.distances(v, b)
        m = int(np.median(np.concatenate((da, db))))
        ia, ib = da <= m, db <= m
        parts = [(a[ia], b[ib]), (a[~ia], b[~ib]), (a[ia & (da > m - self.reach)], b[~ib & (db <= m + self.reach)]), (a[~ia & (da <= m + self.reach)], b[ib & (db > m - self.reach)])]
        if sum(len(x) * len(y) for x, y in parts) > 0.9 * len(a) * len(b):
            self.brute(a, b)  # bounds prune next to nothing here
            return []
        return [x for x in parts if len(x[0]) and len(x[1])]


def projected(radius: int) -> tuple[int, int]:
    """(number of projections, radius in each): two points within ``radius`` are that near in one projection at least."""
    parts = radius // 2 + 1
    return parts, radius // parts


def projections(points: np.ndarray, parts: int) -> list[int]:
    """Disjoint masks of all 64 bits, each with its share of the bits in which ``points`` differ."""
    vary = int(np.bitwise_or.reduce(points) & ~np.bitwise_and.reduce(points))
    bits = sorted(range(64), key=lambda b: (not vary >> b & 1, b))
    cuts = [round(bin(vary).count("1") * i / parts) for i in range(parts)] + [64]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


@dataclass
class Tree:
    """A vantage-point tree in the metric of ``mask``: by node the point, the cut m and two children (below 0: leaf ~child).

    The inner child takes distances up to m + reach, the outer those above m: points in (m, m + reach],
    whose partners may lie on the other side of m, visit both.
    """

    mask: int
    point: np.ndarray
    cut: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    leaf_sizes: list[int]

    def route(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions of its points), every leaf that has any."""
        if not len(points):
            return
        stack = [(0 if len(self.point) else -1, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                yield ~node, at
                continue
            d = np.bitwise_count((points[at] ^ self.point[node]) & np.uint64(self.mask))
            for child, go in ((self.inner[node], at[d <= self.cut[node] + reach]), (self.outer[node], at[d > self.cut[node]])):
                if len(go):
                    stack.append((int(child), go))


def grown(sample: np.ndarray, mask: int, reach: int, least: int) -> Tree:
    """A tree whose leaves hold about ``least`` points of the sample; of a few vantage points and all cuts it takes the best.

    The best leaves the fewest pairs to compare, points that visit both sides counted twice. A node that no
    cut makes a tenth cheaper is a leaf.
    """
    r = np.random.default_rng(len(sample))
    point, cut, kids, sizes = [], [], [], []

    def node(a: np.ndarray) -> int:
        if len(a) > least:
            tried = a[r.integers(0, len(a), TRIED)]
            best = (0.9 * len(a) ** 2, 0, 0)
            for v in tried.tolist():
                upto = np.cumsum(np.bincount(np.bitwise_count((a ^ np.uint64(v)) & np.uint64(mask)).astype(np.int64), minlength=65))
                inner = upto[np.minimum(np.arange(64) + reach, 64)]
                cost = inner**2 + (len(a) - upto[:64]) ** 2
                m = int(np.argmin(cost))
                if cost[m] < best[0]:
                    best = (int(cost[m]), v, m)
            if best[0] < 0.9 * len(a) ** 2:
                at = len(point)
                point.append(best[1])
                cut.append(best[2])
                kids.append(None)
                d = np.bitwise_count((a ^ np.uint64(best[1])) & np.uint64(mask))
                kids[at] = (node(a[d <= best[2] + reach]), node(a[d > best[2]]))
                return at
        sizes.append(len(a))
        return ~(len(sizes) - 1)

    node(sample)
    inner, outer = (np.array([k[i] for k in kids], np.int64) for i in (0, 1))
    return Tree(mask, np.array(point, np.uint64), np.array(cut, np.int64), inner, outer, sizes)


def trees_for(sample: np.ndarray, n: int, mask: int, radius: int, capacity: int) -> list[Tree]:
    """How to divide a shard of ``n`` points by its ``sample``: one tree in its own metric, or else one in each of
    the projections of the bits in which its points differ. No tree: neither leaves half of the pairs.
    """
    parts, reach = projected(radius)
    rate = max(1.0, n / max(1, len(sample)))
    least = max(2, int(capacity / 8 / rate), 16 if rate > 1 else 0)
    for masks in ([mask] if mask else [], projections(sample, parts) if len(sample) else []):
        made = [grown(sample, m, reach, least) for m in masks]
        if made and sum(k * k for t in made for k in t.leaf_sizes) <= len(sample) ** 2 / 2:
            return made
    return []


def dealt(trees: list[Tree], parent: int, fps: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """shard, mask, fp of a shard's points in the leaves of its trees."""
    points, (_, reach) = fps.view(np.uint64), projected(radius)
    for i, tree in enumerate(trees):
        for leaf, at in tree.route(points, reach):
            name = int(mix64(np.array([(parent ^ (i << 56 | leaf) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64)).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), pa.array(np.full(len(at), np.uint64(tree.mask)).view(np.int64)), pa.array(fps[at])], names=["shard", "mask", "fp"])


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` rows, but the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def runs_of(batches: Iterable[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, one run of equal ``keys`` first columns at a time."""
    held: list[list[np.ndarray]] = []

    def flush() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held)]

    for b in batches:
        c = [np.asarray(x) for x in b.columns]
        if not b.num_rows:
            continue
        turn = np.flatnonzero(np.any([x[1:] != x[:-1] for x in c[:keys]], axis=0)) + 1
        for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), b.num_rows]):
            if held and any(held[-1][k][0] != c[k][lo] for k in range(keys)):
                yield flush()
                held = []
            held.append([x[lo:hi] for x in c])
    if held:
        yield flush()


def star_links(points: DataFrame, radius: int) -> DataFrame:
    """fp, root (the smallest of its component in the shard) from shard, mask, fp; a task streams its shards."""
    _, reach = projected(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mask, p in runs_of(batches):
            p = np.unique(p)
            own = int(mask[:1].view(np.uint64)[0])
            r = VantageSearch(p.view(np.uint64), radius, own or ALL, reach if own else radius).run()
            busy = np.bincount(r, minlength=len(p))[r] > 1
            if busy.any():
                yield pa.RecordBatch.from_arrays([pa.array(p[busy]), pa.array(p[r[busy]])], names=["fp", "root"])

    rows = points.select("shard", "mask", "fp").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(released(lambda batches: gathered(run(batches))), "fp long, root long")


def sampled(points: DataFrame, hot: DataFrame) -> DataFrame:
    """shard, n, mask, fp of about SAMPLE points of each hot shard, chosen by a hash of the fingerprint."""
    return points.join(hot, "shard").filter(F.pmod(F.xxhash64("fp"), F.col("n")) < SAMPLE).select("shard", "n", "mask", "fp")


def shards_of(fps: DataFrame, radius: int, out: str, capacity: int) -> DataFrame:
    """shard, mask, fp: all points, divided by vantage-point trees into overlapping shards of about ``capacity`` / 8.

    The first trees are fitted on the driver on a sample of SAMPLE points, less than half of all; a shard
    that holds more than ``capacity`` points is then divided again by trees of its own sample, fitted and
    used on the executors. A shard that no tree divides stays whole: a cluster so tight that most of its
    points are near each other.
    """
    points = fps.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("mask"), "fp")
    shape, done = "shard long, mask long, fp long", []
    n = fps.count()
    if n > capacity:
        root = F.pmod(F.xxhash64("fp"), F.lit(n)) < min(SAMPLE, n // 2)
        sample = np.sort(np.array([r["fp"] for r in fps.filter(root).collect()], np.int64)).view(np.uint64)
        trees = trees_for(sample, n, 0, radius, capacity)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in gathered(batches):
                yield from gathered(dealt(trees, 0, np.asarray(b.column(0)), radius))

        if trees:
            points = written(fps.mapInArrow(released(first), shape), f"{out}/shards-0")
    for level in range(1, LEVELS if n > capacity else 0):
        sizes = points.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        hot = written(sizes.filter(F.col("n") > capacity), f"{out}/hot-{level}")
        if hot.isEmpty():
            break

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, n, mask, p in runs_of(batches):
                made = trees_for(np.sort(p).view(np.uint64), int(n[0]), int(mask[:1].view(np.uint64)[0]), radius, capacity)
                yield pa.RecordBatch.from_arrays([pa.array(shard[:1]), pa.array(n[:1]), pa.array([pickle.dumps(made) if made else None], pa.binary())], names=["shard", "n", "trees"])

        fitted = sampled(points, hot).repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(fit, "shard long, n long, trees binary")
        fitted = written(fitted, f"{out}/trees-{level}")
        splits = fitted.filter("trees IS NOT NULL")
        done.append(points.join(splits.select("shard"), "shard", "left_anti"))
        # A hot shard's points are dealt to several tasks, each with the shard's trees ahead of them.
        pieces = F.ceil(F.col("n") / ROUTED).cast("int")
        some = points.join(splits.select("shard", "n"), "shard").select("shard", F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("piece"), F.lit(None).cast("binary").alias("trees"), "fp")
        ahead = splits.select("shard", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "trees", F.lit(None).cast("long").alias("fp"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = None
            for b in batches:
                head = np.flatnonzero(np.asarray(b.column(2).is_valid()))
                cuts = sorted({0, b.num_rows, *head.tolist(), *(head + 1).tolist()})
                for lo, hi in zip(cuts, cuts[1:]):
                    if b.column(2)[lo].is_valid:
                        trees = pickle.loads(b.column(2)[lo].as_py())
                    else:
                        yield from dealt(trees, b.column(0)[lo].as_py(), np.asarray(b.column(3)[lo:hi]), radius)

        rows = some.unionByName(ahead).repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.col("trees").isNull())
        points = written(rows.mapInArrow(lambda batches: gathered(route(batches)), shape), f"{out}/shards-{level}")
    for d in done:
        points = points.unionByName(d)
    return points


def components(links: DataFrame, out: str) -> DataFrame:
    """fp, label (the smallest fp reachable) of every point of the stars ``links`` (fp, root).

    Joins on a star's centre or a label are plain: adaptive execution divides those that many rows share.
    """
    stars = written(links.distinct().unionByName(links.select(F.col("root").alias("fp"), "root").distinct()).distinct(), f"{out}/stars")
    labels = written(stars.groupBy("fp").agg(F.min("root").alias("label")), f"{out}/labels-0")
    step = 0
    while True:
        step += 1
        told = stars.join(labels, "fp")
        least = told.groupBy("root").agg(F.min("label").alias("least"))
        near = told.join(least, "root").groupBy("fp").agg(F.min("least").alias("label"), F.min("label").alias("was"))
        near = written(near, f"{out}/near-{step}")
        if near.filter("label <> was").isEmpty():
            return near.select("fp", "label")
        # Pointer jumping: a label takes its own label.
        jump = near.select(F.col("label").alias("at")).distinct().join(near.select(F.col("fp").alias("at"), F.col("label").alias("to")), "at")
        labels = near.join(jump.withColumnRenamed("at", "label"), "label").select("fp", F.col("to").alias("label"))
        labels = written(labels, f"{out}/labels-{step}")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, capacity: int = CAPACITY, out: str | None = None) -> DataFrame:
    """doc_id, text_hash, fp, label, component_id of every row of ``docs``.

    Rows are linked where fingerprints differ in ``radius`` bits at most; label names the component (its
    smallest fingerprint) and component_id is the smallest doc_id in it. Null texts are empty; texts
    without words have fingerprint 0 and are linked like others; repeated rows are all returned. A null
    doc_id is never the smallest unless the component has no other. An empty table gives no rows.
    """
    out = out or work_dir(docs.sparkSession, "simhash")
    rows = written(fingerprints(docs), f"{out}/fingerprints")
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{out}/points")
    links = written(star_links(shards_of(reps.select("fp"), radius, out, capacity), radius), f"{out}/links")
    label = components(links, out)
    linked = reps.join(label, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "label").select("fp", "label", "component_id")
    named = written(named, f"{out}/components")
    # Both sides are plain tables: a hot fingerprint's rows are divided by adaptive execution.
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "label", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, out: str | None = None) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), then text hash; all columns kept."""
    return keep_first(docs, near_duplicates(docs, radius, out=out))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each label of ``found`` (doc_id, text_hash, label of every row): the smallest doc_id (null last), then text hash.

    What stays is decided on those three columns; texts move once, to meet the decision and to keep one of
    rows that repeat a doc_id and a text. Those rows are interchangeable but for other columns.
    """
    d, h, nth = free_names(docs, "kept_id", "kept_hash", "kept_row")
    keep = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    keep = keep.select(F.struct("k.none", F.coalesce("k.doc_id", F.lit(0)).alias("doc_id")).alias(d), F.col("k.text_hash").alias(h)).distinct()
    long = F.col("doc_id").cast("long")
    keyed = docs.withColumns({d: F.struct(long.isNull().alias("none"), F.coalesce(long, F.lit(0)).alias("doc_id")), h: F.xxhash64("text")})
    kept = keyed.join(keep, [d, h], "left_semi")
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(d, h).orderBy(F.lit(0)))).filter(F.col(nth) == 1).select(*docs.columns)
