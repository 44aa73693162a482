"""SimHash near duplicates at a Jaccard likeness of word shingle sets: what SimHash finds, verified and completed.

A document is the set of its five-word shingles; equal sets collapse first. Their SimHash fingerprints go
through the vantage-point search of ``simhash``; the pairs it links are verified on the sets. Sets of
likeness 0.8 have fingerprints up to about 14 bits apart, a radius at which no search of 64 bits prunes
(figures in the README). So the pairs beyond its radius come from prefixes: put every set into one global
order; two sets of likeness ``least`` or more then share a shingle among the first
``n - ceil(least * n) + 1`` of each. Only those prefixes are grouped by shingle, and every pair that can
reach the likeness meets in a group. Any order is right; shingles that a sample finds common come last,
by count, so that a passage in many documents seldom makes a group. Candidates lose those whose sizes or
parity masks rule the likeness out, and the rest are verified on the whole sets, made again from their texts.

As only components matter, SimHash's pairs come first, with each point's smallest hub (the smallest point of
a group); then the members of a group and its hub, and at last any two members, are compared unless they
are one component already. In large groups those of any two go by rounds: a component first sends its likeliest
pairs, then more, then all that are left, as the pairs of copies join it to the rest long before they run out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small, texts_of, work_dir, written
from .simhash import CAPACITY, RADIUS, components, keep_first, majority, runs_of, shards_of, shingle_hashes, star_links

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: One document in SAMPLE is looked at for common shingles; those seen OFTEN times, and at most COMMON of them.
SAMPLE, OFTEN, COMMON = 16, 8, 20_000
#: Members of a group up to which all its pairs are candidates, and of a tile of a larger group.
SMALL, TILE = 64, 1024
#: Pairs that a component sends from a tile, by round; then all.
ROUNDS = (4, 64, 1024, None)
#: Words of masks compared at once.
BLOCK_PAIRS = 1 << 20


def shingle_set(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's word shingles, each once; a shorter text is one shingle, one without words none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def point_of(s: np.ndarray) -> int:
    """A hash of the set as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def simhash_of(s: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes as a signed number, 0 for none."""
    return int(np.uint64(majority(s[at : at + (1 << 15)] for at in range(0, len(s), 1 << 15))).view(np.int64))


def mask_of(s: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of a power of two of cells, about two a shingle."""
    cells = max(512, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two masks differ, the longer folded to the shorter: no more than the shingles in which the sets differ."""
    a, b = (np.frombuffer(m, np.uint64) for m in sorted((x, y), key=len))
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many of the sampled sets hold, the rarer first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for t in texts_of(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], names=["shingle"])

    part = texts(docs).filter(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text").mapInArrow(released(run), "shingle long")
    seen = part.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= OFTEN).orderBy(F.desc("k"), "shingle").limit(COMMON).collect()
    return np.array([r["shingle"] for r in reversed(seen)], np.int64).view(np.uint64)


def prefix(s: np.ndarray, least: Fraction, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(least * n) + 1`` of a set in the global order: common shingles (sorted ``hashes``, with ``ranks``) last."""
    k = len(s) - -(-len(s) * least.numerator // least.denominator) + 1
    if not len(hashes):
        return s[:k]
    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    rank = np.where(hashes[at] == s, ranks[at], -1)
    return s[np.argsort(rank, kind="stable")[:k]]


def shingled(docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """doc_id, text_hash, point, n (the set's size), its fingerprint, mask and prefix of every row."""
    common = common_shingles(docs, words)
    order = np.argsort(common)
    hashes, ranks = common[order], order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingle_set(t, words) for t in texts_of(b.column(2))]
            firsts = [prefix(s, least, hashes, ranks).tobytes() if len(s) else b"" for s in sets]
            columns = [b.column(0), b.column(1), *(pa.array([f(s) for s in sets], pa.int64()) for f in (point_of, len, simhash_of))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([mask_of(s) for s in sets], pa.binary()), pa.array(firsts, pa.binary())], names=["doc_id", "text_hash", "point", "n", "fp", "mask", "prefix"])

    return texts(docs).mapInArrow(released(run), "doc_id long, text_hash long, point long, n long, fp long, mask binary, prefix binary")


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        columns = [np.asarray(c) for c in b.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
        if cut or (held and held[-1][0][0] != columns[0][-1]):
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """shingle, members (of the group), point, n, hub, hub_n of the members of every group of two points or more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            firsts = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            if firsts:
                sizes = [len(x) for x in firsts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), *(pa.array(np.repeat(np.asarray(b.column(i)), sizes)) for i in (0, 1))], names=["shingle", "point", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, point, n in by_group(batches):
            first = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (point[1:] != point[:-1])))  # copies of a set once
            shingle, point, n = shingle[first], point[first], n[first]
            starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
            sizes = np.diff(np.append(starts, len(shingle)))
            hub, more = np.repeat(starts, sizes), np.repeat(sizes, sizes) > 1
            if more.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in (shingle, np.repeat(sizes, sizes), point, n, point[hub], n[hub])], names=["shingle", "members", "point", "n", "hub", "hub_n"])

    rows = sets.filter("n > 0").select("point", "n", "prefix").mapInArrow(released(cut), "shingle long, point long, n long")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "point").mapInArrow(released(meet), "shingle long, members long, point long, n long, hub long, hub_n long")


def near_masks(n: np.ndarray, masks: list[bytes], least: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of sets whose sizes and masks allow the likeness, in blocks; each pair once, in either order."""
    for x, y, _ in likely_masks(n, masks, least):
        yield x, y


def likely_masks(n: np.ndarray, masks: list[bytes], least: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of ``near_masks``, and the most that their likeness can be.

    Such sizes differ by a quarter at most, so masks of one length meet those of the same and of twice the length.
    """
    width = np.array([len(m) // 8 for m in masks])
    for w in np.unique(width):
        own, more = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        x = np.frombuffer(b"".join(masks[i] for i in own), np.uint64).reshape(-1, w)
        y = np.frombuffer(b"".join(masks[i] for i in more), np.uint64).reshape(-1, 2, w)
        both, y = np.concatenate((own, more)), np.concatenate((x, y[:, 0] ^ y[:, 1]))
        step = max(1, BLOCK_PAIRS // (len(both) * w))
        for at in range(0, len(own), step):
            d = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
            total = n[own[at : at + step], None] + n[None, both]
            once = np.arange(at, min(len(own), at + step))[:, None] < np.arange(len(both))[None, :]
            i, j = np.nonzero(once & ((total - d) * least.denominator >= (total + d) * least.numerator))
            d, total = d[i, j], total[i, j]
            yield own[i + at], both[j], (total - d) / (total + d)


def likeliest(a: np.ndarray, b: np.ndarray, likeness: np.ndarray, most: int) -> np.ndarray:
    """Whether a pair of labels is among the ``most`` likeliest of one of the two."""
    label, score = np.concatenate((a, b)), np.concatenate((likeness, likeness))
    order = np.lexsort((-score, label))
    starts = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1])))
    keep = np.zeros(len(label), bool)
    keep[order] = np.arange(len(label)) - np.repeat(starts, np.diff(np.append(starts, len(label)))) < most
    return keep[: len(a)] | keep[len(a) :]


def other_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame, least: Fraction, most: int | None = None, first: bool = True) -> DataFrame:
    """a, b, more: the pairs of a group without its hub that are not one component and may have the likeness.

    Groups of up to SMALL members give their pairs, the ``first`` time. Larger ones are cut into tiles of about
    TILE members; two tiles meet in a task, where the masks decide which pairs leave it, so no group's pairs are
    written out. With ``most``, only the likeliest so many of each component leave a tile; more: it has others.
    A pair leaves one of its groups only, that of the least shingle that both prefixes hold.
    """

    def small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, point, n, label in by_group(batches):
            starts = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
            made: list[np.ndarray] = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(shingle)]):
                p, m, k = point[lo:hi], n[lo:hi], label[lo:hi]
                i, j = np.triu_indices(len(p), 1)
                ok = (k[i] != k[j]) & (np.minimum(m[i], m[j]) * least.denominator >= np.maximum(m[i], m[j]) * least.numerator)
                made.append(np.stack((p[i[ok]], p[j[ok]])))
            if made:
                a, b = np.concatenate(made, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], names=["a", "b", "more"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, 3):
            (shingle, i, j, tile, point, n, label), masks, firsts = group[:7], group[7].tolist(), group[8].tolist()
            held: dict[int, set] = {}

            def prefix_of(at: int) -> set:
                if at not in held:
                    held[at] = set(np.frombuffer(firsts[at], np.int64).tolist())
                return held[at]

            here, more = int(shingle[0]), False
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

            def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                nonlocal best, more
                for x, y, likeness in likely_masks(n, masks, least):
                    ok = (label[x] != label[y]) & ((i[0] == j[0]) | (tile[x] != tile[y]))
                    if most is None:
                        yield x[ok], y[ok]
                    elif ok.any():
                        x, y, likeness = (np.concatenate((c, d[ok])) for c, d in zip(best, (x, y, likeness)))
                        keep = likeliest(label[x], label[y], likeness, most)
                        best, more = (x[keep], y[keep], likeness[keep]), more or not keep.all()
                yield best[:2]

            for x, y in blocks():
                ok = [k for k in range(len(x)) if min(prefix_of(int(x[k])) & prefix_of(int(y[k]))) == here]
                if ok:
                    x, y = point[x[ok]], point[y[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), more))], names=["a", "b", "more"])
                elif more:  # those that it keeps back may be its own
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([True])], names=["a", "b", "more"])

    rows = shared.filter("point <> hub").join(labels.select(F.col("fp").alias("point"), "label"), "point", "left")
    rows = rows.select("shingle", "members", "point", "n", F.coalesce("label", "point").alias("label"))
    few = rows.filter(F.col("members") <= SMALL).select("shingle", "point", "n", "label").repartition("shingle").sortWithinPartitions("shingle", "point")
    many = rows.filter(F.col("members") > SMALL)
    marks = sets.select("point", "mask", "prefix").join(many.select("point").distinct(), "point", "left_semi").dropDuplicates(["point"])
    many = many.join(marks, "point")
    count = F.ceil(F.col("members") / TILE).cast("int")
    many = many.withColumn("tile", F.pmod(F.xxhash64("point"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    many = many.select("shingle", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "point", "n", "label", "mask", "prefix")
    many = many.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    pairs = many.mapInArrow(released(tiles), "a long, b long, more boolean")
    if first:
        pairs = pairs.unionByName(few.mapInArrow(released(small_groups), "a long, b long, more boolean"))
    return pairs.groupBy("a", "b").agg(F.max("more").alias("more"))


def sets_of(points: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """point, shingles (its whole set, sorted) of ``points`` (point, rep: text_hash and doc_id of a row that has the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingle_set(t, words) for t in texts_of(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([point_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["point", "shingles"])

    asked = points.select(F.col("rep.text_hash").alias("h"), F.col("rep.doc_id").alias("d"))
    rows = texts(docs)
    rows = rows.join(asked, (rows["text_hash"] == asked["h"]) & rows["doc_id"].eqNullSafe(asked["d"]), "left_semi")
    return rows.select("text").mapInArrow(released(run), "point long, shingles binary").dropDuplicates(["point"])


def simhash_pairs(reps: DataFrame, out: str) -> DataFrame:
    """a, b: each point that the vantage-point search links, with a point of its star's centre (or of its own fingerprint)."""
    fps = written(reps.filter("n > 0").groupBy("fp").agg(F.min("point").alias("a")), f"{out}/fingerprints")
    stars = star_links(shards_of(fps.select("fp"), RADIUS, out, CAPACITY), RADIUS)
    homes = stars.groupBy("fp").agg(F.min("root").alias("root")).join(fps.select(F.col("fp").alias("root"), "a"), "root").select("fp", "a")
    homes = homes.unionByName(fps).distinct()
    return reps.filter("n > 0").select("fp", F.col("point").alias("b")).join(homes, "fp").filter("a <> b").select("a", "b")


def possible(pairs: DataFrame, reps: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and masks allow the likeness; exact, as masks never differ in more bits than the sets in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            a, b, sizes, x, y = (batch.column(i) for i in range(5))
            keep = []
            for n, s, t in zip(sizes.to_pylist(), x.to_pylist(), y.to_pylist()):
                d = apart(s, t)
                keep.append((n - d) * least.denominator >= (n + d) * least.numerator)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    for k in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("point").alias(k), F.col("n").alias(f"{k}_n"), F.col("mask").alias(f"{k}_mask")), k)
    return pairs.select("a", "b", F.col("a_n") + F.col("b_n"), "a_mask", "b_mask").mapInArrow(released(run), "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, least: Fraction, out: str) -> DataFrame:
    """fp, root: the pairs (a, b) whose whole sets have the likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for s, t in zip(x.to_pylist(), y.to_pylist()):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both * least.denominator >= (len(s) + len(t) - both) * least.numerator)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.filter(keep), a.filter(keep)], names=["fp", "root"])

    pairs = written(possible(pairs, reps, least), f"{out}-possible")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct().join(reps, "point").select("point", "rep")
    asked = written(asked, f"{out}-asked")  # Spark sees how small it is
    held = written(sets_of(asked, docs, words), f"{out}-sets")
    # The hub's side first: its rows are ids only, and leave for the other side's even spread.
    one = pairs.join(held.select(F.col("point").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(held.select(F.col("point").alias("b"), F.col("shingles").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(released(run), "fp long, root long"), f"{out}-links")


def near_copies(docs: DataFrame, words: int = SHINGLE, least: float = LEAST, out: str | None = None) -> DataFrame:
    """doc_id, text_hash, point, label of every row of ``docs``; label names the component.

    Rows are linked where the Jaccard likeness of their sets of ``words``-word shingles is ``least`` or
    more; no such pair is missed. Words are cut at ASCII white space, ASCII letters in lower case; texts
    without words (null texts too) are copies of each other. An empty table gives no rows.
    """
    out, share = out or work_dir(docs.sparkSession, "jaccard"), Fraction(str(least))
    sets = written(shingled(docs, words, share), f"{out}/sets")
    reps = written(sets.groupBy("point").agg(F.min(F.struct("text_hash", "doc_id")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "mask")]), f"{out}/points")
    shared = written(shared_prefixes(sets), f"{out}/shared")
    fits = F.least("n", "hub_n") * share.denominator >= F.greatest("n", "hub_n") * share.numerator
    hubs = shared.filter("point <> hub").filter(fits).select(F.col("hub").alias("a"), F.col("point").alias("b"))
    # At most two pairs a point join most of a group of copies; later pairs inside one component are left out.
    early = simhash_pairs(reps, f"{out}/simhash").unionByName(hubs.groupBy("b").agg(F.min("a").alias("a"))).distinct()
    links = verified(early, docs, reps, words, share, f"{out}/near")
    known = components(links, f"{out}/first").select("fp", "label")
    hubs = hubs.distinct()
    for k in ("a", "b"):
        hubs = hubs.join(known.select(F.col("fp").alias(k), F.col("label").alias(f"{k}_label")), k, "left")
    hubs = hubs.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    links = links.unionByName(verified(hubs, docs, reps, words, share, f"{out}/hubs"))
    known, tested = components(links, f"{out}/second"), None
    for step, most in enumerate(ROUNDS):
        others = written(other_pairs(shared, known, sets, share, most, step == 0), f"{out}/others-{step}")
        pairs = others.filter("a IS NOT NULL").select("a", "b")
        new = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        found = verified(new, docs, reps, words, share, f"{out}/others-{step}")
        if not found.isEmpty():
            links = links.unionByName(found)
            known = components(links, f"{out}/all-{step}")
        if others.filter("more").isEmpty():
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
    label = known.withColumnRenamed("fp", "point")
    return sets.select("doc_id", "text_hash", "point").join(label, "point", "left").select("doc_id", "text_hash", "point", F.coalesce("label", "point").alias("label"))


def drop_near_copies(docs: DataFrame, words: int = SHINGLE, least: float = LEAST, out: str | None = None) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), then text hash; all columns kept."""
    return keep_first(docs, near_copies(docs, words, least, out))
