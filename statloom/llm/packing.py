"""Mixture-controlled packing by deficit round-robin over one queue per source.

Every round gives each source's deficit counter its quantum, a share of one window's tokens by the
target weights, and the source sends as many whole tokens as the counter holds; what is left is carried
into the next round. A source with a small share (below 1 / RUNS of a window) saves up for a whole run of
window / RUNS tokens, so that a document is never cut into single tokens. The rounds' tokens end to end,
cut every ``window`` tokens, are the sequences; only the very last one is not full. A source is
never further from its target than its counter: a token, or half a run, which such counters start with. A source that runs dry
leaves the round and the others share its quantum.

Counters start a round as ``carry + r * quantum``, so the round and place of any token follow from its
rank in its source by arithmetic. The driver plans the few stretches between sources running dry from
one count per source; documents never meet in one task. A document's rank is its rank in its file of
encoded documents plus what files before hold of its source, a prefix sum over (file, source) counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, released, small, texts_of, work_dir, written
from .tokens import encoded_texts, encoder, wide

#: Deficit counters count in this part of a token.
UNITS = 1 << 16
#: A source with a share below one in so many of a window sends runs of that size, not single tokens.
RUNS = 64
#: (round, source) numbers held at once while a document is placed.
ROUND_CELLS = 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@dataclass
class Stretch:
    """Rounds with the same sources: arrays by source."""

    first: int  # global place of its first token
    rounds: int
    quantum: np.ndarray  # in UNITS, 0 for sources that ran dry
    carry: np.ndarray  # in UNITS, what a counter holds before the first round
    served: np.ndarray  # tokens that sources sent before
    tokens: np.ndarray  # tokens that sources send here
    run: np.ndarray  # tokens that a source sends at once, or a multiple

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens by (round, source) that sources have sent here after so many rounds."""
        whole = np.minimum((self.carry + rounds[:, None] * self.quantum) // (self.run * UNITS) * self.run, self.tokens)
        return np.where(rounds[:, None] > 0, whole, 0)

    def round_of(self, source: int, tokens: np.ndarray) -> np.ndarray:
        """The round after which a source has sent so many whole runs' tokens."""
        c, q = int(self.carry[source]), int(self.quantum[source])
        return np.clip(-((c - tokens * UNITS) // q), 1, self.rounds)

    def sending(self, source: int, a: int, b: int) -> Iterator[np.ndarray]:
        """The rounds in which a source sends its tokens a to b here, a bounded number at once."""
        run, some = int(self.run[source]), max(1, ROUND_CELLS // len(self.run))
        if run == 1:  # every round sends
            first, last = self.round_of(source, np.array([a + 1, b])).tolist()
            for at in range(first, last + 1, some):
                yield np.arange(at, min(at + some, last + 1))
        else:  # by runs, as many rounds send nothing
            for at in range(a // run, (b - 1) // run + 1, some):
                yield np.unique(self.round_of(source, (np.arange(at, min(at + some, (b - 1) // run + 1)) + 1) * run))


def quanta(weights: np.ndarray, window: int) -> np.ndarray:
    """Quanta in UNITS that add up to one window, by largest remainders, at least 1 for a source with weight."""
    total, w = window * UNITS, np.asarray(weights, float)
    exact = w / w.sum() * total
    q = np.maximum(np.floor(exact), w > 0).astype(np.int64)
    order = np.argsort(-(exact - q), kind="stable")
    rest = int(total - q.sum())
    if rest > 0:
        q[order[:rest]] += 1
    while q.sum() > total:
        q[np.argmax(q)] -= min(q.sum() - total, q.max() - 1)
    return q


def plan(counts: list[int], weights: list[float] | None, window: int, run: int = 1) -> list[Stretch]:
    """The stretches that send all tokens. weights None: the sources' own shares, so that all end together.

    A source whose quantum is below ``run`` tokens sends whole runs only, when its counter holds one.
    """
    left = np.array(counts, np.int64)
    w = np.array(counts if weights is None else weights, float)
    if (w[left > 0] <= 0).any():
        raise ValueError("a source with tokens needs a weight above 0")
    carry, served, out, first = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), [], 0
    while left.sum():
        live = left > 0
        q = np.zeros(len(left), np.int64)
        q[live] = quanta(w[live], window)
        runs = np.where(q < run * UNITS, run, 1)
        carry = carry if out else np.where(runs > 1, run * UNITS // 2, 0)  # half a run ahead, so never more than half a run away
        carry[~live] = 0
        # Up to and with the first round in which a source runs dry; a last run may be short.
        dry = -(-left // runs) * runs * UNITS
        rounds = max(1, int((-((carry[live] - dry[live]) // q[live])).min()))
        stretch = Stretch(first, rounds, q, carry.copy(), served.copy(), left.copy(), runs)
        tokens = stretch.tokens = stretch.sent(np.array([rounds]))[0]
        out.append(stretch)
        carry = np.where(tokens < left, carry + rounds * q - tokens * UNITS, 0)
        first, left, served = first + int(tokens.sum()), left - tokens, served + tokens
    return out


def places(stretches: list[Stretch], source: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(rank in the source, length, global place) of the runs that tokens start to start + n of a source fall into."""
    for s in stretches:
        base = int(s.served[source])
        a, b = max(start - base, 0), min(start + n - base, int(s.tokens[source]))
        if a >= b:
            continue
        for rounds in s.sending(source, a, b):
            before, after = s.sent(rounds - 1), s.sent(rounds)
            place = s.first + before.sum(1) + (after - before)[:, :source].sum(1)
            begin, end = np.maximum(before[:, source], a), np.minimum(after[:, source], b)
            for x, y, p, z in zip(begin.tolist(), end.tolist(), place.tolist(), before[:, source].tolist()):
                if y > x:
                    yield x + base, y - x, p + x - z


def encoded(docs: DataFrame, tokenizer: str, end_id: int, out: str) -> DataFrame:
    """Write doc_id, source, n_tokens and ids (end id included, null texts empty) of every document below ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = enc.number(end_id)
        for batch in small(batches):
            ids = [x + end for x in encoded_texts(enc, texts_of(batch.column(1)))]
            n = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.array(ids, pa.binary())], names=["doc_id", "source", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return written(rows.mapInArrow(released(run), "doc_id long, source string, n_tokens long, ids binary"), f"{out}/encoded")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, weights: dict[str, float] | None = None, out: str | None = None, with_ids: bool = False, temperature: float = 1.0) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens; one row per piece of a document.

    weights: target shares by source; default: each source's tokens to the power ``temperature`` (1: their
    own shares, which hold to the last window). Null sources are one source "". A null text is the end id alone; null and repeated doc_ids
    are documents like any other; an empty table gives no rows. Only doc_id, text and source are read.
    with_ids adds the piece's ids as little-endian 32-bit numbers, to build the sequences from (group by
    sequence_id, order by offset). The driver holds a count and a few numbers per source.
    """
    spark = docs.sparkSession
    out = out or work_dir(spark, "pack")
    rows = encoded(docs, tokenizer, end_id, out)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("path"), "source").agg(F.sum("n_tokens").alias("n"))
    counts = written(counts, f"{out}/counts")
    totals = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    number = {s: i for i, s in enumerate(names)}
    aims = [float(totals[s]) ** temperature if weights is None else weights.get(s, 0) for s in names]
    stretches = plan([totals[s] for s in names], aims, window, max(1, window // RUNS))
    before = Window.partitionBy("source").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("source", "base"))).alias("bases"))
    files = written(files, f"{out}/files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            for path, bases in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rank = dict(bases)
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    for part in pq.ParquetFile(f).iter_batches(batch_size=256):
                        made: list[tuple] = []
                        for doc_id, source, n, ids in zip(*(part.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens", "ids"))):
                            k, first, ids = number[source], rank[source], wide(ids, dtype)
                            rank[source] = first + n
                            for r, length, place in places(stretches, k, first, n):
                                while length:
                                    here = min(length, window - place % window)
                                    piece = ids[(r - first) * 4 : (r - first + here) * 4]
                                    made.append((doc_id, r - first, here, zlib.crc32(piece), n, place // window, place % window, source, piece if with_ids else None))
                                    r, place, length = r + here, place + here, length - here
                        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
                        fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
                        k = len(fields) if with_ids else len(fields) - 1
                        if made:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*made))[:k], kinds)], names=fields[:k])

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(released(run), PIECES + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian 32-bit numbers, padded to ``window``) of pack(..., with_ids=True).

    A sequence has at most ``window`` pieces, so its group is small. A last sequence whose length is a power
    of two is not padded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    pad = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({window} - n_tokens as int))"))
    return made.select("sequence_id", "n_tokens", F.when(whole, ids).otherwise(F.concat(ids, pad)).alias("ids"))
