"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are byte-class shares, lengths and repetition of the line and of
the lines before and behind it; transition weights join neighbouring labels. Forward-backward gives each
line's marginal probability of being good, and a document's score is their mean weighted by line length.
Training: a line inherits its document's label; the regularised likelihood is maximised on the driver on a
bounded sample of labelled documents. Scoring is a map over the documents, vectorised by line and, in the
recursions, by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolled, bounded_batches, free_names, mix64, released, slices

#: Labelled documents that a model is fitted on at most; chosen by a hash of doc_id, so spread over the table.
SAMPLE_DOCS = 4000
#: And bytes of their texts at most.
SAMPLE_BYTES = 32 << 20
#: A document with this score or more is good.
THRESHOLD = 0.3

#: Byte classes: 0 lower-case, 1 upper-case, 2 digits, 3 blanks, 4 full stops and commas, 5 "!" and "?", 6 "|", 7 other marks, 8 lead and 9 following bytes of other characters, 10 control bytes.
CLASSES = 11
_CLASS = np.full(256, 10, np.int64)
_CLASS[33:127] = 7
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[32, 9]] = 3
_CLASS[[ord("."), ord(",")]] = 4
_CLASS[[ord("!"), ord("?")]] = 5
_CLASS[ord("|")] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9


#: Bytes at which a line is cut: the parts of a longer one count as lines. Text bytes featurised at once.
LONGEST_LINE, CHUNK_BYTES = 1 << 18, 1 << 19
#: Chains of more lines are scored in blocks side by side.
LONG_CHAIN = 4096


@dataclass
class Lines:
    own: np.ndarray  # features of a line itself, without those of its repetition in the document
    key: np.ndarray  # a hash of the line
    size: np.ndarray  # bytes by line
    count: np.ndarray  # lines by document, 1 at least

    @property
    def x(self) -> np.ndarray:
        """All features by line: its own and those of the lines before and behind it in the document."""
        own, (edge_before, edge_behind) = self.repeated(), edges(self.count)
        before, behind = np.roll(own, 1, 0), np.roll(own, -1, 0)
        before[edge_before], behind[edge_behind] = 0, 0
        return np.column_stack((np.ones(len(own)), own, before, behind, edge_before, edge_behind))

    def repeated(self) -> np.ndarray:
        """``own`` with a last column: 1 for a line that its document has had before."""
        doc = np.repeat(np.arange(len(self.count)), self.count)
        with np.errstate(over="ignore"):
            key = mix64(self.key + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        return np.column_stack((self.own, ~first & (self.size > 0)))


def edges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the first and the last of their document."""
    before, behind, last = np.zeros(count.sum(), bool), np.zeros(count.sum(), bool), np.cumsum(count)
    before[np.concatenate(([0], last[:-1]))] = True
    behind[last - 1] = True
    return before, behind


def line_ends(buf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of lines: at line feeds, at LONGEST_LINE bytes, and at the texts' ``last`` bytes, line feeds all."""
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    while (long := np.flatnonzero(ends - starts > LONGEST_LINE)).size:
        cuts = starts[long] + LONGEST_LINE
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends


def line_features(texts: list[bytes]) -> Lines:
    """Features of all lines of ``texts``; an empty text is one empty line. Temporaries: about 90 bytes a byte, for texts of CHUNK_BYTES or less."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    last = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts, ends = line_ends(buf, last)
    size, n = ends - starts, len(ends)
    count = np.diff(np.concatenate(([0], np.searchsorted(ends, last, side="right"))))
    line = np.repeat(np.arange(n), np.diff(starts, append=len(buf)))
    cls = _CLASS[buf]
    shares = np.bincount(line * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    shares[:, 10] -= buf[ends] == 10  # the line feed itself
    blanks = shares[:, 3].copy()
    shares /= np.maximum(size, 1)[:, None]
    part = Rolled(buf)
    key = mix64(part(starts, ends))
    # Neighbouring bytes: a change of case inside a word, a mark beside a letter, the same byte thrice.
    inner = np.zeros((n, 3))
    a, b = cls[:-1], cls[1:]
    same = (buf[1:] == buf[:-1]) & (buf[1:] != 10)
    thrice = np.zeros(len(same), bool)
    thrice[:-1] = same[:-1] & same[1:]
    for k, hit in enumerate(((a == 0) & (b == 1), (a <= 1) & (b >= 5) & (b <= 7), thrice)):
        inner[:, k] = np.bincount(line[:-1][hit], minlength=n)
    inner /= np.maximum(size, 1)[:, None]
    # Words that repeat the word before them in the line.
    gaps = np.flatnonzero((cls == 3) | (buf == 10))
    begin = np.concatenate(([0], gaps[:-1] + 1))
    word = part(begin, gaps)
    told = np.flatnonzero((word[1:] == word[:-1]) & (gaps[1:] > begin[1:]) & (buf[gaps[:-1]] != 10)) + 1
    words = blanks + 1
    echo = np.bincount(line[gaps[told]], minlength=n) / words
    own = np.column_stack((shares, np.sqrt(shares[:, [1, 2, 5, 6, 7]]), inner, np.sqrt(inner), echo, np.sqrt(echo), np.log1p(size) / 5, np.log1p(size / words), size == 0))
    return Lines(own, key, size, count)


def chunks(text: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end where lines do; the line feed between two parts is left out."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(b"\n", at, at + most)
        if cut < 0:
            cut = text.find(b"\n", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def pieces(text: bytes) -> Iterator[bytes]:
    """``chunks``, and a line without end in parts of LONGEST_LINE bytes, as line_ends cuts it."""
    for c in chunks(text):
        yield from (c[i : i + LONGEST_LINE] for i in range(0, max(len(c), 1), LONGEST_LINE)) if len(c) > 2 * CHUNK_BYTES and b"\n" not in c else (c,)


def chain_layout(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling number of lines, their first lines, and how many documents have a line t."""
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    alive = np.searchsorted(-count[order], -np.arange(count.max()), side="left")
    return order, first, alive


def forward_backward(u: np.ndarray, trans: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of "good" by line, expected transition counts, and the sum of log partition functions.

    u: log-odds of good by line; trans[i, j]: weight of label j behind label i. All chains advance together.
    """
    _, first, alive = chain_layout(count)
    # Factors of at most 1 keep the recursions in range for any weights.
    top = np.maximum(u, 0)
    e = np.exp(np.column_stack((-top, u - top)))
    k = np.exp(trans - trans.max())
    f, back, log_z = np.empty((len(u), 2)), np.empty((len(u), 2)), float(top.sum()) + trans.max() * (len(u) - len(count))
    steps = len(alive)
    for t in range(steps):
        at = first[: alive[t]] + t
        m = e[at] if not t else (f[at - 1] @ k) * e[at]
        z = np.maximum(m.sum(1), 1e-300)
        f[at] = m / z[:, None]
        log_z += float(np.log(z).sum())
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        n, at = alive[t], first[: alive[t]] + t
        more = alive[t + 1] if t + 1 < steps else 0
        back[at[more:]] = 1
        if more:
            nxt = at[:more] + 1
            g = back[nxt] * e[nxt]
            m = g @ k.T
            z = np.maximum((f[at[:more]] * m).sum(1), 1e-300)
            pairs += k * ((f[at[:more]] / z[:, None]).T @ g)
            back[at[:more]] = m / np.maximum(m.sum(1), 1e-300)[:, None]
    p = f * back
    return p[:, 1] / np.maximum(p.sum(1), 1e-300), pairs, log_z


def swept(e: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Messages from the left at every place of one long chain, before its own factor e, up to a scale.

    Blocks of the chain advance side by side from both labels at their edge; as messages are linear in the
    edge's, the edges' own then follow from block to block. Steps: the root of the chain, twice.
    """
    n = len(e)
    b = max(1, math.isqrt(n))
    rows = -(-n // b)
    e = np.concatenate((e, np.ones((rows * b - n, 2)))).reshape(rows, b, 2)
    m = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()  # by block: label at the edge, label here
    scale, made, logs = np.zeros((rows, 2)), np.empty((rows, b, 2, 2)), np.empty((rows, b, 2))
    for t in range(b):
        made[:, t], logs[:, t] = m, scale
        m = (m * e[:, t, None, :]) @ k
        z = np.maximum(m.sum(2), 1e-300)
        m, scale = m / z[:, :, None], scale + np.log(z)
    edge, out = np.ones(2) / 2, np.empty((rows, b, 2))
    for r in range(rows):
        start = np.log(np.maximum(edge, 1e-300))
        w = start + logs[r]
        out[r] = np.einsum("ts,tsj->tj", np.exp(w - w.max(1, keepdims=True)), made[r])
        w = start + scale[r]
        edge = np.exp(w - w.max()) @ m[r]
        edge = edge / edge.sum()
    return out.reshape(-1, 2)[:n]


def long_marginals(u: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Marginals of "good" along one long chain, as forward_backward gives them."""
    top = np.maximum(u, 0)
    e = np.exp(np.column_stack((-top, u - top)))
    k = np.exp(trans - trans.max())
    p = swept(e, k) * e * swept(e[::-1], k.T)[::-1]
    return p[:, 1] / np.maximum(p.sum(1), 1e-300)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray

    def odds(self, own: list[np.ndarray], before: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Log-odds of good by line from the lines' own features, in parts; the standardised features times the weights."""
        w = self.weights / self.scale
        d = (len(w) - 3) // 3
        a, b, c = (np.concatenate([o @ w[1 + i * d : 1 + (i + 1) * d] for o in own]) for i in range(3))
        u = a + w[0] - self.mean @ w + np.where(before, w[-2], np.roll(b, 1)) + np.where(behind, w[-1], np.roll(c, -1))
        return u

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Documents' mean probability of good lines, weighted by length (an empty line counts as one byte)."""
        if not texts:
            return np.zeros(0)
        lines = line_features(texts)
        u = self.odds([lines.repeated()], *edges(lines.count))
        p, w = forward_backward(u, self.trans, lines.count)[0], lines.size + 1.0
        at = np.cumsum(lines.count) - lines.count
        return np.clip(np.add.reduceat(p * w, at) / np.add.reduceat(w, at), 0, 1)

    def score_long(self, text: bytes) -> float:
        """``score`` of one text of any length: features by chunks of lines, of which log-odds, sizes and hashes stay."""
        sizes, keys, odds = [], [], []
        w = self.weights / self.scale
        d = (len(w) - 3) // 3
        parts = w[1 : 1 + 3 * d].reshape(3, d)
        for chunk in pieces(text):
            lines = line_features([chunk])
            sizes.append(lines.size)
            keys.append(lines.key)
            odds.append(lines.own @ parts[:, :-1].T)
        size, key, abc = np.concatenate(sizes), np.concatenate(keys), np.concatenate(odds)
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        abc += (~first & (size > 0))[:, None] * parts[:, -1]
        u = abc[:, 0] + w[0] - self.mean @ w
        u[1:] += abc[:-1, 1]
        u[:-1] += abc[1:, 2]
        u[0] += w[-2]
        u[-1] += w[-1]
        p = long_marginals(u, self.trans) if len(u) > LONG_CHAIN else forward_backward(u, self.trans, np.array([len(u)]))[0]
        return float(np.clip((p * (size + 1.0)).sum() / (size + 1.0).sum(), 0, 1))


def fit(texts: list[bytes], good: np.ndarray, steps: int = 120, ridge: float = 2e-3, rate: float = 0.15) -> Model:
    """Maximise the lines' mean conditional log-likelihood less a ridge penalty, by Adam on full gradients."""
    if not texts:
        empty = line_features([b""]).x.shape[1]
        return Model(np.zeros(empty), np.ones(empty), np.zeros(empty), np.zeros((2, 2)))
    # By slices, in single precision: the driver holds about 400 bytes a line of the sample.
    made = [line_features(texts[i:j]) for i, j in slices(map(len, texts), 1 << 20)]
    count = np.concatenate([m.count for m in made])
    x = np.concatenate([m.x.astype(np.float32) for m in made])
    del made
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float)
    mean[0], scale[scale < 1e-6] = 0, 1
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    y = np.repeat(good.astype(float), count)
    n, d = x.shape
    inner = np.ones(n, bool)
    inner[np.cumsum(count) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
    theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    for t in range(1, steps + 1):
        p, pairs, _ = forward_backward((x @ theta[:d].astype(np.float32)).astype(float), theta[d:].reshape(2, 2), count)
        grad = np.concatenate((x.T @ (y - p).astype(np.float32), (seen - pairs).ravel())) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(mean, scale, theta[:d], theta[d:].reshape(2, 2))


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled documents and ``most`` bytes outside the held-out fold, spread by a hash of doc_id.

    Labels that are null or of unknown documents, and held-out ones, are left out, as are texts of more than
    CHUNK_BYTES; of rows that repeat a doc_id one is taken. Without any label every document scores 0.5.
    Sizes are chosen from ids and lengths; only the chosen texts reach the driver.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).filter(F.col("n") <= CHUNK_BYTES)
    one = sized.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "n")).alias("m")).select("doc_id", "quality", "m.h", "m.n", F.xxhash64("doc_id").alias("at"))
    kept, size = [], 0
    for r in sorted(one.collect(), key=lambda r: (r["at"], r["doc_id"])):
        size += r["n"]
        if size > most:
            break
        kept.append((r["doc_id"], r["h"], r["quality"]))
    if not kept:
        return fit([], np.zeros(0))
    asked = spark.createDataFrame(kept, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, quality int")
    found = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(asked), ["doc_id", "h"]).dropDuplicates(["doc_id"])
    got = sorted((r["doc_id"], r["text"].encode("utf-8", "surrogatepass"), r["quality"]) for r in found.collect())
    return fit([t for _, t, _ in got], np.array([q for _, _, q in got]))


def score(docs: DataFrame, model: Model, output: str = "score") -> DataFrame:
    """``docs`` with a column of scores; null texts are empty, and an empty text gets the score of one empty line."""
    spark = docs.sparkSession
    bounded_batches(spark)
    told = spark.sparkContext.broadcast(model)  # a few hundred numbers
    names = list(docs.columns)
    (temp,) = free_names(docs, "score_text")

    def scored(texts: list[bytes]) -> np.ndarray:
        out, model = np.empty(len(texts)), told.value
        long = [i for i, t in enumerate(texts) if len(t) > CHUNK_BYTES or t.count(b"\n") >= LONG_CHAIN]
        for i in long:
            out[i] = model.score_long(texts[i])
        rest = sorted(set(range(len(texts))) - set(long))
        for i, j in slices((len(texts[r]) for r in rest), CHUNK_BYTES):
            out[rest[i:j]] = model.score([texts[r] for r in rest[i:j]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scored(texts), pa.float64())], names=[*names, output])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())])
    return docs.withColumn(temp, F.col("text")).mapInArrow(released(run), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; scores see the text alone.

    Null and empty texts are one empty line and have its score; a null doc_id is not held out; equal texts
    have equal scores, repeated rows a row each; texts of any length are scored whole, by chunks; an empty
    table gives no rows. Only doc_id and text are read of ``docs``.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts good, all columns kept; nulls, repeats and long texts as in ``classify``."""
    (s,) = free_names(docs, "score")
    return score(docs, train(docs, labels, sample), s).filter(F.col(s) >= threshold).drop(s)
