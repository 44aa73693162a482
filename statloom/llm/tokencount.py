"""Token counts of documents in flat token files that have no index.

A flat file is ids end to end, each document followed by the end-of-document id. Blocks of a fixed size
are searched for that id with NumPy; a document that crosses blocks is stitched by a prefix scan over the
blocks' summaries (how many ends, where the last one is), a Spark window over one small row per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import AtomicFile, filesystem, small, texts_of, work_dir, written
from .tokens import encoded_texts, encoder

FILE_BYTES = 512 << 20
BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, out: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every document's ids and the end id to flat files below ``out``; no shuffle, a file per task or more.

    Returns doc_id, part, seq, ordinal (place in the file), n_chars: which document is the file's how-manieth.
    The counting does not look at this; it only names the documents found. Strings of special tokens inside
    a text are ordinary text, so the end id occurs at ends only. Null texts are empty: the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text=True)
        end, part, seq, file, ordinal = enc.number(end_id), TaskContext.get().partitionId(), 0, None, 0
        for batch in small(batches):
            seqs, ordinals, chars = [], [], []
            texts = texts_of(batch.column(1))
            for text, ids in zip(texts, encoded_texts(enc, texts)):
                if file is None:
                    file, ordinal = AtomicFile(f"{out}/flat/part-{part:06d}-{seq:04d}.u{enc.dtype.itemsize}"), 0
                file.write(ids + end)
                seqs.append(seq)
                ordinals.append(ordinal)
                chars.append(len(text))
                ordinal += 1
                if file.size >= file_bytes:
                    file.close()
                    file, seq = None, seq + 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * n, pa.int32()), pa.array(seqs, pa.int32()), pa.array(ordinals, pa.int64()), pa.array(chars, pa.int64())], names=["doc_id", "part", "seq", "ordinal", "n_chars"])
        if file is not None:
            file.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "doc_id long, part int, seq int, ordinal long, n_chars long"), f"{out}/names")


def scan_flat(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents of flat files: part, seq, ordinal, start (ids before it in the file), n_tokens (with the end id).

    files: part, seq, path, n_bytes; the ending of the path (.u2 or .u4) gives the bytes of an id. Ids behind
    a file's last end are no document and are left out, as a writer that was stopped leaves them.
    """
    if block_bytes % 4:
        raise ValueError("block_bytes must be a multiple of 4")
    blocks = files.filter("n_bytes > 0").select("part", "seq", "path", "n_bytes", F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {block_bytes}L)")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, path, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = filesystem(path)
                item = int(path[-1])
                with fs.open_input_file(at) as f:
                    data = f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                ids = np.frombuffer(data[: len(data) // item * item], f"<u{item}")
                ends = np.flatnonzero(ids == end_id) + block * (block_bytes // item)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["part", "seq", "block", "ends"])

    n = max(1, blocks.agg(F.count(F.lit(1))).first()[0])
    found = blocks.repartition(min(n, 100_000)).mapInArrow(run, "part int, seq int, block long, ends array<long>")
    before = Window.partitionBy("part", "seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "part", "seq", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("last_end"),
    )
    starts = F.concat(F.array("last_end"), F.expr("slice(ends, 1, size(ends) - 1)"))
    each = scanned.filter(F.size("ends") > 0).select("part", "seq", "docs_before", F.posexplode(F.arrays_zip(starts.alias("prev"), F.col("ends").alias("end"))).alias("i", "at"))
    return each.select("part", "seq", (F.col("docs_before") + F.col("i")).alias("ordinal"), (F.col("at.prev") + 1).alias("start"), (F.col("at.end") - F.col("at.prev")).alias("n_tokens"))


def flat_files(spark: SparkSession, out: str) -> DataFrame:
    """The flat files below ``out`` (a row each, listed on the driver), as scan_flat() takes them."""
    fs, at = filesystem(f"{out}/flat")
    rows = []
    for f in sorted(fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)), key=lambda f: f.path):
        if m := re.fullmatch(r"part-(\d+)-(\d+)\.u[24]", f.base_name):
            rows.append((int(m[1]), int(m[2]), f"{out}/flat/{f.base_name}", f.size))
    return spark.createDataFrame(rows, "part int, seq int, path string, n_bytes long")


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None) -> DataFrame:
    """Write ``docs`` to flat files, scan them, and name each document found: doc_id, n_chars, n_tokens.

    One row per input row (null and repeated doc_ids too); an empty table gives none.
    """
    spark = docs.sparkSession
    out = out or work_dir(spark, "flat")
    names = write_flat(docs, out, tokenizer, end_id)
    found = scan_flat(flat_files(spark, out), end_id)
    # What a scanned block holds once taken apart is more than Spark would guess: never broadcast it.
    return names.hint("merge").join(found, ["part", "seq", "ordinal"]).select("doc_id", "n_chars", "n_tokens")
