"""A training corpus from raw documents: drop bad documents, keep one of near duplicates, mix sources, pack.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), the DataFrame that the stage
before has written, and returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm.common import work_dir, written
from statloom.llm.jaccard import drop_near_copies
from statloom.llm.mixing import chars, mix, sources, targets
from statloom.llm.packing import pack
from statloom.llm.quality import keep_good
from statloom.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, trained on ``labels`` outside the held-out fold, finds good.

    Every row is scored by its whole text alone, so repeated rows and equal texts stay or go together. Null
    and empty texts are one empty line; a null doc_id, lang or source is kept as it is. Without labels all
    rows score 0.5 and stay; an empty table stays empty. All columns, extra ones included, pass through.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash and vantage points first, then every pair of Jaccard 0.8 or more.

    Sets of five-word shingles; groups are chains of such pairs. The smallest doc_id stays (null last), of
    equal doc_ids the smaller text hash; of rows that repeat both, one. Texts without words (null ones too)
    are one group. Texts of any length are compared whole; an empty table stays empty; all columns pass through.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that sources interleave by their target weights (characters to the power 0.5).

    No row is dropped or repeated. Null sources are one source; a null or empty text counts as one character;
    rows that repeat are interchangeable; an empty table stays empty; all columns pass through.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, shared among the sources by mixing's target weights; one row per piece of a document.

    Mixing keeps every row, so its targets follow from the rows it has written. They hold until a source runs
    dry; its share then goes to the others. Null texts are the end id alone; null and repeated doc_ids are
    documents like others; a long text is cut freely; an empty table gives no rows. Extra columns are not read.
    """
    weights = targets(sources(docs, chars()))
    return pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=2, window=4096, weights=weights)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A trained classifier decides what the later stages see, so no SQL gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = work_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"{out}/{name}")
    return docs
