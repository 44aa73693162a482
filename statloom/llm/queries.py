"""The queries of this subpackage, with their production parameters, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file (never copied into this repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=2, window=4096, temperature=0.5)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import token_shards

    return token_shards(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=50256)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import schedule

    return schedule(documents(spark, sf_dir), temperature=0.5, prefix="").select("doc_id", "source", "size", "begin", "block", "release", "deadline", "slot")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import stored_media

    return stored_media(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_labels

    return license_labels(documents(spark, sf_dir)).drop("spans")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orderhash import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Columns of an operator's result that SQL can express, held against it.
def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def token_count_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_token_counts(spark, sf_dir).select("doc_id", "n_chars")


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_media": op4_media,
    "op5_licenses": op5_licenses,
    "op6_warc": op6_warc,
    "op7_order_minhash": op7_order_minhash,
    "op8_simhash": op8_simhash,
    "op9_token_shards": op9_token_shards,
    "op10_token_counts": op10_token_counts,
    "media_payloads": media_payloads,
    "license_base": license_base,
    "fingerprint_edits": fingerprint_edits,
    "token_count_chars": token_count_chars,
}

#: The schedule slot by slot: a "plan" step deals the parts of 1,000 to the sources that have blocks left, a
#: "take" step gives the slot to the released block with the earliest deadline. 65536 characters a block.
MIXING_SQL = """
    WITH RECURSIVE d AS (
        SELECT doc_id, source, coalesce(source, '') AS s, CAST(greatest(coalesce(length(text), 0), 1) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents
    ),
    placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY s ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS begin FROM d),
    src AS (SELECT s, CAST(ceil(sum(size) / 65536.0) AS BIGINT) AS n, sqrt(CAST(sum(size) AS DOUBLE)) AS w FROM d GROUP BY 1),
    run AS (
        SELECT list({'s': s, 'w': w, 'n': n, 'taken': CAST(0 AS BIGINT), 'part': CAST(0 AS BIGINT), 'done': CAST(0 AS BIGINT)} ORDER BY s) AS st,
               true AS planning, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t0, CAST(NULL AS VARCHAR) AS s, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS deadline
        FROM src
        UNION ALL
        SELECT
            CASE WHEN planning THEN list_transform(sized, lambda x: {'s': x.s, 'w': x.w, 'n': x.n, 'taken': x.taken, 'part': CASE WHEN x.taken < x.n THEN x.base + CAST(len(list_filter(sized, lambda y: y.taken < y.n AND (y.base - y.exact < x.base - x.exact OR (y.base - y.exact = x.base - x.exact AND y.s < x.s)))) < 1000 - base_sum AS BIGINT) ELSE 0 END, 'done': CAST(0 AS BIGINT)})
                 WHEN blocked THEN st
                 ELSE list_transform(st, lambda x: {'s': x.s, 'w': x.w, 'n': x.n, 'taken': x.taken + CAST(x.s = pick.s AS BIGINT), 'part': x.part, 'done': x.done + CAST(x.s = pick.s AS BIGINT)}) END,
            NOT planning AND blocked,
            CASE WHEN planning OR blocked THEN slot ELSE slot + 1 END,
            CASE WHEN planning THEN slot ELSE t0 END,
            CASE WHEN planning OR blocked THEN NULL ELSE pick.s END,
            CASE WHEN planning OR blocked THEN NULL ELSE pick.taken END,
            CASE WHEN planning OR blocked THEN NULL ELSE t0 + pick.done * 1000 // pick.part END,
            CASE WHEN planning OR blocked THEN NULL ELSE t0 + pick.d END
        FROM (
            SELECT *, coalesce(pick.taken >= pick.n, false) AS blocked, list_sum(list_transform(list_filter(sized, lambda x: x.taken < x.n), lambda x: x.base)) AS base_sum
            FROM (
                SELECT *,
                    list_transform(st, lambda x: {'s': x.s, 'w': x.w, 'n': x.n, 'taken': x.taken, 'exact': x.w / total * 1000, 'base': CAST(greatest(1, floor(x.w / total * 1000)) AS BIGINT)}) AS sized,
                    list_min(list_transform(list_filter(st, lambda x: x.part > 0 AND x.done * 1000 // greatest(x.part, 1) <= slot - t0), lambda x: {'d': ((x.done + 1) * 1000 + x.part - 1) // x.part, 's': x.s, 'taken': x.taken, 'n': x.n, 'done': x.done, 'part': x.part})) AS pick
                FROM (SELECT st, planning, slot, t0, list_sum(list_transform(list_filter(st, lambda x: x.taken < x.n), lambda x: x.w)) AS total FROM run WHERE len(list_filter(st, lambda x: x.taken < x.n)) > 0)
            )
        )
    )
    SELECT p.doc_id, p.source, p.size, p.begin, r.block, r.release, r.deadline, r.slot - 1 AS slot
    FROM placed p JOIN run r ON p.s = r.s AND p.begin // 65536 = r.block
"""

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": MIXING_SQL,
    "media_payloads": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents), p AS (SELECT *, greatest(1, (n + 191) // 192) * 192 AS m FROM d)
        SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', m - n)) AS payload_sha256 FROM p
    """,
    "license_base": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        p AS (
            SELECT doc_id, len(w) AS n,
                list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS a,
                list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS b,
                list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS c
            FROM w
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) AS n_base, CAST(list_min(a || b || c) - 1 AS BIGINT) AS first_word, CAST(list_max(a || b || c) - 1 AS BIGINT) AS last_word,
            concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels
        FROM p
    """,
    "fingerprint_edits": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
        SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 4) || left(following, n // 4)) AS edited_sha256 FROM f
    """,
    "token_count_chars": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
}
