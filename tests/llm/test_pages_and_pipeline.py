import hashlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from statloom.llm import queries, warc
from statloom.llm.common import work_dir

ROOT = Path(__file__).resolve().parents[2]
BIG = "<html>" + "é" * 80 + "</html>"
PAGES = [
    (5, "https://www.Example.com/a?x=1", BIG), (2, "http://example.com:8080/b", BIG), (9, "http://sub.example.org/", BIG), (1, "http://a.b/c", "small"), (3, "http://a.b/d", "small"),
    (4, None, None), (6, "", ""), (7, "not a url\r\nat all", "x" * 100), (8, "http://[bad/", "x" * 100), (7, "not a url\r\nat all", "x" * 100), (None, "http://a.b/c", BIG), (10, "http://a.b/c", "third visit " * 20), (11, "http://a.b/cc", "other"),
]
SCHEMA = "page_id long, url string, html string"


def test_records_come_back(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in warc.archived(pages).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = min((j for j, _, g in PAGES if g == h and j is not None), default=None)
        revisit = len(b) >= 100 and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_lookups(spark):
    out = work_dir(spark, "t")
    index = warc.CaptureIndex(warc.write_index(warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).repartition(3), out), out))
    visits = index.fetch("http://A.B/c")
    assert sorted(f.get("x-page-id", "") for f, _, _ in visits) == ["", "1", "10"]
    assert {p.decode() for f, _, p in visits if f["warc-type"] == "response"} == {"small", "third visit " * 20}
    assert [p.decode() for _, _, p in index.fetch("http://example.com:8080/b")] == [BIG]
    assert index.fetch("http://nowhere.example/") == []


def test_extra_columns_and_no_rows(spark):
    from pyspark.sql import functions as F

    extra = spark.createDataFrame(PAGES, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("digest", "salt", "first", "n", "path", "offset")])
    assert warc.archived(extra).count() == len(PAGES)
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("url, key", [("http://www.Example.com/a?b=c", "com,example,www)/a?b=c"), ("https://x.y:444", "y,x:444)/"), (None, ")/"), ("http://x.y:80/z", "y,x)/z")])
def test_surt(url, key):
    assert warc.surt(url) == key


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op6_warc"]).df().sort_values("page_id").reset_index(drop=True)
    got = queries.QUERIES["op6_warc"](spark, d).toPandas().sort_values("page_id").reset_index(drop=True)[list(want.columns)]
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        out = f"{work_dir(spark, 'stage')}/x"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    rows = corpus_pipeline.run(spark, d)
    assert rows.select("doc_id").distinct().count() == counts[3]
    per = rows.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] == 4096 for r in per) >= len(per) - 1
    assert "pipeline" in __import__("__spark_entry__").queries()


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op2_mixing", "op6_warc"}))
def test_columns_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES[name](spark, d).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """Row numbers that stay when chains of Jaccard 0.8 or more keep their smallest doc_id."""
    sets = [five_words(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {min((rows[i][0], i) for i in range(len(rows)) if group[i] == g)[1] for g in set(group)}


def test_pipeline_rows_against_brute_force(spark):
    """run()'s rows by plain loops: score, compare all pairs, encode; every id of every document left lies in one piece."""
    import zlib

    import numpy as np

    from statloom.llm import quality
    from statloom.llm.tokens import Encoder

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score([(r["text"] or "").encode()])[0] >= quality.THRESHOLD]
    left = [good[i] for i in one_of_each(good)]
    enc = Encoder(queries.tokenizer_file("word_bpe_49k.json"), False)
    want = {}
    for i, t in left:
        want[i] = np.frombuffer(enc._library(t or "") + enc.number(2), enc.dtype).astype("<u4")
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(left) < len(good)
    at = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert zlib.crc32(ids[r["start"] : at[r["doc_id"]]].tobytes()) == r["ids_crc32"]
    assert all(at[i] == len(ids) for i, ids in want.items())
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    total = 0
    for q, o, n in places:
        assert q * 4096 + o == total
        total += n


def test_pipeline_takes_odd_tables(spark, clashing, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    path = f"{work_dir(spark, 'labels')}"
    labels.write.parquet(f"{path}/labels.parquet")
    for docs in (clashing, nothing):
        now, ids = docs, None
        for name, stage in corpus_pipeline.STAGES:
            before = sorted(map(str, (r["doc_id"] for r in now.select("doc_id").collect())))
            now = stage(spark, now, path)
            ids = sorted(map(str, (r["doc_id"] for r in now.select("doc_id").collect())))
            if name == "packing":
                assert set(ids) == set(before)
            elif name == "mixing":
                assert ids == before and now.columns == docs.columns
            else:
                assert set(ids) <= set(before) and now.columns == docs.columns
        assert bool(ids) == (docs is clashing)


def test_nothing_else_needs_this_subpackage(tmp_path):
    """Without the folder the entry still imports and registers the other queries."""
    for p in ("__spark_entry__.py", "statloom"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    import shutil

    shutil.copytree(ROOT / "statloom", tmp_path / "statloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ols_by_group' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), q; assert 'pipeline' not in e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").unlink()
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
