"""Very long texts by chunks, and ids that many rows share."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from statloom.llm import jaccard, licenses, orderhash, quality, simhash, sstable
from statloom.llm.common import work_dir
from statloom.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string"


def prose(r, n):
    """n bytes of words in lines, some of them long, with license phrases strewn in."""
    words = [bytes(w) for w in r.integers(97, 122, (5000, 12)).astype(np.uint8)]
    out, size = [], 0
    while size < n:
        w = words[r.integers(5000)][: r.integers(1, 12)]
        w = b"all rights reserved" if r.random() < 0.0005 else w
        out.append(w + (b"\n" if r.random() < 0.08 else b" "))
        size += len(out[-1])
    return b"".join(out)[:n]


@pytest.fixture(scope="module")
def long_text():
    return prose(np.random.default_rng(1), 9 << 20)


def model(texts):
    return quality.fit(texts, np.arange(len(texts)) % 2, steps=3)


def test_scores_do_not_depend_on_chunks(monkeypatch):
    r = np.random.default_rng(2)
    texts = [prose(r, n) for n in (3000, 10_000, 40_000)] + [b"", b"\n", b"x" * 3000, b"a\n" * 9000, b"y" * 999 + b"\n" + b"z" * 5000]
    monkeypatch.setattr(quality, "LONGEST_LINE", 700)
    m = model(texts)
    whole = m.score(texts)
    monkeypatch.setattr(quality, "LONG_CHAIN", 50)
    for most in (2000, 1 << 20):
        monkeypatch.setattr(quality.chunks, "__defaults__", (most,))
        got = np.array([m.score_long(t) for t in texts])
        assert np.abs(got[[0, 1, 2, 3, 4, 6]] - whole[[0, 1, 2, 3, 4, 6]]).max() < 1e-9
        assert np.abs(got - whole).max() < 0.02  # a run of one byte over a cut


def test_long_chains_equal_short_ones():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 5003):
        u, trans = r.normal(size=n) * 3, r.normal(size=(2, 2)) * 2
        assert np.allclose(quality.long_marginals(u, trans), quality.forward_backward(u, trans, np.array([n]))[0])


@pytest.mark.parametrize("most", [40, 700, 1 << 20])
def test_bigrams_do_not_depend_on_chunks(most):
    for text in (prose(np.random.default_rng(4), 20_000), b"", b"." * 500, b"a" * 900 + b" b", b" . " * 60 + b"x y z" * 30 + b" " * 300, "中文".encode() * 300 + b" a b"):
        values, _, n = licenses.grams_of([text])
        k, parts = licenses.long_grams(text, most)
        got = np.concatenate([v for _, v in parts])
        assert k == n[0] and (got == values).all() and [b for b, _ in parts] == np.cumsum([0, *(len(v) for _, v in parts[:-1])]).tolist()


def test_words_of_a_long_text(monkeypatch):
    text = prose(np.random.default_rng(5), 5000)
    ranges = [(0, 4), (90, 130), (100, 101), (10**6, 10**6 + 3)]
    want = licenses.words_in(text, ranges)
    monkeypatch.setattr(licenses, "CHUNK_BYTES", 100)
    assert licenses.words_in(text, ranges) == want


def test_signatures_do_not_depend_on_groups(monkeypatch):
    text = "".join(map(chr, np.random.default_rng(6).integers(97, 101, 30_000)))
    want = orderhash.signature(text)
    monkeypatch.setattr(orderhash, "GROUP", 900)
    monkeypatch.setattr(orderhash, "CHUNK", 777)
    assert (orderhash.signature(text) == want).all()


def test_fingerprints_do_not_depend_on_chunks(monkeypatch):
    text = prose(np.random.default_rng(7), 30_000).decode()
    want = np.concatenate(list(simhash.shingle_hashes(text, 4)))
    for most in (10, 1000):
        assert (np.concatenate(list(simhash.shingle_hashes(text, 4, most))) == want).all()
    for text in ("", "  ", "one", " one two  three ", "a b c d", "a b c d e"):
        assert [h.tolist() for h in simhash.shingle_hashes(text, 4, 1)] or not text.split()
        assert np.concatenate([[], *simhash.shingle_hashes(text, 4, 1)]).tolist() == np.concatenate([[], *simhash.shingle_hashes(text, 4)]).tolist()


def test_a_long_text_takes_bounded_memory(long_text):
    m, text = model([long_text[:20_000], long_text[20_000:60_000]]), long_text.decode()
    for work, most in ((lambda: m.score_long(long_text), 40), (lambda: orderhash.signature(text), 60), (lambda: licenses.long_grams(long_text), 30), (lambda: simhash.fingerprint(text), 25), (lambda: jaccard.shingle_set(text), 25)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(long_text)


def test_long_rows_through_the_operators(spark, long_text):
    text = long_text[: 5 << 20].decode()
    docs = spark.createDataFrame([(1, text), (2, "all rights reserved"), (3, text)], SCHEMA)
    got = {r["doc_id"]: r for r in licenses.license_labels(docs).collect()}
    w = licenses.words_of(text.encode())
    at = [i for i in range(len(w)) if w[i : i + 3] == [b"all", b"rights", b"reserved"]]
    assert got[1]["n_words"] == len(w) and got[1]["n_base"] == len(at) == got[3]["n_base"] and (got[1]["first_word"], got[1]["last_word"]) == (at[0], at[-1])
    assert len({r["score"] for r in quality.score(docs, model([text.encode()[:9000]])).collect() if r["doc_id"] != 2}) == 1
    assert len({r["fp"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] != 2}) == 1


@pytest.mark.parametrize("texts", [5000, 1])
def test_many_rows_of_one_id(spark, texts, monkeypatch):
    """Null ids of a third of the rows and more: every row comes out, and no task has most of them."""
    monkeypatch.setattr(sstable, "HOT_ROWS", 1000)
    rows = [(None, f"text {i % texts} of many") for i in range(6000)] + [(i, f"own text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = orderhash.fingerprint_documents(docs, 8)
    sizes = got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == len(rows) and (texts == 1 or max(sizes) < 2500)
    path = tokenizer_file("byte_bpe_50k.json")
    out = work_dir(spark, "t")
    manifest = sstable.write_shards(docs, out, path, 0)
    back = sstable.read_shards(manifest).collect()
    from statloom.llm.tokens import Encoder

    enc = Encoder(path, False)
    want = Counter((d, zlib.crc32(np.frombuffer(enc._library(t) + enc.number(0), enc.dtype).astype("<u4").tobytes())) for d, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in back) == want
    back.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in back]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    keys = [k for r in sorted(manifest.collect(), key=lambda r: (r["part"], r["seq"])) for k, _ in sstable.Shard(r["path"])]
    assert keys == sorted(set(keys)) and len(keys) == len(rows)
