import random

import numpy as np

import corpus_pipeline
from statloom.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Position -> smallest position reachable by pairs of Jaccard 0.8 or more; texts without words are equal."""
    sets = [shingles(t) for t in texts]
    near = np.array([[(5 * len(a & b) >= 4 * len(a | b)) for b in sets] for a in sets])
    lab = np.arange(len(sets))
    while not ((new := np.where(near, lab[None, :], len(sets)).min(1)) == lab).all():
        lab = new
    return lab


def corpus(seed):
    """Edited copies around 0.8, a common passage in every text, a large tight group, short, empty and null texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(25)]
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for _ in range(40):
        base = passage + [word() for _ in range(r.randint(40, 160))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            now = list(base)
            for _ in range(r.randint(1, 6)):
                now[r.randrange(len(now))] = word()
            texts.append(" ".join(now))
    base = [word() for _ in range(150)]
    for i in range(80):
        now = list(base)
        now[r.randrange(150)] = f"edit{i}"
        texts.append(" ".join(now))
    r.shuffle(texts)
    return texts


def test_stage_finds_every_pair_of_jaccard_08(spark, monkeypatch):
    for seed, sample in ((3, 1), (4, 16)):  # with and without common shingles
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
        lab = brute(texts)
        kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
        assert sorted(kept) == sorted(set(lab.tolist()))
    assert simhash.drop_near_duplicates(docs).count() > len(kept)  # four bits of four-word fingerprints miss most of them


def test_large_groups_go_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "TILE", 16)
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    assert sorted(r["doc_id"] for r in jaccard.drop_near_copies(docs).collect()) == sorted(set(brute(texts).tolist()))


def test_a_large_group_sends_its_likeliest_pairs_first(spark):
    r = np.random.default_rng(7)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(100) < 0.97], r.integers(1 << 40, 1 << 60, 3, np.uint64)))) for _ in range(150)]
    rows = [(i, len(s), jaccard.mask_of(s), np.array([5], np.int64).tobytes()) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "point long, n long, mask binary, prefix binary")
    shared = spark.createDataFrame([(5, 150, i, n, -1, 100) for i, n, *_ in rows], "shingle long, members long, point long, n long, hub long, hub_n long")
    none = spark.createDataFrame([], "fp long, label long")
    every = jaccard.other_pairs(shared, none, held, jaccard.Fraction("0.8")).collect()
    some = jaccard.other_pairs(shared, none, held, jaccard.Fraction("0.8"), 4).collect()
    assert len(every) > 10_000 and not any(q["more"] for q in every)
    assert len(some) <= 4 * 150 and all(q["more"] for q in some) and {q["a"] for q in some} | {q["b"] for q in some} == set(range(150))
    assert {(q["a"], q["b"]) for q in some} <= {(q["a"], q["b"]) for q in every}


def test_masks_never_lose_a_likely_pair():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 700, np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(700) < q], r.integers(0, 1 << 63, k, np.uint64)))) for q, k in [(0.3, 5), (0.33, 9), (0.4, 2), (0.95, 20), (0.97, 9), (1, 3), (1, 60), (0.9, 1)] * 6]
    n = np.array([len(s) for s in sets])
    found = [(int(a), int(b)) for x, y in jaccard.near_masks(n, [jaccard.mask_of(s) for s in sets], jaccard.Fraction("0.8")) for a, b in zip(x, y)]
    assert len(found) == len({frozenset(p) for p in found})
    likely = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 5 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (n[i] + n[j] - both)}
    assert likely <= {frozenset(p) for p in found} and len(found) < len(sets) * (len(sets) - 1) / 2


def test_prefixes_of_likely_sets_meet():
    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 63, 50, np.uint64)
    order = np.argsort(common)
    for _ in range(200):
        both = np.concatenate((common[: r.integers(0, 50)], r.integers(0, 1 << 63, r.integers(5, 60), np.uint64)))
        d = int(len(both) / 4)  # at most a fifth of the union differs
        a = np.unique(np.concatenate((both, r.integers(0, 1 << 63, d // 2, np.uint64))))
        b = np.unique(np.concatenate((both, r.integers(0, 1 << 63, d - d // 2, np.uint64))))
        cut = [jaccard.prefix(s, jaccard.Fraction("0.8"), common[order], order) for s in (a, b)]
        assert set(cut[0].tolist()) & set(cut[1].tolist())


def test_columns_and_no_rows(spark, clashing, nothing):
    out = jaccard.drop_near_copies(clashing)
    assert out.columns == clashing.columns and out.count() > 0
    assert jaccard.drop_near_copies(nothing).count() == 0
