import math
from collections import Counter

import corpus_pipeline
from statloom.llm.common import work_dir, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_windows_follow_the_targets_of_mixing(spark):
    """A hot source is packed at its target share, not at its share of the tokens, until another runs dry."""
    rows = [(i, "some words of a document number %d " % i * 60, "en", "hot" if i % 10 else ["a", None][i // 10 % 2], 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s or ""] += len(t)
    total = sum(math.sqrt(n) for n in size.values())
    mixed = written(corpus_pipeline.mixing(spark, docs, ""), f"{work_dir(spark, 't')}/mixed")
    got = corpus_pipeline.packing(spark, mixed, "").collect()
    assert {r["doc_id"] for r in got} == set(range(400))
    windows, left = {}, Counter()
    for r in got:
        windows.setdefault(r["sequence_id"], Counter())[r["source"]] += r["length"]
        left[r["source"]] += r["length"]
    checked = 0
    for k in sorted(windows):
        left.subtract(windows[k])
        if min(left.values()) <= 0:
            break
        checked += 1
        assert all(abs(windows[k][s] - 4096 * math.sqrt(n) / total) <= 2 for s, n in size.items())
    assert checked >= 3 and len(windows) > checked + 1  # a source runs dry and the rest goes on
