import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm.common import work_dir
from statloom.llm.packing import pack, places, plan, sequences
from statloom.llm.queries import tokenizer_file
from statloom.llm.sstable import Shard, token_shards, write_shards
from statloom.llm.tokencount import flat_files, scan_flat, token_counts
from statloom.llm.tokens import Encoder

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("plain", [False, True])
def test_pieces_give_the_library_ids(path, plain):
    enc = Encoder(path, plain)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(list(" \n\t\r\x1c\x85　'sStdabcABCéÉßİıſΣς中0123.,!?<|>-_#́😀") + ["<|endoftext|>", "don't", "  "]), max_size=14).map("".join), max_size=4))
    def run(texts):
        assert enc.encode_all(texts) == [enc._library(t) for t in texts]

    run()


def encoded(path, end, rows, plain=False):
    enc = Encoder(path, plain)
    return [(d, np.frombuffer(enc._library(t or "") + enc.number(end), enc.dtype).astype("<u4")) for d, t, *_ in rows]


def test_shards_round_trip(spark, docs, clashing, rows, nothing):
    got = sorted(token_shards(docs, BYTE, 0).collect(), key=lambda r: r["start"])
    want = encoded(BYTE, 0, rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_shards(clashing, BYTE, 0).count() == len(rows)
    assert token_shards(nothing, BYTE, 0).count() == 0


def test_shard_lookup_and_rollover(spark, docs, rows):
    manifest = write_shards(docs, work_dir(spark, "t"), BYTE, 0, shard_bytes=1).collect()
    shards = [Shard(r["path"]) for r in manifest]
    want = dict(encoded(BYTE, 0, [r for r in rows if r[0] not in (7, 8, None)]))
    for d, x in want.items():
        found = [v for s in shards if (v := s.get(d)) is not None]
        assert len(found) == 1 and (found[0] == x).all()
    assert all(s.get(123456) is None for s in shards)
    assert sum(s.get(7, 1) is not None for s in shards) == 1
    assert sum(r["n_docs"] for r in manifest) == len(rows)


def test_damaged_shard_is_refused(spark, docs):
    path = write_shards(docs, work_dir(spark, "t"), BYTE, 0).first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(ValueError):
        Shard(path)


def test_token_counts(spark, docs, clashing, rows, nothing):
    got = token_counts(docs, BYTE, 50256).collect()
    want = encoded(BYTE, 50256, rows, True)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((d, len(x)) for d, x in want)
    assert token_counts(clashing, BYTE, 50256).count() == len(rows)
    assert token_counts(nothing, BYTE, 50256).count() == 0


@pytest.mark.parametrize("block", [4, 8, 64, 1 << 20])
def test_separators_across_blocks(spark, tmp_path, block):
    (tmp_path / "flat").mkdir()
    r = np.random.default_rng(1)
    ids = r.integers(0, 4, 500).astype("<u2")
    ids[100:180] = 1  # a document over many blocks
    ids.tofile(tmp_path / "flat/part-000000-0000.u2")
    np.full(3, 9, "<u2").tofile(tmp_path / "flat/part-000001-0000.u2")  # no end at all
    got = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in scan_flat(flat_files(spark, str(tmp_path)), 0, block).collect())
    ends = np.flatnonzero(ids == 0)
    starts = np.concatenate(([0], ends[:-1] + 1))
    assert got == [(i, s, e - s + 1) for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist()))]


def round_robin(counts, weights, window):
    """Deficit round-robin token by token: the source of each place."""
    from statloom.llm.packing import UNITS, quanta

    left, deficit, out = list(counts), [0] * len(counts), []
    w = np.array(counts if weights is None else weights, float)
    while sum(left):
        live = np.array(left) > 0
        q = np.zeros(len(left), np.int64)
        q[live] = quanta(w[live], window)
        for s in range(len(left)):
            if live[s]:
                deficit[s] += int(q[s])
                n = min(deficit[s] // UNITS, left[s])
                out += [s] * n
                left[s] -= n
                deficit[s] = deficit[s] - n * UNITS if left[s] else 0
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=6), st.booleans(), st.sampled_from([8, 32, 128]))
def test_places_are_those_of_deficit_round_robin(counts, own, window):
    weights = None if own else [i + 1.0 for i in range(len(counts))]
    if not sum(counts):
        return
    want = round_robin(counts, weights, window)
    got = [None] * sum(counts)
    for s, n in enumerate(counts):
        for at in range(0, n, 7):
            for rank, length, place in places(stretches := plan(counts, weights, window), s, at, min(7, n - at)):
                assert at <= rank and rank + length <= n and stretches
                for k in range(length):
                    assert got[place + k] is None
                    got[place + k] = s
    assert got == want


def round_robin_in_runs(counts, weights, window, run):
    """As round_robin; a source whose quantum is below ``run`` tokens sends whole runs and starts with half a run."""
    from statloom.llm.packing import UNITS, quanta

    left, out = list(counts), []
    deficit = [run * UNITS // 2 if q < run * UNITS else 0 for q in quanta(np.array([float(w) for w in weights]), window).tolist()]
    while sum(left):
        live = [i for i, n in enumerate(left) if n]
        for s, q in zip(live, quanta(np.array([float(weights[i]) for i in live]), window).tolist()):
            unit = run if q < run * UNITS else 1
            deficit[s] += q
            n = min(deficit[s] // (unit * UNITS) * unit, left[s])
            out += [s] * n
            left[s] -= n
            deficit[s] = deficit[s] - n * UNITS if left[s] else 0
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=6), st.sampled_from([8, 32, 128]), st.sampled_from([2, 5, 16]), st.integers(1, 30))
def test_runs_are_those_of_deficit_round_robin(counts, window, run, tilt):
    weights = [1.0 + i * tilt for i in range(len(counts))]
    stretches, got = plan(counts, weights, window, run), [None] * sum(counts)
    for s, n in enumerate(counts):
        for at in range(0, n, 7):
            for rank, length, place in places(stretches, s, at, min(7, n - at)):
                assert at <= rank and rank + length <= n
                for k in range(length):
                    assert got[place + k] is None
                    got[place + k] = s
    assert got == round_robin_in_runs(counts, weights, window, run)


def test_a_rare_source_sends_runs():
    counts = [2_000_000_000, 500_000_000, 5000]
    stretches = plan(counts, None, 4096, 64)
    pieces = list(places(stretches, 2, 0, 5000))
    assert sum(n for _, n, _ in pieces) == 5000 and len(pieces) <= 5000 // 64 + 2
    assert len(list(places(stretches, 0, 10**9, 5000))) < 8
    at = sorted(p for _, _, p in pieces)
    assert all(b - a > 20_000_000 for a, b in zip(at[:-3], at[1:]))  # spread over the windows, but for what rounding leaves to the end


def test_packing(spark, docs, clashing, rows, nothing):
    got = pack(docs, WORD, 2, 256, with_ids=True).collect()
    want = Counter((d, len(x), x.tobytes()) for d, x in encoded(WORD, 2, rows))
    at: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and r["length"] > 0
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert sorted(at) == list(range(len(at))) and all(v == 256 for k, v in at.items() if k < len(at) - 1)
    assert sum(at.values()) == sum(n * c for (_, n, _), c in want.items())
    single = {d for d, n in Counter(d for d, *_ in rows).items() if n == 1}
    for d in single:
        pieces = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == d)
        data = b"".join(p for _, p in pieces)
        assert (d, len(data) // 4, data) in want
        assert [s for s, _ in pieces] == [sum(len(p) // 4 for _, p in pieces[:i]) for i in range(len(pieces))]
    # Every window but the last few holds each source's share, within its carried deficit.
    total = Counter()
    for r in got:
        total[r["source"]] += r["length"]
    share = {s: n / sum(total.values()) * 256 for s, n in total.items()}
    for w in range(len(at) - 2):
        here = Counter()
        for r in got:
            if r["sequence_id"] == w:
                here[r["source"]] += r["length"]
        assert all(abs(here[s] - share[s]) <= len(share) + 1 for s in share)
    assert pack(clashing, WORD, 2, 256).count() == len(got)
    assert pack(nothing, WORD, 2).count() == 0


def test_packing_to_weights(spark, docs):
    with pytest.raises(ValueError):
        pack(docs, WORD, 2, 64, {"hot": 1.0})
    weights = {"hot": 1.0, "": 1.0, **{f"s{i}": 2.0 for i in range(4)}}
    got = pack(docs, WORD, 2, 64, weights).collect()
    first = Counter()
    for r in got:
        if r["sequence_id"] < 4:
            first[r["source"]] += r["length"]
    assert first["s1"] > 1.5 * first["hot"] and sum(first.values()) == 4 * 64


def test_sequences_are_built(spark, docs):
    pieces = pack(docs, WORD, 2, 256, with_ids=True).cache()
    got = {r["sequence_id"]: r for r in sequences(pieces, 256, 7).collect()}
    want: dict = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        want[r["sequence_id"]] = want.get(r["sequence_id"], b"") + bytes(r["ids"])
    assert sorted(got) == sorted(want)
    for k, v in want.items():
        n = len(v) // 4
        assert got[k]["n_tokens"] == n and bytes(got[k]["ids"]) == v + (b"" if n & n - 1 == 0 else (7).to_bytes(4, "little") * (256 - n))
    pieces.unpersist()
