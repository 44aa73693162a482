import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from statloom.llm import licenses, media, mixing, orderhash, quality, simhash
from statloom.llm.common import work_dir
from statloom.llm.queries import op8_simhash  # noqa: F401  registered


def body(t):
    return (t or "").encode()


# SimHash.
def simhash_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", body(text).lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points):
    """Position -> smallest position reachable within 4 bits."""
    x = np.array(points, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    lab = np.arange(len(x))
    while True:
        new = np.where(near, lab[None, :], len(x)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_simhash_against_brute_force(docs, clashing, rows, nothing):
    got = simhash.near_duplicates(docs).collect()
    fps = [simhash_of(t) for _, t, *_ in rows]
    lab = brute_components(fps)
    least = {k: min((rows[i][0] for i in np.flatnonzero(lab == k) if rows[i][0] is not None), default=None) for k in set(lab.tolist())}
    want = Counter((d, fps[i], least[lab[i]]) for i, (d, *_) in enumerate(rows))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(clashing).count() == len(rows)
    assert simhash.near_duplicates(nothing).count() == 0


def test_spark_hash_is_the_contract_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("capacity", [20_000, 16])
def test_hot_shards_are_divided_without_losing_links(spark, capacity):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 4, np.uint64)
    pts = {0, (1 << 64) - 1}
    for b in base:  # tight groups, chains and noise
        p = int(b)
        for _ in range(60):
            pts.add(int(b) ^ sum(1 << int(i) for i in r.choice(64, r.integers(0, 6), replace=False)))
            p ^= sum(1 << int(i) for i in r.choice(64, 3, replace=False))
            pts.add(p)
    pts = sorted(pts)
    fps = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in pts], "fp long")
    out = work_dir(spark, "t")
    links = simhash.star_links(simhash.shards_of(fps, 4, out, capacity), 4)
    label = {r["fp"] % (1 << 64): r["label"] for r in simhash.components(links, out).collect()}
    lab = brute_components(pts)
    groups = {}
    for p, k in zip(pts, lab.tolist()):
        groups.setdefault(k, []).append(p)
    for g in groups.values():
        if len(g) > 1:
            assert len({label[p] for p in g}) == 1
        else:
            assert g[0] not in label
    assert len({label[g[0]] for g in groups.values() if len(g) > 1}) == sum(len(g) > 1 for g in groups.values())


def test_vantage_search_prunes(spark):
    r = np.random.default_rng(1)
    pts = np.unique(np.concatenate([r.integers(0, 1 << 63, 1500, np.uint64), np.uint64(77) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64))]))
    s = simhash.VantageSearch(pts, 4)
    assert (s.run() == brute_components(pts)).all() and s.pairs_seen < len(pts) ** 2 / 2


def near_pairs(r, n, bits):
    """n random points of so many bits, and as many again up to 4 bits from them."""
    x = r.integers(0, 1 << bits, n, np.uint64)
    flips = [sum(1 << int(b) for b in r.choice(bits, r.integers(0, 5), replace=False)) for _ in range(n)]
    return x, x ^ np.array(flips, np.uint64)


@pytest.mark.parametrize("bits", [63, 51])  # 51: all points share 13 bits
def test_every_near_pair_meets_in_a_shard(bits):
    x, y = near_pairs(np.random.default_rng(4), 20_000, bits)
    pts = np.unique(np.concatenate((x, y)))
    trees = simhash.trees_for(pts[:: len(pts) // 4000], len(pts), 0, 4, 8192)
    at, sizes, met = np.stack((np.searchsorted(pts, x), np.searchsorted(pts, y))), [], np.zeros(len(x), bool)
    for t in trees:
        for _, leaf in t.route(pts, 1):
            inside = np.zeros(len(pts), bool)
            inside[leaf] = True
            sizes.append(len(leaf))
            met |= inside[at].all(0)
    assert met.all() and len(trees) == 3 and max(sizes) < 4000 and sum(sizes) < 16 * len(pts)


@pytest.mark.parametrize("capacity", [64, 600])
def test_shards_are_divided_again_on_the_executors(spark, capacity, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 200)
    monkeypatch.setattr(simhash, "ROUTED", 300)
    x, y = near_pairs(np.random.default_rng(6), 1500, 63)
    pts = np.unique(np.concatenate((x, y)))
    out = work_dir(spark, "t")
    shards = simhash.shards_of(spark.createDataFrame([(int(p),) for p in pts], "fp long"), 4, out, capacity)
    label = {r["fp"]: r["label"] for r in simhash.components(simhash.star_links(shards, 4), out).collect()}
    assert [label.get(p, p) for p in pts.tolist()] == pts[brute_components(pts)].tolist()


def test_drop_near_duplicates_keeps_one(docs, clashing, rows, nothing):
    kept = simhash.drop_near_duplicates(docs).collect()
    full = simhash.near_duplicates(docs).select("label").distinct().count()
    assert len(kept) == full and simhash.drop_near_duplicates(docs).columns == docs.columns
    ids = [r["doc_id"] for r in kept]
    assert 5 in ids and not set(range(100, 112)) & set(ids) and ids.count(7) == 1 and 11 in ids
    out = simhash.drop_near_duplicates(clashing)
    assert out.columns == clashing.columns and out.count() == full
    assert simhash.drop_near_duplicates(nothing).count() == 0


# Quality.
def test_forward_backward_against_enumeration():
    r = np.random.default_rng(2)
    count, u, trans = np.array([1, 4, 3]), r.normal(size=8), r.normal(size=(2, 2))
    p, pairs, log_z = quality.forward_backward(u, trans, count)
    at, want_pairs, want_z, want = 0, np.zeros((2, 2)), 0.0, []
    for n in count:
        weights, paths = [], []
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            weights.append(np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:]))))
            paths.append(y)
        w = np.array(weights) / sum(weights)
        want += [sum(w[k] * paths[k][i] for k in range(2**n)) for i in range(n)]
        for k in range(2**n):
            for a, b in zip(paths[k], paths[k][1:]):
                want_pairs[a, b] += w[k]
        want_z += np.log(sum(weights))
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_quality_learns_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    good, bad = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97 and all((r["score"] >= 0.3) == r["predicted"] for r in got)
    assert sum(g >= 0.3 for g in good) > 0.98 * len(good)


def test_quality_edge_cases(spark, docs, clashing, rows, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (300, 301)}
    assert len(same) == 1
    assert quality.classify(nothing, labels).count() == 0
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.keep_good(clashing, labels).columns == clashing.columns


# Order MinHash.
def omh_by_hand(text):
    """The signature by plain loops over numbered k-mers."""
    m, c = (1 << 64) - 1, [ord(x) + 1 for x in text]

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    k, seen, kmers = min(orderhash.K, len(c)), Counter(), []
    for i in range(len(c) - k + 1 if c else 0):
        h = 0
        for v in c[i : i + k]:
            h = (h * 0xD6E8FEB86659FD93 + v) & m
        v = mix((h + k) & m) >> 24
        n = seen[v]
        seen[v] += 1
        kmers.append((mix((v + n * 0x9E3779B97F4A7C15) & m) >> 24 if n else v, i))
    out = []
    for b in range(orderhash.BINS):
        pick = sorted(x for x in kmers if x[0] >> 34 == b)[: orderhash.PICK]
        if not pick:
            out.append(0)
            continue
        pick = [v for v, _ in sorted(pick, key=lambda x: x[1])]
        x, y = pick[0], pick[1] if len(pick) > 1 else 0
        out.append(mix((x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F + (len(pick) > 1)) & m) % 65535 + 1)
    return out


@pytest.mark.parametrize("text", ["", "a", "short", "abcabcabc" * 30, "the quick brown fox é中😀 " * 9, "x" * 500])
def test_signature_by_hand(text):
    assert orderhash.signature(text).tolist() == omh_by_hand(text)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_order_minhash(docs, clashing, rows, nothing, parts):
    got = orderhash.fingerprint_documents(docs, parts).collect()
    assert len(got) == len(rows)
    single = sorted({d for d, n in Counter(d for d, *_ in rows).items() if n == 1})
    text = {d: t or "" for d, t, *_ in rows}
    order = sorted({d for d, *_ in rows if d is not None})
    by = {r["doc_id"]: r for r in got if r["doc_id"] in single}
    for d in single:
        i = order.index(d)
        if i + 1 < len(order) and order[i + 1] in single:
            t, nxt = text[d], text[order[i + 1]]
            q = len(t) // 4
            new = t[: len(t) - q] + nxt[:q]
            r = by[d]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            a, b, c = (np.array(orderhash.signature(x)) for x in (t, new, nxt))
            assert r["near_edited"] == orderhash.likeness(a, b) and r["near_next"] == orderhash.likeness(a, c)
    copies = {r["fingerprint"] for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 112}
    assert len(copies) == 1
    # Behind the last comes the first: the null ids.
    last = by[order[-1]]
    firsts = {t or "" for d, t, *_ in rows if d is None}
    q = len(text[order[-1]]) // 4
    assert last["edited_sha256"] in {hashlib.sha256((text[order[-1]][: len(text[order[-1]]) - q] + f[:q]).encode()).hexdigest() for f in firsts}
    assert orderhash.fingerprint_documents(clashing, parts).count() == len(rows)
    assert orderhash.fingerprint_documents(nothing, parts).count() == 0


def test_order_matters():
    r = np.random.default_rng(3)
    a = "".join(chr(c) for c in r.integers(97, 123, 800))
    moved = a[400:] + a[:400]
    same = orderhash.likeness(orderhash.signature(a), orderhash.signature(a))
    near = orderhash.likeness(orderhash.signature(a), orderhash.signature(a[:790] + "zzz"))
    assert same == 1.0 and near > orderhash.likeness(orderhash.signature(a), orderhash.signature(moved))


# Licenses.
def test_base_phrases_at_every_place(docs, clashing, rows, nothing):
    got = licenses.license_labels(docs).collect()
    assert len(got) == len(rows)
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for d, t, *_ in rows:
        w = word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), body(t)))
        at = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
        want[d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert licenses.license_labels(clashing).count() == len(rows)
    assert licenses.license_labels(nothing).count() == 0


def test_edited_passages_are_found_and_others_not(spark):
    passage = licenses.TEMPLATES[2][0]
    w = passage.split()
    texts = [passage, " ".join(w[:8] + ["extra"] + w[8:]), " ".join(w[:5] + w[6:]), " ".join(reversed(w)), "of the of the of the " * 30, "CC-BY " * 500, "This software is permitted to any person"]
    got = {r["doc_id"]: r for r in licenses.license_labels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["mit", "mit", "mit", "", "", "cc-by", ""]
    assert got[0]["score"] == 1.0 and 0.8 <= got[1]["score"] <= 1 and got[5]["n_base"] == 500 and got[5]["last_word"] == 998


# Media.
def test_media_round_trip(spark, docs, clashing, rows, nothing):
    got = media.stored_media(docs).collect()
    want = Counter()
    for d, t, *_ in rows:
        b = body(t)
        p = b + b" " * (-len(b) % 192 if b else 192)
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = [(r["media_sha256"], r["feature"], r["media_bytes"]) for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 112]
    assert len(set(same)) == 1
    assert media.stored_media(clashing).count() == len(rows)
    assert media.stored_media(nothing).count() == 0


def test_ranges_cover_every_member_once_and_damage_is_met(spark, docs, rows):
    out = work_dir(spark, "t")
    media.write_archives(docs, out)
    names = [r["archive"] + r["name"] for r in media.read_archives(spark, f"{out}/media", rangeBytes="700").collect()]
    assert len(names) == len(set(names)) == len(rows)
    folder = f"{out}/media".removeprefix("file://")
    path = os.path.join(folder, sorted(os.listdir(folder))[0])
    data = bytearray(open(path, "rb").read())
    data[60] ^= 255
    with open(path, "wb") as f:
        f.write(data)
    kept = media.read_archives(spark, f"{out}/media", onError="null", retries="1").collect()
    assert sum(r["media"] is None for r in kept) == 1 and len(kept) == len(rows)
    with pytest.raises(Exception):
        media.read_archives(spark, f"{out}/media", retries="0").collect()


def test_a_member_is_read_again_by_offset(spark, docs, monkeypatch):
    out = work_dir(spark, "t")
    media.write_archives(docs, out)
    reader = media.ArchiveReader({"path": f"{out}/media"})
    failed, real = [], media.ArchiveReader.member

    def flaky(data, m):
        if m.header_offset not in failed:
            failed.append(m.header_offset)
            return None
        return real(data, m)

    part = reader.partitions()[0]
    whole = [x for b in reader.read(part) for x in b.column("media").to_pylist()]
    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(flaky))
    assert [x for b in reader.read(part) for x in b.column("media").to_pylist()] == whole and failed


# Mixing.
@pytest.mark.parametrize("weights", [None, {"hot": 5.0, "": 1.0, **{f"s{i}": 1.0 for i in range(4)}}])
def test_every_block_runs_in_its_window(docs, clashing, rows, nothing, weights):
    got = mixing.schedule(docs, weights, block_chars=64, prefix="").collect()
    assert len(got) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s or ""] += max(1, len(t or ""))
    for s in size:
        mine = sorted((r["begin"], r["size"]) for r in got if (r["source"] or "") == s)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and sum(n for _, n in mine) == size[s]
        slots = {r["block"]: r["slot"] for r in got if (r["source"] or "") == s}
        assert list(dict(sorted(slots.items())).values()) == sorted(slots.values())
    taken = {(r["slot"], r["source"] or "") for r in got}
    assert len({s for s, _ in taken}) == len(taken)
    assert mixing.schedule(nothing).count() == 0
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == len(rows)


def test_schedule_deviates_by_less_than_a_block():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1.0 + i % 5 for i in range(30)} | {"big": 40.0}):
        parts = mixing.parts_of(weights)
        turn, n, done = mixing.one_period(parts), sum(parts.values()), Counter()
        for slot, s in enumerate(turn, 1):
            done[s] += 1
            assert all(abs(done[x] - parts[x] * slot / n) < 1 for x in parts)
        assert done == Counter(parts)


def test_integer_weights_hold_at_any_length():
    weights = {"a": 7919, "b": 2000, "c": 3, "d": 5}
    parts = mixing.parts_of(weights)
    assert parts == weights and sum(parts.values()) == 9927
    turn, done = mixing.one_period(parts), Counter()
    for slot in range(3 * len(turn)):  # periods are alike, so three stand for any number
        done[turn[slot % len(turn)]] += 1
        assert all(abs(done[s] - w * (slot + 1) / 9927) < 1 for s, w in weights.items())


def test_mixed_rows_follow_the_schedule(spark, docs, clashing, rows, nothing):
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "", r["source"] or "")
    slot = {}
    for r in mixing.schedule(docs, block_chars=64, prefix="").collect():
        slot.setdefault(key(r), set()).add(r["slot"])
    parts = mixing.mix(docs, block_chars=64).rdd.glom().collect()
    got = [r for part in parts for r in part]
    assert Counter(map(key, got)) == Counter((d is not None, d or 0, t or "", s or "") for d, t, _, s, _ in rows)
    for part in parts:
        at = 0
        for r in part:
            at = min((x for x in slot[key(r)] if x >= at), default=None)
            assert at is not None
    assert mixing.mix(nothing).count() == 0


def test_stretches_take_every_block_once():
    blocks = {"a": 1703, "b": 50, "c": 0, "d": 7}
    rows = mixing.stretches(blocks, {"a": 1.0, "b": 2.0, "c": 1.0, "d": 3.0})
    seen, slots = Counter(), set()
    for s, n in blocks.items():
        for b in range(n):
            hits = [r for r in rows if r["s"] == s and r["a"] <= b < r["z"] and (b - r["a"]) % r["part"] == r["i"]]
            assert len(hits) == 1
            r = hits[0]
            slots.add(r["start"] + (b - r["a"]) // r["part"] * r["period"] + r["slot"])
            seen[s] += 1
    assert slots == set(range(1760)) and sum(seen.values()) == 1760
