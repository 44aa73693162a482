"""License scans by diagonal voting.

All rolling word bigrams of all documents are hashed and joined in Spark to the bigrams of license
templates. A match at word p of a document and word q of a template votes for the diagonal p - q; votes
are aggregated by (document, template, diagonal), neighbouring diagonals of a template are merged, as a
word put in or left out moves the rest of a passage to the next diagonal (the gap that is bridged grows
with the template), and spans with enough votes are verified against the words themselves. Short phrases must stand word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Rolled, mix64, slices, work_dir, written

#: Phrases whose every place counts, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Passages that name or open a license, with their labels; each is at most 62 words, the width of a vote mask.
TEMPLATES = (
    ("released under the MIT license", "mit"),
    ("licensed under the MIT license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the Apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under the GNU general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the GNU general public license", "gpl"),
    ("GNU lesser general public license", "lgpl"),
    ("GNU affero general public license", "agpl"),
    ("this source code form is subject to the terms of the Mozilla public license", "mpl"),
    ("licensed under CC BY NC 4 0", "cc-by-nc"),
    ("licensed under CC BY SA 4 0", "cc-by-sa"),
    ("licensed under CC BY ND 4 0", "cc-by-nd"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("no rights reserved CC0 1 0 universal public domain dedication", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Share of a passage's bigrams that must vote, share of its words that must match; diagonals merged at least, and one more for so many bigrams.
VOTES, MATCH, NEAR, NEAR_PART = 0.5, 0.8, 2, 4
#: Text bytes whose bigrams are hashed at once.
CHUNK_BYTES = 2 << 20
#: Passages of up to so many words must match word for word.
EXACT_WORDS = 6

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same before lower-casing.
WORD_ANY = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TWO_WORDS = re.compile(rb"(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++){2}")
_IS_WORD = np.array([b >= 0x80 or 48 <= b <= 57 or 97 <= (b | 32) <= 122 and b not in (64, 91) and chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Stands for "this row is a document" among the hashes.
MARK = -1
HEAD = "doc_id long, text_hash long"


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, letters and bytes above 127."""
    return WORD.findall(text.lower())


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, words by text). A text's part starts with MARK; the hash at i + 1 is that of words i and i + 1."""
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    inside = np.concatenate(([False], _IS_WORD[buf], [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turn[::2], turn[1::2]
    first = np.searchsorted(starts, begin)
    n_words = np.diff(np.append(first, len(starts)))
    h = Rolled(buf)(starts, ends)
    with np.errstate(over="ignore"):
        pairs = mix64(h[:-1] * np.uint64(0x9FB21C651E98DF25) + mix64(h[1:])).view(np.int64)
    pairs = np.where(pairs == MARK, MARK - 1, pairs)
    values = np.concatenate(([MARK], pairs)) if len(h) else np.zeros(0, np.int64)
    values[first[n_words > 0]] = MARK
    none = first[n_words == 0]
    values = np.insert(values, none, MARK)
    return values, np.concatenate(([0], np.cumsum(np.maximum(n_words, 1)))), n_words


def long_grams(text: bytes, most: int = CHUNK_BYTES) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """(words, [(place of the first value, values)]) of a long text, as one text of grams_of: by chunks that share a word.

    Chunks end behind a word; a word longer than a chunk is a chunk with its neighbours.
    """
    out, at, base = [], 0, 0
    while True:
        end = len(text)
        if end - at > most:
            gap = np.flatnonzero(~_IS_WORD[_LOWER[np.frombuffer(text, np.uint8, most, at)]])
            if len(gap) and WORD_ANY.search(text, at, at + int(gap[-1])):
                end = at + int(gap[-1])
            # The next chunk starts with this one's last word, so it must not be the first one here.
            if end == len(text) or not TWO_WORDS.match(text, at, end):
                m = TWO_WORDS.match(text, at)
                end = m.end() if m else len(text)
        values, _, n = grams_of([text[at:end]])
        out.append((base, values) if not base else (base + 1, values[1:]))
        if end == len(text):
            return base + int(n[0]), out
        at = end - WORD_ANY.search(text[at:end][::-1]).end()
        base += int(n[0]) - 1


def words_in(text: bytes, ranges: list[tuple[int, int]]) -> list[list[bytes]]:
    """The words of a text in each range of places; a long text's other words are not kept."""
    if len(text) <= CHUNK_BYTES:
        w = words_of(text)
        return [w[a:b] for a, b in ranges]
    need, held = {i for a, b in ranges for i in range(a, b)}, {}
    last = max(need, default=-1)
    for i, m in enumerate(WORD_ANY.finditer(text)):
        if i > last:
            break
        if i in need:
            held[i] = m[0].lower()
    return [[held[i] for i in range(a, b) if i in held] for a, b in ranges]


def match(template: list[bytes], span: list[bytes]) -> float:
    """Share of the template's words found in the span in order."""
    blocks = SequenceMatcher(None, template, span, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, out: str | None = None) -> DataFrame:
    """doc_id, n_words, spans (array of template, start, score) of every row; templates are numbered, base phrases first.

    Null texts are empty; texts without words have no spans; equal rows have equal results; an empty table
    gives no rows. Only template bigrams are broadcast, a fixed few hundred rows.
    """
    spark = docs.sparkSession
    out = out or work_dir(spark, "licenses")
    phrases = [words_of(t.encode()) for t, _ in (*base, *templates)]
    if any(not 2 <= len(p) <= 62 for p in phrases):
        raise ValueError("a template has 2 to 62 words")
    exact = [len(p) <= EXACT_WORDS for p in phrases]
    rows = [(MARK, MARK, 0, 0, True)]
    for k, p in enumerate(phrases):
        rows += [(int(h), k, q, len(p) - 1, exact[k]) for q, h in enumerate(grams_of([b" ".join(p)])[0][1:])]
    voters = spark.createDataFrame(rows, "gram long, template int, q int, n_grams int, exact boolean")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            for i, j in slices(map(len, texts)):
                if len(texts[i]) > CHUNK_BYTES:
                    n, parts = long_grams(texts[i])
                    for base, values in parts:
                        yield row(b, i, j, np.array([n]), np.array([base]), np.array([0, len(values)]), values)
                    continue
                values, offsets, n_words = grams_of(texts[i:j])
                yield row(b, i, j, n_words, np.zeros(j - i, np.int64), offsets, values)

    def row(b: pa.RecordBatch, i: int, j: int, n_words, base, offsets, values) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(n_words, pa.int64()), pa.array(base, pa.int64()), lists], names=["doc_id", "text_hash", "n_words", "base", "grams"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    key = ["doc_id", "text_hash"]
    rolled = keyed.mapInArrow(grams, HEAD + ", n_words long, base long, grams array<long>").select(*key, "n_words", "base", F.posexplode("grams").alias("i", "gram"))
    rolled = rolled.select(*key, "n_words", (F.col("base") + F.col("i")).alias("i"), "gram")
    hits = rolled.join(F.broadcast(voters), "gram")
    votes = hits.groupBy(*key, "template", "n_grams", "exact", (F.when(F.col("template") == MARK, F.lit(0)).otherwise(F.col("i") - 1 - F.col("q"))).alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, q))").alias("mask"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n")
    )
    found = F.bit_count("mask")
    votes = votes.filter((F.col("template") == MARK) | F.when(F.col("exact"), found == F.col("n_grams")).otherwise(found >= 2))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    near = F.greatest(F.lit(NEAR), F.expr(f"n_grams div {NEAR_PART}"))  # as many words may be put in or left out together
    chained = votes.withColumn("fresh", F.when(F.col("exact") | F.lag("diagonal").over(order).isNull(), 1).otherwise((F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int")))
    chained = chained.withColumn("chain", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = chained.groupBy(*key, "template", "n_grams", "exact", "chain").agg(F.expr("bit_or(mask)").alias("mask"), F.min("diagonal").alias("start"), F.max("diagonal").alias("last"), F.max("n_words").alias("n_words"), F.max("n").alias("n"))
    merged = merged.filter((F.col("template") == MARK) | (F.bit_count("mask") >= F.ceil(F.col("n_grams") * VOTES)))
    by_doc = merged.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template") == MARK, F.col("n"))).alias("copies"),
        F.collect_list(F.when(F.col("template") != MARK, F.struct("template", "start", "last"))).alias("spans"),
    )
    by_doc = written(by_doc, f"{out}/voted")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for spans, text in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                good = []
                for s in spans:
                    p = phrases[s["template"]]
                    s["from"], s["to"] = max(0, s["start"]), (s["start"] if exact[s["template"]] else s["last"] + NEAR) + len(p)
                for s, w in zip(spans, words_in((text or "").encode("utf-8", "surrogatepass"), [(s["from"], s["to"]) for s in spans])):
                    p = phrases[s["template"]]
                    score = float(w == p) if exact[s["template"]] else match(p, w)
                    if score >= MATCH:
                        good.append({"template": s["template"], "start": s["from"], "score": score})
                kept.append(good)
            kind = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(kept, kind)], names=["doc_id", "n_words", "copies", "spans"])

    shape = "doc_id long, n_words long, copies long, spans array<struct<template:int,start:long,score:double>>"
    id_key = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text_hash"))
    some, none = by_doc.filter(F.size("spans") > 0).withColumn("k", id_key), by_doc.filter(F.size("spans") == 0)
    # Equal rows are one row of by_doc; one of their equal texts is enough.
    both = some.hint("merge").join(keyed.select(id_key.alias("k"), "text"), "k")
    verified = both.select(*key, "n_words", "copies", "spans", "text").mapInArrow(verify, shape)
    rest = none.select("doc_id", "n_words", F.explode(F.expr("sequence(1L, copies)")).alias("copy"), F.expr("cast(array() as array<struct<template:int,start:long,score:double>>)").alias("spans"))
    return verified.select("doc_id", "n_words", "spans").unionByName(rest.select("doc_id", "n_words", "spans"))


def license_labels(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans of every row."""
    names = [label for _, label in (*base, *templates)]
    n = len(base)
    label = F.array(*[F.lit(x) for x in names])

    def joined(of):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda s: F.get(label, s["template"])))))

    at = F.filter("spans", lambda s: s["template"] < n)
    starts = F.transform(at, lambda s: s["start"])
    return scan(docs, base, templates).select(
        "doc_id", "n_words",
        F.size(at).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(at).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"), "spans",
    )
