"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source is a stream of blocks of ``block_chars`` characters; a document belongs to the block it starts
in. With target weight w, block i (from 0) of a source is released at slot floor(i / w) and has its
deadline at slot ceil((i + 1) / w); every slot takes the released block with the earliest deadline. As
the weights add up to 1 every slot is filled and every block runs inside its window, so that at any slot
a source is less than one block away from its share. Weights are whole parts of ``PERIOD``; the schedule
then repeats after PERIOD slots, and one period, planned from the weights alone, is joined to any number
of blocks. When a source has no block left the others' weights are scaled up and a new stretch begins.

What runs over documents: lengths, a running sum of lengths inside (source, hash bucket), the buckets'
own running sums by source, and a join to the period. A source with a third of all rows is spread over
its buckets. The driver sees one row per source. Targets given as integers are met exactly at any length;
others, as those by temperature, are rounded to parts of PERIOD first.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names

PERIOD = 1000
#: The longest period that integer weights may make.
LONGEST = 1 << 16
BLOCK_CHARS = 1 << 16
#: Turns up to which they are sent to every task (a period for each stretch, a stretch for each source).
BROADCAST_TURNS = 1 << 17
#: Characters of a partition of mixed documents, about.
PART_CHARS = 1 << 27
#: Documents that share a source and a bucket, about.
BUCKET_DOCS = 1000


def parts_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole parts that add up to ``period``, by largest remainders, at least 1 each; integer weights stay as they are.

    Integers whose sum (by their greatest common divisor) is at most LONGEST are the parts themselves: then the
    schedule's bound of one block holds against the weights at any length. Others are rounded to the period.
    """
    if all(isinstance(w, int) for w in weights.values()):
        common = math.gcd(*weights.values())
        if sum(weights.values()) // common <= LONGEST:
            return {s: w // common for s, w in weights.items()}
    if len(weights) > period:
        period = len(weights)
    total = math.fsum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (parts[s] - exact[s], s)):
        if sum(parts.values()) < period:
            parts[s] += 1
    while (over := sum(parts.values()) - period) > 0:
        s = max(parts, key=lambda s: (parts[s], s))
        parts[s] -= min(over, parts[s] - 1)
    return parts


def release(i: int, part: int, period: int) -> int:
    return i * period // part


def deadline(i: int, part: int, period: int) -> int:
    return -(-(i + 1) * period // part)


def one_period(parts: dict[str, int]) -> list[str]:
    """The source of each slot, earliest deadline first among released blocks; ties go to the first name."""
    period, done, out = sum(parts.values()), dict.fromkeys(sorted(parts), 0), []
    for slot in range(period):
        ready = [(deadline(done[s], p, period), s) for s, p in sorted(parts.items()) if done[s] < p and release(done[s], p, period) <= slot]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def stretches(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """Rows (source, place in the period) of every stretch: from and to which of a source's blocks, where it starts."""
    left, served, start, rows = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        parts = parts_of({s: weights[s] for s in left})
        turn, period = one_period(parts), sum(parts.values())
        whole = min(left[s] // parts[s] for s in left)
        rest = {s: left[s] - whole * parts[s] for s in left}
        used = 0
        for s in turn:  # the part of a period up to the first source without a block
            if not rest[s]:
                break
            rest[s] -= 1
            used += 1
        begun = dict(served)
        for s in left:
            served[s] += left[s] - rest[s]
        seen = dict.fromkeys(left, 0)
        n = rows[-1]["n"] + 1 if rows else 0
        for slot, s in enumerate(turn):
            i = seen[s]
            seen[s] += 1
            rows.append({"n": n, "s": s, "a": begun[s], "z": served[s], "part": parts[s], "period": period, "start": start, "i": i, "slot": slot, "r": release(i, parts[s], period), "d": deadline(i, parts[s], period)})
        start += whole * period + used
        left = {s: n for s, n in rest.items() if n}
    return rows


def sources(docs: DataFrame, size: Column) -> dict[str, tuple[int, int]]:
    """(documents, characters) by source."""
    got = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).collect()
    return {r["s"]: (r["n"], r["size"]) for r in got}


def chars(text: str = "text") -> Column:
    """A document's characters; a null or empty text counts as one."""
    return F.greatest(F.coalesce(F.char_length(text), F.lit(0)), F.lit(1)).cast("long")


def targets(have: dict[str, tuple[int, int]], temperature: float = 0.5) -> dict[str, float]:
    """Target weights by source: characters to the power ``temperature``."""
    return {s: float(n) ** temperature for s, (_, n) in have.items()}


def table(spark: SparkSession, rows: list[dict], kinds: str) -> DataFrame:
    """Rows as a DataFrame made by the JVM from a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kinds}>>")))


class Turns:
    """A plan's tables: a source's stretches (one row a source) and the turns of a period in each stretch."""

    def __init__(self, spark: SparkSession, have: dict[str, tuple[int, int]], weights: dict[str, float], block_chars: int):
        blocks = {s: -(-n // block_chars) for s, (_, n) in have.items()}
        rows = stretches(blocks, weights)
        self.slots, self.block_chars = sum(blocks.values()), block_chars
        spans: dict[str, dict] = {s: {} for s in have}
        for r in rows:
            spans[r["s"]][r["n"]] = {"a": r["a"], "z": r["z"], "n": r["n"], "part": r["part"], "period": r["period"], "start": r["start"]}
        kinds = "plan_s:string,plan_size:bigint,plan_spans:array<struct<a:bigint,z:bigint,n:bigint,part:bigint,period:bigint,start:bigint>>"
        self.sources = table(spark, [{"plan_s": s, "plan_size": have[s][1], "plan_spans": list(v.values())} for s, v in spans.items()], kinds)
        turns = table(spark, [{f"turn_{k}": r[k] for k in ("n", "s", "i", "slot", "r", "d")} for r in rows], "turn_n:bigint,turn_s:string,turn_i:bigint,turn_slot:bigint,turn_r:bigint,turn_d:bigint")
        self.turns = F.broadcast(turns) if len(rows) <= BROADCAST_TURNS else turns

    def stretched(self, rows: DataFrame, s: str) -> DataFrame:
        """``rows`` with plan_size and plan_spans of their source: a row for each source is broadcast."""
        return rows.join(F.broadcast(self.sources), F.col(s) == F.col("plan_s"))

    @staticmethod
    def span(block: Column) -> Column:
        """The stretch that takes a block (the last one for places beyond it)."""
        return F.coalesce(F.get(F.filter("plan_spans", lambda x: (x["a"] <= block) & (block < x["z"])), F.lit(0)), F.element_at("plan_spans", -1))

    def timed(self, rows: DataFrame, s: str, block: str, prefix: str, columns: list) -> DataFrame:
        """``columns`` with release, deadline and slot of each row's block: equal keys (source, stretch, turn) meet."""
        at = rows.withColumn("plan_span", self.span(F.col(block)))
        since = F.col(block) - F.col("plan_span.a")
        found = at.withColumn("plan_i", F.pmod(since, F.col("plan_span.part"))).join(
            self.turns, (F.col(s) == F.col("turn_s")) & (F.col("plan_span.n") == F.col("turn_n")) & (F.col("plan_i") == F.col("turn_i"))
        )
        turn = F.col("plan_span.start") + F.expr(f"(`{block}` - plan_span.a) div plan_span.part") * F.col("plan_span.period")
        return found.select(*columns, *[(turn + F.col(f"turn_{c}")).alias(f"{prefix}{n}") for c, n in (("r", "release"), ("d", "deadline"), ("slot", "slot"))])


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_chars: int = BLOCK_CHARS, prefix: str = "mix_") -> DataFrame:
    """``docs`` with columns size, begin (characters of its source before it), block, release, deadline and slot, named with ``prefix``.

    weights: target weights by source, all above 0; default: each source's characters to the power
    ``temperature``. Every row is scheduled once: nothing is dropped or repeated to reach the weights, so
    they hold for as long as a source lasts. A source's order is by md5 of doc_id, then doc_id, then a hash
    of the text; identical rows are interchangeable. Null sources are one source ""; a null or empty text
    counts as one character; an empty table gives no rows.
    """
    spark, size = docs.sparkSession, chars()
    have = sources(docs, size)
    turns = Turns(spark, have, known(have, weights, temperature), block_chars)
    rows, (s, o, h, b, e), order = keyed(docs, have, size, f"{prefix}size")
    z, begin, block = f"{prefix}size", f"{prefix}begin", f"{prefix}block"
    sums = rows.groupBy(s, b).agg(F.sum(z).alias("n"))
    sums = sums.select(F.col(s).alias("base_source"), F.col(b).alias("base_bucket"), based(s, b).alias(e))
    inside = Window.partitionBy(s, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, (rows[s] == sums["base_source"]) & (rows[b] == sums["base_bucket"])).drop("base_source", "base_bucket")
    placed = placed.withColumn(begin, F.sum(z).over(inside) - F.col(z) + F.col(e)).withColumn(block, F.expr(f"`{begin}` div {block_chars}"))
    return turns.timed(turns.stretched(placed, s), s, block, prefix, [*docs.columns, z, begin, block])


def known(have: dict[str, tuple[int, int]], weights: dict[str, float] | None, temperature: float) -> dict[str, float]:
    """The weights of all sources."""
    weights = targets(have, temperature) if weights is None else weights
    if any(weights.get(s, 0) <= 0 for s in have):
        raise ValueError("every source needs a weight above 0")
    return weights


def keyed(docs: DataFrame, have: dict[str, tuple[int, int]], size: Column, z: str) -> tuple[DataFrame, list[str], list]:
    """``docs`` with source, order, hash, bucket and size; the names of those and of a bucket's base; the order in a source."""
    digits = max(1, math.ceil(math.log(max(1, sum(n for n, _ in have.values())) / BUCKET_DOCS, 16))) if have else 1
    s, o, h, b, e = free_names(docs, "mix_source", "mix_order", "mix_hash", "mix_bucket", "mix_base")
    rows = docs.withColumns({
        s: F.coalesce(F.col("source").cast("string"), F.lit("")), o: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), h: F.xxhash64("text"), z: size,
    }).withColumn(b, F.substring(o, 1, digits))
    return rows, [s, o, h, b, e], [o, "doc_id", h]


def based(s: str, b: str) -> Column:
    """Characters ``n`` of the buckets of a source before this one."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows of ``docs`` in the order of the schedule; the columns stay the same.

    Texts move once: a (source, bucket) goes to the partition in which the plan expects its blocks, taking
    buckets of a source as equally long. Inside a partition rows are in the order of their slots; from one
    partition to the next the order is that of the schedule up to a bucket (about BUCKET_DOCS documents).
    A bucket's row with the characters before it travels with its documents, so that their running sum needs
    no join. Nulls, empty texts, repeated rows and empty tables: as in ``schedule``.
    """
    spark, size = docs.sparkSession, chars()
    have = sources(docs, size)
    if not have:
        return docs
    turns = Turns(spark, have, known(have, weights, temperature), block_chars)
    z, p, begin, block, m = free_names(docs, "mix_size", "mix_part", "mix_begin", "mix_block", "mix_marker")
    rows, (s, o, h, b, e), order = keyed(docs, have, size, z)
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-sum(n for _, n in have.values()) // PART_CHARS))

    def homed(df: DataFrame) -> DataFrame:
        share = F.conv(b, 16, 10).cast("double") / F.pow(F.lit(16.0), F.length(b))
        span = turns.span(F.floor(share * F.col("plan_size") / block_chars))
        at = span["start"] + (F.floor(share * F.col("plan_size") / block_chars) - span["a"]) * span["period"] / span["part"]
        part = F.least(F.floor(at * parts / max(1, turns.slots)), F.lit(parts - 1)).cast("int")
        return turns.stretched(df, s).withColumn(p, part)

    bases = rows.groupBy(s, b).agg(F.sum(z).alias("n")).select(s, b, based(s, b).alias(z), F.lit(0).alias(m))
    both = homed(rows.withColumn(m, F.lit(1))).unionByName(homed(bases), allowMissingColumns=True)
    inside = Window.partitionBy(p, s, b).orderBy(m, *order).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.repartitionById(parts, F.col(p)).withColumn(begin, F.sum(z).over(inside) - F.col(z)).filter(F.col(m) == 1)
    placed = placed.withColumn(block, F.expr(f"`{begin}` div {block_chars}"))
    ranked = turns.timed(placed, s, block, "mix_out_", [*docs.columns, F.col(begin)])
    return ranked.sortWithinPartitions("mix_out_slot", begin).select(*docs.columns)
