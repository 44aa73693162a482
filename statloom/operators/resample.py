"""Splits, folds and resamplers. Randomness is a hash of a unique key and a seed, so it can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import indexed


def shuffled(keys: list[str], seed: int) -> list[Column]:
    """An order that looks random and is the same each time."""
    return [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]


def _order(keys: list[str], shuffle: bool, seed: int) -> list:
    return shuffled(keys, seed) if shuffle else list(keys)


def with_places(df: DataFrame, keys: list[str], shuffle: bool, seed: int) -> DataFrame:
    """``df`` with ``__at`` (0-based place) and ``__n`` (rows)."""
    placed = indexed(df, _order(keys, shuffle, seed), "__at")
    return placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("__n"))))


def train_test_split(df: DataFrame, keys: list[str], ratio: float = 0.8, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """``df`` with a column ``split``: the first floor(n ratio) rows are "train"."""
    placed = with_places(df, keys, shuffle, seed)
    return placed.withColumn("split", F.when(F.col("__at") < F.floor(F.col("__n") * ratio), "train").otherwise("test")).drop("__at", "__n")


def k_fold(df: DataFrame, keys: list[str], k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 1 to k: runs of floor(n / k) rows, the last fold takes the rest."""
    placed = with_places(df, keys, shuffle, seed)
    size = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return placed.withColumn("fold", F.least(F.lit(k), F.floor(F.col("__at") / size) + 1).cast("int")).drop("__at", "__n")


def stratified_k_fold(df: DataFrame, y: str, keys: list[str], k: int = 5, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """As k_fold within each class of ``y``. Places in a class come from one order over (class, key)."""
    placed = indexed(df, [F.col(y), *_order(keys, shuffle, seed)], "__at")
    sizes = placed.groupBy(F.col(y).alias("__y")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    joined = placed.join(F.broadcast(sizes), placed[y].eqNullSafe(sizes["__y"]))  # a row per class
    size = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return joined.withColumn("fold", F.least(F.lit(k), F.floor((F.col("__at") - F.col("__first")) / size) + 1).cast("int")).drop("__at", "__n", "__first", "__y")


def group_k_fold(df: DataFrame, group: str, k: int = 5, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` by group; folds' numbers of groups differ by one at most."""
    groups = with_places(df.select(group).distinct(), [group], shuffle, seed)
    base, more = F.floor(F.col("__n") / k), F.pmod(F.col("__n"), F.lit(k))
    cut = (base + 1) * more
    fold = F.when(F.col("__at") < cut, F.floor(F.col("__at") / (base + 1))).otherwise(more + F.floor((F.col("__at") - cut) / F.greatest(base, F.lit(1))))
    return df.join(groups.select(group, (fold + 1).cast("int").alias("fold")), group)


def leave_one_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """A fold for each row, in key order."""
    return indexed(df, list(keys), "fold").withColumn("fold", F.col("fold") + 1)


def shuffle_splits(df: DataFrame, keys: list[str], splits: int = 5, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with boolean columns test_1 to test_n; each marks max(1, floor(n ratio)) rows."""
    n = df.count()
    size = max(1, int(n * test_ratio))
    for i in range(splits):
        df = indexed(df, shuffled(keys, seed + i), "__at").withColumn(f"test_{i + 1}", F.col("__at") < size).drop("__at")
    return df


def class_sizes(df: DataFrame, y: str) -> dict:
    return {r[y]: r["count"] for r in df.groupBy(y).count().collect()}


def downsample(df: DataFrame, y: str, keys: list[str], ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Random rows of each class: as many as the smallest has, or ``ratio`` times that (a sampling operator)."""
    sizes = class_sizes(df, y)
    most = int(min(sizes.values()) * (ratio or 1.0))
    placed = indexed(df, [F.col(y), *shuffled(keys, seed)], "__at")
    first = placed.groupBy(F.col(y).alias("__y")).agg(F.min("__at").alias("__first"))
    joined = placed.join(F.broadcast(first), placed[y].eqNullSafe(first["__y"]))
    return joined.filter(F.col("__at") - F.col("__first") < most).drop("__at", "__first", "__y")


def upsample(df: DataFrame, y: str, keys: list[str], target: float = 1.0, seed: int = 42) -> DataFrame:
    """Smaller classes drawn with replacement up to floor(largest target) rows, put behind their own rows.

    Draw i of a class takes the row at place hash(i) mod size, so the draws are made and joined in Spark.
    """
    sizes = class_sizes(df, y)
    goal = int(max(sizes.values()) * target)
    spark = df.sparkSession
    short = {c: goal - n for c, n in sizes.items() if n < goal}
    if not short:
        return df
    kind = dict(df.dtypes)[y]
    placed = indexed(df, [F.col(y), *[F.col(k) for k in keys]], "__at")
    first = placed.groupBy(F.col(y).alias("__y")).agg(F.min("__at").alias("__first"))
    placed = placed.join(F.broadcast(first), placed[y].eqNullSafe(first["__y"])).withColumn("__place", F.col("__at") - F.col("__first"))
    out = df
    for i, (c, n) in enumerate(short.items()):
        draws = spark.range(n).select(F.lit(c).cast(kind).alias("__c"), F.pmod(F.xxhash64(F.lit(seed + i), "id"), F.lit(sizes[c])).alias("__place"))
        drawn = placed.join(draws, placed[y].eqNullSafe(draws["__c"]) & (placed["__place"] == draws["__place"])).select(*[placed[k] for k in df.columns])
        out = out.unionByName(drawn)
    return out


def bootstrap(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Rows with a column ``times``: how often each is drawn, by a Poisson(1) variable from its hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    times, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        times = times + (u > total).cast("int")
        p /= k + 1
    return df.withColumn("times", times)
