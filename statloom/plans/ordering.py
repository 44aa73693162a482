"""Positions and running sums over a whole table's order, without one task seeing the whole table.

The rows are range-partitioned by the order and sorted inside each range; a range's own sums, one small
row each, are added up over the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settled


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums by ``order``, which must be unique for sums that can be repeated."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.withColumns({f"__v_{k}": c for k, c in sums.items()})
    ranged = settled(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    # At most one row for each shuffle partition.
    bases = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    out = ranged.join(F.broadcast(bases), "__part")
    out = out.withColumns({k: F.sum(f"__v_{k}").over(inside) + F.col(f"__b_{k}") for k in sums})
    return out.select(*df.columns, *[k for k in sums if k not in df.columns])


def indexed(df: DataFrame, order: list[Column | str], name: str = "_row_id") -> DataFrame:
    """``df`` with each row's 0-based place in ``order``."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long") - 1)


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """``df`` with 1-based ranks by ``value``, ties sharing their mean rank. NULL values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(counts, ["__value"], {"__upto": F.col("__n")})
    ranks = placed.select("__value", (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(name), F.col("__n").alias(f"{name}_ties"))
    return df.join(ranks, df[value] == ranks["__value"]).drop("__value")


def picked(df: DataFrame, value: str, places: list[int]) -> list[float]:
    """The values at given 0-based places of the sorted column; the driver gets one row per place."""
    rows = indexed(df.filter(F.col(value).isNotNull()).select(value), [value], "__at")
    got = {r["__at"]: r[value] for r in rows.filter(F.col("__at").isin([int(p) for p in places])).distinct().collect()}
    return [got[int(p)] for p in places]
