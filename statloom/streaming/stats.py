"""Windowed statistics of a stream. Counts, sums and products add up, so means, variances, correlations and
straight-line fits come from one aggregate per window, late rows included up to the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import normalize


def moments(x: str, y: str | None = None) -> list[Column]:
    a = F.col(x).cast("double")
    out = [F.count(a).alias("n"), F.sum(a).alias("sx"), F.sum(a * a).alias("sxx")]
    if y:
        b = F.col(y).cast("double")
        out += [F.sum(b).alias("sy"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]
    return out


def statistics(sums: DataFrame, pair: bool = False) -> DataFrame:
    """mean and variance of x; with sums of a pair also correlation, slope and intercept of y on x."""
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    vx = sxx - sx * sx / n
    columns = {"mean": sx / n, "variance": F.try_divide(vx, (n - 1).cast("double"))}
    if pair:
        sy, vy, c = F.col("sy"), F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - sx * F.col("sy") / n
        slope = F.try_divide(c, vx)
        columns |= {"correlation": F.try_divide(c, F.sqrt(vx * vy)), "slope": slope, "intercept": (sy - slope * sx) / n}
    return sums.withColumns(columns)


def watermarked(rows: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need times with a zone; those without are taken in the session's."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(stream: DataFrame, time: str, width: str, x: str, y: str | None = None, by: list[str] | None = None, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, keys and statistics by time window of a stream or a table; rows later than ``late`` are dropped by streams."""
    rows = normalize(stream)
    if rows.isStreaming:
        rows = watermarked(rows, time, late)
    sums = rows.groupBy(F.window(time, width, slide).alias("w") if slide else F.window(time, width).alias("w"), *(by or [])).agg(*moments(x, y))
    out = statistics(sums, y is not None)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), *[c for c in out.columns if c not in ("w", *(by or []))])


def sessions(stream: DataFrame, time: str, gap: str, user: str, x: str, late: str = "10 minutes") -> DataFrame:
    """Statistics by session: a user's rows with gaps of less than ``gap``."""
    rows = normalize(stream)
    if rows.isStreaming:
        rows = watermarked(rows, time, late)
    sums = rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(*moments(x))
    out = statistics(sums)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n", "mean", "variance")
