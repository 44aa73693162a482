"""Filling missing values: a statistic, nearest neighbours, chained regressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import dot_columns
from ..plans.gram import gram
from ..sources.models import saveable
from ..sources.tables import is_numeric, normalize, settled
from .neighbors import meet


@saveable
@dataclass
class SimpleImputer:
    """strategy: mean, median, most_frequent or constant; group: statistics within each group.

    A column without any value is filled with 0 (numbers) or left missing. The most frequent value of equals
    is the one whose last row by ``order`` comes first (without an order: the smallest).
    """

    strategy: str
    values: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], strategy: str = "mean", fill=None, order: str | None = None) -> SimpleImputer:
        df, kinds = normalize(df), dict(df.dtypes)
        if strategy == "constant":
            return cls(strategy, dict.fromkeys(columns, fill))
        if strategy in ("mean", "median"):
            f = F.avg if strategy == "mean" else F.median
            r = df.agg(*[f(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
            return cls(strategy, {c: 0.0 if r[f"v{i}"] is None else r[f"v{i}"] for i, c in enumerate(columns)})
        out = {}
        for c in columns:
            counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"), (F.max(order) if order else F.min(c)).alias("o"))
            top = counts.orderBy(F.desc("n"), "o").first()
            out[c] = top["v"] if top else 0 if is_numeric(kinds[c]) else None
        return cls(strategy, out)

    def transform(self, df: DataFrame) -> DataFrame:
        return normalize(df).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


def group_impute(df: DataFrame, columns: list[str], group: str, strategy: str = "mean") -> DataFrame:
    """Each missing value from its group's mean or median; 0 where a group has none. Groups are joined, not windowed."""
    df = normalize(df)
    f = F.avg if strategy == "mean" else F.median
    stats = df.groupBy(F.col(group).alias("__g")).agg(*[f(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    joined = df.join(stats, df[group].eqNullSafe(stats["__g"]), "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__v{i}"), F.lit(0.0)) for i, c in enumerate(columns)}).select(*df.columns)


@dataclass
class KNNImputer:
    """Missing values from the nearest donors: the rows it was fitted on, any number of them.

    Distances are Euclidean over dimensions both rows have; Gower's if a column is text. Only the row itself
    (same key) is no donor of its own; equal distances are ranked by key. No donor: 0, or the missing value
    for text. Donors are cut into pieces of at most ``held`` rows; rows with gaps meet each piece in blocks,
    and the best of all pieces are taken. Distances over shared dimensions are no metric, so no piece can be left out.
    """

    columns: list[str]
    donors: DataFrame
    key: str
    numeric: list[bool]
    width: list[float]
    k: int = 5
    weights: str = "uniform"
    held: int = 50_000

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], key: str, k: int = 5, weights: str = "uniform", held: int = 50_000) -> KNNImputer:
        df, kinds = normalize(df), dict(df.dtypes)
        numeric = [is_numeric(kinds[c]) for c in columns]
        r = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"w{i}") if num else F.lit(1.0).alias(f"w{i}") for i, (c, num) in enumerate(zip(columns, numeric))]).first()
        return cls(list(columns), df.select(key, *columns), key, numeric, [r[f"w{i}"] or 1.0 for i in range(len(columns))], k, weights, held)

    def _parts(self, df: DataFrame) -> DataFrame:
        """id, and a column for each of the imputer's: doubles, or texts."""
        return df.select(F.col(self.key).alias("id"), *[F.col(c).cast("double" if num else "string").alias(f"c{i}") for i, (c, num) in enumerate(zip(self.columns, self.numeric))])

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        columns, numeric, width, k, names = self.columns, self.numeric, self.width, self.k, df.columns
        df = settled(normalize(df).withColumn("__row", F.monotonically_increasing_id()))
        gap = F.lit(False)
        for c in columns:
            gap = gap | F.col(c).isNull()
        kind, gower = dict(self.donors.dtypes)[self.key], not all(numeric)
        donors = self._parts(self.donors)
        n = max(1, -(-self.donors.count() // self.held))
        lots = max(1, df.sparkSession.sparkContext.defaultParallelism // n)
        donors = donors.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        asked = df.filter(gap).select("__row", F.col(key).cast(kind).alias("id"), *[F.col(c).cast("double" if num else "string").alias(f"c{i}") for i, (c, num) in enumerate(zip(columns, numeric))])
        asked = asked.withColumn("lot", F.pmod(F.xxhash64("__row"), F.lit(lots)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

        def work(held, b):
            import pandas as pd

            held = held.sort_values("id", kind="stable", ignore_index=True)
            ids = held["id"].to_numpy()
            base = [held[f"c{i}"].to_numpy(float if num else object) for i, num in enumerate(numeric)]
            has = [~pd.isna(d) for d in base]
            values = [b[f"c{i}"].to_numpy(float if num else object) for i, num in enumerate(numeric)]
            missing = np.column_stack([pd.isna(v) for v in values])
            step = max(1, (1 << 21) // max(1, len(ids)))
            for at in range(0, len(b), step):
                part = slice(at, at + step)
                total, seen = (np.zeros((len(b["id"].iloc[part]), len(ids))) for _ in range(2))
                for i, num in enumerate(numeric):
                    both = ~missing[part, i][:, None] & has[i][None, :]
                    if num:
                        d = np.where(both, values[i][part][:, None] - base[i][None, :], 0.0)
                        total += np.abs(d) / width[i] if gower else d * d
                    else:
                        total += both & (values[i][part].astype(object)[:, None] != base[i][None, :])
                    seen += both
                dist = np.where((seen > 0) & (b["id"].to_numpy()[part][:, None] != ids[None, :]), total / np.maximum(seen, 1) if gower else np.sqrt(total), np.inf)
                rows = b["__row"].to_numpy()[part]
                for i, num in enumerate(numeric):
                    want = np.flatnonzero(missing[part, i])
                    own = np.flatnonzero(has[i])
                    if not len(want) or not len(own):
                        continue
                    d = dist[np.ix_(want, own)]
                    m = min(k, len(own))
                    cut = np.partition(d, m - 1, axis=1)[:, m - 1]
                    out = []
                    for r, (line, c) in enumerate(zip(d, cut)):
                        pick = np.flatnonzero((line <= c) & np.isfinite(line))
                        pick = pick[np.argsort(line[pick], kind="stable")][:m]
                        out.append(pd.DataFrame({"__row": rows[want[r]], "col": np.int32(i), "d": line[pick], "id": ids[own[pick]], "num": base[i][own[pick]] if num else np.nan, "txt": None if num else base[i][own[pick]]}))
                    yield pd.concat(out, ignore_index=True)

        found = meet(donors, asked, ["piece", "lot"], work, f"__row long, col int, d double, id {kind}, num double, txt string")
        best = found.withColumn("__place", F.row_number().over(Window.partitionBy("__row", "col").orderBy("d", "id"))).filter(F.col("__place") <= k)
        w = F.try_divide(F.lit(1.0), F.greatest("d", F.lit(1e-9))) if self.weights == "distance" else F.lit(1.0)
        votes = best.withColumn("w", w).groupBy("__row", "col", "txt").agg(F.sum("w").alias("w"), F.sum(F.col("num") * F.col("w")).alias("nw"), F.min("__place").alias("first"))
        pick = F.max(F.struct("w", (-F.col("first")).alias("near"), "txt"))["txt"]
        made = votes.groupBy("__row", "col").agg((F.sum("nw") / F.sum("w")).alias("num"), pick.alias("txt"))
        wide = made.groupBy("__row").agg(*[F.max(F.when(F.col("col") == i, F.col("num" if num else "txt"))).alias(f"__f{i}") for i, num in enumerate(numeric)])
        out = df.join(wide, "__row", "left")
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__f{i}"), F.lit(0.0)) if num else F.coalesce(F.col(c), F.col(f"__f{i}")) for i, (c, num) in enumerate(zip(columns, numeric))}
        return out.withColumns(filled).select(*names)


@saveable
@dataclass
class IterativeImputer:
    """Chained regressions: every column with gaps is regressed on the others, by rows of its own, until nothing moves."""

    columns: list
    start: dict
    models: dict
    low: float | None = None
    high: float | None = None

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], strategy: str = "mean", max_iter: int = 10, tol: float = 1e-3, low: float | None = None, high: float | None = None) -> IterativeImputer:
        df = normalize(df).select(*[F.col(c).cast("double").alias(c) for c in columns])
        start = SimpleImputer.fit(df, columns, strategy).values
        gaps = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
        todo = [c for c in columns if gaps[c]]
        now, models, last = settled(df.withColumns({f"__g_{c}": F.col(c).isNull() for c in columns} | {c: F.coalesce(F.col(c), F.lit(float(start[c]))) for c in columns})), {}, None
        for _ in range(max_iter):
            for c in todo:
                others = [o for o in columns if o != c]
                g = gram(now.filter(~F.col(f"__g_{c}")), {"1": F.lit(1.0)} | {o: F.col(o) for o in (*others, c)})
                beta = np.linalg.lstsq(g.g[:-1, :-1], g.g[:-1, -1], rcond=None)[0]
                models[c] = [float(b) for b in beta]
                # Settled for each column: nested projections over all others would grow with every step.
                now = settled(now.withColumn(c, F.when(F.col(f"__g_{c}"), cls._value(others, models[c], low, high)).otherwise(F.col(c))))
            means = np.array([v or 0.0 for v in now.agg(*[F.avg(F.when(F.col(f"__g_{c}"), F.col(c))) for c in todo]).first()]) if todo else np.zeros(0)
            if last is not None and (not len(means) or np.abs(means - last).max() < tol):
                break
            last = means
        return cls(list(columns), {k: float(v) for k, v in start.items()}, models, low, high)

    @staticmethod
    def _value(others: list[str], beta: list[float], low: float | None, high: float | None) -> Column:
        v = dot_columns(others, beta[1:]) + beta[0]
        v = v if low is None else F.greatest(F.lit(float(low)), v)
        return v if high is None else F.least(F.lit(float(high)), v)

    def transform(self, df: DataFrame, sweeps: int = 10) -> DataFrame:
        """The fitted regressions applied in turn, ``sweeps`` times, on Arrow batches of the columns concerned."""
        columns, models, start, low, high = self.columns, self.models, self.start, self.low, self.high
        low, high = -np.inf if low is None else low, np.inf if high is None else high

        @F.pandas_udf("array<double>")
        def filled(*series):
            import pandas as pd

            x = np.column_stack([s.to_numpy(float) for s in series])
            gap = np.isnan(x)
            x = np.where(gap, [float(start[c]) for c in columns], x)
            for _ in range(sweeps if len(models) > 1 else 1):
                for c, beta in models.items():
                    j = columns.index(c)
                    at = gap[:, j]
                    x[at, j] = np.clip(np.delete(x[at], j, 1) @ beta[1:] + beta[0], low, high)
            return pd.Series(list(x))

        out = normalize(df).withColumn("__x", filled(*[F.col(c).cast("double") for c in columns]))
        return out.withColumns({c: F.col("__x")[i] for i, c in enumerate(columns)}).drop("__x")


@saveable
@dataclass
class CompositionalImputer:
    """Missing parts from mean centred log-ratios of complete rows: part = exp(mean clr + row's log mean), exactly.

    With m of D parts missing the row's log geometric mean solves a linear equation, so nothing is iterated.
    Zeros are missing too.
    """

    parts: list
    mean_clr: list

    @classmethod
    def fit(cls, df: DataFrame, parts: list[str]) -> CompositionalImputer:
        whole = df.filter(" AND ".join(f"coalesce(`{p}` > 0 AND NOT isnan(`{p}`), false)" for p in parts))
        r = whole.agg(*[F.avg(F.log(F.col(p).cast("double"))) for p in parts]).first()
        if r[0] is None:
            raise ValueError("no complete row")
        logs = np.array([float(v) for v in r])
        return cls(list(parts), (logs - logs.mean()).tolist())

    def transform(self, df: DataFrame) -> DataFrame:
        d = len(self.parts)
        ok = {p: F.coalesce((F.col(p) > 0) & ~F.isnan(F.col(p).cast("double")), F.lit(False)) for p in self.parts}
        # log mean g = (sum of known logs + sum over missing of (clr + g)) / D, solved for g
        known = sum((F.when(ok[p], F.log(F.col(p).cast("double"))).otherwise(F.lit(float(c))) for p, c in zip(self.parts, self.mean_clr)), F.lit(0.0))
        n = sum((ok[p].cast("int") for p in self.parts), F.lit(0))
        g = F.try_divide(known, n.cast("double"))
        out = df.withColumn("__g", g)
        return out.withColumns({p: F.when(ok[p], F.col(p).cast("double")).otherwise(F.exp(F.lit(float(c)) + F.col("__g"))) for p, c in zip(self.parts, self.mean_clr)}).drop("__g") if d else df
