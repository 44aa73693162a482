"""Nearest neighbours and radius searches.

A reference side of up to HELD rows is held by every task as one matrix, past which queries of any number
stream in blocks. A larger one is divided into shards around pivot rows; a query first meets its own
pivot's shard, whose k-th distance bounds by the triangle inequality which other shards it has to visit.
Distances that are no metric visit all shards. Either way the result is exact and the same. Pairs within a
radius in up to three dimensions are joined by grid cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import distance
from ..sources.tables import settled

#: Rows of the reference side that a task holds; pivots of a larger side at most.
HELD, PIVOTS = 200_000, 1024
BLOCK = 1 << 22


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    return np.where(n > 0, 1 - a @ b.T / np.where(n > 0, n, 1), 1.0)


def _canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d, s = np.abs(a[:, None, :] - b[None, :, :]), np.abs(a)[:, None, :] + np.abs(b)[None, :, :]
    return np.where(s > 0, d / np.where(s > 0, s, 1), 0.0).sum(2)


def minkowski(p: float) -> Callable:
    """The distance of order p between the rows of two matrices."""
    return lambda a, b: (np.abs(a[:, None, :] - b[None, :, :]) ** p).sum(2) ** (1 / p)


def gower_block(ranges: list[float]) -> Callable:
    """Gower's distance of numeric columns with these ranges: the mean of differences in parts of the range."""
    r = np.array([v or 1.0 for v in ranges], float)
    return lambda a, b: (np.abs(a[:, None, :] - b[None, :, :]) / r).mean(2)


BLOCKS: dict[str, Callable] = {
    "euclidean": _exact,
    "manhattan": lambda a, b: np.abs(a[:, None, :] - b[None, :, :]).sum(2),
    "chebyshev": lambda a, b: np.abs(a[:, None, :] - b[None, :, :]).max(2),
    "minkowski": minkowski(3),
    "hamming": lambda a, b: (a[:, None, :] != b[None, :, :]).sum(2).astype(float),
    "canberra": _canberra,
    "cosine": _cosine,
}
#: Those for which the triangle inequality holds.
METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski", "hamming", "canberra")


def matrix(df: DataFrame, columns: list[str], key: str, most: int, extra: list[str] | None = None):
    """(keys, values, extra columns) of a table on the driver; an error if it has more than ``most`` rows."""
    kinds = dict(df.dtypes)
    rows = df.select(key, *columns, *(extra or [])).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a method of the whole matrix")
    return rows[key].to_numpy(), _values([rows[c] for c in columns], kinds[columns[0]]), rows[extra or []]


def _values(series: list, kind: str) -> np.ndarray:
    if not len(series[0]):
        return np.zeros((0, len(series)))
    if kind.startswith("array"):
        return np.array(series[0].tolist(), float).reshape(len(series[0]), -1)
    return np.column_stack([s.to_numpy(float) for s in series])


def vector(df: DataFrame, columns: list[str]):
    """The columns (or the one array column) as an array of doubles."""
    return F.col(columns[0]).cast("array<double>") if dict(df.dtypes)[columns[0]].startswith("array") else F.array(*[F.col(c).cast("double") for c in columns])


def _distances(x: np.ndarray, values: np.ndarray, metric: Callable, k: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Distances of a block, and for the k nearest by the Euclidean one the columns that can be among them.

    A product of matrices first bounds the squared distances; only what may be near is computed exactly.
    """
    if metric is not _exact or k is None or not len(values) or x.shape[1] < 4:
        return (metric(x, values) if len(values) else np.zeros((len(x), 0))), None
    sx, sv = (x * x).sum(1), (values * values).sum(1)
    rough = sx[:, None] + sv[None, :] - 2 * (x @ values.T)
    slack = 1e-9 * (sx[:, None] + sv[None, :]) + 1e-12
    m = min(k, rough.shape[1])
    cut = np.partition(rough + slack, m - 1, axis=1)[:, m - 1]
    maybe = rough - slack <= cut[:, None]
    out = np.full(rough.shape, np.inf)
    i, j = np.nonzero(maybe)
    for at in range(0, len(i), BLOCK // max(1, x.shape[1])):
        a, b = i[at : at + BLOCK // x.shape[1]], j[at : at + BLOCK // x.shape[1]]
        out[a, b] = np.sqrt(((x[a] - values[b]) ** 2).sum(1))
    return out, None


def _nearest(x, ids, keys, values, k, radius, metric, exclude_self) -> Iterator[tuple[slice, np.ndarray, list[int], np.ndarray]]:
    """By block of queries: (its rows, positions of the neighbours, how many for each row, distances); ``keys`` ascending."""
    step = max(1, BLOCK // max(1, values.size))
    for at in range(0, len(x), step):
        part = slice(at, min(len(x), at + step))
        d, _ = _distances(x[part], values, metric, None if radius is not None else k + exclude_self)
        if exclude_self:
            d = np.where(ids[part][:, None] == keys[None, :], np.inf, d)
        if radius is None:
            m = min(k, d.shape[1])
            if not m:
                continue
            # A cut by the k-th distance keeps ties, which the stable sort then ranks by key.
            cut = np.partition(d, m - 1, axis=1)[:, m - 1]
            rows = [np.flatnonzero(r <= c) for r, c in zip(d, cut)]
            rows = [a[np.argsort(r[a], kind="stable")][:m] for r, a in zip(d, rows)]
            rows = [a[np.isfinite(r[a])] for r, a in zip(d, rows)]
        else:
            rows = [np.flatnonzero(r <= radius) for r in d]
            rows = [a[np.argsort(r[a], kind="stable")] for r, a in zip(d, rows)]
        n = [len(a) for a in rows]
        if sum(n):
            yield part, np.concatenate(rows), n, np.concatenate([r[a] for r, a in zip(d, rows)])


def meet(train: DataFrame, queries: DataFrame, groups: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(held, batch)`` for every batch of queries with the train rows of its group, both frames of pandas.

    Both sides have the columns ``groups``; a group's train rows come first to its task, which holds them,
    and its queries stream past. The caller bounds the train rows of a group.
    """
    t, q = [c for c in train.columns if c not in groups], [c for c in queries.columns if c not in groups]
    none = lambda df, names, kinds: [F.lit(None).cast(kinds[c]).alias(f"{p}{c}") for p, c in names]
    kt, kq = dict(train.dtypes), dict(queries.dtypes)
    left = train.select(*groups, F.lit(0).alias("__side"), *[F.col(c).alias(f"t_{c}") for c in t], *none(train, [("q_", c) for c in q], kq))
    right = queries.select(*groups, F.lit(1).alias("__side"), *none(queries, [("t_", c) for c in t], kt), *[F.col(c).alias(f"q_{c}") for c in q])
    rows = left.unionByName(right).repartition(*groups).sortWithinPartitions(*groups, "__side")

    def run(batches):
        import pandas as pd

        group, held, parts = None, None, []
        for b in batches:
            for _, part in b.groupby((b[[*groups, "__side"]] != b[[*groups, "__side"]].shift()).any(axis=1).cumsum(), sort=False):
                at = tuple(part[g].iloc[0] for g in groups)
                if at != group:
                    group, held, parts = at, None, []
                if part["__side"].iloc[0] == 0:
                    parts.append(part[[f"t_{c}" for c in t]].set_axis(t, axis=1))
                    continue
                if not parts and held is None:
                    continue  # a group without train rows
                held = pd.concat(parts, ignore_index=True) if held is None else held
                parts = []
                yield from work(held, part[[f"q_{c}" for c in q]].set_axis(q, axis=1))

    return rows.mapInPandas(run, schema)


def neighbors(queries: DataFrame, train: DataFrame, columns: list[str], query_key: str, train_key: str, k: int = 5, metric: str | Callable = "euclidean", exclude_self: bool = False, radius: float | None = None, extra: list[str] | None = None, held: int = HELD) -> DataFrame:
    """query, neighbor, distance, rank (and extra columns of the neighbour): the k nearest, or all within ``radius``.

    columns: numeric ones, or one array column. Equal distances are ranked by the neighbour's key. metric: a
    name or a function of two matrices. held: reference rows that a task holds; more go by shards.
    """
    block = BLOCKS[metric] if isinstance(metric, str) else metric
    q, t, extras = dict(queries.dtypes), dict(train.dtypes), extra or []
    more = "".join(f", `{c}` {t[c]}" for c in extras)
    rows = train.select(F.col(train_key).alias("key"), vector(train, columns).alias("x"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(extras)])
    asked = queries.select(F.col(query_key).alias("id"), vector(queries, columns).alias("x"))
    first = rows.limit(held + 1).toPandas()
    if len(first) > held:
        return _sharded(asked, rows, k, metric, block, exclude_self, radius, extras, f"query {q[query_key]}, neighbor {t[train_key]}, distance double, rank int{more}", held)
    first = first.sort_values("key", kind="stable", ignore_index=True)
    told = queries.sparkSession.sparkContext.broadcast((first["key"].to_numpy(), _values([first["x"]], "array"), first.drop(columns=["key", "x"])))

    def run(batches):
        for b in batches:
            yield from _answer(*told.value, b, k, radius, block, exclude_self, extras)

    return asked.mapInPandas(run, f"query {q[query_key]}, neighbor {t[train_key]}, distance double, rank int{more}")


def _answer(keys, values, more, b, k, radius, block, exclude_self, extras, tag: str | None = None):
    import pandas as pd

    x, ids = _values([b["x"]], "array"), b["id"].to_numpy()
    for part, flat, n, d in _nearest(x, ids, keys, values, k, radius, block, exclude_self):
        out = {"query": np.repeat(ids[part], n), "neighbor": keys[flat], "distance": d, "rank": np.concatenate([np.arange(1, m + 1) for m in n]).astype(np.int32)}
        out |= {c: more[f"e{i}"].to_numpy()[flat] for i, c in enumerate(extras)}
        yield pd.DataFrame(out | ({tag: np.repeat(b[tag].to_numpy()[part], n)} if tag else {}))


def _sharded(asked: DataFrame, rows: DataFrame, k: int, metric, block: Callable, exclude_self: bool, radius: float | None, extras: list[str], schema: str, held: int) -> DataFrame:
    """The search by shards around pivots: rows that the least hashes choose, at most PIVOTS."""
    import pandas as pd

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    rows = settled(rows)
    n = rows.count()
    some = rows.orderBy(F.xxhash64("key"), "key").limit(min(PIVOTS, max(2, -(-4 * n // held)))).toPandas()
    pivots = _values([some["x"]], "array")

    def to_pivots(x: np.ndarray) -> np.ndarray:
        return np.concatenate([block(x[i : i + 1024], pivots) for i in range(0, len(x), 1024)])

    def homes(batches):
        for b in batches:
            d = to_pivots(_values([b["x"]], "array"))
            yield b.assign(shard=d.argmin(1).astype(np.int32), r=d.min(1))

    placed = settled(rows.mapInPandas(homes, f"{kinds}, shard int, r double"))
    sizes = {r["shard"]: (r["n"], r["r"]) for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect()}
    pieces = {s: -(-m // held) for s, (m, _) in sizes.items()}
    count = F.coalesce(*[F.when(F.col("shard") == s, F.lit(m)) for s, m in pieces.items() if m > 1], F.lit(1)) if any(m > 1 for m in pieces.values()) else F.lit(1)
    train = placed.withColumn("piece", F.pmod(F.xxhash64("key"), count).cast("int")).drop("r")
    bounded = metric in METRICS
    shards, reach = np.array(sorted(sizes)), np.array([sizes[s][1] if bounded else np.inf for s in sorted(sizes)])
    asked = settled(asked.withColumn("q", F.monotonically_increasing_id()))
    out_schema = schema + ", q long"

    def answer(part, b):
        part = part.sort_values("key", kind="stable", ignore_index=True)
        yield from _answer(part["key"].to_numpy(), _values([part["x"]], "array"), part, b, k, radius, block, exclude_self, extras, "q")

    q_kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
    if radius is None and bounded:
        def home(batches):
            for b in batches:
                d = to_pivots(_values([b["x"]], "array"))[:, shards]
                yield b.assign(shard=shards[d.argmin(1)].astype(np.int32), piece=np.int32(0))

        begun = meet(train.filter("piece = 0"), asked.mapInPandas(home, f"{q_kinds}, shard int, piece int"), ["shard", "piece"], answer, out_schema)
        bound = begun.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
        asked = settled(asked.join(bound, "q", "left"))
    else:
        asked = asked.withColumn("bound", F.lit(radius).cast("double"))

    def visits(batches):
        for b in batches:
            x, bound = _values([b["x"]], "array"), b["bound"].to_numpy(float)
            for at in range(0, len(b), 256):
                part = slice(at, at + 256)
                d = to_pivots(x[part])[:, shards]
                with np.errstate(invalid="ignore"):
                    go = ~(d - reach[None, :] > (bound[part] * (1 + 1e-9) + 1e-12)[:, None])
                i, j = np.nonzero(go)
                times = np.array([pieces[s] for s in shards[j]])
                i, j = np.repeat(i, times), np.repeat(j, times)
                piece = np.concatenate([np.arange(m) for m in times]) if len(times) else np.zeros(0)
                yield pd.DataFrame({c: b[c].iloc[part].iloc[i].to_numpy() for c in b.columns if c != "bound"} | {"shard": shards[j].astype(np.int32), "piece": piece.astype(np.int32)})

    names = [c for c in asked.columns if c != "bound"]
    q_kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes if c != "bound")
    found = meet(train, asked.select(*names, "bound").mapInPandas(visits, f"{q_kinds}, shard int, piece int"), ["shard", "piece"], answer, out_schema)
    order = Window.partitionBy("q").orderBy("distance", "neighbor")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return (ranked if radius is not None else ranked.filter(F.col("rank") <= k)).drop("q")


def radius_pairs(df: DataFrame, columns: list[str], key: str, eps: float, metric: str = "euclidean", digits: int | None = None) -> DataFrame:
    """a, b, distance of all pairs within eps, each way and each row with itself; by grid cell in up to 3 dimensions.

    digits: distances are rounded before they are held against eps, so that one of eps itself is within
    it whatever its last bits are.
    """
    if digits is not None:
        wide = radius_pairs(df, columns, key, eps + 10.0**-digits, metric)
        return wide.withColumn("distance", F.round("distance", digits)).filter(F.col("distance") <= eps)
    if len(columns) > 3 or metric not in ("euclidean", "manhattan", "chebyshev", "minkowski"):  # else no coordinate differs by more than the distance
        found = neighbors(df, df, columns, key, key, radius=eps, metric=metric)
        return found.select(F.col("query").alias("a"), F.col("neighbor").alias("b"), "distance")
    cells = [F.floor(F.col(c) / (eps * (1 + 1e-9))).cast("long") for c in columns]  # a hair wider: a quotient's last bits move no neighbour two cells off
    base = df.select(key, *[F.col(c).cast("double") for c in columns]).withColumn("cell", F.array(*cells))
    around = [F.array(*[F.element_at("cell", i + 1) + s for i, s in enumerate(shift)]) for shift in product((-1, 0, 1), repeat=len(columns))]
    left = base.select(F.col(key).alias("a"), F.array(*columns).alias("x"), F.explode(F.array(*around)).alias("cell"))
    right = base.select(F.col(key).alias("b"), F.array(*columns).alias("z"), "cell")
    d = distance(metric)(F.col("x"), F.col("z"))
    return left.join(right, "cell").select("a", "b", d.alias("distance")).filter(F.col("distance") <= eps)


def _vote_weight(weights: str):
    return F.lit(1.0) if weights == "uniform" else F.when(F.col("distance") == 0, F.lit(1e9)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))


def knn_classify(queries: DataFrame, train: DataFrame, columns: list[str], query_key: str, train_key: str, y: str, k: int = 5, weights: str = "uniform", metric="euclidean", held: int = HELD, exclude_self: bool = False) -> DataFrame:
    """query, predicted, probability (votes of the winner). Equal votes go to the label of the nearest neighbour."""
    near = neighbors(queries, train, columns, query_key, train_key, k, metric, exclude_self, extra=[y], held=held)
    votes = near.groupBy("query", y).agg(F.sum(_vote_weight(weights)).alias("w"), F.min("rank").alias("first"))
    best = votes.groupBy("query").agg(F.max(F.struct("w", (-F.col("first")).alias("near"), y)).alias("top"), F.sum("w").alias("all"))
    return best.select("query", F.col(f"top.{y}").alias("predicted"), (F.col("top.w") / F.col("all")).alias("probability"))


def knn_probabilities(queries: DataFrame, train: DataFrame, columns: list[str], query_key: str, train_key: str, y: str, k: int = 5, weights: str = "uniform", metric="euclidean", held: int = HELD) -> DataFrame:
    """query and a map of each voted label's share."""
    near = neighbors(queries, train, columns, query_key, train_key, k, metric, extra=[y], held=held)
    votes = near.groupBy("query", y).agg(F.sum(_vote_weight(weights)).alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("query"))
    return votes.select("query", y, share.alias("p")).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct(y, "p"))).alias("probabilities"))


def knn_regress(queries: DataFrame, train: DataFrame, columns: list[str], query_key: str, train_key: str, y: str, k: int = 5, weights: str = "uniform", metric="euclidean", held: int = HELD) -> DataFrame:
    near = neighbors(queries, train, columns, query_key, train_key, k, metric, extra=[y], held=held)
    w = _vote_weight(weights)
    return near.groupBy("query").agg((F.sum(F.col(y) * w) / F.sum(w)).alias("predicted"))


def gower_ranges(df: DataFrame, columns: list[str]) -> list[float | None]:
    """What gower() needs of each column: the range of a numeric one, None for text."""
    from ..sources.tables import is_numeric

    kinds = dict(df.dtypes)
    number = [c for c in columns if is_numeric(kinds[c])]
    r = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in number]).first() if number else {}
    return [float(r[c] or 0.0) if c in number else None for c in columns]
