"""Trees, forests and boosting.

One level of a tree is one aggregate: rows are counted by (node, feature, bin, class or moments), where bins
are the fitted cut points of each feature; splits are chosen from those counts and the next level's node is
a Column expression. With no more distinct values than bins the cuts are the midpoints between neighbouring
values, so the tree is the exact one. Scores are nested expressions, so prediction stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import largest
from ..sources.models import saveable
from ..sources.tables import normalize


def cut_points(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Midpoints of neighbouring distinct values, or ``bins`` quantiles' midpoints where there are more values.

    With ``bins`` of at least the number of distinct values the cuts are exact. One aggregate estimates how
    many values each column has, one gathers the values of the short ones, one the quantiles of the others.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    about = df.agg(*[F.approx_count_distinct(v, 0.02).alias(f"n{i}") for i, v in enumerate(x.values())]).first()
    short = [c for i, c in enumerate(columns) if about[f"n{i}"] <= 1.3 * bins + 10]
    got = df.agg(*[F.collect_set(x[c]).alias(f"v{i}") for i, c in enumerate(short)]).first() if short else []
    values = {c: got[f"v{i}"] for i, c in enumerate(short) if len(got[f"v{i}"]) <= bins}
    rest = [c for c in columns if c not in values]
    if rest:
        q = df.agg(*[F.percentile_approx(x[c], [i / bins for i in range(bins + 1)], F.lit(100 * bins)).alias(f"q{i}") for i, c in enumerate(rest)]).first()
        values |= {c: q[f"q{i}"] or [] for i, c in enumerate(rest)}
    out = {}
    for c in columns:
        v = sorted(set(values[c]))
        out[c] = [(a + b) / 2 for a, b in zip(v, v[1:])]
    return out


@saveable
@dataclass
class Tree:
    """nodes: id -> {feature, threshold, left, right} or {value, shares}, all with n, impurity, depth."""

    columns: list
    task: str
    classes: list
    nodes: dict
    importances: list = field(default_factory=list)

    def _expr(self, node: int, leaf) -> Column:
        t = self.nodes[node]
        if "feature" not in t:
            return leaf(t, node)
        return F.when(F.col(f"`{t['feature']}`") <= float(t["threshold"]), self._expr(t["left"], leaf)).otherwise(self._expr(t["right"], leaf))

    def value(self) -> Column:
        """The prediction as a Column."""
        return self._expr(0, lambda t, i: F.lit(t["value"]))

    def shares(self) -> Column:
        """Array of class shares of the leaf."""
        return self._expr(0, lambda t, i: F.array(*[F.lit(float(s)) for s in t["shares"]]))

    def leaf(self) -> Column:
        """The leaf's node number."""
        return self._expr(0, lambda t, i: F.lit(i))

    def path(self) -> Column:
        """Array of node numbers from the root to the leaf."""

        def walk(node: int, way: list[int]) -> Column:
            t, way = self.nodes[node], [*way, node]
            if "feature" not in t:
                return F.array(*[F.lit(i) for i in way])
            return F.when(F.col(f"`{t['feature']}`") <= float(t["threshold"]), walk(t["left"], way)).otherwise(walk(t["right"], way))

        return walk(0, [])

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.value())

    def depth(self) -> int:
        return max(t["depth"] for t in self.nodes.values())

    def n_leaves(self) -> int:
        return sum("feature" not in t for t in self.nodes.values())

    def text(self) -> str:
        """The rules, indented."""

        def walk(i: int, pad: str) -> list[str]:
            t = self.nodes[i]
            if "feature" not in t:
                return [f"{pad}value: {t['value']} (n={t['n']:g})"]
            return [f"{pad}{t['feature']} <= {t['threshold']:.6g}", *walk(t["left"], pad + "  "), f"{pad}{t['feature']} > {t['threshold']:.6g}", *walk(t["right"], pad + "  ")]

        return "\n".join(walk(0, ""))

    def dot(self) -> str:
        """Graphviz source."""
        out = ["digraph tree {"]
        for i, t in self.nodes.items():
            label = f"{t['feature']} <= {t['threshold']:.6g}" if "feature" in t else f"{t['value']}"
            out.append(f'  n{i} [label="{label}"];')
            out += [f"  n{i} -> n{t[s]};" for s in ("left", "right") if s in t]
        return "\n".join([*out, "}"])


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many cut points lie below a value."""
    return F.aggregate(F.array(*[F.lit(float(v)) for v in cuts]), F.lit(0), lambda s, v: s + (x > v).cast("int")) if cuts else F.lit(0)


def _equal(values: str, c) -> Column:
    """How many entries of an array column equal a label."""
    return F.size(F.filter(values, lambda v: v == F.lit(c)))


def _voted(values: str, classes: list) -> Column:
    """The most frequent label of an array column; of equals the first class."""
    if len(classes) == 1:
        return F.lit(classes[0])
    return largest([F.struct(_equal(values, c).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(classes)])["c"]


def _share(each: Column, i: int) -> Column:
    """Sum of the i-th entries of an array of arrays."""
    return F.aggregate(each, F.lit(0.0), lambda s, a: s + a[i])


def _impurity(stats: np.ndarray, task: str, criterion: str) -> np.ndarray:
    """Impurity along the first axis: class counts, or (w, sum, sum of squares)."""
    if task == "regression":
        w = np.where(stats[..., 0] > 0, stats[..., 0], np.inf)  # nothing: 0
        return np.maximum(stats[..., 2] / w - (stats[..., 1] / w) ** 2, 0)
    n = stats.sum(-1, keepdims=True)
    p = stats / np.where(n > 0, n, np.inf)
    if criterion == "entropy":
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)
    return 1 - p.max(-1) if criterion == "error" else 1 - (p * p).sum(-1)


def grow(df: DataFrame, columns: list[str], y: str, task: str = "classification", max_depth: int = 10, min_split: int = 2, min_leaf: int = 1, min_gain: float = 1e-7, criterion: str = "gini", bins: int = 64, weight: Column | None = None, features_per_node: int | None = None, seed: int = 42, cuts: dict | None = None, classes: list | None = None, max_leaves: int | None = None) -> Tree:
    """Grow a tree level by level. Missing values in ``columns`` or ``y`` leave a row out. max_leaves: about, if given."""
    rows = normalize(df).dropna(subset=[*columns, y])
    classes = classes if classes is not None else (sorted(r[0] for r in rows.select(y).distinct().collect()) if task == "classification" else [])
    cuts = cuts or cut_points(rows, columns, bins)
    w = F.lit(1.0) if weight is None else weight
    t = F.col(y).cast("double") if task == "regression" else F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)) - 1
    binned = [_bin(F.col(c).cast("double"), cuts[c]) for c in columns]
    base = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], t.alias("__t"), w.cast("double").alias("__w"), F.array(*binned).alias("__bins")).cache()
    width = 3 if task == "regression" else len(classes)
    nodes, active, tree = {0: {"depth": 0}}, [0], Tree(list(columns), task, list(classes), {})
    gains, rng = dict.fromkeys(columns, 0.0), np.random.default_rng(seed)
    total = None
    try:
        while active:
            tree.nodes = {i: n | ({} if "feature" in n else {"value": i}) for i, n in nodes.items()}
            at = base.withColumn("__node", tree.leaf()).filter(F.col("__node").isin(active))
            cells = at.select("__node", "__t", "__w", F.posexplode("__bins").alias("f", "b"))
            if task == "regression":
                got = cells.groupBy("__node", "f", "b").agg(F.sum("__w").alias("s0"), F.sum(F.col("__w") * F.col("__t")).alias("s1"), F.sum(F.col("__w") * F.col("__t") * F.col("__t")).alias("s2")).collect()
            else:
                got = cells.groupBy("__node", "f", "b", "__t").agg(F.sum("__w").alias("s")).collect()
            hist = {i: [np.zeros((len(cuts[c]) + 1, width)) for c in columns] for i in active}
            for r in got:
                h = hist[r["__node"]][r["f"]]
                if task == "regression":
                    h[r["b"]] += (r["s0"], r["s1"], r["s2"])
                else:
                    h[r["b"], int(r["__t"])] += r["s"]
            following = []
            for i in active:
                stats = hist[i][0].sum(0)
                n = stats[0] if task == "regression" else stats.sum()
                total = n if total is None else total
                imp = float(_impurity(stats, task, criterion))
                node = nodes[i] | {"n": float(n), "impurity": imp}
                node |= {"value": float(stats[1] / n) if n else 0.0} if task == "regression" else {"value": classes[int(stats.argmax())], "shares": (stats / max(n, 1e-300)).tolist()}
                best = None
                if node["depth"] < max_depth and n >= min_split and imp > 0 and (max_leaves is None or len(nodes) < 2 * max_leaves):
                    chosen = range(len(columns)) if features_per_node is None else sorted(rng.choice(len(columns), min(features_per_node, len(columns)), replace=False))
                    for f in chosen:
                        if not cuts[columns[f]]:
                            continue
                        left = np.cumsum(hist[i][f], 0)[:-1]
                        right = stats - left
                        nl, nr = (left[:, 0], right[:, 0]) if task == "regression" else (left.sum(1), right.sum(1))
                        ok = (nl >= min_leaf) & (nr >= min_leaf) & (nl > 0) & (nr > 0)
                        gain = np.where(ok, imp - (nl * _impurity(left, task, criterion) + nr * _impurity(right, task, criterion)) / n, -np.inf)
                        k = int(gain.argmax())
                        if gain[k] > min_gain and (best is None or gain[k] > best[0] + 1e-12):
                            # An empty run of bins behind the cut belongs to the gap: split it in the middle.
                            full = np.flatnonzero(hist[i][f].any(1))
                            k2 = int(full[full > k][0]) - 1
                            best = (float(gain[k]), columns[f], (cuts[columns[f]][k] + cuts[columns[f]][k2]) / 2)
                if best:
                    gain, c, cut = best
                    gains[c] += gain * n / total
                    a, b = len(nodes), len(nodes) + 1
                    node |= {"feature": c, "threshold": float(cut), "left": a, "right": b}
                    nodes[a] = nodes[b] = {"depth": node["depth"] + 1}
                    nodes[b] = dict(nodes[b])
                    following += [a, b]
                nodes[i] = node
            active = following
    finally:
        base.unpersist()
    s = sum(gains.values())
    return Tree(list(columns), task, list(classes), nodes, [gains[c] / s if s else 0.0 for c in columns])


@saveable
@dataclass
class Forest:
    columns: list
    task: str
    classes: list
    trees: list
    importances: list
    oob_score: float | None = None

    def shares(self) -> Column:
        """Mean class shares of the trees' leaves."""
        each = F.array(*[t.shares() for t in self.trees])
        k = len(self.classes)
        return F.array(*[_share(each, i) / len(self.trees) for i in range(k)])

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if self.task == "regression":
            return df.withColumn(output, F.aggregate(F.array(*[t.value() for t in self.trees]), F.lit(0.0), lambda s, v: s + v) / len(self.trees))
        votes = F.array(*[t.value() for t in self.trees])
        out = df.withColumn("__v", votes)
        return out.withColumn(output, _voted("__v", self.classes)).drop("__v")


def _times(key: str, seed: int) -> Column:
    """How often a row is drawn: a Poisson(1) variable from its hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    out, p, total = F.lit(0.0), math.exp(-1), 0.0
    for k in range(7):
        total += p
        out = out + (u > total).cast("double")
        p /= k + 1
    return out


def forest(df: DataFrame, columns: list[str], y: str, key: str, task: str = "classification", n_estimators: int = 20, max_depth: int = 8, class_weight: str | None = None, oob: bool = False, start: Forest | None = None, seed: int = 42, bins: int = 32, **options) -> Forest:
    """Trees on Poisson bootstrap weights with random features per node (root of p, or p / 3).

    class_weight "balanced": rows weigh n / (classes x class size). oob: score on rows no weight was given by a
    tree. start: a forest to add trees to.
    """
    rows = normalize(df).dropna(subset=[*columns, y])
    cuts = cut_points(rows, columns, bins)
    classes = sorted(r[0] for r in rows.select(y).distinct().collect()) if task == "classification" else []
    per = max(1, int(math.sqrt(len(columns)))) if task == "classification" else max(1, len(columns) // 3)
    weight = F.lit(1.0)
    if class_weight == "balanced":
        sizes = {r[y]: r["count"] for r in rows.groupBy(y).count().collect()}
        n = sum(sizes.values())
        weight = F.coalesce(*[F.when(F.col(y) == F.lit(c), F.lit(n / (len(sizes) * s))) for c, s in sizes.items()])
    trees = list(start.trees) if start else []
    first = len(trees)
    for i in range(first, first + n_estimators):
        times = _times(key, seed + i)
        trees.append(grow(rows.filter(times > 0), columns, y, task, max_depth, weight=weight * times, features_per_node=per, seed=seed + i, cuts=cuts, classes=classes, bins=bins, **options))
    importances = np.mean([t.importances for t in trees], 0).tolist()
    model = Forest(list(columns), task, classes, trees, importances)
    if oob:
        outs = [F.when(_times(key, seed + i) == 0, t.value()) for i, t in enumerate(trees)]
        votes = F.filter(F.array(*outs), lambda v: v.isNotNull())
        held = rows.withColumn("__v", votes).filter(F.size("__v") > 0)
        if task == "regression":
            pred = F.aggregate("__v", F.lit(0.0), lambda s, v: s + v) / F.size("__v")
            r = held.select(F.col(y).cast("double").alias("y"), pred.alias("p")).agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("e"), F.var_pop("y").alias("v")).first()
            model.oob_score = 1 - r["e"] / r["v"] if r["v"] else 0.0
        else:
            best = _voted("__v", classes)
            model.oob_score = held.agg(F.avg((best == F.col(y)).cast("double"))).first()[0]
    return model


@saveable
@dataclass
class Boosting:
    columns: list
    task: str
    classes: list
    base: list
    rate: float
    rounds: list  # rounds of one tree per output
    loss_history: list

    def scores(self) -> list[Column]:
        out = [F.lit(float(b)) for b in self.base]
        for trees in self.rounds:
            out = [s + t.value() * self.rate for s, t in zip(out, trees)]
        return out

    def predict(self, df: DataFrame, output: str = "prediction", probabilities: bool = False) -> DataFrame:
        s = self.scores()
        if self.task == "regression":
            return df.withColumn(output, s[0])
        if len(self.classes) == 2:
            p = 1 / (1 + F.exp(-s[0]))
            out = df.withColumn(output, F.when(p >= 0.5, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
            return out.withColumn("probability", p) if probabilities else out
        best = largest([F.struct(v.alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (v, c) in enumerate(zip(s, self.classes))])
        return df.withColumn(output, best["c"])


def boosting(df: DataFrame, columns: list[str], y: str, key: str, task: str = "regression", n_estimators: int = 20, rate: float = 0.1, max_depth: int = 3, subsample: float = 1.0, seed: int = 42, bins: int = 32) -> Boosting:
    """Gradient boosting: least squares, binary logistic with Newton leaves, or one tree per class on softmax residuals."""
    rows = normalize(df).dropna(subset=[*columns, y])
    classes = sorted(r[0] for r in rows.select(y).distinct().collect()) if task == "classification" else []
    cuts = cut_points(rows, columns, bins)
    k = 1 if task == "regression" or len(classes) == 2 else len(classes)
    t = [F.col(y).cast("double")] if task == "regression" else [(F.col(y) == F.lit(c)).cast("double") for c in (classes[1:] if k == 1 else classes)]
    start = rows.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(t)]).first()
    mean = [min(max(start[f"m{i}"], 1e-9), 1 - 1e-9) if task == "classification" else start[f"m{i}"] for i in range(k)]
    base = mean if task == "regression" else [math.log(m / (1 - m)) if k == 1 else math.log(m) for m in mean]
    model = Boosting(list(columns), task, classes, base, rate, [], [])
    now = rows.select(key, *columns, *[v.alias(f"__t{i}") for i, v in enumerate(t)], *[F.lit(float(b)).alias(f"__s{i}") for i, b in enumerate(base)])
    for m in range(n_estimators):
        if task == "regression":
            probs = [F.col("__s0")]
        elif k == 1:
            probs = [1 / (1 + F.exp(-F.col("__s0")))]
        else:
            top = F.greatest(*[F.col(f"__s{i}") for i in range(k)])
            z = sum((F.exp(F.col(f"__s{i}") - top) for i in range(k)), F.lit(0.0))
            probs = [F.exp(F.col(f"__s{i}") - top) / z for i in range(k)]
        staged = now.withColumns({f"__p{i}": p for i, p in enumerate(probs)}).withColumns({f"__r{i}": F.col(f"__t{i}") - F.col(f"__p{i}") for i in range(k)}).cache()
        part = staged if subsample >= 1 else staged.filter(F.pmod(F.xxhash64(F.lit(seed + m), key), F.lit(1_000_000)) < int(subsample * 1_000_000))
        trees = []
        for i in range(k):
            tree = grow(part, columns, f"__r{i}", "regression", max_depth, cuts=cuts, bins=bins)
            if task == "classification":
                leaves = part.groupBy(tree.leaf().alias("leaf")).agg(F.sum(f"__r{i}").alias("r"), F.sum(F.col(f"__p{i}") * (1 - F.col(f"__p{i}")) if k == 1 else F.abs(F.col(f"__r{i}")) * (1 - F.abs(F.col(f"__r{i}")))).alias("h")).collect()
                for r in leaves:
                    tree.nodes[r["leaf"]]["value"] = float((1 if k == 1 else (k - 1) / k) * r["r"] / max(r["h"], 1e-9))
            trees.append(tree)
        model.rounds.append(trees)
        if task == "regression":
            loss = staged.agg(F.avg(F.col("__r0") * F.col("__r0"))).first()[0]
        else:
            loss = staged.agg(*[-F.avg(F.col(f"__t{i}") * F.log(F.greatest(F.col(f"__p{i}"), F.lit(1e-15))) + ((1 - F.col(f"__t{i}")) * F.log(F.greatest(1 - F.col(f"__p{i}"), F.lit(1e-15))) if k == 1 else F.lit(0.0))) for i in range(k)]).first()
            loss = sum(loss)
        model.loss_history.append(float(loss))
        now = staged.select(key, *columns, *[f"__t{i}" for i in range(k)], *[(F.col(f"__s{i}") + trees[i].value() * rate).alias(f"__s{i}") for i in range(k)])
        if m % 10 == 9:
            from ..sources.tables import settled

            now = settled(now)
        staged.unpersist()
    return model


def best_split(df: DataFrame, x: str, y: str, criterion: str = "gini") -> DataFrame:
    """The exact best split of a numeric column for classes y: threshold, gain, by running class counts over distinct values."""
    from ..plans.ordering import indexed, running

    classes = sorted(r[0] for r in df.select(y).filter(F.col(y).isNotNull()).distinct().collect())
    counts = df.groupBy(F.col(x).cast("double").alias("v")).agg(*[F.sum((F.col(y) == F.lit(c)).cast("long")).alias(f"c{i}") for i, c in enumerate(classes)])
    steps = running(counts, ["v"], {f"l{i}": F.col(f"c{i}") for i in range(len(classes))})
    total = counts.agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in range(len(classes))])
    # The next distinct value comes from the same order, one place on.
    placed = indexed(counts.select("v"), ["v"], "at")
    following = placed.select((F.col("at") - 1).alias("at"), F.col("v").alias("next"))
    joined = steps.join(placed, "v").join(following, "at").crossJoin(F.broadcast(total))
    k = range(len(classes))

    def impurity(c: list[Column]) -> Column:
        n = sum(c, F.lit(0.0))
        ps = [v / n for v in c]
        if criterion == "entropy":
            return -sum((F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in ps), F.lit(0.0))
        return 1 - sum((p * p for p in ps), F.lit(0.0))

    left, all_ = [F.col(f"l{i}").cast("double") for i in k], [F.col(f"t{i}").cast("double") for i in k]
    right = [a - b for a, b in zip(all_, left)]
    n, nl = sum(all_, F.lit(0.0)), sum(left, F.lit(0.0))
    gain = impurity(all_) - nl / n * impurity(left) - (n - nl) / n * impurity(right)
    return joined.select(((F.col("v") + F.col("next")) / 2).alias("threshold"), gain.alias("gain")).orderBy(F.desc(F.round("gain", 10)), "threshold").limit(1)
