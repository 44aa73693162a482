"""Model evaluation: one aggregate for a metric, running sums over distinct scores for a curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordering import indexed, running

EPS = 1e-15


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def regression(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """n, mse, rmse, mae and r2 (NULL if y is constant)."""
    e = F.col(y).cast("double") - F.col(pred)
    mse, mae = F.avg(e * e), F.avg(F.abs(e))
    return df.groupBy(*(by or [])).agg(F.count(e).alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), mae.alias("mae"), (1 - F.try_divide(mse, F.var_pop(F.when(e.isNotNull(), F.col(y).cast("double"))))).alias("r2"))


def binary(df: DataFrame, y: str, pred: str, positive=1) -> DataFrame:
    """accuracy, precision, recall, f1 and Cohen's kappa of two labels; undefined ratios are 0."""
    t, p = (F.col(y) == positive).cast("double"), (F.col(pred) == positive).cast("double")
    r = df.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(t * p).alias("tp"), F.sum(p).alias("pp"), F.sum(t).alias("ap"), F.sum((F.col(y) == F.col(pred)).cast("double")).alias("hit"))
    c = {k: F.col(k) for k in ("n", "tp", "pp", "ap", "hit")}
    precision, recall = _ratio(c["tp"], c["pp"]), _ratio(c["tp"], c["ap"])
    expected = (c["ap"] * c["pp"] + (c["n"] - c["ap"]) * (c["n"] - c["pp"])) / (c["n"] * c["n"])
    return r.select(
        (c["hit"] / c["n"]).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), F.try_divide(c["hit"] / c["n"] - expected, 1 - expected).alias("kappa"),
    )


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, y: str, pred: str, normalize: bool = False) -> DataFrame:
    """actual, predicted, n for every pair of labels in either column, zeros included; normalize: share of the actual label."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    grid = labels.withColumnRenamed("label", "actual").crossJoin(labels.withColumnRenamed("label", "predicted"))  # labels are classes: few
    out = grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    if not normalize:
        return out
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("actual"))), F.lit(0.0)))


def log_loss(df: DataFrame, y: str, prob: str) -> DataFrame:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(prob)))
    return df.agg((-F.avg(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))).alias("log_loss"))


def by_score(df: DataFrame, y: str, prob: str, positive=1) -> DataFrame:
    """Distinct scores from high to low with the positives and negatives up to each."""
    t = (F.col(y) == positive).cast("long")
    counts = df.groupBy(F.col(prob).alias("score")).agg(F.sum(t).alias("pos"), F.sum(1 - t).alias("neg"))
    return running(counts, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})


def _before(df: DataFrame, columns: list[str]) -> DataFrame:
    """The value of each column in the row before (by falling score): its running sum less its own share."""
    return df.withColumns({f"{c}_before": F.col(c) - F.col({"tp": "pos", "fp": "neg"}[c]) for c in columns})


def roc_auc(df: DataFrame, y: str, prob: str, positive=1) -> DataFrame:
    """Area under the ROC curve, ties counting half; 0.5 with one class only."""
    steps = _before(by_score(df, y, prob, positive), ["tp"])
    area = F.sum(F.col("neg") * (F.col("tp") + F.col("tp_before")) / 2)
    return steps.agg(F.coalesce(F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")), F.lit(0.5)).alias("auc"))


def roc_curve(df: DataFrame, y: str, prob: str, positive=1) -> DataFrame:
    """threshold, fpr, tpr: a point for each distinct score, and (infinity, 0, 0)."""
    steps = by_score(df, y, prob, positive)
    both = steps.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    points = steps.crossJoin(F.broadcast(both)).select(F.col("score").alias("threshold"), F.coalesce(F.try_divide(F.col("fp"), F.col("n")), F.lit(0.0)).alias("fpr"), F.coalesce(F.try_divide(F.col("tp"), F.col("p")), F.lit(0.0)).alias("tpr"))
    return points.unionByName(df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def pr_curve(df: DataFrame, y: str, prob: str, positive=1) -> DataFrame:
    """threshold, precision, recall at each distinct score."""
    steps = by_score(df, y, prob, positive)
    both = steps.agg(F.sum("pos").alias("p"))
    return steps.crossJoin(F.broadcast(both)).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("p")), F.lit(0.0)).alias("recall"))


def average_precision(df: DataFrame, y: str, prob: str, positive=1) -> DataFrame:
    """Precision at each score weighted by the recall it adds, from the second score on."""
    steps = _before(by_score(df, y, prob, positive), ["tp"])
    top = steps.agg(F.max("score").alias("top"), F.sum("pos").alias("p"))
    s = steps.crossJoin(F.broadcast(top)).filter(F.col("score") < F.col("top"))
    return s.agg(F.coalesce(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("average_precision"))


def calibration(df: DataFrame, y: str, prob: str, bins: int = 10, key: str = "_row_id", positive=1) -> DataFrame:
    """bin, n, mean_score, observed in bins of ceil(n / bins) rows by rising score; key breaks ties."""
    rows = indexed(df.select(prob, y, key), [prob, key], "__at")
    n = rows.agg(F.ceil(F.count(F.lit(1)) / bins).alias("size"))
    placed = rows.crossJoin(F.broadcast(n)).withColumn("bin", F.floor(F.col("__at") / F.col("size")))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_score"), F.avg((F.col(y) == positive).cast("double")).alias("observed"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings (Hubert and Arabie), from their contingency table."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    one = cells.agg(F.sum(pairs("n")).alias("index"), F.sum("n").alias("total"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("sa"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("sb"))
    r = one.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # one row each
    expected, top = F.try_divide(F.col("sa") * F.col("sb"), pairs("total")), (F.col("sa") + F.col("sb")) / 2
    return r.select(F.coalesce(F.try_divide(F.col("index") - expected, top - expected), F.lit(1.0)).alias("ari"))


# Losses with gradients: (loss per row, gradient per row before it is divided by n).
def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


LOSSES = {
    "mse": lambda y, p: ((p - y) * (p - y), 2 * (p - y)),
    "mae": lambda y, p: (F.abs(p - y), F.signum(p - y)),
    "huber": lambda y, p, delta=1.0: (F.when(F.abs(p - y) <= delta, (p - y) * (p - y) / 2).otherwise(delta * (F.abs(p - y) - delta / 2)), F.when(F.abs(p - y) <= delta, p - y).otherwise(delta * F.signum(p - y))),
    "hinge": lambda y, p: (F.greatest(F.lit(0.0), 1 - y * p), F.when(y * p < 1, -y).otherwise(F.lit(0.0))),
    "log": lambda y, p: (-(y * F.log(_clipped(p)) + (1 - y) * F.log(1 - _clipped(p))), (_clipped(p) - y) / (_clipped(p) * (1 - _clipped(p)))),
}
ALIASES = {"l2": "mse", "squared": "mse", "l1": "mae", "absolute": "mae", "logloss": "log", "bce": "log"}


def loss_function(name: str):
    """A loss by name or alias."""
    name = ALIASES.get(name, name)
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}")
    return LOSSES[name]


def loss(df: DataFrame, y: str, pred: str, name: str = "mse", **options) -> DataFrame:
    return df.agg(F.avg(loss_function(name)(F.col(y).cast("double"), F.col(pred), **options)[0]).alias("loss"))


def loss_gradient(df: DataFrame, y: str, pred: str, name: str = "mse", n: int | None = None, **options) -> DataFrame:
    """``df`` with the gradient of the mean loss by prediction."""
    n = n or df.count()
    return df.withColumn("gradient", loss_function(name)(F.col(y).cast("double"), F.col(pred), **options)[1] / float(n))


def cross_entropy(df: DataFrame, y: str, probs: str) -> DataFrame:
    """Mean cross-entropy of one-hot arrays against arrays of probabilities."""
    each = F.aggregate(F.zip_with(y, probs, lambda a, p: a * F.log(_clipped(p))), F.lit(0.0), lambda s, x: s + x)
    return df.agg((-F.avg(each)).alias("loss"))
