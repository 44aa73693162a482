"""Fitted models against closed forms, published reference values and simulated truth."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom import catalog_models
from statloom.functions import columns as fc
from statloom.functions import special
from statloom.operators import cluster, features, glm, htests, impute, interpret, neighbors, ordination, outliers, resample, smooth, table, trees
from statloom.plans import formula as fm
from statloom.plans.ordering import indexed, running
from statloom.plans.pipeline import BranchPipeline, Checkpoint, EarlyStopping, Pipeline, RateSchedule, cross_validate, grid, learning_curve, loguniform, random_candidates, randint, search, train
from statloom.plans.recipe import Recipe
from statloom.sources import models


@pytest.fixture(scope="module")
def line(spark):
    r = np.random.default_rng(0)
    x, z = r.normal(size=300), r.normal(size=300)
    return spark.createDataFrame(pd.DataFrame({"k": range(300), "x": x, "z": z, "g": [f"g{i % 6}" for i in range(300)], "y": 1 + 2 * x - z + r.normal(size=300) * 0.1, "c": (x + z > 0).astype(int)}))


def test_special_functions():
    assert special.gamma_cdf(1, 1) == pytest.approx(1 - math.exp(-1))
    assert special.chisq_cdf(5.991, 2) == pytest.approx(0.95, abs=1e-4) and special.chisq_cdf(9.488, 4) == pytest.approx(0.95, abs=1e-4)
    assert special.chisq_quantile(0.95, 3) == pytest.approx(7.814728, abs=1e-5)
    assert special.t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4) and special.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-5)
    assert special.f_cdf(4.965, 1, 10) == pytest.approx(0.95, abs=1e-4)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-10)
    assert special.beta_cdf(0.5, 2, 3) == pytest.approx(0.6875) and special.beta_quantile(0.6875, 2, 3) == pytest.approx(0.5)
    assert special.gamma_quantile(special.gamma_cdf(2.5, 3, 2), 3, 2) == pytest.approx(2.5)
    assert special.uniform_quantile(0.25, 2, 6) == 3 and special.uniform_cdf(9, 2, 6) == 1 and special.uniform_pdf(3, 2, 6) == 0.25
    assert special.gamma_pdf(1, 2) == pytest.approx(math.exp(-1)) and special.beta_pdf(0.5, 2, 2) == pytest.approx(1.5)


def test_normal_columns(spark):
    p = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(v,) for v in p], "p double").select(fc.normal_inverse(F.col("p")), fc.normal_cumulative(fc.normal_inverse(F.col("p")))).collect()
    for v, (q, back) in zip(p, got):
        assert q == pytest.approx(special.normal_quantile(v), abs=1e-6) and back == pytest.approx(v, abs=2e-7)


def test_links_invert(spark):
    for name, (link, inverse, slope) in fc.LINKS.items():
        mu, h = 0.37, 1e-5
        e = spark.range(1).select(link(F.lit(mu)).alias("e")).first()["e"]
        got = spark.range(1).select(inverse(F.lit(e)), slope(F.lit(e), inverse(F.lit(e))), inverse(F.lit(e + h)), inverse(F.lit(e - h))).first()
        assert got[0] == pytest.approx(mu, abs=1e-6), name
        assert got[1] == pytest.approx((got[2] - got[3]) / 2 / h, rel=1e-3), name


def test_compositions(spark):
    df = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0],)], "p array<double>")
    r = df.select(fc.clr_inverse(fc.clr("p")), fc.alr_inverse(fc.alr("p")), fc.ilr_inverse(fc.ilr("p", 4), 4), fc.alr_inverse(fc.alr("p", 1), 1), fc.aitchison_inner(F.col("p"), F.col("p")), fc.power(F.col("p"), 2)).first()
    for v in r[:4]:
        assert np.allclose(v, [0.1, 0.2, 0.3, 0.4])
    b = fc.sbp_basis([[1, 1, -1, -1], [1, -1, 0, 0], [0, 0, 1, -1]])
    assert np.allclose(b @ b.T, np.eye(3)) and r[4] > 0 and np.isclose(sum(r[5]), 1)
    with pytest.raises(ValueError):
        fc.sbp_basis([[1, 1, 0], [1, 0, -1]])


def test_order_helpers(spark):
    df = spark.createDataFrame([(i * 37 % 101, float(i)) for i in range(101)], "k long, v double").repartition(7)
    got = sorted(indexed(df, ["k"], "at").collect())
    assert [r["at"] for r in got] == list(range(101))
    r = sorted(running(df, [F.desc("k")], {"s": F.col("v")}).collect(), key=lambda r: -r["k"])
    assert np.allclose([x["s"] for x in r], np.cumsum([x["v"] for x in r]))


def test_formula_grammar(spark):
    f = fm.parse("y ~ a*b + a:b + log(`odd name`) + poly(x, 3) + I(a^2 + 1) + (1 + t | g)")
    assert [":".join(x.label() for x in t) for t in f.terms] == ["a", "b", "a:b", "log(odd name)", "poly(x,3)", "I(a ^ 2 + 1)"]
    assert f.random == (("g", True, ("t",)),) and len(fm.parse("y ~ a*b*c").terms) == 7
    for bad in ("y", "y ~ a -b", "y ~ a ~ b", "y ~ f(x)", "y ~ a +", "y ~ I(__import__('os'))", "y + z ~ a", "y ~ poly(x)"):
        with pytest.raises(fm.FormulaError):
            fm.parse(bad)
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "u"), (4.0, 5.0, None, "v"), (7.0, math.e, 9.0, "w")], "y double, a double, b double, s string")
    out = fm.apply("y ~ log(a) + a:b + I(a^2 * 2 - 1) + poly(a, 3)", df).collect()
    assert len(out) == 2 and out[0]["a:b"] == 6 and out[0]["I(a ^ 2 * 2 - 1)"] == 7 and out[0]["a^3"] == 8 and out[1]["log(a)"] == pytest.approx(1)
    with pytest.raises(fm.FormulaError):
        fm.apply("y ~ s", df)


R01 = {"X1": range(1, 11), "X2": [2, 3, 4, 3, 5, 6, 5, 7, 8, 9], "y": [3, 5, 7, 6, 9, 11, 10, 13, 15, 17]}


def test_gaussian_reference(spark):
    df = spark.createDataFrame(pd.DataFrame(R01).astype(float))
    m = glm.lm(df, "y ~ X1 + X2")
    assert np.allclose(m.coefficients, [-0.0734, 0.4404, 1.3945], atol=1e-4) and m.deviance == pytest.approx(0.1468, abs=1e-4)
    x = np.column_stack((np.ones(10), R01["X1"], R01["X2"]))
    rss = m.deviance
    assert np.allclose(m.std_errors, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / 7))
    assert m.log_likelihood == pytest.approx(-5 * (math.log(2 * math.pi * rss / 10) + 1)) and m.aic == pytest.approx(8 - 2 * m.log_likelihood)
    p = m.predict(df, interval=0.9).collect()
    assert all(r["prediction_low"] < r["prediction"] < r["prediction_high"] for r in p)
    small = glm.lm(df, "y ~ X1")
    assert glm.likelihood_ratio(small, m)["p_value"] < 0.05 and glm.compare({"a": small, "b": m})[0]["model"] == "b"
    back = models.load(models.save(m))
    assert back.coefficients == m.coefficients and np.allclose(back.covariance, m.covariance)


@pytest.mark.parametrize("family, link", [("poisson", None), ("binomial", None), ("binomial", "probit"), ("gamma", None), ("gamma", "log"), ("inverse_gaussian", None), ("negative_binomial", None), ("gaussian", "log"), ("poisson", "sqrt")])
def test_families_solve_their_score_equations(spark, family, link):
    r = np.random.default_rng(4)
    x = r.uniform(0.2, 1, 400)
    y = {"binomial": (r.uniform(size=400) < 0.3 + 0.3 * x).astype(float), "poisson": r.poisson(1 + 2 * x).astype(float), "negative_binomial": r.poisson(1 + 2 * x).astype(float)}.get(family, (1 + x) * r.gamma(20, 1 / 20, 400))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    m = glm.glm(df, "y ~ x", family, link)
    assert m.converged
    e = m.coefficients[0] + m.coefficients[1] * x
    mu, slope = {"log": (np.exp(e), np.exp(e)), "logit": ((q := 1 / (1 + np.exp(-e))), q * (1 - q)), "probit": (np.array([special.normal_cdf(v) for v in e]), np.exp(-e * e / 2) / math.sqrt(2 * math.pi)), "inverse": (1 / e, -1 / e**2), "inverse_squared": (e**-0.5, -0.5 * e**-1.5), "sqrt": (e * e, 2 * e)}[m.link]
    var = {"poisson": mu, "binomial": mu * (1 - mu), "gamma": mu**2, "inverse_gaussian": mu**3, "negative_binomial": mu + mu**2, "gaussian": np.ones(400)}[family]
    score = np.column_stack((np.ones(400), x)).T @ ((y - mu) / var * slope)
    assert np.abs(score).max() < 1e-3
    assert m.deviance <= m.null_deviance + 1e-9 and m.aic == pytest.approx(2 * (2 + (family in ("gaussian", "gamma", "inverse_gaussian"))) - 2 * m.log_likelihood)


def test_weights_offset_ridge_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, None, 2.0), (4.0, 4.0, 1.0), (5.0, 5.0, 1.0)], "x double, y double, w double")
    assert glm.lm(df, "y ~ x").n == 4
    full = df.fillna({"y": 5.0})
    twice = full.union(full.filter("w = 2"))
    assert np.allclose(glm.lm(full, "y ~ x", weights=F.col("w")).coefficients, glm.lm(twice, "y ~ x").coefficients)
    shifted = glm.lm(full, "y ~ x", offset=F.col("x") * 2)
    assert shifted.coefficients[1] == pytest.approx(glm.lm(full, "y ~ x").coefficients[1] - 2)
    assert abs(glm.lm(full, "y ~ x", ridge=100.0).coefficients[1]) < abs(glm.lm(full, "y ~ x").coefficients[1])
    with pytest.raises(ValueError):
        glm.glm(df, "y ~ x", "unknown")


def test_several_classes(line):
    three = line.withColumn("t", F.when(F.col("x") < -0.5, "a").when(F.col("x") < 0.5, "b").otherwise("c"))
    m = glm.multinomial(three, "t", "x + z", max_iter=12)
    assert m.predict(three).filter("prediction = t").count() > 280
    ovr = glm.one_vs_rest(line, "c", "x + z", max_iter=8)
    assert glm.predict_ovr(ovr, line).filter("prediction = c").count() > 285
    assert glm.polynomial(line, "y", "x", 2).terms == ["(Intercept)", "x", "x^2"]


def test_mixed_models(spark):
    r = np.random.default_rng(1)
    g = np.repeat(np.arange(30), 20)
    u, x = r.normal(0, 2, 30), r.normal(size=600)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": [f"g{i}" for i in g], "y": 1 + 0.5 * x + u[g] + r.normal(0, 0.5, 600), "n": r.poisson(np.exp(0.3 + 0.4 * x + u[g] / 4)).astype(float)}))
    m = glm.mixed(df, "y ~ x + (1 | g)")
    assert m.coefficients[1] == pytest.approx(0.5, abs=0.06) and m.residual == pytest.approx(0.25, abs=0.05) and m.variances[0] == pytest.approx(np.var(u), rel=0.4)
    assert np.corrcoef([m.effects[f"g{i}"][0] for i in range(30)], u)[0, 1] > 0.99
    s = glm.mixed(df, "y ~ x + (1 + x | g)", max_iter=60)
    assert s.random_terms == ["(Intercept)", "x"] and s.variances[1] < 0.05
    p = glm.mixed(df, "n ~ x + (1 | g)", "poisson", max_iter=8)
    assert p.coefficients[1] == pytest.approx(0.4, abs=0.1) and p.predict(df).filter("prediction > 0").count() == 600
    with pytest.raises(ValueError):
        glm.mixed(df, "y ~ x")


def test_ordination(line):
    x = np.array([tuple(r) for r in line.select("x", "z", "y").collect()])
    m = ordination.PCA.fit(line, ["x", "z", "y"], scale=True)
    s = (x - x.mean(0)) / x.std(0)
    assert np.allclose(m.eigenvalues, np.linalg.svd(s, compute_uv=False) ** 2 / 299) and m.cumulative[-1] == pytest.approx(1)
    t = m.transform(line, 2).select(F.sum(F.col("PC1") * F.col("PC1")), F.sum(F.col("PC1") * F.col("PC2"))).first()
    assert t[0] == pytest.approx(1) and t[1] == pytest.approx(0, abs=1e-9)
    assert m.loadings(1).shape == (3, 3) and ordination.scaling_of("3") == 2
    d = ordination.LDA.fit(line, ["x", "z"], "c")
    assert d.predict(line).filter("prediction = c").count() > 270
    rda = ordination.RDA.fit(line, ["y", "z"], ["x"])
    assert 0 < rda.constrained < 1 and rda.rank == 1 and "RDA1" in rda.transform(line).columns
    assert ordination.rda_permutations(line, ["y"], ["x"], "k", 9)["p_value"] == 0.1
    c = ordination.CCA.fit(line, ["x", "z"], ["y"])
    assert c.correlations[0] > 0.99
    assert c.transform(line).agg(F.corr("X1", "Y1")).first()[0] == pytest.approx(float(c.correlations[0]))


def test_trees(line):
    t = trees.grow(line, ["x", "z"], "c", max_depth=6, bins=400)
    p = t.predict(line)
    assert p.filter("prediction = c").count() > 280 and t.depth() <= 6 and t.n_leaves() == t.text().count("value") and "digraph" in t.dot()
    assert sum(t.importances) == pytest.approx(1) and line.select(t.path().alias("p"), t.leaf().alias("l")).filter("element_at(p, -1) <> l OR p[0] <> 0").count() == 0
    stump = trees.grow(line, ["x"], "c", max_depth=1, bins=400)
    best = trees.best_split(line, "x", "c").first()
    assert stump.nodes[0]["threshold"] == pytest.approx(best["threshold"])
    f = trees.forest(line, ["x", "z"], "c", "k", n_estimators=5, max_depth=4, oob=True, class_weight="balanced")
    assert f.oob_score > 0.8 and f.predict(line).filter("prediction = c").count() > 260
    assert len(trees.forest(line, ["x", "z"], "c", "k", n_estimators=1, start=f).trees) == 6
    b = trees.boosting(line, ["x", "z"], "y", "k", n_estimators=8, rate=0.5)
    assert b.loss_history[-1] < b.loss_history[0] / 3
    bc = trees.boosting(line, ["x", "z"], "c", "k", "classification", n_estimators=5, rate=0.5)
    assert bc.predict(line, probabilities=True).filter("prediction = c").count() > 270
    assert models.load(models.save(t)).nodes == t.nodes
    shap = interpret.tree_shap(line.select("x", "z"), t, 1).collect()
    want = [r[0][1] for r in line.select(t.shares()).collect()]
    assert np.allclose([r["base"] + r["shap_x"] + r["shap_z"] for r in shap], want)


def test_smooth_models(spark):
    x = np.linspace(0, 1, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.sin(6 * x), "c": (np.sin(6 * x) > 0).astype(float)}))
    for basis in ("tp", "bs", "cr"):
        m = smooth.gam(df, "y", ["x"], n_splines=6, basis=basis, method="GCV")
        assert m.predict(df, level=0.95).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0] < 1e-3, basis
        assert m.summary()["deviance_explained"] > 0.99
    smooth.gam(df, "y", ["x"], method="REML")
    g = smooth.gam_classifier(df, "c", ["x"])
    assert g.predict(df).filter("prediction = c").count() > 185
    gp = smooth.GaussianProcess.fit(df.filter("x * 10 % 1 < 0.5"), ["x"], "y", smooth.Kernel("matern", length=0.2, nu=2.5), alpha=1e-4)
    assert gp.predict(df, std=True).agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 0.1
    assert gp.samples(np.array([[0.1], [0.5]]), 3).shape == (3, 2) and gp.samples(np.array([[0.1]]), 2, prior=True).shape == (2, 1)
    n = smooth.mlp(df, ["x"], ["y"], (16,), "tanh", epochs=100, rate=0.02)
    assert n.loss_history[-1] < n.loss_history[0] / 2 and "y_prediction" in n.predict(df).columns
    big = smooth.mlp(df, ["x"], ["y"], (4,), epochs=3, local_rows=10)
    assert len(big.loss_history) == 3
    for kind in ("rbf", "periodic", "rational_quadratic", "dot", "constant", "matern"):
        k = smooth.Kernel(kind)(x[:5, None], x[:5, None])
        assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9
    assert np.allclose((smooth.Kernel("rbf") + smooth.Kernel("constant"))(x[:2, None], x[:2, None]), smooth.Kernel("rbf")(x[:2, None], x[:2, None]) + 1)


def test_network_trains_alike_beyond_local_rows(spark):
    x = np.random.default_rng(3).uniform(-1, 1, 1500)
    df = spark.createDataFrame([(float(v), float(2 * v - 0.5)) for v in x], "x double, y double").repartition(3)
    fit = [smooth.mlp(df, ["x"], ["y"], (8,), "tanh", epochs=3, local_rows=n) for n in (100_000, 100)]
    a, b = (m.loss_history[-1] for m in fit)
    assert b < fit[1].loss_history[0] / 5 and b < 2 * a and a < 2 * b
    assert smooth.mlp(df, ["x"], ["y"], (8,), epochs=1, local_rows=100, batch=1499).loss_history


def test_optimisers():
    f = lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2
    for method in ("gd", "momentum", "rmsprop", "adam"):
        assert np.allclose(smooth.minimize(f, [0, 0], method=method, rate=0.02, max_iter=5000)["x"], [1, -2], atol=0.05), method
    assert smooth.minimize_scalar(lambda v: (v - 3) ** 2, 0, 10) == pytest.approx(3, abs=1e-5) and smooth.root_scalar(lambda v: v**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3))
    xs = np.linspace(0, 2, 30)
    assert np.allclose(smooth.curve_fit(lambda v, a, b: a * np.exp(b * v), xs, 2 * np.exp(0.5 * xs), [1, 1]), [2, 0.5], atol=1e-6)


def test_imputers(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, None, 6.0), (2, 7.0, 8.0, None), (3, None, 11.0, 12.0)], "k long, a double, b double, c double")
    assert impute.SimpleImputer.fit(df, ["a", "b", "c"]).values == {"a": 4.0, "b": 7.0, "c": 7.0}
    assert impute.SimpleImputer.fit(df, ["a", "b"], "median").values == {"a": 4.0, "b": 8.0}
    text = spark.createDataFrame([(0, "m", 1.0), (1, "f", 2.0), (2, None, 1.1), (3, "m", 1.2)], "k long, s string, v double")
    assert impute.SimpleImputer.fit(text, ["s"], "most_frequent", order="k").transform(text).filter("k = 2").first()["s"] == "m"
    assert impute.KNNImputer.fit(text, ["s", "v"], "k", 2).transform(text, "k").filter("k = 2").first()["s"] == "m"
    out = impute.IterativeImputer.fit(df, ["a", "b", "c"]).transform(df)
    assert out.filter("a IS NULL OR b IS NULL OR c IS NULL").count() == 0
    parts = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 6.0), (None, 4.0, 6.0), (5.0, 0.0, 15.0)], "p double, q double, r double")
    got = impute.CompositionalImputer.fit(parts, ["p", "q", "r"]).transform(parts).collect()
    assert got[2]["p"] == pytest.approx(2) and got[3]["q"] == pytest.approx(10)


def test_outliers(spark):
    r = np.random.default_rng(2)
    x = np.vstack((r.normal(size=(99, 2)), [[8, 8]]))
    df = spark.createDataFrame(pd.DataFrame({"k": range(100), "a": x[:, 0], "b": x[:, 1]})).union(spark.createDataFrame([(100, None, 1.0)], "k long, a double, b double"))
    for labels in (outliers.Mahalanobis.fit(df, ["a", "b"], 0.01).label(df), outliers.IsolationForest.fit(df, ["a", "b"], "k", 40, contamination=0.01).label(df), outliers.write_labels(df, outliers.local_outlier_factor(df, ["a", "b"], "k", 10, 0.01), "k")):
        got = {v["k"]: v["outlier"] for v in labels.collect()}
        assert got[99] == -1 and got[100] == 1 and len(got) == 101 and sum(v == -1 for v in got.values()) <= 4
    parts = spark.createDataFrame([(10.0 + i % 3, 20.0 + i % 5, 30.0 + i % 2, 40.0 + i % 7) for i in range(40)] + [(40.0, 5.0, 5.0, 5.0)], "p double, q double, r double, s double")
    got = outliers.CompositionalOutliers.fit(parts, ["p", "q", "r", "s"], F.col("p") < 40).score(parts).filter("outlier").collect()
    assert any(v["p"] == 40.0 for v in got)


def test_clusters(spark):
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(c, 0.2, (30, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame(pd.DataFrame({"k": range(90), "a": x[:, 0], "b": x[:, 1], "t": np.repeat([0, 1, 2], 30)}))
    m = cluster.KMeans.fit(df, ["a", "b"], 3, key="k")
    p = m.predict(df)
    assert cluster.rand_index(p, "cluster", "t") == 1.0 and cluster.silhouette_score(p, ["a", "b"], "k", "cluster") > 0.8
    d = cluster.dbscan(df, ["a", "b"], "k", 0.8, 4)
    assert cluster.rand_index(d.join(df, "k"), "cluster", "t") == 1.0
    new = spark.createDataFrame([(1000, 4.0, 0.1), (1001, 50.0, 50.0)], "k long, a double, b double")
    got = {v["query"]: v["cluster"] for v in cluster.dbscan_predict(new, df, d, ["a", "b"], "k", 0.8).collect()}
    assert got[1001] == -1 and got[1000] > 0
    for linkage in ("single", "complete", "average", "ward"):
        link = cluster.Linkage.fit(df, ["a", "b"], "k", linkage)
        cut = link.cut(3)
        assert len({(cut[i], i // 30) for i in range(90)}) == 3 and len(link.layout()) == 89
        assert len(set(link.cut_height(link.merges[-1][2] + 1).values())) == 1
    labels = d.join(p.select("k", F.col("cluster").alias("c2")), "k").select("k", F.col("cluster").alias("c1"), "c2")
    c = cluster.consensus(labels, "k", ["c1", "c2"], 0.9)
    assert cluster.rand_index(c.join(df, "k"), "cluster", "t") == 1.0 and cluster.agreement(labels, ["c1", "c2"]) == 1.0


def test_neighbours(line):
    got = neighbors.knn_classify(line, line, ["x", "z"], "k", "k", "c", 3)
    assert got.join(line, got["query"] == line["k"]).filter("predicted = c").count() > 285
    pr = neighbors.knn_probabilities(line, line, ["x", "z"], "k", "k", "c", 3, "distance").first()["probabilities"]
    assert sum(pr.values()) == pytest.approx(1)
    near = neighbors.radius_pairs(line, ["x", "z"], "k", 0.3).count()
    assert near == neighbors.neighbors(line, line, ["x", "z"], "k", "k", radius=0.3).count()


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski", "canberra", "hamming", "cosine"])
def test_shards_give_the_same_neighbours(line, metric):
    """A reference side beyond what a task holds: equal rows, whatever the metric, ties and copies included."""
    some = line.select("k", F.round("x", 1).alias("x"), F.round("z", 1).alias("z"), (F.col("k") % 3).cast("double").alias("u"), "c")
    args = (some, some, ["x", "z", "u"], "k", "k")
    assert rows_of(neighbors.neighbors(*args, 4, metric, extra=["c"], held=40)) == rows_of(neighbors.neighbors(*args, 4, metric, extra=["c"]))
    assert rows_of(neighbors.neighbors(*args, 3, metric, exclude_self=True, held=40)) == rows_of(neighbors.neighbors(*args, 3, metric, exclude_self=True))
    if metric in ("euclidean", "cosine"):
        assert rows_of(neighbors.neighbors(*args, radius=0.4, metric=metric, held=40)) == rows_of(neighbors.neighbors(*args, radius=0.4, metric=metric))


def test_methods_on_neighbours_have_no_row_limit(line):
    from statloom.operators import impute, outliers

    lof = rows_of(outliers.local_outlier_factor(line, ["x", "z"], "k", 5).select("k", "lof"))
    assert rows_of(outliers.local_outlier_factor(line, ["x", "z"], "k", 5, held=50).select("k", "lof")) == lof
    s = rows_of(cluster.silhouette_samples(line, ["x", "z"], "k", "c"))
    assert rows_of(cluster.silhouette_samples(line, ["x", "z"], "k", "c", held=70)) == s
    gaps = line.select("k", F.when(F.col("k") % 4 != 0, F.col("x")).alias("x"), "z", F.when(F.col("k") % 5 != 0, F.col("c").cast("string")).alias("t"))
    for columns in (["x", "z"], ["x", "z", "t"]):
        full = rows_of(impute.KNNImputer.fit(gaps, columns, "k", 3).transform(gaps, "k"))
        assert rows_of(impute.KNNImputer.fit(gaps, columns, "k", 3, held=60).transform(gaps, "k")) == full and all(None not in r[:3] for r in full)
    votes = neighbors.knn_classify(line, line, ["x", "z"], "k", "k", "c", 3, held=50)
    assert rows_of(votes) == rows_of(neighbors.knn_classify(line, line, ["x", "z"], "k", "k", "c", 3))


def test_components_of_many_edges(spark):
    edges = spark.createDataFrame([(i, i + 7) for i in range(700)] + [(5000, 5001), (9, 9)], "a long, b long").repartition(6)
    want = {i: i % 7 for i in range(707)} | {5000: 5000, 5001: 5000}
    for local in (500_000, 10):
        assert {r["node"]: r["component"] for r in cluster.connected(edges, local).collect()} == want


def test_p_values(spark):
    df = spark.createDataFrame([(float(v), g) for g, vs in {"a": [1.0, 2, 3], "b": [4.0, 5, 6], "c": [7.0, 8, 9]}.items() for v in vs], "v double, g string")
    a = htests.anova(df, "v", "g")
    assert (a["df_between"], a["df_within"], a["statistic"]) == (2, 6, 27) and a["p_value"] == pytest.approx(0.001, abs=1e-4)
    t = {(r["a"], r["b"]): r["p_value"] for r in htests.tukey_hsd(df, "v", "g").collect()}
    assert t["a", "c"] < 0.01 < t["a", "b"] < 0.05
    assert htests.studentized_range_cdf(3.773, 3, 12) == pytest.approx(0.95, abs=2e-3)
    assert htests.t_one(df, "v", 5.0)["p_value"] == pytest.approx(1) and htests.t_one(df, "v", 0.0, "greater")["p_value"] < 0.01
    assert htests.fisher_exact(8, 2, 1, 5)["p_value"] == pytest.approx(0.0349650, abs=1e-6)
    assert htests.kruskal_wallis(df, "v", "g")["statistic"] == pytest.approx(7.2)
    assert htests.mann_whitney(df.filter("g <> 'c'"), "v", "g")["statistic"] == 0
    assert htests.levene(df, "v", "g", "mean")["statistic"] == pytest.approx(0) and htests.levene(df, "v", "g", "trimmed")["statistic"] == pytest.approx(0)
    c = spark.createDataFrame([(10.0, 15.0), (20.0, 20.0), (30.0, 25.0)], "o double, e double")
    x = htests.chi_square(c, "o", "e")
    assert x["df"] == 2 and x["statistic"] == pytest.approx(25 / 15 + 1)
    assert htests.pearson(df.withColumn("w", F.lit(1.0)), "v", "w")["p_value"] == 1.0


def test_tables_and_encoders(spark):
    df = spark.createDataFrame([("Adelie", 1.0, "12abc"), ("Chinstrap", float("nan"), "x"), ("Gentoo", 3.0, " -2e1 ")], "species string, v double, s string")
    e = features.OneHotEncoder.fit(df, ["species"], drop_first=True)
    assert e.names() == ["species_Chinstrap", "species_Gentoo"]
    assert [r["s"] for r in table.parse_numeric(df, ["s"]).collect()] == [12.0, None, -20.0]
    p = table.prepare(df, ["v", "species"], encode={"species": "onehot"})
    assert p.data.count() == 2 and len(p.x) == 3
    lab = features.LabelEncoder.fit(df, "species")
    assert lab.inverse(lab.transform(df, "species", "i"), "i", "back").filter("back = species").count() == 3
    new = spark.createDataFrame([("Other",)], "species string")
    with pytest.raises(Exception):
        lab.transform(new, "species").collect()
    assert features.LabelEncoder(lab.classes, "extend").transform(new, "species").first()[0] == 3
    assert features.LabelEncoder(lab.classes, "ignore").transform(new, "species").first()[0] is None
    with pytest.raises(ValueError):
        table.prepare(df, ["nope"])
    assert table.keep_by(df, ["v"], lambda p: p["v"] > 2).count() == 1
    s = features.Scaler.minmax(df.dropna(), ["v"], -1, 1)
    assert [r["v"] for r in s.inverse(s.transform(df.dropna())).collect()] == [1.0, 3.0]
    assert [r["value"] for r in table.number_range(spark, 5, 1, -2).collect()] == [5.0, 3.0, 1.0]
    assert features.penalty(4, 2).shape == (4, 4)
    x = spark.range(11).select((F.col("id") / 10).alias("x"))
    b = np.array([list(r) for r in x.select(*features.bspline_basis(F.col("x"), [0.3, 0.6], 0.0, 1.0)).collect()])
    assert np.allclose(b.sum(1), 1) and b.shape[1] == 6
    d = np.array([list(r) for r in x.select(*features.bspline_basis(F.col("x"), [0.3, 0.6], 0.0, 1.0, derivative=1)).collect()])
    assert np.allclose(d.sum(1), 0, atol=1e-6)


def test_recipe(line):
    r = Recipe(line.withColumn("y2", F.when(F.col("k") % 7 != 0, F.col("y"))), ["x", "z"], "c", "k").impute_median(["y2"]).clip_outliers(["x"]).scale(["x", "z"]).interactions(["x", "z"]).polynomial(["x"], 3).one_hot(["g"]).bin(["y"], 4).select_by_variance().split(0.7)
    p = r.prep()
    assert p.train.count() == 210 and p.test.count() == 90 and p.test.columns == p.train.columns
    baked = p.bake(line.withColumn("y2", F.lit(None).cast("double")))
    assert baked.columns == p.train.columns and baked.count() == 300 and "one_hot" in r.summary()
    more = Recipe(line, ["x"], "c", "k").remove_outliers(["x", "z"], contamination=0.1).pca(["x", "z"]).downsample().prep(fit_on="all")
    assert more.data.count() < 271 and "PC1" in more.data.columns and more.bake(line).count() == 300
    assert Recipe(line, ["x"], "c", "k").lda(["x", "z"]).prep().data.columns.count("LD1") == 1
    assert "RDA1" in Recipe(line, ["x"], "c", "k").rda(["y"], ["x", "z"]).prep().data.columns
    assert Recipe(line, ["x"], "c", "k").impute_knn(["x", "z"]).impute_iterative(["x", "z"]).impute_mean(["x"]).select_by_correlation(0.99).upsample().prep().data.count() >= 300


class Mean:
    def __init__(self, c):
        self.c = c

    def fit(self, df):
        v = df.agg(F.avg(self.c)).first()[0]

        class Model:
            def predict(self, d, output="prediction"):
                return d.withColumn(output, F.lit(v))

        return Model()


class Lin:
    def __init__(self, f="y ~ x"):
        self.f = f

    def fit(self, df):
        return glm.lm(df, self.f)


def test_pipelines_and_search(line):
    score = lambda m, d: -m.predict(d).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert Pipeline([("m", Lin())]).fit(line).predict(line).count() == 300
    b = BranchPipeline({"a": Mean("y"), "b": Lin("y ~ x + z")}, "average").fit(line).predict(line)
    assert {"prediction", "prediction_agreement", "prediction_confidence"} <= set(b.columns)
    cv = cross_validate(line, ["k"], lambda d: glm.lm(d, "y ~ x + z"), score, 3)
    assert cv["mean"] > -0.02 and len(cv["scores"]) == 3
    s = search(line, ["k"], grid({"f": ["y ~ x", "y ~ x + z", "y ~ nope"]}), lambda d, f: glm.lm(d, f), score, 3)
    assert s.best == {"f": "y ~ x + z"} and s.results[2]["mean"] == -math.inf
    assert len(random_candidates({"a": loguniform(0.1, 1), "b": randint(1, 5)}, 4)) == 4
    curve = learning_curve(line, ["k"], lambda d: glm.lm(d, "y ~ x + z"), score, (0.5, 1.0), 3)
    assert [c["size"] for c in curve] == [0.5, 1.0]
    keep, state = Checkpoint(), {"rate": 1.0, "v": 10.0}

    def step(st):
        st["v"] = max(st["v"] - st["rate"], 3.0)
        return st["v"]

    h = train(step, state, 50, [EarlyStopping(3), RateSchedule(0.5, 4), keep])
    assert len(h) < 50 and keep.best == 3.0


def test_resampling(line):
    s = resample.train_test_split(line, ["k"], 0.8, seed=1)
    assert s.filter("split = 'train'").count() == 240
    f = resample.stratified_k_fold(line, "c", ["k"], 5, True).groupBy("c", "fold").count().collect()
    assert len(f) == 10
    assert resample.shuffle_splits(line, ["k"], 2).filter("test_1").count() == 60
    assert resample.leave_one_out(line.limit(5), ["k"]).select("fold").distinct().count() == 5
    n = resample.bootstrap(line, ["k"]).agg(F.sum("times")).first()[0]
    assert 240 < n < 360


def test_interpretation(line):
    predict = lambda x: 2 + 3 * x[:, 0] - x[:, 1]
    bg = np.array([tuple(r) for r in line.select("x", "z").limit(50).collect()])
    few = line.limit(5).select("x", "z")
    want = [(3 * (r["x"] - bg[:, 0].mean()), -(r["z"] - bg[:, 1].mean())) for r in few.collect()]
    for f in (interpret.kernel_shap, interpret.permutation_shap):
        got = f(few, ["x", "z"], predict, bg).collect()
        assert np.allclose([(r["shap_x"], r["shap_z"]) for r in got], want), f
    imp = interpret.permutation_importance(line, ["x", "z"], "k", lambda d: -glm.lm(line, "y ~ x + z").predict(d).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0], 2)
    assert imp[0]["feature"] == "x" and interpret.top_importances(imp, 1)[0] == imp[0]
    assert interpret.effect_grid(line, "x", ["z"]).count() == 50
    h = interpret.hulls(line, "c", "x", "z").collect()
    assert {r["c"] for r in h} == {0, 1} and len(h) < 60
    assert interpret.coefficient_importance(["(Intercept)", "a"], [9.0, -2.0])[0]["importance"] == 2
    assert set(interpret.biplot(ordination.PCA.fit(line, ["x", "z"]), line)) == {"sites", "variables"}
    assert interpret.centroids(line, "c", "x", "z").count() == 2


def test_small_helpers(spark, line):
    row = spark.range(1).select(fc.approx_equal(F.lit(1.0), F.lit(1.0 + 1e-12)), fc.guard_probability(F.lit(0.5)), fc.guard_positive(F.lit(2)), fc.guard_finite(F.lit(1.5))).first()
    assert tuple(row) == (True, 0.5, 2.0, 1.5)
    for bad in (fc.guard_probability(F.col("id") + 1.5), fc.guard_positive(F.col("id") * -1.0), fc.guard_finite(F.col("id") + math.inf)):
        with pytest.raises(Exception):
            spark.range(1).select(bad).collect()
    assert table.sample_rows(line, ["k"], 7).count() == 7
    t = glm.coefficient_table({"a": glm.lm(line, "y ~ x"), "b": glm.lm(line, "y ~ x + z")}, line)
    assert t.count() == 5 and t.filter("low <= estimate AND estimate <= high").count() == 5


def test_saving_odd_values():
    v = {"a": [1.5, math.inf, -math.inf, None], 3: (1, "x"), "m": np.eye(2)}
    back = models.load(models.save(v))
    assert back["a"] == v["a"] and back[3] == (1, "x") and (back["m"] == np.eye(2)).all() and math.isnan(models.load(models.save(math.nan)))
    with pytest.raises(ValueError):
        models.load("{}")


def test_linkage_of_many_rows(spark):
    """Copies are one weighted point; equal distances go by the smallest keys; more rows than a matrix would hold."""
    r = np.random.default_rng(5)
    x = r.integers(0, 6, (40, 2)).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    d, left, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), {i: [i] for i in range(40)}, []
    while len(left) > 1:
        h, i, j = min((round(d[np.ix_(left[i], left[j])].mean(), 10), i, j) for i in left for j in left if i < j)
        left[i] += left.pop(j)
        want.append((h, len(left[i])))
        if len(left) == 5:
            clusters = {frozenset(v) for v in left.values()}
    m = cluster.Linkage.fit(df, ["a", "b"], "k")
    assert [(round(v[2], 10), v[3]) for v in m.merges] == want
    got = m.cut(5)
    assert {frozenset(k for k in got if got[k] == c) for c in got.values()} == clusters
    many = spark.range(5500).selectExpr("id AS k", "CAST(id % 40 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) * 1000 AS b")
    for kind in ("single", "average"):
        got = cluster.Linkage.fit(many, ["a", "b"], "k", kind).cut(3)
        assert len(got) == 5500 and all(c == k % 3 for k, c in got.items())


def test_coassociation_classes_say_what_all_pairs_say(spark):
    rows = [(i, i * 7 % 3, None if i % 11 == 0 else i * 5 % 4, -1 if i % 5 == 0 else i % 2) for i in range(60)] + [(60, -1, None, -1)]
    df = spark.createDataFrame(rows, "k long, a long, b long, c long")
    want = {(r["a"], r["b"]): r["agreement"] for r in cluster.coassociation(df, "k", ["a", "b", "c"]).collect()}
    got = cluster.coassociation_classes(df, "k", ["a", "b", "c"]).collect()
    names, least = [k[0] for k in rows], {}
    by = {tuple(v[1:]): min(k[0] for k in rows if k[1:] == v[1:]) for v in rows}
    home = {v[0]: by[tuple(v[1:])] for v in rows}
    own = {r["b"]: r["agreement"] for r in got if home[r["b"]] == r["a"]}
    between = {(r["a"], r["b"]): r["agreement"] for r in got if home[r["b"]] != r["a"]}
    for x in names:
        for y in names:
            if x < y:
                v = own[x] if home[x] == home[y] else between.get((min(home[x], home[y]), max(home[x], home[y])), 0.0)
                if v:
                    least[(x, y)] = v
    assert least == pytest.approx(want) and len(got) < len(want) and own[60] == 0.0


def test_pairs_at_the_radius_itself(spark):
    df = spark.createDataFrame([(0, 0.1, 0.0), (1, 0.4, 0.0), (2, -1e-20, 9.0), (3, 0.3, 9.0)], "k long, x double, y double")  # 0.4 - 0.1 is a bit over 0.3
    got = {(r["a"], r["b"]) for r in neighbors.radius_pairs(df, ["x", "y"], "k", 0.3, digits=6).filter("a < b").collect()}
    assert got == {(0, 1), (2, 3)}


def test_gaussian_process_takes_rows_at_few_points(spark):
    r = np.random.default_rng(8)
    x, y = r.integers(0, 6, 60).astype(float), r.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    kernel = smooth.Kernel("rbf", length=2.0)
    m = smooth.GaussianProcess.fit(df, ["x"], "y", kernel, alpha=0.1, optimize=False, max_rows=6)
    k, t = kernel(x[:, None], x[:, None]) + 0.1 * np.eye(60), (y - y.mean()) / y.std()
    z = np.array([[0.5], [3.0]])
    kz = kernel(z, x[:, None])
    got = m.predict(spark.createDataFrame([(0.5,), (3.0,)], "x double"), std=True).orderBy("x").collect()
    assert [g["prediction"] for g in got] == pytest.approx(list(kz @ np.linalg.solve(k, t) * y.std() + y.mean()))
    assert [g["prediction_std"] for g in got] == pytest.approx(list(np.sqrt(1 - np.einsum("ij,ji->i", kz, np.linalg.solve(k, kz.T))) * y.std()))
    assert m.log_likelihood == pytest.approx(-0.5 * t @ np.linalg.solve(k, t) - 0.5 * np.linalg.slogdet(k)[1] - 30 * math.log(2 * math.pi))


def test_golden_section_beyond_half_the_digits():
    assert smooth.minimize_scalar(lambda v: 853.5 - 2 * 25.40225 * v + v * v, 0.0, 100.0) == pytest.approx(25.40225, abs=1e-9)
    assert catalog_models.half_up(25.40225 - 2e-12, 4) == 25.4023


def test_fisher_on_large_counts():
    start = time.time()
    p = htests.fisher_exact(4_000_000, 5_000_000, 12_004_000, 15_000_000)["p_value"]
    z = (4_000_000 * 15_000_000 - 5_000_000 * 12_004_000) * math.sqrt(36_004_000 / (9_000_000 * 27_004_000 * 16_004_000 * 20_000_000))
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-3) and time.time() - start < 5
