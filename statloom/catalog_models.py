"""More registered queries: p-values and intervals, families, recipe steps, trees of one split, Shapley values, searches."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from .catalog import ANOVA, DBSCAN, ORACLE_SQL, PARTS, RANKED, SPOTS, TWO, compositions, load, one_row, query, rounded, spots
from .functions import columns as fc
from .functions import special
from .operators import cluster, features, glm, htests, interpret, metrics, neighbors, ordination, smooth, table, trees
from .plans import formula
from .plans.pipeline import BranchPipeline, EarlyStopping, Pipeline, train
from .plans.recipe import Recipe
from .sources import models


def simpson(f: str, a: str, b: str, n: int = 20_000) -> str:
    """SQL for the integral of ``f`` (of x) from a to b."""
    return f"(SELECT ({b} - {a}) / {n} / 3 * sum((CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f})) FROM (SELECT i, {a} + ({b} - {a}) * i / {n}.0 AS x FROM generate_series(0, {n}) g(i)))"


T_DENSITY = "exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * pow(1 + x * x / {v}, -({v} + 1) / 2.0)"
CHI_DENSITY = "exp(({v} / 2.0 - 1) * ln(greatest(x, 1e-300)) - x / 2 - {v} / 2.0 * ln(2) - lgamma({v} / 2.0))"
F_DENSITY = "exp(lgamma(({v} + {w}) / 2.0) - lgamma({v} / 2.0) - lgamma({w} / 2.0) + {v} / 2.0 * ln({v} / CAST({w} AS DOUBLE)) + ({v} / 2.0 - 1) * ln(greatest(x, 1e-300)) - ({v} + {w}) / 2.0 * ln(1 + {v} * x / {w}))"
NORMAL = "exp(-x * x / 2) / sqrt(2 * pi())"
T_P = "1 - 2 * " + simpson(T_DENSITY.format(v="df"), "0", "abs(s)")


def tested(name: str, p: str, statistics: str) -> str:
    return f"SELECT '{name}' AS test, round({p}, 6) AS p_value FROM (SELECT * FROM ({statistics}))"


@query(" UNION ALL ".join([
    tested("t_one", T_P, "SELECT (avg(l_quantity) - 25.5) / (stddev_samp(l_quantity) / sqrt(count(*))) AS s, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem"),
    tested("t_two", T_P, f"{TWO} SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS s, CAST(a.n + b.n - 2 AS DOUBLE) AS df FROM a, b"),
    tested("t_paired", T_P, "SELECT avg(l_tax - l_discount + 0.01) / (stddev_samp(l_tax - l_discount + 0.01) / sqrt(count(*))) AS s, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem"),
    tested("chi_square", "1 - " + simpson(CHI_DENSITY.format(v="df"), "0", "s"), "WITH c AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), e AS (SELECT avg(n) AS e FROM c) SELECT sum((n - e) * (n - e) / e) AS s, CAST(count(*) - 1 AS DOUBLE) AS df FROM c, e"),
    tested("anova", "1 - " + simpson(F_DENSITY.format(v="d1", w="d2"), "0", "s"), ANOVA.format(g="o_orderpriority", v="o_totalprice", t="orders") + " SELECT (b / (k - 1)) / (w / (n - k)) AS s, CAST(k - 1 AS DOUBLE) AS d1, CAST(n - k AS DOUBLE) AS d2 FROM x"),
    tested("kruskal_wallis", "1 - " + simpson(CHI_DENSITY.format(v="df"), "0", "s"), RANKED.format(g="l_returnflag", v="l_quantity", t="lineitem") + " SELECT 12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1) AS s, CAST(count(*) - 1 AS DOUBLE) AS df FROM s"),
    tested("mann_whitney", "1 - 2 * " + simpson(NORMAL, "0", "abs(s)"), RANKED.format(g="l_linestatus", v="l_quantity", t="lineitem") + ", a AS (SELECT * FROM s ORDER BY g LIMIT 1), b AS (SELECT * FROM s ORDER BY g DESC LIMIT 1), u AS (SELECT a.n * b.n AS nn, a.n + b.n AS n, a.s - a.n * (a.n + 1) / 2 AS u1 FROM a, b) SELECT (least(u1, nn - u1) - nn / 2) / sqrt(nn * (n + 1) / 12) AS s FROM u"),
    tested("pearson", T_P, "SELECT r * sqrt((n - 2) / (1 - r * r)) AS s, CAST(n - 2 AS DOUBLE) AS df FROM (SELECT corr(l_quantity, l_tax) AS r, count(*) AS n FROM lineitem)"),
    tested("likelihood_ratio", "1 - 2 * " + simpson(NORMAL, "0", "sqrt(s)"), "SELECT -n * ln(1 - r) AS s FROM (SELECT count(*) AS n, regr_r2(l_quantity, l_tax) AS r FROM lineitem)"),
]))
def p_values_of_tests(spark, d):
    """Distribution values by continued fractions and series, held against integrals of the densities."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    c = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = c.crossJoin(F.broadcast(c.agg(F.avg("n").alias("e"))))
    got = {
        "t_one": htests.t_one(li, "l_quantity", 25.5), "t_two": htests.t_two(li, "l_extendedprice", "l_linestatus"), "t_paired": htests.t_paired(li.withColumn("up", F.col("l_tax") + 0.01), "up", "l_discount"),
        "chi_square": htests.chi_square(c, "n", "e"), "anova": htests.anova(o, "o_totalprice", "o_orderpriority"), "kruskal_wallis": htests.kruskal_wallis(li, "l_quantity", "l_returnflag"),
        "mann_whitney": htests.mann_whitney(li, "l_quantity", "l_linestatus"), "pearson": htests.pearson(li, "l_quantity", "l_tax"), "likelihood_ratio": glm.likelihood_ratio(glm.lm(li, "l_quantity ~ 1"), glm.lm(li, "l_quantity ~ l_tax")),
    }
    return spark.createDataFrame([(k, round(float(v["p_value"]), 6)) for k, v in got.items()], "test string, p_value double")


DISTRIBUTIONS = [
    ("gamma", special.gamma_cdf, special.gamma_quantile, (2.5, 1.5), (1.0, 4.0), "exp(1.5 * ln(greatest(x, 1e-300) / 1.5) - x / 1.5 - lgamma(2.5)) / 1.5"),
    ("beta", special.beta_cdf, special.beta_quantile, (2.5, 3.5), (0.3, 0.6), "pow(x, 1.5) * pow(1 - x, 2.5) * exp(lgamma(6.0) - lgamma(2.5) - lgamma(3.5))"),
    ("chisq", special.chisq_cdf, special.chisq_quantile, (4,), (2.0, 5.0), CHI_DENSITY.format(v=4)),
    ("t", lambda x, v: special.t_cdf(x, v) - 0.5, lambda p, v: special.t_quantile(p + 0.5, v), (7,), (0.5, 2.0), T_DENSITY.format(v=7)),
    ("f", special.f_cdf, None, (4, 9), (1.0, 2.5), F_DENSITY.format(v=4, w=9)),
    ("normal", lambda x: special.normal_cdf(x) - 0.5, lambda p: special.normal_quantile(p + 0.5), (), (0.5, 1.96), NORMAL),
    ("uniform", special.uniform_cdf, special.uniform_quantile, (0.0, 5.0), (1.0, 3.0), "0.2"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS distribution, CAST({x} AS DOUBLE) AS x, round({simpson(f, '0', str(x))}, 7) AS cdf, CAST({x if q else 'NULL'} AS DOUBLE) AS quantile" for n, _, q, _, xs, f in DISTRIBUTIONS for x in xs))
def distribution_functions(spark, d):
    """Distribution values (t and normal: from 0 on), and quantiles that lead back."""
    rows = [(n, x, round(cdf(x, *args), 7), round(q(cdf(x, *args), *args), 6) if q else None) for n, cdf, q, args, xs, _ in DISTRIBUTIONS for x in xs]
    return spark.createDataFrame(rows, "distribution string, x double, cdf double, quantile double")


# Linear models: errors, intervals, families.
SIMPLE = "SELECT n, b1, my - b1 * mx AS b0, mx, sxx, n * vy * (1 - r) / (n - 2) AS s2 FROM (SELECT CAST(count(*) AS DOUBLE) AS n, regr_slope({y}, {x}) AS b1, avg({y}) AS my, avg({x}) AS mx, var_pop({x}) * count(*) AS sxx, var_pop({y}) AS vy, regr_r2({y}, {x}) AS r FROM {t})"


@query(f"""WITH m AS ({SIMPLE.format(y="l_extendedprice", x="l_quantity", t="lineitem")}), t AS (SELECT '(Intercept)' AS term, b0 AS b, sqrt(s2 * (1 / n + mx * mx / sxx)) AS s FROM m UNION ALL SELECT 'l_quantity', b1, sqrt(s2 / sxx) FROM m)
SELECT term, round(b, 3) AS estimate, round(s, 4) AS std_error, round(b / s, 3) AS z, round(b - 1.959963984540054 * s, 3) AS low, round(b + 1.959963984540054 * s, 3) AS high FROM t""")
def glm_std_errors(spark, d):
    li = load(spark, d, "lineitem")
    s = models.load(models.save(glm.lm(li, "l_extendedprice ~ l_quantity"))).summary(li)
    return s.select("term", F.round("estimate", 3).alias("estimate"), F.round("std_error", 4).alias("std_error"), F.round("z", 3).alias("z"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query(f"""WITH m AS ({SIMPLE.format(y="o_totalprice", x="o_custkey", t="orders")}) SELECT o_orderkey, round(b0 + b1 * o_custkey, 2) AS prediction, round(b0 + b1 * o_custkey - 1.6448536269514722 * sqrt(s2 * (1 / n + (o_custkey - mx) * (o_custkey - mx) / sxx)), 2) AS low FROM orders, m""")
def glm_interval(spark, d):
    o = load(spark, d, "orders")
    return glm.lm(o, "o_totalprice ~ o_custkey").predict(o, interval=0.9).select("o_orderkey", F.round("prediction", 2).alias("prediction"), F.round("prediction_low", 2).alias("low"))


GROUPS = "WITH g AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN v END) AS r, avg(CASE WHEN l_returnflag <> 'R' THEN v END) AS o FROM (SELECT l_returnflag, l_extendedprice / 10000 AS v FROM lineitem))"
LINKED = {"gamma": ("1 / o", "1 / r - 1 / o"), "inverse_gaussian": ("1 / (o * o)", "1 / (r * r) - 1 / (o * o)"), "negative_binomial": ("ln(o)", "ln(r / o)"), "gaussian": ("o", "r - o")}


@query(f"{GROUPS} " + " UNION ALL ".join(f"SELECT '{k}' AS family, '{t}' AS term, round({e}, 5) AS estimate FROM g" for k, v in LINKED.items() for t, e in zip(("(Intercept)", "x"), v)))
def glm_families(spark, d):
    """With one indicator the fitted means are the groups' means, on each family's own link."""
    li = load(spark, d, "lineitem").select((F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("x"))
    rows = [(k, t, round(b, 5)) for k in LINKED for m in [glm.glm(li, "y ~ x", k)] for t, b in zip(m.terms, m.coefficients)]
    return spark.createDataFrame(rows, "family string, term string, estimate double")


@query("""WITH y AS (SELECT l_linestatus, CAST(l_quantity AS DOUBLE) AS y, avg(l_quantity) OVER (PARTITION BY l_linestatus = 'F') AS m, avg(l_quantity) OVER () AS a FROM lineitem)
SELECT round(sum(2 * (y * ln(y / m) - (y - m))), 3) AS deviance, round(sum(2 * (y * ln(y / a) - (y - a))), 3) AS null_deviance, round(4 - 2 * sum(y * ln(m) - m - lgamma(y + 1)), 2) AS aic FROM y""")
def glm_deviance(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", (F.col("l_linestatus") == "F").cast("double").alias("x"))
    m = glm.glm(li, "l_quantity ~ x", "poisson")
    return one_row(spark, {"deviance": round(m.deviance, 3), "null_deviance": round(m.null_deviance, 3), "aic": round(m.aic, 2)})


@query("SELECT round(regr_r2(o_totalprice, o_custkey), 8) AS r2, round(1 - regr_r2(o_totalprice, o_custkey), 8) AS unexplained, round(abs(regr_slope(o_totalprice, o_custkey)), 5) AS importance FROM orders")
def regressor_score(spark, d):
    o = load(spark, d, "orders")
    m = glm.lm(o, "o_totalprice ~ o_custkey")
    r = metrics.regression(m.predict(o), "o_totalprice", "prediction").first()
    top = interpret.top_importances(interpret.coefficient_importance(m.terms, m.coefficients), 1)[0]
    return one_row(spark, {"r2": round(r["r2"], 8), "unexplained": round(m.deviance / m.null_deviance, 8), "importance": round(top["importance"], 5)})


@query('SELECT l_quantity AS y, CAST(1.0 AS DOUBLE) AS "(Intercept)", round(l_tax * l_tax + l_discount, 8) AS "I(l_tax ^ 2 + l_discount)", CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_linenumber * l_linenumber AS DOUBLE) AS "l_linenumber^2" FROM lineitem')
def formula_terms(spark, d):
    out = formula.apply("l_quantity ~ I(l_tax ^ 2 + l_discount) + poly(l_linenumber, 2)", load(spark, d, "lineitem"))
    return out.withColumn("I(l_tax ^ 2 + l_discount)", F.round("`I(l_tax ^ 2 + l_discount)`", 8))


# Recipe steps.
@query('SELECT p_partkey, round(p_size * p_retailprice, 3) AS product, CAST(p_size * p_size AS DOUBLE) AS square, CAST(p_size * p_size * p_size AS DOUBLE) AS cube, \'bin_\' || greatest(1, least(4, CAST(floor((p_retailprice - a) / ((z - a) / 4)) AS INT) + 1)) AS bin FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS z FROM part)')
def recipe_features(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = Recipe(p, ["p_size"], key="p_partkey").interactions(["p_size", "p_retailprice"]).polynomial(["p_size"], 3).bin(["p_retailprice"], 4).prep().data
    return out.select("p_partkey", F.round("p_size_x_p_retailprice", 3).alias("product"), F.col("`p_size^2`").alias("square"), F.col("`p_size^3`").alias("cube"), F.col("p_retailprice").alias("bin"))


@query("WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders), t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM n WHERE i <= floor(n * 0.7)) SELECT o_orderkey, round((o_totalprice - m) / s, 5) AS z FROM orders, t")
def recipe_split_bake(spark, d):
    """Fitted on the first 70 % of the rows, baked on all."""
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    done = Recipe(o, ["o_totalprice"], key="o_orderkey").scale(["o_totalprice"]).split(0.7, shuffle=False).prep()
    return done.bake(o).select("o_orderkey", F.round("o_totalprice", 5).alias("z"))


@query(ORACLE_SQL["impute_knn"])
def recipe_impute_knn(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") * 2 + F.col("s_nationkey")).alias("b"))
    return rounded(Recipe(s, ["a", "b"], key="s_suppkey").impute_knn(["a", "b"], 3).prep().data, 4)


@query(ORACLE_SQL["impute_iterative"])
def recipe_impute_iterative(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") * 0.5 + F.col("c_nationkey")).alias("b"))
    return rounded(Recipe(c, ["a", "b"], key="c_custkey").impute_iterative(["a", "b"]).prep().data.select("c_custkey", "b"), 3)


@query("SELECT unnest(['p_size', 'p_retailprice']) AS kept")
def recipe_selects(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") * 2 + 1).alias("twice"), "p_retailprice", F.lit(1.0).alias("same"))
    out = Recipe(p, ["p_size"], key="p_partkey").select_by_variance().select_by_correlation().prep().data
    return spark.createDataFrame([(c,) for c in out.columns if c != "p_partkey"], "kept string")


@query(ORACLE_SQL["downsample"].replace("SELECT n.", "SELECT 'down' AS step, n.", 1) + " UNION ALL SELECT 'up', o_orderstatus, m FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))")
def recipe_balance(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    made = {"down": Recipe(o, [], "o_orderstatus", "o_orderkey").downsample(), "up": Recipe(o, [], "o_orderstatus", "o_orderkey").upsample()}
    both = [r.prep().data.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), "o_orderstatus", "n") for k, r in made.items()]
    return both[0].unionByName(both[1])


@query("""WITH m AS (SELECT avg(p_size) AS ms, avg(p_retailprice) AS mp, var_samp(p_size) AS vs, var_samp(p_retailprice) AS vp, covar_samp(p_size, p_retailprice) AS c FROM part),
s AS (SELECT sqrt(((p_size - ms) * (p_size - ms) * vp - 2 * (p_size - ms) * (p_retailprice - mp) * c + (p_retailprice - mp) * (p_retailprice - mp) * vs) / (vs * vp - c * c)) AS d FROM part, m),
r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM s) SELECT count(*) AS n FROM r WHERE d < (SELECT d FROM r WHERE i = n - floor(n * 0.1))""")
def recipe_remove_outliers(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return Recipe(p, ["p_size"], key="p_partkey").remove_outliers(["p_size", "p_retailprice"]).prep().data.agg(F.count(F.lit(1)).alias("n"))


@query("WITH z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b, sign(corr(p_size, p_retailprice) OVER ()) AS r FROM part) SELECT p_partkey, round(abs(a + r * b) / sqrt(2), 5) AS first, round(abs(a - r * b) / sqrt(2), 5) AS second FROM z")
def recipe_pca(spark, d):
    """Two standardised columns: the axes are the diagonals."""
    p = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = Recipe(p, ["p_size"], key="p_partkey").pca(["p_size", "p_retailprice"]).prep().data
    return out.select("p_partkey", F.round(F.abs("PC1"), 5).alias("first"), F.round(F.abs("PC2"), 5).alias("second"))


@query("SELECT o_orderkey, round(abs(b * (o_custkey - m)), 4) AS score FROM orders, (SELECT regr_slope(o_totalprice, o_custkey) AS b, avg(o_custkey) AS m FROM orders)")
def recipe_rda(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = Recipe(o, ["o_custkey"], key="o_orderkey").rda(["o_totalprice"], ["o_custkey"]).prep().data
    return out.select("o_orderkey", F.round(F.abs("RDA1"), 4).alias("score"))


# Compositions, splines, kernels, scalers.
@query(f"WITH p AS ({PARTS}) SELECT l_suppkey, round(sqrt(2.0 / 3) * ((ln(a) + ln(b)) / 2 - ln(c)), 6) AS first, round(sqrt(0.5) * (ln(a) - ln(b)), 6) AS second, round(a / (a + b + c), 6) AS clr_back, round(b / (a + b + c), 6) AS alr_back, round(c / (a + b + c), 6) AS ilr_back FROM p")
def coda_partition(spark, d):
    """Balances of a sequential binary partition; every transform leads back to the closed parts."""
    x, basis = F.array("a", "b", "c"), fc.sbp_basis([[1, 1, -1], [1, -1, 0]])
    p = compositions(spark, d)
    p = p.select("l_suppkey", fc.ilr(x, 3, basis).alias("z"), fc.clr_inverse(fc.clr(x)).alias("u"), fc.alr_inverse(fc.alr(x)).alias("v"), fc.ilr_inverse(fc.ilr(x, 3, basis), 3, basis).alias("w"))
    return rounded(p.select("l_suppkey", F.col("z")[0].alias("first"), F.col("z")[1].alias("second"), F.col("u")[0].alias("clr_back"), F.col("v")[1].alias("alr_back"), F.col("w")[2].alias("ilr_back")))


@query("SELECT * FROM (VALUES (0, 1.0, -2.0, 1.0, 0.0), (1, -2.0, 5.0, -4.0, 1.0), (2, 1.0, -4.0, 5.0, -2.0), (3, 0.0, 1.0, -2.0, 1.0)) t(i, a, b, c, d)".replace("SELECT *", "SELECT i, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d"))
def spline_penalty(spark, d):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(features.penalty(4, 2))], "i int, a double, b double, c double, d double")


@query("SELECT p_partkey, CAST(1.0 AS DOUBLE) AS whole, CAST(1.0 AS DOUBLE) AS one, CAST(p_size AS DOUBLE) AS x, CAST(pow(greatest(p_size - 20, 0), 3) AS DOUBLE) AS cube FROM part")
def spline_bases(spark, d):
    """B-splines add up to 1 everywhere; the cubic regression basis is 1, x and truncated cubes."""
    p = load(spark, d, "part")
    b = features.bspline_basis(F.col("p_size"), [10, 20, 30], 1.0, 50.0)
    c = features.cubic_regression_basis(F.col("p_size"), [20])
    return p.select("p_partkey", F.round(sum(b[1:], b[0]), 8).alias("whole"), c[0].alias("one"), c[1].alias("x"), c[2].alias("cube"))


KERNELS = {
    "rbf": (smooth.Kernel("rbf", 2.0, 1.5), "2 * exp(-r * r / 1.5 / 1.5 / 2)"), "matern_0.5": (smooth.Kernel("matern", 1.0, 2.0, 0.5), "exp(-r / 2)"),
    "matern_1.5": (smooth.Kernel("matern", 1.0, 2.0, 1.5), "(1 + sqrt(3) * r / 2) * exp(-sqrt(3) * r / 2)"), "matern_2.5": (smooth.Kernel("matern", 1.0, 2.0, 2.5), "(1 + sqrt(5) * r / 2 + 5 * r * r / 12) * exp(-sqrt(5) * r / 2)"),
    "matern_inf": (smooth.Kernel("matern", 1.0, 2.0, math.inf), "exp(-r * r / 8)"), "periodic": (smooth.Kernel("periodic", 1.0, 2.0, period=3.0), "exp(-2 * pow(sin(pi() * r / 3), 2) / 2)"),
    "rational_quadratic": (smooth.Kernel("rational_quadratic", 1.0, 2.0, alpha=1.5), "pow(1 + r * r / (2 * 1.5 * 4), -1.5)"), "dot": (smooth.Kernel("dot", 0.5), "0.5 + 1 * (1 + r)"), "constant": (smooth.Kernel("constant", 3.0), "3.0"),
    "sum": (smooth.Kernel("constant", 3.0) + smooth.Kernel("rbf"), "3 + exp(-r * r / 2)"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kernel, CAST(r AS DOUBLE) AS r, round(CAST({f} AS DOUBLE), 8) AS value FROM (VALUES (0.0), (0.5), (2.0)) t(r)" for k, (_, f) in KERNELS.items()))
def kernels(spark, d):
    rows = [(k, r, round(float(f(np.array([[1.0]]), np.array([[1.0 + r]]))[0, 0]), 8)) for k, (f, _) in KERNELS.items() for r in (0.0, 0.5, 2.0)]
    return spark.createDataFrame(rows, "kernel string, r double, value double")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, round(p_retailprice, 4) AS p_retailprice FROM part")
def scale_inverse(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    s, m = features.Scaler.standard(p, ["p_size"]), features.Scaler.minmax(p, ["p_retailprice"], -1, 1)
    return rounded(s.inverse(m.inverse(m.transform(s.transform(p)))), 4)


# Tables.
@query("SELECT o_orderkey, o_custkey, o_custkey * 2 AS o_totalprice, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS y FROM orders")
def table_prepare(spark, d):
    """Columns written back by key, a text response encoded, other columns kept."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    back = table.write_back(o, o.select("o_orderkey", (F.col("o_custkey") * 2).alias("o_totalprice")), "o_orderkey")
    made = table.prepare(back, ["o_custkey", "o_totalprice"], "o_orderpriority", table.na_policy(None, True))
    return made.data.select("o_orderkey", *made.x, F.col(made.y).cast("long").alias("y"))


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'first', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 5) UNION ALL SELECT 'vector', count(*) FROM customer")
def table_sets(spark, d):
    c, s = load(spark, d, "customer").select("c_nationkey"), load(spark, d, "supplier").select("s_nationkey")
    made = {"both": c.intersect(s), "first": c.exceptAll(c.filter("false")).distinct().exceptAll(s.filter("s_nationkey < 5").distinct()), "vector": table.to_vector(c, "c_nationkey")}
    rows = [df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, df in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Neighbours: every distance, and a reference side by shards.
MEASURES = {
    "manhattan": "abs(a.x - b.x) + abs(a.y - b.y)", "chebyshev": "greatest(abs(a.x - b.x), abs(a.y - b.y))", "minkowski": "pow(pow(abs(a.x - b.x), 3) + pow(abs(a.y - b.y), 3), 1 / 3.0)",
    "canberra": "CASE WHEN abs(a.x) + abs(b.x) > 0 THEN abs(a.x - b.x) / (abs(a.x) + abs(b.x)) ELSE 0 END + CASE WHEN abs(a.y) + abs(b.y) > 0 THEN abs(a.y - b.y) / (abs(a.y) + abs(b.y)) ELSE 0 END", "hamming": "CAST(a.x <> b.x AS INT) + CAST(a.y <> b.y AS INT)",
}
OWN = "abs(a.x - b.x) + 2 * abs(a.y - b.y)"


def ranked_sql(measures: dict, k: int) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS metric, a.s_suppkey AS query, b.s_suppkey AS neighbor, CAST({f} AS DOUBLE) AS d FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey" for m, f in measures.items())
    return f"WITH s AS ({SPOTS}), p AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY metric, query ORDER BY round(d, 12), neighbor) AS rank FROM p) SELECT metric, query, CAST(rank AS INT) AS rank, round(d, 6) AS distance FROM r WHERE rank <= {k}"


def by_metric(spark, d, measures: dict, k: int, held: int):
    s, out = spots(spark, d), None
    for name, f in measures.items():
        got = neighbors.neighbors(s, s, ["x", "y"], "s_suppkey", "s_suppkey", k, f, exclude_self=True, held=held)
        got = got.select(F.lit(name).alias("metric"), "query", "rank", F.round("distance", 6).alias("distance"))
        out = got if out is None else out.unionByName(got)
    return out


@query(ranked_sql(MEASURES | {"own": OWN}, 3))
def knn_metrics(spark, d):
    own = lambda a, b: np.abs(a[:, None, 0] - b[None, :, 0]) + 2 * np.abs(a[:, None, 1] - b[None, :, 1])
    return by_metric(spark, d, {m: m for m in MEASURES} | {"own": own}, 3, neighbors.HELD)


@query(ranked_sql({"euclidean": "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", "manhattan": MEASURES["manhattan"]}, 4))
def knn_sharded(spark, d):
    """A task holds 8 rows, so the reference side goes by shards at any size of the table."""
    return by_metric(spark, d, {"euclidean": "euclidean", "manhattan": "manhattan"}, 4, 8)


# Clusters.
LLOYD = "c0 AS (SELECT * FROM (VALUES (0, 10.0, 920.0), (1, 40.0, 905.0)) t(k, x, y))"
for _i in range(4):
    LLOYD += f", a{_i} AS (SELECT p_partkey, any_value(p_size) AS s, any_value(p_retailprice) AS r, arg_min(k, (p_size - x) * (p_size - x) + (p_retailprice - y) * (p_retailprice - y)) AS k FROM part, c{_i} GROUP BY 1)"
    LLOYD += f", c{_i + 1} AS (SELECT k, avg(s) AS x, avg(r) AS y FROM a{_i} GROUP BY 1)"


@query(f"WITH {LLOYD} SELECT c3.k AS cluster, round(x, 5) AS p_size, round(y, 4) AS p_retailprice, n FROM c3 JOIN (SELECT k, count(*) AS n FROM a3 GROUP BY 1) m ON c3.k = m.k")
def kmeans_from_centers(spark, d):
    p = load(spark, d, "part")
    m = cluster.KMeans.fit(p, ["p_size", "p_retailprice"], 2, max_iter=3, start=[(10, 920), (40, 905)])
    sizes = {r["cluster"]: r["count"] for r in m.predict(p).groupBy("cluster").count().collect()}
    return spark.createDataFrame([(k, round(float(c[0]), 5), round(float(c[1]), 4), sizes.get(k, 0)) for k, c in enumerate(m.centers)], "cluster int, p_size double, p_retailprice double, n long")


@query(f"""WITH RECURSIVE s AS ({SPOTS}), e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a, s b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.0), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS root FROM r GROUP BY 1) SELECT a AS s_suppkey, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS cluster FROM m""")
def linkage_cut(spark, d):
    """Single linkage cut at a height: chains of rows that near. Built on the driver, as every method of the whole matrix."""
    m = cluster.Linkage.fit(spots(spark, d), ["x", "y"], "s_suppkey", "single")
    return spark.createDataFrame(list(m.cut_height(1.0).items()), "s_suppkey long, cluster int")


ORACLE_SQL["dbscan_predict"] = DBSCAN[: DBSCAN.rindex("SELECT s.s_suppkey")] + "SELECT s.s_suppkey AS query, CAST(coalesce(w.cluster, -1) AS INT) AS cluster FROM s LEFT JOIN w ON s.s_suppkey = w.a"
ORACLE_SQL["consensus"] = """WITH l AS (SELECT s_suppkey AS k, s_nationkey % 3 AS a, s_nationkey % 5 AS b, s_acctbal > 5000 AS c FROM supplier), g AS (SELECT a, b, c, min(k) AS first FROM l GROUP BY 1, 2, 3 HAVING count(*) > 1), n AS (SELECT *, dense_rank() OVER (ORDER BY first) AS cluster FROM g)
SELECT l.k, CAST(coalesce(n.cluster, -1) AS INT) AS cluster FROM l LEFT JOIN n ON l.a = n.a AND l.b = n.b AND l.c = n.c"""
ORACLE_SQL["impute_composition"] = f"""WITH p AS (SELECT l_suppkey, a, CASE WHEN l_suppkey % 4 <> 0 THEN b END AS b, c FROM ({PARTS})), m AS (SELECT avg(ln(b)) - (avg(ln(a)) + avg(ln(b)) + avg(ln(c))) / 3 AS z FROM p WHERE b IS NOT NULL)
SELECT l_suppkey, round(a, 6) AS a, round(coalesce(b, exp(z + (ln(a) + z + ln(c)) / 2)), 6) AS b, round(c, 6) AS c FROM p, m"""
ORACLE_SQL["compositional_outliers"] = f"""WITH z AS (SELECT l_suppkey, (ln(a) - ln(b)) * sqrt(0.5) AS u, ((ln(a) + ln(b)) / 2 - ln(c)) * sqrt(2.0 / 3) AS v FROM ({PARTS})), m AS (SELECT avg(u) AS mu, avg(v) AS mv, var_samp(u) AS a, var_samp(v) AS b, covar_samp(u, v) AS c FROM z),
d AS (SELECT l_suppkey, ((u - mu) * (u - mu) * b - 2 * (u - mu) * (v - mv) * c + (v - mv) * (v - mv) * a) / (a * b - c * c) AS d2 FROM z, m) SELECT l_suppkey, round(d2, 5) AS d2, round(exp(-d2 / 2), 5) AS p_value, exp(-d2 / 2) < 0.025 AS outlier FROM d"""
ORACLE_SQL["fisher_exact"] = """WITH t AS (SELECT sum(CAST(l_returnflag = 'R' AND l_linestatus = 'F' AS BIGINT)) AS a, sum(CAST(l_returnflag = 'R' AND l_linestatus <> 'F' AS BIGINT)) AS b, sum(CAST(l_returnflag <> 'R' AND l_linestatus = 'F' AS BIGINT)) AS c, sum(CAST(l_returnflag <> 'R' AND l_linestatus <> 'F' AS BIGINT)) AS d FROM lineitem),
x AS (SELECT x, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(c + d - a - c + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS l, a FROM t, generate_series(0, 700000) g(x) WHERE x <= a + b AND x <= a + c AND c + d - a - c + x >= 0)
SELECT round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) AS odds_ratio, round(least(1.0, (SELECT sum(exp(l)) FROM x WHERE l <= (SELECT l FROM x WHERE x.x = x.a) + 1e-7)), 6) AS p_value FROM t"""
ORACLE_SQL["kernel_shap"] = "SELECT s_suppkey, s_nationkey, s_acctbal, CAST(-3.0 AS DOUBLE) AS base, round(3 * (s_nationkey - 7.5), 6) AS shap_s_nationkey, round(-(s_acctbal - 2550) / 100, 6) AS shap_s_acctbal FROM supplier"


@query(ORACLE_SQL["kernel_shap"])
def permutation_shap(spark, d):
    """For a sum of functions of one column each, every order gives the same contributions."""
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    got = interpret.permutation_shap(s, ["s_nationkey", "s_acctbal"], lambda x: 3 * x[:, 0] - x[:, 1] / 100, np.array([[12.0, 5000.0], [3.0, 100.0]]), 4)
    return rounded(got, 6, ["s_acctbal"])


# Trees of one split.
SPLIT = """g AS (SELECT CAST(p_size AS DOUBLE) AS v, sum({y}) AS s, count(*) AS n FROM part GROUP BY 1), r AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, CAST(sum(s) OVER (ORDER BY v) AS DOUBLE) AS ls, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS ln, CAST(sum(s) OVER () AS DOUBLE) AS ts, CAST(sum(n) OVER () AS DOUBLE) AS tn FROM g),
b AS (SELECT (v + nx) / 2 AS cut, ls / ln AS low, (ts - ls) / (tn - ln) AS high, ts / tn AS mean FROM r WHERE nx IS NOT NULL ORDER BY round(ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln), 6) DESC, v LIMIT 1)"""


@query(f"WITH {SPLIT.format(y='CAST((p_size > 20) = (p_partkey % 4 > 0) AS INT)')} SELECT cut, prediction, count(*) AS n FROM (SELECT cut, CAST(CASE WHEN p_size <= cut THEN low ELSE high END > 0.5 AS INT) AS prediction FROM part, b) GROUP BY 1, 2")
def tree_stump(spark, d):
    p = load(spark, d, "part").withColumn("y", ((F.col("p_size") > 20) == (F.col("p_partkey") % 4 > 0)).cast("int"))
    t = trees.grow(p, ["p_size"], "y", max_depth=1)
    return t.predict(p).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).select(F.lit(float(t.nodes[0].get("threshold", 0.0))).alias("cut"), "prediction", "n")


@query(f"WITH {SPLIT.format(y='p_retailprice')} SELECT p_partkey, round(mean + 0.1 * (CASE WHEN p_size <= cut THEN low ELSE high END - mean), 4) AS prediction, round(mean, 4) AS base, round(CASE WHEN p_size <= cut THEN low ELSE high END - mean, 4) AS shap FROM part, b")
def boosting_stump(spark, d):
    """A round of boosting on one split, and the Shapley values of that split alone."""
    p = load(spark, d, "part")
    out = trees.boosting(p, ["p_size"], "p_retailprice", "p_partkey", n_estimators=1, max_depth=1).predict(p).select("p_partkey", "p_size", "prediction")
    shap = interpret.tree_shap(out, trees.grow(p, ["p_size"], "p_retailprice", "regression", max_depth=1))
    return shap.select("p_partkey", F.round("prediction", 4).alias("prediction"), F.round("base", 4).alias("base"), F.round("shap_p_size", 4).alias("shap"))


@query("WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS m FROM lineitem GROUP BY 1), q AS (SELECT q, any_value(n) AS n, arg_min(f, abs(q - m)) AS prediction FROM (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1), m GROUP BY 1) SELECT prediction, CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY 1")
def lda_one_column(spark, d):
    li = load(spark, d, "lineitem")
    return ordination.LDA.fit(li, ["l_quantity"], "l_returnflag").predict(li).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(r / (1 - r) * (n - 2), 5) AS statistic FROM (SELECT regr_r2(s_acctbal, s_nationkey) AS r, count(*) AS n FROM supplier)")
def rda_statistic(spark, d):
    r = ordination.rda_permutations(load(spark, d, "supplier"), ["s_acctbal"], ["s_nationkey"], "s_suppkey", 30)
    return one_row(spark, {"statistic": round(r["statistic"], 5)})


# Chains, branches, loops, optimisers.
class Fitted:
    """An estimator from a function of the training rows."""

    def __init__(self, f):
        self.fit = f


@query("SELECT o_orderkey, round(b0 + b1 * o_custkey, 2) AS prediction, round((b0 + b1 * o_custkey + m) / 2, 2) AS branches FROM orders, (SELECT regr_intercept(o_totalprice, o_custkey) AS b0, regr_slope(o_totalprice, o_custkey) AS b1, avg(o_totalprice) AS m FROM orders)")
def pipeline_and_branches(spark, d):
    """A regression behind a scaler, and the average of two fitted branches."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    chain = Pipeline([("scale", Fitted(lambda df: features.Scaler.standard(df, ["o_custkey"]))), ("line", Fitted(lambda df: glm.lm(df, "o_totalprice ~ o_custkey")))]).fit(o)
    both = BranchPipeline({"line": Fitted(lambda df: glm.lm(df, "o_totalprice ~ o_custkey")), "mean": Fitted(lambda df: glm.lm(df, "o_totalprice ~ 1"))}, "average").fit(o)
    return both.predict(chain.predict(o).join(o.select("o_orderkey", F.col("o_custkey").alias("raw")), "o_orderkey").withColumn("o_custkey", F.col("raw")), "branches").select("o_orderkey", F.round("prediction", 2).alias("prediction"), F.round("branches", 2).alias("branches"))


def half_up(v: float, digits: int, sure: int = 9) -> float:
    """Rounded as SQL rounds, halves up, of the digits that a search is sure of."""
    return float(Decimal(repr(round(v, sure))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@query("SELECT round(avg(l_quantity) * (1 - pow(0.8, 20)), 6) AS trained, round(avg(l_quantity), 4) AS golden, round(avg(l_quantity), 4) AS root, round(avg(l_quantity), 4) AS squares, round(avg(l_quantity), 3) AS adam FROM lineitem")
def optimisers(spark, d):
    """The mean as the least-squares constant, by a training loop and by each optimiser, over sums that Spark made."""
    s = load(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("s"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("q")).first()
    mean = s["s"] / s["n"]
    loss = lambda m: float((s["q"] - 2 * np.ravel(m)[0] * s["s"]) / s["n"] + np.ravel(m)[0] ** 2)
    state = {"m": 0.0, "rate": 0.1}

    def step(at):
        at["m"] -= at["rate"] * 2 * (at["m"] - mean)
        return loss(at["m"])

    train(step, state, 20, [EarlyStopping(5)])
    return one_row(spark, {
        "trained": half_up(state["m"], 6), "golden": half_up(smooth.minimize_scalar(loss, 0.0, 100.0), 4), "root": half_up(smooth.root_scalar(lambda m: m - mean, 0.0, 100.0), 4),
        "squares": half_up(float(smooth.least_squares(lambda p: np.array([p[0] - mean]), [1.0])["x"][0]), 4), "adam": half_up(float(smooth.minimize(loss, [20.0], method="adam")["x"][0]), 3, 5),
    })


FOLDS = "WITH k AS (SELECT p_retailprice AS y, CAST(p_size AS DOUBLE) AS x, CAST(p_size * p_size AS DOUBLE) AS z, least(3, floor((row_number() OVER (ORDER BY p_partkey) - 1) / floor(count(*) OVER () / 3)) + 1) AS fold FROM part), t AS (SELECT f.fold, k.x, k.y, k.z FROM (SELECT DISTINCT fold FROM k) f JOIN k ON k.fold <> f.fold)"
ORACLE_SQL["grid_search"] = f"""{FOLDS}, a AS (SELECT fold, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM t GROUP BY 1),
c AS (SELECT fold, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) AS sxx, var_pop(z) AS szz, covar_pop(x, z) AS sxz, covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy FROM t GROUP BY 1),
b AS (SELECT *, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS b1, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS b2 FROM c),
e AS (SELECT 1 AS degree, k.fold, -avg((y - i - s * x) * (y - i - s * x)) AS s FROM k JOIN a ON k.fold = a.fold GROUP BY 2 UNION ALL SELECT 2, k.fold, -avg((y - my - b1 * (x - mx) - b2 * (z - mz)) * (y - my - b1 * (x - mx) - b2 * (z - mz))) FROM k JOIN b ON k.fold = b.fold GROUP BY 2)
SELECT CAST(degree AS INT) AS degree, round(avg(s), 2) AS mean, round(stddev_pop(s), 2) AS std FROM e GROUP BY 1"""


@query("SELECT * FROM (VALUES ('nan', 'nan'), ('inf', 'inf'), ('-inf', '-inf'), ('array', '[1.0, nan]'), ('tuple', '(1, None)')) t(name, value)")
def model_codec(spark, d):
    """Values that JSON lacks, saved and loaded."""
    values = {"nan": math.nan, "inf": math.inf, "-inf": -math.inf, "array": np.array([1.0, math.nan]), "tuple": (1, None)}
    back = models.load(models.save(values))
    return spark.createDataFrame([(k, str(v.tolist() if hasattr(v, "tolist") else v)) for k, v in back.items()], "name string, value string")


@query("SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS same, round(avg(o_totalprice), 4) AS mean FROM orders")
def guards(spark, d):
    """Guards let good values through."""
    o = load(spark, d, "orders")
    ok = o.select(fc.guard_finite(F.col("o_totalprice")).alias("v"), fc.guard_positive(F.col("o_totalprice")).alias("c"), fc.guard_probability(F.lit(0.5)).alias("p"), "o_totalprice")
    return ok.agg(F.count(F.lit(1)).alias("n"), F.sum(fc.approx_equal(F.col("v"), F.col("o_totalprice")).cast("double")).alias("same"), F.round(F.avg("c"), 4).alias("mean"))


# SQL for whole models.
ORACLE_SQL["ordination_hulls"] = """WITH e AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS x, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2),
w AS (SELECT g, min(x) AS a, max(x) AS z FROM e GROUP BY 1),
below AS (SELECT g, x, lo AS y FROM e p WHERE NOT EXISTS (SELECT 1 FROM e a, e b WHERE a.g = p.g AND b.g = p.g AND a.x < p.x AND p.x < b.x AND (p.x - a.x) * (b.lo - a.lo) - (p.lo - a.lo) * (b.x - a.x) <= 0)),
above AS (SELECT g, x, hi AS y FROM e p WHERE NOT EXISTS (SELECT 1 FROM e a, e b WHERE a.g = p.g AND b.g = p.g AND a.x < p.x AND p.x < b.x AND (p.x - a.x) * (b.hi - a.hi) - (p.hi - a.hi) * (b.x - a.x) >= 0)),
h AS (SELECT g, 0 AS half, x AS place, x, y FROM below UNION ALL SELECT g, 1, -x, x, y FROM above WHERE (g, x, y) NOT IN (SELECT g, x, y FROM below))
SELECT g AS l_returnflag, CAST(row_number() OVER (PARTITION BY g ORDER BY half, place) - 1 AS INT) AS i, x, y FROM h"""
ORACLE_SQL["saved_model"] = f"""WITH m AS ({SIMPLE.format(y="o_totalprice", x="o_custkey", t="orders")}), t AS (SELECT '(Intercept)' AS term, b0 AS b, sqrt(s2 * (1 / n + mx * mx / sxx)) AS e FROM m UNION ALL SELECT 'o_custkey', b1, sqrt(s2 / sxx) FROM m), v AS (SELECT *, b / e AS s FROM t)
SELECT term, round(b, 3) AS estimate, round(e, 3) AS std_error, round(s, 3) AS z, round(greatest(0, 1 - 2 * {simpson(NORMAL, "0", "least(abs(s), 12)")}), 3) AS p_value, round(b - 1.959963984540054 * e, 3) AS low, round(b + 1.959963984540054 * e, 3) AS high FROM v"""
ORACLE_SQL["one_vs_rest"] = """WITH RECURSIVE c AS (SELECT c_custkey, c_mktsegment AS m, c_acctbal / 10000 AS x FROM customer), k AS (SELECT DISTINCT m FROM c),
fit AS (SELECT m, 0 AS step, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM k
    UNION ALL
    SELECT m, step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT m, step, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
        FROM (SELECT fit.m, step, b0, b1, x, CAST(c.m = fit.m AS INT) AS y, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM fit, c WHERE step < 10) GROUP BY 1, 2, 3, 4)),
top AS (SELECT c_custkey, arg_max(fit.m, b0 + b1 * x) AS prediction FROM c, fit WHERE step = 10 GROUP BY 1)
SELECT prediction, count(*) AS n FROM top GROUP BY 1"""
_XYZ = {"a": "l_quantity", "b": "l_discount", "c": "l_tax"}
_PAIRS = [p + q for i, p in enumerate("abc") for q in "abc"[i:]]
ORACLE_SQL["lda"] = f"""WITH v AS (SELECT l_returnflag AS f, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem),
m AS (SELECT f, avg(a) AS a, avg(b) AS b, avg(c) AS c, {", ".join(f"covar_pop({p[0]}, {p[1]}) * count(*) AS {p}" for p in _PAIRS)} FROM v GROUP BY 1),
w AS (SELECT {", ".join(f"sum({p}) AS {p}" for p in _PAIRS)} FROM m),
s AS (SELECT bb * cc - bc * bc AS iaa, ac * bc - ab * cc AS iab, ab * bc - ac * bb AS iac, aa * cc - ac * ac AS ibb, ab * ac - aa * bc AS ibc, aa * bb - ab * ab AS icc FROM w),
d AS (SELECT v.a, v.b, v.c, v.n, m.f, iaa * (v.a - m.a) * (v.a - m.a) + ibb * (v.b - m.b) * (v.b - m.b) + icc * (v.c - m.c) * (v.c - m.c)
        + 2 * (iab * (v.a - m.a) * (v.b - m.b) + iac * (v.a - m.a) * (v.c - m.c) + ibc * (v.b - m.b) * (v.c - m.c)) AS d
    FROM (SELECT a, b, c, count(*) AS n FROM v GROUP BY 1, 2, 3) v, m, s),
p AS (SELECT a, b, c, any_value(n) AS n, arg_min(f, d) AS prediction FROM d GROUP BY 1, 2, 3)
SELECT prediction, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1"""
_LEVELS = "t0 AS (SELECT CAST(p_size AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n, sum(p_retailprice) AS s, 0 AS node FROM part GROUP BY 1)"
for _i in range(3):
    _LEVELS += f""", r{_i} AS (SELECT node, v, lead(v) OVER k AS nx, sum(n) OVER k AS ln, sum(s) OVER k AS ls, sum(n) OVER (PARTITION BY node) AS tn, sum(s) OVER (PARTITION BY node) AS ts FROM t{_i} WINDOW k AS (PARTITION BY node ORDER BY v)),
    c{_i} AS (SELECT node, arg_max((v + nx) / 2, (round(gain, 9), -v)) AS cut FROM (SELECT *, (ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn) / tn AS gain FROM r{_i} WHERE nx IS NOT NULL) WHERE gain > 1e-7 GROUP BY 1),
    t{_i + 1} AS (SELECT v, n, s, CASE WHEN cut IS NULL THEN t.node * 2 WHEN v <= cut THEN t.node * 2 ELSE t.node * 2 + 1 END AS node FROM t{_i} t LEFT JOIN c{_i} c ON t.node = c.node)"""
ORACLE_SQL["tree_shap"] = f"""WITH {_LEVELS}, leaf AS (SELECT node, sum(s) / sum(n) AS value FROM t3 GROUP BY 1), base AS (SELECT sum(s) / sum(n) AS base FROM t0)
SELECT p_partkey, p_size, round(base, 5) AS base, round(value - base, 5) AS shap_p_size FROM part JOIN t3 ON p_size = v JOIN leaf ON t3.node = leaf.node, base"""
ORACLE_SQL["linkage"] = f"""WITH RECURSIVE s AS ({SPOTS}), p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a, s b WHERE a.s_suppkey <> b.s_suppkey),
run AS (SELECT s_suppkey AS k, s_suppkey AS c, (SELECT count(*) FROM s) AS n FROM s
    UNION ALL
    SELECT r.k, CASE WHEN r.c = m.y THEN m.x ELSE r.c END, r.n - 1
    FROM run r, (SELECT arg_min({{'x': x, 'y': y}}, (round(d, 10), x, y)).x AS x, arg_min({{'x': x, 'y': y}}, (round(d, 10), x, y)).y AS y
        FROM (SELECT u.c AS x, v.c AS y, avg(d) AS d FROM run u JOIN p ON u.k = p.a JOIN run v ON v.k = p.b WHERE u.c < v.c GROUP BY 1, 2)) m
    WHERE r.n > 5)
SELECT k AS s_suppkey, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INT) AS cluster FROM run WHERE n = least(5, (SELECT count(*) FROM s))"""
