"""Registered queries over the TPC-H-like tables, each with the DuckDB SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as fc
from .operators import cluster, describe, features, glm, htests, impute, interpret, metrics, neighbors, ordination, outliers, resample, smooth, table, trees
from .plans import formula
from .plans.ordering import average_ranks
from .plans.pipeline import agreement, combine, cross_validate_linear
from .plans.recipe import Recipe
from .sources.tables import read
from .streaming.stats import sessions, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Unique in lineitem, so it breaks every tie.
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEYS = ", ".join(KEY)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """These tables hold no NaN, so filters and columns go to the scan as they are."""
    return read(spark, f"{sf_dir}/{name}.parquet", nan_to_null=False)


def rounded(df: DataFrame, digits: int = 6, but: list[str] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" and c not in but else F.col(c) for c, k in df.dtypes])


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    """A dict of numbers as a row."""
    kinds = {k: "long" if isinstance(v, int) else "double" for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))


# Tables.
@query(f"SELECT {KEYS}, l_quantity FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05")
def table_filter_select(spark, d):
    return table.project(table.keep(load(spark, d, "lineitem"), "l_quantity >= 25 AND l_discount < 0.05"), [*KEY, "l_quantity"])


@query("SELECT CAST(v AS DOUBLE) AS value FROM generate_series(0, 1000, 5) t(v)")
def table_range(spark, d):
    return table.number_range(spark, 0, 1000, 5)


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def table_matrix(spark, d):
    return table.to_matrix(load(spark, d, "part"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0 END AS b FROM part")
def table_parse_numeric(spark, d):
    p = load(spark, d, "part")
    texts = p.select("p_partkey", F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("cm")).alias("a"), F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") / 10).cast("string"), F.lit("x"))).otherwise("none").alias("b"))
    return table.parse_numeric(texts, ["a", "b"])


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')")
def table_clean_categorical(spark, d):
    return table.clean_categorical(load(spark, d, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["F", "O"]}).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query(f"SELECT {KEYS}, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS q FROM lineitem WHERE l_linenumber % 3 <> 0")
def table_drop_missing(spark, d):
    li = load(spark, d, "lineitem").select(*KEY, F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q"))
    return table.drop_missing(li, ["q"])


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_idx, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O FROM orders WHERE o_orderstatus IN ('F', 'O')")
def table_preprocess(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    p = table.Preprocessor.fit(o, valid={"o_orderstatus": ["F", "O"]}, label=["o_orderpriority"], one_hot=["o_orderstatus"])
    return p.transform(o).select("o_orderkey", F.col("o_orderpriority_idx").cast("long"), "o_orderstatus_F", "o_orderstatus_O")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_idx FROM customer")
def label_encode_sorted(spark, d):
    c = load(spark, d, "customer")
    return features.LabelEncoder.fit(c, "c_mktsegment").transform(c, "c_mktsegment", "c_mktsegment_idx").select("c_custkey", F.col("c_mktsegment_idx").cast("long"))


@query("WITH f AS (SELECT c_mktsegment, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS i FROM customer GROUP BY 1) SELECT c_custkey, i AS c_mktsegment_idx FROM customer JOIN f USING (c_mktsegment)")
def label_encode_first_seen(spark, d):
    c = load(spark, d, "customer")
    return features.LabelEncoder.fit(c, "c_mktsegment", "c_custkey").transform(c, "c_mktsegment", "c_mktsegment_idx").select("c_custkey", F.col("c_mktsegment_idx").cast("long"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders")
def one_hot(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    made = features.OneHotEncoder.fit(o, ["o_orderstatus"], drop_first=True).transform(o)
    return made.select("o_orderkey", *[F.col(c) if c in made.columns else F.lit(0).alias(c) for c in ("o_orderstatus_O", "o_orderstatus_P")])


@query(f"SELECT {KEYS}, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 5) AS l_quantity, round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 5) AS l_discount FROM lineitem")
def scale_standard(spark, d):
    li = load(spark, d, "lineitem").select(*KEY, "l_quantity", "l_discount")
    return rounded(features.Scaler.standard(li, ["l_quantity", "l_discount"]).transform(li), 5, KEY)


@query(f"SELECT {KEYS}, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity FROM lineitem")
def scale_minmax(spark, d):
    li = load(spark, d, "lineitem").select(*KEY, "l_quantity")
    return rounded(features.Scaler.minmax(li, ["l_quantity"]).transform(li), 6, KEY)


@query('SELECT CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(p_size * p_size AS DOUBLE) AS "p_size^2", round(p_size * p_retailprice, 4) AS "p_size*p_retailprice", round(p_retailprice * p_retailprice, 4) AS "p_retailprice^2" FROM part')
def polynomial_features(spark, d):
    return rounded(features.polynomial_features(load(spark, d, "part"), ["p_size", "p_retailprice"]), 4, ["p_size", "p_retailprice"])


@query("SELECT p_partkey, p_size, p_retailprice, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part")
def feature_interactions(spark, d):
    return rounded(features.interactions(load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), 4, ["p_retailprice"])


@query("WITH b AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem) SELECT 'bin_' || CAST(greatest(1, least(5, CAST(floor((l_extendedprice - a) / ((z - a) / 5)) AS INT) + 1)) AS VARCHAR) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1")
def bin_equal_width(spark, d):
    li = load(spark, d, "lineitem")
    return features.EqualWidthBins.fit(li, "l_extendedprice").transform(li, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
q AS (SELECT max(CASE WHEN i = CAST(floor(n * 0.25) AS BIGINT) THEN v END) AS a, max(CASE WHEN i = CAST(floor(n * 0.75) AS BIGINT) THEN v END) AS b FROM s)
SELECT round(sum(greatest(a - 0.5 * (b - a), least(b + 0.5 * (b - a), v))) / count(*), 3) AS mean, round(min(greatest(a - 0.5 * (b - a), least(b + 0.5 * (b - a), v))), 3) AS low, round(max(greatest(a - 0.5 * (b - a), least(b + 0.5 * (b - a), v))), 3) AS high FROM s, q""")
def clip_iqr(spark, d):
    li = load(spark, d, "lineitem").select("l_extendedprice")
    out = features.Clipper.fit(li, ["l_extendedprice"], 0.5).transform(li)
    return rounded(out.agg(F.avg("l_extendedprice").alias("mean"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")), 3)


PARTS = "SELECT l_suppkey, sum(l_quantity) AS a, sum(l_extendedprice) / 1000 AS b, sum(l_tax + 0.01) * 100 AS c FROM lineitem GROUP BY 1"


def compositions(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a"), (F.sum("l_extendedprice") / 1000).alias("b"), (F.sum(F.col("l_tax") + 0.01) * 100).alias("c"))


@query(f"WITH p AS ({PARTS}) SELECT l_suppkey, round(a / (a + b + c), 6) AS a, round(b / (a + b + c), 6) AS b, round(c / (a + b + c), 6) AS c FROM p")
def coda_closure(spark, d):
    p = compositions(spark, d).withColumn("p", fc.closure(F.array("a", "b", "c")))
    return rounded(p.select("l_suppkey", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.col("p")[2].alias("c")))


@query(f"WITH p AS ({PARTS}) SELECT l_suppkey, round(ln(a) - (ln(a) + ln(b) + ln(c)) / 3, 6) AS a, round(ln(b) - (ln(a) + ln(b) + ln(c)) / 3, 6) AS b, round(ln(a / c), 6) AS alr_a, round(ln(b / c), 6) AS alr_b, round((ln(a) - ln(b)) * sqrt(0.5), 6) AS ilr_1, round(((ln(a) + ln(b)) / 2 - ln(c)) * sqrt(2.0 / 3), 6) AS ilr_2 FROM p")
def coda_log_ratios(spark, d):
    p = compositions(spark, d)
    x = F.array("a", "b", "c")
    p = p.select("l_suppkey", fc.clr(x).alias("clr"), fc.alr(x).alias("alr"), fc.ilr(x, 3).alias("ilr"))
    return rounded(p.select("l_suppkey", F.col("clr")[0].alias("a"), F.col("clr")[1].alias("b"), F.col("alr")[0].alias("alr_a"), F.col("alr")[1].alias("alr_b"), F.col("ilr")[0].alias("ilr_1"), F.col("ilr")[1].alias("ilr_2")))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN 0.000001 ELSE o_totalprice - 0.000001 * CAST(o_orderkey % 3 = 0 AS INT) / 2 END / (CASE WHEN o_orderkey % 3 = 0 THEN 0.000001 ELSE o_totalprice END + 2 * 1.0 - CASE WHEN o_orderkey % 3 = 0 THEN 0.000001 ELSE 0 END), 9) AS a FROM orders")
def coda_zero_replacement(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("c"))
    return rounded(features.multiplicative_replacement(o, ["a", "b", "c"]).select("o_orderkey", "a"), 9)


# Descriptions.
@query("""WITH s AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT "column", count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, round(var_samp(v), 5) AS variance, round(min(v), 5) AS min, round(quantile_cont(v, 0.25), 5) AS q1, round(median(v), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q3, round(max(v), 5) AS max FROM s GROUP BY 1""")
def describe_summary(spark, d):
    return rounded(describe.summary(load(spark, d, "lineitem"), ["l_quantity", "l_discount"]), 5)


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(avg(CAST(l_extendedprice <= 30000 AS INT)), 6) AS ecdf FROM lineitem GROUP BY 1")
def describe_quantiles(spark, d):
    li = load(spark, d, "lineitem")
    q = li.groupBy("l_returnflag").agg(describe.quantile("l_extendedprice", [0.1, 0.9]).alias("q"), describe.ecdf("l_extendedprice", 30000).alias("ecdf"))
    return q.select("l_returnflag", F.round(F.col("q")[0], 4).alias("p10"), F.round(F.col("q")[1], 4).alias("p90"), F.round("ecdf", 6).alias("ecdf"))


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT o_orderstatus, n / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM c)
SELECT o_orderstatus, round(1 - sum(p * p), 6) AS gini, round(-sum(p * log2(p)), 6) AS entropy, round(1 - max(p), 6) AS error FROM p GROUP BY 1""")
def impurity(spark, d):
    return rounded(describe.impurity(load(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"]))


@query("SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_quantity', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_discount', 'l_discount', 1.0")
def correlation_matrix(spark, d):
    return rounded(describe.correlation_cells(load(spark, d, "lineitem"), ["l_quantity", "l_discount"]))


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS quantity_price, round(var_samp(l_quantity), 4) AS quantity, round(covar_samp(l_quantity, l_tax), 6) AS quantity_tax FROM lineitem")
def covariance_matrix(spark, d):
    c = describe.covariance_matrix(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return one_row(spark, {"quantity_price": round(float(c[0, 1]), 2), "quantity": round(float(c[0, 0]), 4), "quantity_tax": round(float(c[0, 2]), 6)})


@query("SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS rank FROM customer")
def rank_average(spark, d):
    return average_ranks(load(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "rank")


@query("SELECT o_orderpriority AS mode, n FROM (SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1)")
def describe_mode(spark, d):
    return describe.mode(load(spark, d, "orders"), "o_orderpriority", "o_orderkey").select(F.col("mode"), "n")


# Missing values.
GAPS = f"SELECT {KEYS}, l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem"


def gaps(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").select(*KEY, "l_returnflag", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q"))


@query(f"WITH g AS ({GAPS}) SELECT {KEYS}, round(coalesce(q, avg(q) OVER ()), 6) AS q FROM g")
def impute_mean(spark, d):
    g = gaps(spark, d)
    return rounded(impute.SimpleImputer.fit(g, ["q"]).transform(g).select(*KEY, "q"), 6, KEY)


@query(f"WITH g AS ({GAPS}), m AS (SELECT l_returnflag, median(q) AS m FROM g GROUP BY 1) SELECT {KEYS}, round(coalesce(q, m), 6) AS q FROM g JOIN m USING (l_returnflag)")
def impute_median_group(spark, d):
    return rounded(impute.group_impute(gaps(spark, d), ["q"], "l_returnflag", "median").select(*KEY, "q"), 6, KEY)


@query("WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS p FROM orders), m AS (SELECT p AS mode FROM c WHERE p IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, max(o_orderkey) LIMIT 1) SELECT o_orderkey, coalesce(p, mode) AS p FROM c, m")
def impute_mode(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p"))
    return impute.SimpleImputer.fit(o, ["p"], "most_frequent", order="o_orderkey").transform(o)


@query("""WITH g AS (SELECT s_suppkey, s_acctbal AS a, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal * 2 + s_nationkey END AS b FROM supplier),
d AS (SELECT x.s_suppkey, y.b, row_number() OVER (PARTITION BY x.s_suppkey ORDER BY abs(x.a - y.a), y.s_suppkey) AS r FROM g x JOIN g y ON x.s_suppkey <> y.s_suppkey WHERE x.b IS NULL AND y.b IS NOT NULL)
SELECT s_suppkey, round(a, 4) AS a, round(coalesce(b, (SELECT avg(d.b) FROM d WHERE d.s_suppkey = g.s_suppkey AND r <= 3)), 4) AS b FROM g""")
def impute_knn(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") * 2 + F.col("s_nationkey")).alias("b"))
    return rounded(impute.KNNImputer.fit(s, ["a", "b"], "s_suppkey", 3).transform(s, "s_suppkey"), 4)


@query("""WITH g AS (SELECT c_custkey, c_acctbal AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal * 0.5 + c_nationkey END AS b FROM customer), m AS (SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS i FROM g)
SELECT c_custkey, round(coalesce(b, i + s * a), 3) AS b FROM g, m""")
def impute_iterative(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") * 0.5 + F.col("c_nationkey")).alias("b"))
    return rounded(impute.IterativeImputer.fit(c, ["a", "b"]).transform(c).select("c_custkey", "b"), 3)


# Outliers.
@query(f"""WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, var_samp(l_quantity) AS vq, var_samp(l_discount) AS vd, covar_samp(l_quantity, l_discount) AS c FROM lineitem)
SELECT {KEYS}, round(sqrt(((l_quantity - mq) * (l_quantity - mq) * vd - 2 * (l_quantity - mq) * (l_discount - md) * c + (l_discount - md) * (l_discount - md) * vq) / (vq * vd - c * c)), 5) AS distance FROM lineitem, m""")
def mahalanobis(spark, d):
    li = load(spark, d, "lineitem").select(*KEY, "l_quantity", "l_discount")
    m = outliers.Mahalanobis.fit(li, ["l_quantity", "l_discount"], 0.0)
    return rounded(m.score(li).select(*KEY, "distance"), 5, KEY)


@query()
def isolation_forest(spark, d):
    c = load(spark, d, "customer")
    return outliers.IsolationForest.fit(c, ["c_acctbal", "c_nationkey"], "c_custkey", 50).label(c).select("c_custkey", "outlier")


LOF = """WITH d AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y, sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + CAST((a.s_nationkey - b.s_nationkey) * (a.s_nationkey - b.s_nationkey) AS DOUBLE)) AS d FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS r FROM d) WHERE r <= 5), k AS (SELECT x, max(d) AS kd FROM n GROUP BY 1),
l AS (SELECT n.x, 1 / avg(greatest(n.d, k.kd)) AS lrd FROM n JOIN k ON n.y = k.x GROUP BY 1)
SELECT n.x AS s_suppkey, round(avg(b.lrd / a.lrd), 5) AS lof FROM n JOIN l a ON n.x = a.x JOIN l b ON n.y = b.x GROUP BY 1"""


@query(LOF)
def local_outlier_factor(spark, d):
    s = load(spark, d, "supplier")
    return rounded(outliers.local_outlier_factor(s, ["s_acctbal", "s_nationkey"], "s_suppkey", 5).select("s_suppkey", "lof"), 5)


@query()
def compositional_outliers(spark, d):
    p = compositions(spark, d)
    return rounded(outliers.CompositionalOutliers.fit(p, ["a", "b", "c"]).score(p).select("l_suppkey", "d2", "p_value", "outlier"), 5)


# Distances and neighbours.
@query("""WITH e AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_distance(a, b), 5) AS euclidean, round(list_sum(list_transform(list_zip(a, b), lambda t: abs(t[1] - t[2]))), 5) AS manhattan, round(list_max(list_transform(list_zip(a, b), lambda t: abs(t[1] - t[2]))), 6) AS chebyshev, round(1 - list_cosine_similarity(a, b), 6) AS cosine,
round(list_sum(list_transform(list_zip(a, b), lambda t: abs(t[1] - t[2]) / (abs(t[1]) + abs(t[2])))), 5) AS canberra, round(pow(list_sum(list_transform(list_zip(a, b), lambda t: pow(abs(t[1] - t[2]), 3))), 1.0 / 3), 5) AS minkowski FROM e""")
def distances(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.round(fc.euclidean("a", "b"), 5).alias("euclidean"), F.round(fc.manhattan("a", "b"), 5).alias("manhattan"), F.round(fc.chebyshev("a", "b"), 6).alias("chebyshev"), F.round(fc.cosine("a", "b"), 6).alias("cosine"), F.round(fc.canberra("a", "b"), 5).alias("canberra"), F.round(fc.minkowski("a", "b", 3), 5).alias("minkowski"))


PAIRS = "SELECT a.vec_id AS query, b.vec_id AS neighbor, b.label, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


def near(spark, d, k: int) -> DataFrame:
    e = load(spark, d, "embeddings")
    return neighbors.neighbors(e, e, ["embedding"], "vec_id", "vec_id", k, exclude_self=True, extra=["label"])


@query("""WITH r AS (SELECT max(p_size) - min(p_size) AS s, max(p_retailprice) - min(p_retailprice) AS p FROM part)
SELECT a.p_partkey, round((abs(a.p_size - b.p_size) / s + abs(a.p_retailprice - b.p_retailprice) / p + CAST(a.p_brand <> b.p_brand AS INT)) / 3, 6) AS gower FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1, r""")
def distance_gower(spark, d):
    p, names = load(spark, d, "part"), ["p_size", "p_retailprice", "p_brand"]
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), *[F.col(c).alias(f"o_{c}") for c in names])
    g = fc.gower([(F.col(c), F.col(f"o_{c}")) for c in names], neighbors.gower_ranges(p, names))
    return p.join(other, "p_partkey").select("p_partkey", F.round(g, 6).alias("gower"))


@query(f"WITH p AS ({PAIRS}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS INT) AS rank FROM p) SELECT query, neighbor, round(distance, 5) AS distance, rank FROM r WHERE rank <= 5")
def knn_topk(spark, d):
    return rounded(near(spark, d, 5).drop("label"), 5)


@query(f"""WITH p AS ({PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM p), v AS (SELECT query, label, count(*) AS w, min(rank) AS first FROM r WHERE rank <= 7 GROUP BY 1, 2)
SELECT query, label AS predicted, w / 7.0 AS probability FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY w DESC, first) AS k FROM v) WHERE k = 1""")
def knn_classify(spark, d):
    e = load(spark, d, "embeddings")
    return neighbors.knn_classify(e, e, ["embedding"], "vec_id", "vec_id", "label", 7, exclude_self=True)


@query("""WITH d AS (SELECT a.p_partkey AS query, b.p_retailprice AS y, row_number() OVER (PARTITION BY a.p_partkey ORDER BY CAST(abs(a.p_size - b.p_size) AS DOUBLE), b.p_partkey) AS r FROM part a, part b)
SELECT query, round(avg(y), 5) AS predicted FROM d WHERE r <= 5 GROUP BY 1""")
def knn_regress(spark, d):
    p = load(spark, d, "part")
    return rounded(neighbors.knn_regress(p, p, ["p_size"], "p_partkey", "p_partkey", "p_retailprice"), 5)


SPOTS = "SELECT s_suppkey, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier"


def spots(spark, d) -> DataFrame:
    return load(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))


@query(f"WITH s AS ({SPOTS}) SELECT * FROM (SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM s a, s b) WHERE distance <= 1.25")
def radius_join(spark, d):
    return neighbors.radius_pairs(spots(spark, d), ["x", "y"], "s_suppkey", 1.25, digits=6)


DBSCAN = f"""WITH RECURSIVE s AS ({SPOTS}), p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a, s b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.25),
c AS (SELECT a FROM p GROUP BY 1 HAVING count(*) >= 4), e AS (SELECT a, b FROM p WHERE a IN (SELECT a FROM c) AND b IN (SELECT a FROM c)),
r AS (SELECT a, a AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a, min(b) AS root FROM r GROUP BY 1), n AS (SELECT a, dense_rank() OVER (ORDER BY root) AS cluster FROM m),
w AS (SELECT p.a, arg_min(n.cluster, (p.d, p.b)) AS cluster FROM p JOIN n ON p.b = n.a GROUP BY 1)
SELECT s.s_suppkey, s.s_suppkey IN (SELECT a FROM c) AS core, CAST(coalesce(w.cluster, -1) AS INT) AS cluster FROM s LEFT JOIN w ON s.s_suppkey = w.a"""


@query(DBSCAN)
def dbscan(spark, d):
    return cluster.dbscan(spots(spark, d), ["x", "y"], "s_suppkey", 1.25, 4)


@query("""WITH p AS (SELECT a.vec_id, a.label, b.label AS other, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, label, other, avg(d) AS d FROM p GROUP BY 1, 2, 3), s AS (SELECT vec_id, label AS cluster, coalesce(max(CASE WHEN other = label THEN d END), 0) AS a, min(CASE WHEN other <> label THEN d END) AS b FROM m GROUP BY 1, 2)
SELECT vec_id, cluster, round(a, 5) AS a, round(b, 5) AS b, round((b - a) / greatest(a, b), 5) AS silhouette FROM s""")
def silhouette(spark, d):
    return rounded(cluster.silhouette_samples(load(spark, d, "embeddings"), ["embedding"], "vec_id", "label"), 5)


@query("""WITH p AS (SELECT a.vec_id, a.label, b.label AS other, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, label, other, avg(d) AS d FROM p GROUP BY 1, 2, 3), s AS (SELECT vec_id, label AS cluster, coalesce(max(CASE WHEN other = label THEN d END), 0) AS a, min(CASE WHEN other <> label THEN d END) AS b FROM m GROUP BY 1, 2)
SELECT cluster, count(*) AS n, round(avg((b - a) / greatest(a, b)), 5) AS mean FROM s GROUP BY 1""")
def silhouette_by_cluster(spark, d):
    return rounded(cluster.silhouette_by_cluster(cluster.silhouette_samples(load(spark, d, "embeddings"), ["embedding"], "vec_id", "label")), 5)


@query("""WITH a AS (SELECT p_size, p_retailprice, (p_size - 10) * (p_size - 10) + (p_retailprice - 1000) * (p_retailprice - 1000) AS d0, (p_size - 40) * (p_size - 40) + (p_retailprice - 1500) * (p_retailprice - 1500) AS d1 FROM part)
SELECT CAST(d1 < d0 AS INT) AS cluster, count(*) AS n, round(sum(least(d0, d1)) / count(*), 3) AS inertia, round(avg(p_size), 5) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM a GROUP BY 1""")
def kmeans_step(spark, d):
    s = cluster.kmeans_step(load(spark, d, "part"), ["p_size", "p_retailprice"], [(10, 1000), (40, 1500)])
    return s.select("cluster", "n", F.round(F.col("inertia") / F.col("n"), 3).alias("inertia"), F.round("p_size", 5).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"))


@query()
def kmeans(spark, d):
    p = load(spark, d, "part")
    m = cluster.KMeans.fit(p, ["p_size", "p_retailprice"], 4, key="p_partkey", max_iter=30)
    return m.predict(p).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


LABELINGS = "SELECT s_suppkey AS k, s_nationkey % 3 AS a, s_nationkey % 5 AS b, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS c FROM supplier"


def labelings(spark, d) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 3).alias("a"), (F.col("s_nationkey") % 5).alias("b"), (F.col("s_acctbal") > 5000).cast("int").alias("c"))


@query(f"""WITH l AS ({LABELINGS}), p AS (SELECT a, b, c, min(k) AS k FROM l GROUP BY 1, 2, 3)
SELECT p.k AS a, l.k AS b, CAST(1 AS DOUBLE) AS agreement FROM l JOIN p ON l.a = p.a AND l.b = p.b AND l.c = p.c
UNION ALL SELECT x.k, y.k, round((CAST(x.a = y.a AS INT) + CAST(x.b = y.b AS INT) + CAST(x.c = y.c AS INT)) / 3.0, 6) FROM p x JOIN p y ON x.k < y.k WHERE x.a = y.a OR x.b = y.b OR x.c = y.c""")
def coassociation(spark, d):
    """Every row with its class of equal labels, and the pairs of classes."""
    return rounded(cluster.coassociation_classes(labelings(spark, d), "k", ["a", "b", "c"]))


@query()
def consensus(spark, d):
    return cluster.consensus(labelings(spark, d), "k", ["a", "b", "c"], 0.99)


@query()
def linkage(spark, d):
    m = cluster.Linkage.fit(spots(spark, d), ["x", "y"], "s_suppkey", "average")
    return spark.createDataFrame(list(m.cut(5).items()), "s_suppkey long, cluster int")


# Metrics. Scores are made from columns.
SCORED = f"SELECT {KEYS}, CAST(l_returnflag = 'R' AS INT) AS y, round((l_quantity + l_tax * 100) / 60, 2) AS p FROM lineitem"


def scored(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").select(*KEY, (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round((F.col("l_quantity") + F.col("l_tax") * 100) / 60, 2).alias("p"))


@query("""WITH e AS (SELECT l_returnflag, l_quantity AS y, 25 + 10 * l_discount AS f FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg((y - f) * (y - f)), 4) AS mse, round(sqrt(avg((y - f) * (y - f))), 5) AS rmse, round(avg(abs(y - f)), 5) AS mae, round(1 - avg((y - f) * (y - f)) / var_pop(y), 6) AS r2 FROM e GROUP BY 1""")
def metrics_regression(spark, d):
    li = load(spark, d, "lineitem").withColumn("f", 25 + 10 * F.col("l_discount"))
    m = metrics.regression(li, "l_quantity", "f", ["l_returnflag"])
    return m.select("l_returnflag", "n", F.round("mse", 4).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("r2", 6).alias("r2"))


@query(f"""WITH s AS ({SCORED}), c AS (SELECT count(*) AS n, sum(CAST(y = 1 AND p >= 0.5 AS INT)) AS tp, sum(CAST(p >= 0.5 AS INT)) AS pp, sum(y) AS ap, sum(CAST(y = CAST(p >= 0.5 AS INT) AS INT)) AS hit FROM s),
e AS (SELECT *, (ap * pp + (n - ap) * (n - pp)) / (n * n) AS x FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(tp AS DOUBLE) AS tp, CAST(pp AS DOUBLE) AS pp, CAST(ap AS DOUBLE) AS ap, CAST(hit AS DOUBLE) AS hit FROM c))
SELECT round(hit / n, 6) AS accuracy, round(tp / pp, 6) AS precision, round(tp / ap, 6) AS recall, round(2 * tp / (pp + ap), 6) AS f1, round((hit / n - x) / (1 - x), 6) AS kappa FROM e""")
def metrics_binary(spark, d):
    return rounded(metrics.binary(scored(spark, d).withColumn("z", (F.col("p") >= 0.5).cast("int")), "y", "z"))


@query("SELECT a.l_returnflag AS actual, b.p AS predicted, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a, (SELECT DISTINCT l_returnflag AS p FROM lineitem) b LEFT JOIN (SELECT l_returnflag, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON a.l_returnflag = c.l_returnflag AND b.p = c.p")
def confusion(spark, d):
    li = load(spark, d, "lineitem").withColumn("p", F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R"))
    return metrics.confusion(li, "l_returnflag", "p")


@query(f"WITH s AS (SELECT y, greatest(1e-15, least(1 - 1e-15, p)) AS p FROM ({SCORED})) SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM s")
def log_loss(spark, d):
    return rounded(metrics.log_loss(scored(spark, d), "y", "p"))


BY_SCORE = f"WITH s AS ({SCORED}), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1), r AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM g)"


@query(f"{BY_SCORE} SELECT p AS threshold, round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr FROM r UNION ALL SELECT CAST('infinity' AS DOUBLE), 0.0, 0.0")
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(scored(spark, d), "y", "p"), 6, ["threshold"])


@query(f"{BY_SCORE} SELECT round(CAST(sum(neg * (tp + tp - pos) / 2.0) AS DOUBLE) / max(ap * an), 6) AS auc FROM r")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d), "y", "p"))


@query(f"{BY_SCORE} SELECT p AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / ap, 6) AS recall FROM r")
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(scored(spark, d), "y", "p"), 6, ["threshold"])


@query(f"{BY_SCORE} SELECT round(sum(pos / ap * tp / (tp + fp)), 6) AS average_precision FROM r WHERE p < (SELECT max(p) FROM r)")
def average_precision(spark, d):
    return rounded(metrics.average_precision(scored(spark, d), "y", "p"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS y, o_totalprice / 600000 AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT CAST(floor(i / ceil(n / 10.0)) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed FROM r GROUP BY 1""")
def calibration(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 600000).alias("p"))
    return rounded(metrics.calibration(o, "y", "p", 10, "o_orderkey"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c),
x AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((i.s - x.s * y.s / (i.n * (i.n - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (i.n * (i.n - 1) / 2)), 8) AS ari FROM i, x, y""")
def adjusted_rand(spark, d):
    return rounded(metrics.adjusted_rand(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), 8)


@query("SELECT round(avg(CASE WHEN abs(e) <= 10 THEN e * e / 2 ELSE 10 * (abs(e) - 5) END), 5) AS loss FROM (SELECT 25 - l_quantity AS e FROM lineitem)")
def huber_loss(spark, d):
    return rounded(metrics.loss(load(spark, d, "lineitem").withColumn("p", F.lit(25.0)), "l_quantity", "p", "huber", delta=10.0), 5)


# Splits and folds.
@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM orders")
def split_ordered(spark, d):
    return resample.train_test_split(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], shuffle=False)


@query("SELECT o_orderkey, CAST(least(7, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / floor(count(*) OVER () / 7)) + 1) AS INT) AS fold FROM orders")
def k_fold(spark, d):
    return resample.k_fold(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("SELECT o_orderkey, o_orderstatus, CAST(least(5, floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / floor(count(*) OVER (PARTITION BY o_orderstatus) / 5)) + 1) AS INT) AS fold FROM orders")
def stratified_fold(spark, d):
    return resample.stratified_k_fold(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query("""WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM customer))
SELECT c_custkey, c.c_nationkey, CAST(CASE WHEN i < (n // 4 + 1) * (n % 4) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n // 4 + 1) * (n % 4)) // (n // 4) END + 1 AS INT) AS fold FROM customer c JOIN g ON c.c_nationkey = g.c_nationkey""")
def group_fold(spark, d):
    return resample.group_k_fold(load(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 4, shuffle=False).select("c_custkey", "c_nationkey", "fold")


@query("SELECT n.o_orderstatus, least(n.n, m.m) AS n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) n, (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) m")
def downsample(spark, d):
    return resample.downsample(load(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, m AS n FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))")
def upsample(spark, d):
    return resample.upsample(load(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# Tests.
def statistics(spark, got: dict, names: dict[str, int]) -> DataFrame:
    return one_row(spark, {k: round(float(got[k]), n) for k, n in names.items()})


@query("SELECT round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 5) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem")
def t_test_one(spark, d):
    return statistics(spark, htests.t_one(load(spark, d, "lineitem"), "l_quantity", 25.0), {"statistic": 5, "df": 0})


TWO = "WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g ORDER BY g LIMIT 1), b AS (SELECT * FROM g ORDER BY g DESC LIMIT 1)"


@query(f"{TWO} SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 5) AS statistic, CAST(a.n + b.n - 2 AS DOUBLE) AS df FROM a, b")
def t_test_two(spark, d):
    return statistics(spark, htests.t_two(load(spark, d, "lineitem"), "l_extendedprice", "l_linestatus"), {"statistic": 5, "df": 0})


@query(f"{TWO} SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d FROM a, b")
def cohens_d(spark, d):
    return one_row(spark, {"cohens_d": round(htests.cohens_d(load(spark, d, "lineitem"), "l_extendedprice", "l_linestatus"), 6)})


@query("SELECT round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 4) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem")
def t_test_paired(spark, d):
    return statistics(spark, htests.t_paired(load(spark, d, "lineitem"), "l_tax", "l_discount"), {"statistic": 4, "df": 0})


@query("WITH c AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), e AS (SELECT avg(n) AS e FROM c) SELECT round(sum((n - e) * (n - e) / e), 6) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM c, e")
def chi_square(spark, d):
    c = load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = c.crossJoin(F.broadcast(c.agg(F.avg("n").alias("e"))))
    return statistics(spark, htests.chi_square(c, "n", "e"), {"statistic": 6, "df": 0})


ANOVA = "WITH g AS (SELECT {g} AS g, CAST(count(*) AS DOUBLE) AS n, avg({v}) AS m, var_samp({v}) AS s FROM {t} GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS mean, sum(n) AS n, count(*) AS k FROM g), x AS (SELECT sum(g.n * (m - mean) * (m - mean)) AS b, sum((g.n - 1) * s) AS w, max(t.k) AS k, max(t.n) AS n FROM g, t)"


@query(ANOVA.format(g="o_orderpriority", v="o_totalprice", t="orders") + " SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS statistic, CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within, round(b / (b + w), 8) AS eta2, round((b - (k - 1) * w / (n - k)) / (b + w + w / (n - k)), 8) AS omega2 FROM x")
def anova(spark, d):
    a = htests.anova(load(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return one_row(spark, {"statistic": round(a["statistic"], 6), "df_between": float(a["df_between"]), "df_within": float(a["df_within"]), "eta2": round(htests.eta_squared(a), 8), "omega2": round(htests.omega_squared(a), 8)})


@query("WITH m AS (SELECT o_orderpriority AS p, median(o_totalprice) AS c FROM orders GROUP BY 1), z AS (SELECT p, abs(o_totalprice - c) AS d FROM orders JOIN m ON o_orderpriority = p) " + ANOVA.format(g="p", v="d", t="z").replace("WITH g", ", g", 1) + " SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS statistic FROM x")
def levene(spark, d):
    return statistics(spark, htests.levene(load(spark, d, "orders"), "o_totalprice", "o_orderpriority"), {"statistic": 6})


@query("WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS ms FROM g) SELECT a.g AS a, b.g AS b, round(a.m - b.m, 3) AS diff, round(abs(a.m - b.m) / sqrt(ms / 2 * (1.0 / a.n + 1.0 / b.n)), 5) AS q FROM g a JOIN g b ON a.g < b.g, w")
def tukey(spark, d):
    t = htests.tukey_hsd(load(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return t.select("a", "b", F.round("diff", 3).alias("diff"), F.round("q", 5).alias("q"))


RANKED = "WITH r AS (SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r FROM {t}), s AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s FROM r GROUP BY 1)"


@query(RANKED.format(g="l_linestatus", v="l_quantity", t="lineitem") + ", a AS (SELECT * FROM s ORDER BY g LIMIT 1), b AS (SELECT * FROM s ORDER BY g DESC LIMIT 1), u AS (SELECT a.n * b.n AS nn, a.n + b.n AS n, a.s - a.n * (a.n + 1) / 2 AS u1 FROM a, b) SELECT round(least(u1, nn - u1), 1) AS statistic, round((least(u1, nn - u1) - nn / 2) / sqrt(nn * (n + 1) / 12), 5) AS z FROM u")
def mann_whitney(spark, d):
    return statistics(spark, htests.mann_whitney(load(spark, d, "lineitem"), "l_quantity", "l_linestatus"), {"statistic": 1, "z": 5})


@query(RANKED.format(g="l_returnflag", v="l_quantity", t="lineitem") + " SELECT round(12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1), 4) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM s")
def kruskal_wallis(spark, d):
    return statistics(spark, htests.kruskal_wallis(load(spark, d, "lineitem"), "l_quantity", "l_returnflag"), {"statistic": 4, "df": 0})


@query("WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS statistic, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS ci_low FROM c")
def pearson(spark, d):
    return statistics(spark, htests.pearson(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), {"r": 6, "statistic": 4, "ci_low": 6})


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) AS r FROM r")
def spearman(spark, d):
    return statistics(spark, htests.spearman(load(spark, d, "part"), "p_size", "p_retailprice"), {"r": 6})


PVALUES = "SELECT p_partkey AS k, (p_partkey * 37 % 1009 + 1) / 20000.0 AS p FROM part"


def p_values(spark, d) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 37 % 1009 + 1) / 20000).alias("p"))


@query(f"""WITH p AS ({PVALUES}), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p)
SELECT k, round(least(1.0, p * m), 6) AS bonferroni, round(max(least(1.0, p * (m - i + 1))) OVER (ORDER BY i), 6) AS holm, round(min(least(1.0, p * m / i)) OVER (ORDER BY i DESC), 6) AS bh, round(i / m * 0.05, 8) AS critical FROM r""")
def p_adjust(spark, d):
    out = htests.bonferroni(p_values(spark, d), "p", "bonferroni")
    out = htests.benjamini_hochberg(htests.holm(out, "p", "k", "holm"), "p", "k", "bh")
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("bonferroni", "holm", "bh")], F.round("critical", 8).alias("critical"))


@query()
def fisher_exact(spark, d):
    c = {(r[0], r[1]): r[2] for r in load(spark, d, "lineitem").groupBy((F.col("l_returnflag") == "R"), F.col("l_linestatus") == "F").count().collect()}
    got = htests.fisher_exact(*[int(c.get(k, 0)) for k in ((True, True), (True, False), (False, True), (False, False))])
    return one_row(spark, {k: round(v, 6) for k, v in got.items()})


# Models.
OLS = "l_extendedprice ~ l_quantity"


@query("SELECT l_returnflag, '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS estimate FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem GROUP BY 1")
def ols_by_group(spark, d):
    """A pricing regression for each return flag; the flagship query."""
    return rounded(glm.ols_by(load(spark, d, "lineitem"), "l_returnflag", OLS).select("l_returnflag", "term", "estimate"), 3)


@query("SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")
def ols_simple(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(glm.lm(li, OLS).summary(li).select("term", "estimate"), 3)


@query("""WITH m AS (SELECT var_pop(l_discount) AS a, var_pop(l_tax) AS b, covar_pop(l_discount, l_tax) AS c, covar_pop(l_discount, l_quantity) AS u, covar_pop(l_tax, l_quantity) AS v, avg(l_discount) AS x, avg(l_tax) AS z, avg(l_quantity) AS y FROM lineitem),
s AS (SELECT (b * u - c * v) / (a * b - c * c) AS p, (a * v - c * u) / (a * b - c * c) AS q, x, y, z FROM m)
SELECT '(Intercept)' AS term, round(y - p * x - q * z, 4) AS estimate FROM s UNION ALL SELECT 'l_discount', round(p, 4) FROM s UNION ALL SELECT 'l_tax', round(q, 4) FROM s""")
def ols_two_predictors(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(glm.lm(li, "l_quantity ~ l_discount + l_tax").summary(li).select("term", "estimate"), 4)


@query("WITH s AS (SELECT CAST(count(*) AS DOUBLE) + 5 AS n, sum(l_quantity) AS x, sum(l_quantity * l_quantity) + 5 AS xx, sum(l_tax) AS y, sum(l_quantity * l_tax) AS xy FROM lineitem) SELECT '(Intercept)' AS term, round((xx * y - x * xy) / (n * xx - x * x), 7) AS estimate FROM s UNION ALL SELECT 'l_quantity', round((n * xy - x * y) / (n * xx - x * x), 7) FROM s")
def ridge(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(glm.lm(li, "l_tax ~ l_quantity", ridge=5.0).summary(li).select("term", "estimate"), 7)


@query("""WITH s AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), b AS (SELECT max(CASE WHEN l_returnflag = 'R' THEN m END) AS r, sum(CASE WHEN l_returnflag <> 'R' THEN n * m END) / sum(CASE WHEN l_returnflag <> 'R' THEN n END) AS o FROM s)
SELECT '(Intercept)' AS term, round(ln(o), 6) AS estimate FROM b UNION ALL SELECT 'x', round(ln(r / o), 6) FROM b""")
def glm_gamma_log(spark, d):
    """With one indicator the fitted means are the groups' means, whatever the family."""
    li = load(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("double").alias("x"))
    return rounded(glm.glm(li, "l_extendedprice ~ x", "gamma", "log").summary(li).select("term", "estimate"))


@query("""WITH s AS (SELECT l_linestatus, avg(CAST(l_quantity > 30 AS INT)) AS p FROM lineitem GROUP BY 1), b AS (SELECT max(CASE WHEN l_linestatus = 'F' THEN p END) AS f, max(CASE WHEN l_linestatus <> 'F' THEN p END) AS o FROM s)
SELECT '(Intercept)' AS term, round(ln(o / (1 - o)), 6) AS estimate FROM b UNION ALL SELECT 'x', round(ln(f / (1 - f)) - ln(o / (1 - o)), 6) FROM b""")
def glm_logistic(spark, d):
    li = load(spark, d, "lineitem").select((F.col("l_quantity") > 30).cast("double").alias("y"), (F.col("l_linestatus") == "F").cast("double").alias("x"))
    return rounded(glm.logit(li, "y ~ x").summary(li).select("term", "estimate"))


@query("""WITH s AS (SELECT l_linestatus, avg(CAST(l_quantity AS DOUBLE)) AS m FROM lineitem GROUP BY 1), b AS (SELECT max(CASE WHEN l_linestatus = 'F' THEN m END) AS f, max(CASE WHEN l_linestatus <> 'F' THEN m END) AS o FROM s)
SELECT '(Intercept)' AS term, round(ln(o), 6) AS estimate FROM b UNION ALL SELECT 'x', round(ln(f / o), 6) FROM b""")
def glm_poisson(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", (F.col("l_linestatus") == "F").cast("double").alias("x"))
    return rounded(glm.glm(li, "l_quantity ~ x", "poisson").summary(li).select("term", "estimate"))


@query("""WITH s AS (SELECT l_returnflag AS f, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_linestatus = 'F' OR l_linestatus = 'O' GROUP BY 1), b AS (SELECT max(CASE WHEN f = 'A' THEN n END) AS a, max(CASE WHEN f = 'N' THEN n END) AS m, max(CASE WHEN f = 'R' THEN n END) AS r FROM s)
SELECT 'N' AS class, round(ln(m / a), 5) AS intercept FROM b UNION ALL SELECT 'R', round(ln(r / a), 5) FROM b""")
def multinomial(spark, d):
    """Without predictors the intercepts are logs of class ratios."""
    m = glm.multinomial(load(spark, d, "lineitem").select("l_returnflag"), "l_returnflag", "1")
    return spark.createDataFrame([(c, round(float(b[0]), 5)) for c, b in zip(m.classes[1:], m.coefficients)], "class string, intercept double")


@query('SELECT l_quantity AS y, CAST(1.0 AS DOUBLE) AS "(Intercept)", round(ln(l_extendedprice), 6) AS "log(l_extendedprice)", l_discount, l_tax, round(l_discount * l_tax, 8) AS "l_discount:l_tax" FROM lineitem')
def formula_design(spark, d):
    out = formula.apply("l_quantity ~ log(l_extendedprice) + l_discount * l_tax", load(spark, d, "lineitem"))
    return out.withColumns({"log(l_extendedprice)": F.round("`log(l_extendedprice)`", 6), "l_discount:l_tax": F.round("`l_discount:l_tax`", 8)})


@query("""WITH k AS (SELECT l_quantity AS y, l_discount AS x, CAST(least(5, floor((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) / floor(count(*) OVER () / 5)) + 1) AS INT) AS fold FROM lineitem),
m AS (SELECT f.fold, regr_slope(k.y, k.x) AS s, regr_intercept(k.y, k.x) AS i FROM (SELECT DISTINCT fold FROM k) f JOIN k ON k.fold <> f.fold GROUP BY 1)
SELECT k.fold, round(avg((y - i - s * x) * (y - i - s * x)), 4) AS mse FROM k JOIN m ON k.fold = m.fold GROUP BY 1""")
def cross_validate(spark, d):
    got = cross_validate_linear(load(spark, d, "lineitem"), KEY, "l_quantity ~ l_discount")
    return spark.createDataFrame([(i + 1, round(v, 4)) for i, v in enumerate(got["mse"])], "fold int, mse double")


@query()
def mixed_model(spark, d):
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = glm.mixed(o.select((F.col("o_totalprice") / 1000).alias("y"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").alias("g")), "y ~ x + (1 | g)", max_iter=50)
    return spark.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(m.terms, m.coefficients, m.std_errors)], "term string, estimate double, std_error double")


@query()
def gam(spark, d):
    p = load(spark, d, "part")
    return smooth.gam(p, "p_retailprice", ["p_size"]).predict(p).select("p_partkey", "prediction")


@query()
def gaussian_process(spark, d):
    s = load(spark, d, "supplier")
    return smooth.GaussianProcess.fit(s, ["s_nationkey"], "s_acctbal", smooth.Kernel("rbf", length=5.0), alpha=0.1, optimize=False).predict(s, std=True).select("s_suppkey", "prediction", "prediction_std")


@query()
def neural_network(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") / 25).alias("x"), (F.col("s_acctbal") / 10000).alias("y"))
    return smooth.mlp(s, ["x"], ["y"], (8,), epochs=10).predict(s).select("s_suppkey", "y_prediction")


@query()
def decision_tree(spark, d):
    o = load(spark, d, "orders")
    return trees.grow(o, ["o_totalprice", "o_custkey"], "o_orderstatus", max_depth=3).predict(o).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def random_forest(spark, d):
    o = load(spark, d, "orders")
    return trees.forest(o, ["o_totalprice", "o_custkey"], "o_orderstatus", "o_orderkey", n_estimators=3, max_depth=3).predict(o).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def gradient_boosting(spark, d):
    p = load(spark, d, "part")
    return trees.boosting(p, ["p_size"], "p_retailprice", "p_partkey", n_estimators=3, max_depth=2).predict(p).select("p_partkey", "prediction")


@query("""WITH g AS (SELECT CAST(p_size AS DOUBLE) AS v, sum(CAST(p_retailprice > 1200 AS INT)) AS a, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) AS la, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS ln, CAST(sum(a) OVER () AS DOUBLE) AS ta, CAST(sum(n) OVER () AS DOUBLE) AS tn FROM g),
s AS (SELECT (v + nx) / 2 AS threshold, 2 * ta / tn * (1 - ta / tn) - ln / tn * 2 * la / ln * (1 - la / ln) - (tn - ln) / tn * 2 * (ta - la) / (tn - ln) * (1 - (ta - la) / (tn - ln)) AS gain FROM r WHERE nx IS NOT NULL)
SELECT threshold, round(gain, 8) AS gain FROM s ORDER BY round(gain, 10) DESC, threshold LIMIT 1""")
def best_split(spark, d):
    p = load(spark, d, "part").select("p_size", (F.col("p_retailprice") > 1200).cast("int").alias("y"))
    return rounded(trees.best_split(p, "p_size", "y"), 8)


# Ordination.
@query("""WITH m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS b, covar_samp(l_quantity, l_discount * 100) AS c FROM lineitem)
SELECT 1 AS component, round((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c), 5) AS eigenvalue FROM m UNION ALL SELECT 2, round((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 5) FROM m""")
def pca(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("x"))
    return interpret.scree(ordination.PCA.fit(li, ["l_quantity", "x"]), spark).select("component", F.round("eigenvalue", 5).alias("eigenvalue"))


@query()
def lda(spark, d):
    li = load(spark, d, "lineitem")
    m = ordination.LDA.fit(li, ["l_quantity", "l_discount", "l_tax"], "l_returnflag")
    return m.predict(li).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 8) AS constrained FROM lineitem")
def rda(spark, d):
    """With one response and one explanatory column the constrained share is r squared."""
    m = ordination.RDA.fit(load(spark, d, "lineitem"), ["l_extendedprice"], ["l_quantity"])
    return one_row(spark, {"constrained": round(m.constrained, 8)})


@query("SELECT round(abs(corr(l_quantity, l_extendedprice)), 6) AS correlation FROM lineitem")
def cca(spark, d):
    m = ordination.CCA.fit(load(spark, d, "lineitem"), ["l_quantity"], ["l_extendedprice"])
    return one_row(spark, {"correlation": round(float(m.correlations[0]), 6)})


# Interpretation and plot data.
@query("""WITH s AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem), e AS (SELECT max(CASE WHEN i = CAST(floor(n * 0.05) AS BIGINT) THEN v END) AS a, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN v END) AS z FROM s), g AS (SELECT a + (z - a) * i / 9 AS value FROM e, generate_series(0, 9) t(i))
SELECT round(value, 6) AS value, round(3 * value + 100 * (SELECT avg(l_discount) FROM lineitem), 5) AS mean_prediction FROM g""")
def partial_dependence(spark, d):
    li = load(spark, d, "lineitem").select("l_quantity", "l_discount")
    return rounded(interpret.partial_dependence(li, "l_quantity", 3 * F.col("l_quantity") + 100 * F.col("l_discount"), 10), 5).select(F.round("value", 6).alias("value"), "mean_prediction")


@query("SELECT 'l_quantity' AS feature, round(avg(abs(2 * (l_quantity - (SELECT avg(l_quantity) FROM lineitem)))), 5) AS importance FROM lineitem UNION ALL SELECT 'l_discount', round(avg(abs(-5 * (l_discount - (SELECT avg(l_discount) FROM lineitem)))), 5) FROM lineitem")
def shap_importance(spark, d):
    li = load(spark, d, "lineitem")
    return rounded(interpret.shap_importance(interpret.linear_shap(li, ["l_quantity", "l_discount"], [2.0, -5.0]), ["l_quantity", "l_discount"]), 5)


@query(f"SELECT {KEYS}, round(l_quantity - 25 - l_tax, 6) AS residual, round((l_quantity - 25 - l_tax - avg(l_quantity - 25 - l_tax) OVER ()) / stddev_pop(l_quantity - 25 - l_tax) OVER (), 5) AS standardized FROM lineitem")
def residuals(spark, d):
    li = load(spark, d, "lineitem").withColumn("f", 25 + F.col("l_tax"))
    return interpret.residual_data(li, "l_quantity", "f").select(*KEY, F.round("residual", 6).alias("residual"), F.round("standardized", 5).alias("standardized"))


@query("SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i, round((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 0.5) / count(*) OVER (), 8) AS p, s_acctbal AS sample FROM supplier")
def qq_points(spark, d):
    return interpret.qq_points(load(spark, d, "supplier"), "s_acctbal", "s_suppkey").select("i", F.round("p", 8).alias("p"), "sample")


BRANCHES = "SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 2 AS b, o_custkey % 2 AS c FROM orders"


@query(f"WITH t AS ({BRANCHES}) SELECT o_orderkey, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS vote, round((CAST(a = b AS INT) + CAST(a = c AS INT) + CAST(b = c AS INT)) / 3.0, 6) AS agreement FROM t")
def branch_vote(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("a"), (F.col("o_orderkey") % 2).alias("b"), (F.col("o_custkey") % 2).alias("c"))
    return o.select("o_orderkey", combine(["a", "b", "c"]).alias("vote"), F.round(agreement(["a", "b", "c"]), 6).alias("agreement"))


@query(f"""WITH g AS ({GAPS}), f AS (SELECT {KEYS}, l_returnflag, coalesce(q, avg(q) OVER ()) AS q FROM g), s AS (SELECT *, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS z FROM f)
SELECT {KEYS}, round(z, 5) AS q, CAST(l_returnflag = 'N' AS INT) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INT) AS l_returnflag_R FROM s""")
def recipe(spark, d):
    r = Recipe(gaps(spark, d), ["q"]).impute_mean(["q"]).scale(["q"]).one_hot(["l_returnflag"])
    return rounded(r.prep().data, 5, KEY)


# Streams: the same plans over a table.
@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    w = windowed(load(spark, d, "events"), "ts", "1 hour", "value", by=["event_type"])
    return w.select("start", "event_type", "n", F.round("mean", 5).alias("mean"), F.round(F.sqrt(F.when(F.col("variance") < 0, 0.0).otherwise(F.col("variance"))), 5).alias("sd"))


@query("""WITH l AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n, round(avg(value), 5) AS mean FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    s = sessions(load(spark, d, "events"), "ts", "30 minutes", "user_id", "value")
    return s.select("user_id", "start", "n", F.round("mean", 5).alias("mean"))


# More of each family.
@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS fold FROM orders")
def leave_one_out(spark, d):
    return resample.leave_one_out(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT CAST(greatest(1, floor(count(*) * 0.2)) AS BIGINT) AS n1, CAST(greatest(1, floor(count(*) * 0.2)) AS BIGINT) AS n2 FROM customer")
def shuffle_split(spark, d):
    s = resample.shuffle_splits(load(spark, d, "customer").select("c_custkey"), ["c_custkey"], 2)
    return s.agg(F.sum(F.col("test_1").cast("long")).alias("n1"), F.sum(F.col("test_2").cast("long")).alias("n2"))


@query("SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS train, CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) AS test FROM orders")
def split_shuffled(spark, d):
    s = resample.train_test_split(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], seed=7)
    return s.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT max(CASE WHEN i = CAST(CASE WHEN 0.9 * (n - 1) - floor(0.9 * (n - 1)) > 0.5 THEN ceil(0.9 * (n - 1)) ELSE floor(0.9 * (n - 1)) END AS BIGINT) THEN v END) AS p90 FROM s")
def quantile_nearest(spark, d):
    return one_row(spark, {"p90": float(describe.nearest_quantile(load(spark, d, "lineitem"), "l_extendedprice", 0.9))})


@query("WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part), m AS (SELECT max(CASE WHEN i = n // 2 THEN v END) AS m FROM s) SELECT round(avg(abs(v - m)), 5) AS mae FROM s, m")
def impurity_absolute(spark, d):
    return one_row(spark, {"mae": round(describe.absolute_impurity(load(spark, d, "part"), "p_retailprice"), 5)})


@query("""WITH c AS (SELECT l_quantity <= 25 AS side, l_returnflag AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT side, sum(n) AS n, 1 - sum(n * n) / (sum(n) * sum(n)) AS g FROM c GROUP BY 1),
w AS (SELECT 1 - sum(n * n) / (sum(n) * sum(n)) AS g, sum(n) AS n FROM (SELECT y, sum(n) AS n FROM c GROUP BY 1)) SELECT round(w.g - (SELECT sum(p.n * p.g) FROM p) / w.n, 8) AS gain FROM w""")
def information_gain(spark, d):
    return one_row(spark, {"gain": round(describe.information_gain(load(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity") <= 25), 8)})


@query("SELECT unnest(CASE WHEN var_pop(l_tax) > 0.5 THEN ['l_quantity', 'l_tax'] ELSE ['l_quantity'] END) AS kept FROM lineitem")
def select_by_variance(spark, d):
    return spark.createDataFrame([(c,) for c in features.varying(load(spark, d, "lineitem"), ["l_quantity", "l_tax"], 0.5)], "kept string")


@query("SELECT unnest(['l_quantity', 'l_tax']) AS kept")
def select_by_correlation(spark, d):
    li = load(spark, d, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + 1)
    return spark.createDataFrame([(c,) for c in features.uncorrelated(li, ["l_quantity", "twice", "l_tax"])], "kept string")


@query("WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem), k AS (SELECT unnest([1, 2, 3]) AS k) SELECT k, max(CASE WHEN i = CAST(floor(k / 4.0 * (n - 1)) AS BIGINT) THEN v END) AS knot FROM s, k GROUP BY 1")
def spline_knots(spark, d):
    at = features.knots(load(spark, d, "lineitem"), "l_extendedprice", 3)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(at)], "k int, knot double")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS b1, pow(greatest(p_size - 10, 0), 3) AS b2, pow(greatest(p_size - 30, 0), 3) AS b3 FROM part")
def spline_basis(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", *[c.alias(f"b{i + 1}") for i, c in enumerate(features.truncated_power_basis(F.col("p_size"), [10, 30]))])


@query(f"WITH p AS ({PARTS}), m AS (SELECT exp((avg(ln(a)) + avg(ln(b)) + avg(ln(c))) / 3) AS g FROM p) SELECT l_suppkey, round(a / g / (a / g + b / g + c / g), 6) AS a FROM p, m")
def coda_center(spark, d):
    return rounded(features.centered_composition(compositions(spark, d), ["a", "b", "c"]).select("l_suppkey", "a"))


@query(f"WITH p AS ({PARTS}), l AS (SELECT l_suppkey, ln(a) - (ln(a) + ln(b) + ln(c)) / 3 AS x, ln(b) - (ln(a) + ln(b) + ln(c)) / 3 AS y, ln(c) - (ln(a) + ln(b) + ln(c)) / 3 AS z, a * a / (a * a + b * b + c * c) AS s FROM p) SELECT l_suppkey, round(x * x + y * y + z * z, 6) AS inner_self, round(s, 6) AS squared FROM l")
def coda_inner_power(spark, d):
    x = F.array("a", "b", "c")
    return rounded(compositions(spark, d).select("l_suppkey", fc.aitchison_inner(x, x).alias("inner_self"), fc.power(x, 2)[0].alias("squared")))


@query()
def impute_composition(spark, d):
    p = compositions(spark, d).withColumn("b", F.when(F.col("l_suppkey") % 4 != 0, F.col("b")))
    return rounded(impute.CompositionalImputer.fit(p, ["a", "b", "c"]).transform(p))


@query("SELECT o_orderkey, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-p)), 6) AS inverse_logit, round(ln(p), 6) AS log, round(sqrt(p), 6) AS root, round(1 / p, 6) AS inverse FROM (SELECT o_orderkey, (o_orderkey % 98 + 1) / 100.0::DOUBLE AS p FROM orders)")
def link_functions(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 98 + 1) / 100).alias("p"))
    p, link = F.col("p"), fc.LINKS
    return rounded(o.select("o_orderkey", link["logit"][0](p).alias("logit"), link["logit"][1](p).alias("inverse_logit"), link["log"][0](p).alias("log"), link["sqrt"][0](p).alias("root"), link["inverse"][0](p).alias("inverse")))


@query("SELECT s_suppkey, round(CASE WHEN z >= 0 THEN 1 - u ELSE u END, 6) AS cdf FROM (SELECT s_suppkey, z, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS u FROM (SELECT s_suppkey, s_acctbal / 4000 AS z, 1 / (1 + 0.2316419 * abs(s_acctbal / 4000)) AS t FROM supplier))")
def normal_distribution(spark, d):
    s = load(spark, d, "supplier")
    return s.select("s_suppkey", F.round(fc.normal_cumulative(F.col("s_acctbal") / 4000), 6).alias("cdf"))


@query("SELECT round(avg(greatest(0, 1 - y * s)), 6) AS hinge, round(avg(abs(s - y)), 6) AS mae FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y, (l_quantity - 25) / 25 AS s FROM lineitem)")
def losses(spark, d):
    li = load(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"), ((F.col("l_quantity") - 25) / 25).alias("s"))
    both = metrics.loss(li, "y", "s", "hinge").select(F.round("loss", 6).alias("hinge"))
    return both.crossJoin(metrics.loss(li, "y", "s", "l1").select(F.round("loss", 6).alias("mae")))


@query(f"SELECT {KEYS}, round(2 * (25 - l_quantity) / (SELECT count(*) FROM lineitem), 9) AS gradient FROM lineitem")
def loss_gradient(spark, d):
    li = load(spark, d, "lineitem").withColumn("p", F.lit(25.0))
    return rounded(metrics.loss_gradient(li, "l_quantity", "p").select(*KEY, "gradient"), 9, KEY)


@query("WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, avg(l_tax) AS t FROM lineitem) SELECT round(a + (b - a) * i / 49, 6) AS l_quantity, round(t, 6) AS l_tax FROM e, generate_series(0, 49) g(i)")
def effect_grid(spark, d):
    return rounded(interpret.effect_grid(load(spark, d, "lineitem"), "l_quantity", ["l_tax"]))


@query("SELECT l_returnflag, round(avg(l_quantity), 5) AS l_quantity, round(avg(l_tax), 6) AS l_tax, count(*) AS n FROM lineitem GROUP BY 1")
def ordination_centroids(spark, d):
    c = interpret.centroids(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_tax")
    return c.select("l_returnflag", F.round("l_quantity", 5).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"), "n")


@query()
def ordination_hulls(spark, d):
    return interpret.hulls(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query("WITH e AS (SELECT CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y, a.vec_id AS query, b.vec_id AS neighbor FROM embeddings a, embeddings b) SELECT query, neighbor FROM e WHERE list_distance(x, y) <= 0.5")
def radius_neighbors(spark, d):
    e = load(spark, d, "embeddings")
    return neighbors.neighbors(e, e, ["embedding"], "vec_id", "vec_id", radius=0.5).select("query", "neighbor")


@query()
def dbscan_predict(spark, d):
    s = spots(spark, d)
    return cluster.dbscan_predict(s, s, cluster.dbscan(s, ["x", "y"], "s_suppkey", 1.25, 4), ["x", "y"], "s_suppkey", 1.25)


@query("WITH m AS (SELECT sum((l_quantity - b) * (l_quantity - b)) AS r0, count(*) AS n, regr_r2(l_quantity, l_tax) AS r FROM lineitem, (SELECT avg(l_quantity) AS b FROM lineitem)) SELECT round(-n * ln(1 - r), 5) AS statistic, CAST(1 AS BIGINT) AS df FROM m")
def likelihood_ratio(spark, d):
    li = load(spark, d, "lineitem")
    r = glm.likelihood_ratio(glm.lm(li, "l_quantity ~ 1"), glm.lm(li, "l_quantity ~ l_tax"))
    return one_row(spark, {"statistic": round(r["statistic"], 5), "df": r["df"]})


@query("WITH m AS (SELECT count(*) AS n, var_pop(l_quantity) AS v, regr_r2(l_quantity, l_tax) AS r FROM lineitem) SELECT 'mean' AS model, round(n * (ln(2 * pi() * v) + 1) + 4, 3) AS aic FROM m UNION ALL SELECT 'tax', round(n * (ln(2 * pi() * v * (1 - r)) + 1) + 6, 3) FROM m")
def model_comparison(spark, d):
    li = load(spark, d, "lineitem")
    got = glm.compare({"mean": glm.lm(li, "l_quantity ~ 1"), "tax": glm.lm(li, "l_quantity ~ l_tax")})
    return spark.createDataFrame([(r["model"], round(r["aic"], 3)) for r in got], "model string, aic double")


@query("SELECT o_orderkey, round(b0 + b1 * o_custkey, 3) AS prediction FROM orders, (SELECT regr_intercept(o_totalprice, o_custkey) AS b0, regr_slope(o_totalprice, o_custkey) AS b1 FROM orders)")
def glm_predict(spark, d):
    o = load(spark, d, "orders")
    return glm.lm(o, "o_totalprice ~ o_custkey").predict(o).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


@query("SELECT p_partkey, round(b0 + b1 * p_size + b2 * p_size * p_size, 3) AS prediction FROM part, (SELECT my - b1 * mx - b2 * mz AS b0, b1, b2 FROM (SELECT my, mx, mz, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS b1, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS b2 FROM (SELECT avg(p_retailprice) AS my, avg(p_size) AS mx, avg(p_size * p_size) AS mz, var_pop(p_size) AS sxx, var_pop(p_size * p_size) AS szz, covar_pop(p_size, p_size * p_size) AS sxz, covar_pop(p_size, p_retailprice) AS sxy, covar_pop(p_size * p_size, p_retailprice) AS szy FROM part)))")
def polynomial_regression(spark, d):
    p = load(spark, d, "part")
    return glm.polynomial(p, "p_retailprice", "p_size").predict(p).select("p_partkey", F.round("prediction", 3).alias("prediction"))


@query()
def one_vs_rest(spark, d):
    o = load(spark, d, "customer").withColumn("x", F.col("c_acctbal") / 10000)
    return glm.predict_ovr(glm.one_vs_rest(o, "c_mktsegment", "x", max_iter=5), o).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query()
def gam_classifier(spark, d):
    p = load(spark, d, "part").withColumn("c", (F.col("p_retailprice") > 1000).cast("int"))
    return smooth.gam_classifier(p, "c", ["p_size"], n_splines=3, max_iter=5).predict(p).select("p_partkey", "prediction")


@query()
def rda_permutation_test(spark, d):
    r = ordination.rda_permutations(load(spark, d, "supplier"), ["s_acctbal"], ["s_nationkey"], "s_suppkey", 5)
    return one_row(spark, {"statistic": float(r["statistic"]), "p_value": float(r["p_value"])})


@query()
def tree_shap(spark, d):
    o = load(spark, d, "part")
    t = trees.grow(o, ["p_size"], "p_retailprice", "regression", max_depth=3)
    return rounded(interpret.tree_shap(o.select("p_partkey", "p_size"), t), 5)


@query()
def kernel_shap(spark, d):
    import numpy as np

    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    got = interpret.kernel_shap(s, ["s_nationkey", "s_acctbal"], lambda x: 3 * x[:, 0] - x[:, 1] / 100, np.array([[12.0, 5000.0], [3.0, 100.0]]))
    return rounded(got, 6, ["s_acctbal"])


@query()
def permutation_importance(spark, d):
    li = load(spark, d, "customer")
    m = glm.lm(li, "c_acctbal ~ c_nationkey")
    got = interpret.permutation_importance(li, ["c_nationkey"], "c_custkey", lambda df: -m.predict(df).agg(F.avg(F.abs(F.col("c_acctbal") - F.col("prediction")))).first()[0], 2)
    return spark.createDataFrame([(r["feature"], r["importance"], r["std"]) for r in got], "feature string, importance double, std double")


@query()
def grid_search(spark, d):
    from .plans.pipeline import grid, search

    p = load(spark, d, "part")
    score = lambda m, df: -m.predict(df).agg(F.avg((F.col("p_retailprice") - F.col("prediction")) ** 2)).first()[0]
    s = search(p, ["p_partkey"], grid({"degree": [1, 2]}), lambda df, degree: glm.polynomial(df, "p_retailprice", "p_size", degree), score, 3)
    return spark.createDataFrame([(r["params"]["degree"], round(r["mean"], 2), round(r["std"], 2)) for r in s.results], "degree int, mean double, std double")


@query()
def learning_curve(spark, d):
    from .plans.pipeline import learning_curve as curve

    p = load(spark, d, "part")
    score = lambda m, df: -m.predict(df).agg(F.avg(F.abs(F.col("p_retailprice") - F.col("prediction")))).first()[0]
    got = curve(p, ["p_partkey"], lambda df: glm.lm(df, "p_retailprice ~ p_size"), score, (0.5, 1.0), 3)
    return spark.createDataFrame([(r["size"], r["train"], r["test"]) for r in got], "size double, train double, test double")


@query()
def saved_model(spark, d):
    from .sources import models

    o = load(spark, d, "orders")
    m = models.load(models.save(glm.lm(o, "o_totalprice ~ o_custkey")))
    return rounded(m.summary(o), 3)


from . import catalog_models  # noqa: E402, F401  registers more queries here
