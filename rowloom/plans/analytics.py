"""Registered queries of the analytics: metrics, sampling, regression, clustering, graphs, trees and boosting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import glm, graph, kmeans, metrics, sampling
from ..operators.grid import Grid, with_row_id
from ..scratch import materialise
from ..trees import boost, forest, grow
from .arrays import LINE_KEYS, _IDS, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- metrics and sampling ------------------------------------------------------------------------------------------------

_PAIRS = "SELECT CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS observed, CASE WHEN d.n_chars % 7 > 0 THEN 'good' ELSE 'bad' END AS predicted FROM labels l JOIN documents d USING (doc_id)"


def _pairs(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    name = lambda c: F.when(c, "good").otherwise("bad")
    return t.select(name(F.col("quality") == 1).alias("observed"), name(F.col("n_chars") % 7 > 0).alias("predicted"))


@query(f"WITH p AS ({_PAIRS}) SELECT a.x AS observed, b.x AS predicted, CAST((SELECT count(*) FROM p WHERE observed = a.x AND predicted = b.x) AS BIGINT) AS n FROM (VALUES ('good'), ('bad')) a(x), (VALUES ('good'), ('bad')) b(x)")
def metric_confusion(spark, d):
    return metrics.confusion_matrix(_pairs(spark, d))


@query(f"WITH p AS ({_PAIRS}) SELECT observed AS class, round(avg(CASE WHEN observed = predicted THEN 0.0 ELSE 1.0 END), 6) AS error FROM p GROUP BY 1 UNION ALL SELECT 'all', round(avg(CASE WHEN observed = predicted THEN 0.0 ELSE 1.0 END), 6) FROM p")
def metric_error_rate(spark, d):
    return metrics.error_rate(_pairs(spark, d)).withColumn("error", F.round("error", 6))


def _forecast(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("observed"), (F.col("l_quantity") * 1000).alias("predicted"))


@query("SELECT round(avg(pow(l_extendedprice - l_quantity * 1000, 2)), 0) AS value FROM lineitem")
def metric_mean_squared(spark, d):
    return metrics.mean_squared(_forecast(spark, d)).withColumn("value", F.round("value", 0))


@query("SELECT round(1 - avg(pow(l_extendedprice - l_quantity * 1000, 2)) / var_samp(l_extendedprice), 8) AS value FROM lineitem")
def metric_r_squared(spark, d):
    return metrics.r_squared(_forecast(spark, d)).withColumn("value", F.round("value", 8))


@query("WITH n AS (SELECT count(*) c FROM orders), b AS (SELECT least(1000, c - p * 1000) s FROM n, (SELECT unnest(range(0, CAST(ceil((SELECT c FROM n) / 1000.0) AS BIGINT))) p)), k AS (SELECT CAST(sum(ceil(s * 0.25)) AS BIGINT) n_rows FROM b) SELECT CAST(pid AS BIGINT) AS pid, n_rows, true AS aligned FROM k, range(1, 4) t(pid)")
def sample_with_replacement(spark, d):
    rows = with_row_id(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    out = sampling.sampled(rows, Grid.of(rows.count(), 2, (1000, 2)), 3, 0.25, seed=7)
    back = out.withColumnRenamed("o_orderkey", "k").join(rows.select("row_id", "o_orderkey"), "row_id")
    return back.groupBy("pid").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("k") == F.col("o_orderkey")).alias("aligned"))


# -- regression ----------------------------------------------------------------------------------------------------------


def _frame(spark, rows: list, schema: str):
    return spark.createDataFrame(rows, schema)


@query("SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")
def glm_gaussian(spark, d):
    m = glm.fit_glm(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return _frame(spark, [(s["term"], round(s["estimate"], 3)) for s in m.summary()], "term string, estimate double")


_FIT = "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, count(*) n, avg(l_extendedprice) my, regr_sxx(l_extendedprice, l_quantity) sxx FROM lineitem), r AS (SELECT sum(pow(l_extendedprice - a - b * l_quantity, 2)) dev, sum(pow(l_extendedprice - my, 2)) nul FROM lineitem, f)"


@query(_FIT + " SELECT round(dev / 1e9, 4) AS deviance, round(nul / 1e9, 4) AS null_deviance, n - 2 AS df_residual, round(n * (ln(2 * pi() * dev / n) + 1) + 2 + 4, 2) AS aic, round(sqrt(dev / (n - 2) / sxx), 5) AS slope_error FROM f, r")
def glm_gaussian_summary(spark, d):
    m = glm.fit_glm(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    row = (round(m.deviance / 1e9, 4), round(m.null_deviance / 1e9, 4), m.df_residual, round(m.aic, 2), round(m.summary()[1]["std_error"], 5))
    return _frame(spark, [row], "deviance double, null_deviance double, df_residual long, aic double, slope_error double")


@query(_FIT + f" SELECT {_IDS} AS row_id, round(a + b * l_quantity, 2) AS prediction, round(l_extendedprice - a - b * l_quantity, 2) AS residual FROM lineitem, f")
def glm_gaussian_predict(spark, d):
    t = with_row_id(table(spark, d, "lineitem").select(*LINE_KEYS), LINE_KEYS)
    m = glm.fit_glm(t, "l_extendedprice", ["l_quantity"], complete=False)
    return m.residuals(m.predict(t, "response"), "response").select("row_id", F.round("prediction", 2).alias("prediction"), F.round("residual", 2).alias("residual"))


def _newton_sql(rows: str, mu: str, v: str, steps: int) -> str:
    """Newton steps on (y, x) from zero, unrolled; two unknowns by Cramer's rule."""
    parts, sql = [f"d AS ({rows})", "t0 AS (SELECT CAST(0 AS DOUBLE) a, CAST(0 AS DOUBLE) b)"], ""
    for k in range(steps):
        parts.append(f"s{k} AS (SELECT sum(y - m) g0, sum((y - m) * x) g1, sum(v) h00, sum(v * x) h01, sum(v * x * x) h11 FROM (SELECT y, x, m, {v} v FROM (SELECT y, x, {mu} m FROM (SELECT y, x, a + b * x e FROM d, t{k}))))")
        parts.append(f"t{k + 1} AS (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) b FROM t{k}, s{k})")
    return f"WITH {', '.join(parts)} SELECT round(a, 6) AS a, round(b, 6) AS b FROM t{steps}{sql}"


def _newton(rows, family: str, steps: int):
    theta = np.zeros(2)
    for _ in range(steps):
        g, h, _, _ = glm.newton_sums(rows, family, "y", ["x"], theta)
        theta = theta + np.linalg.solve(h, g)
    return rows.sparkSession.createDataFrame([tuple(round(float(v), 6) for v in theta)], "a double, b double")


@query(_newton_sql("SELECT CAST(l.quality AS DOUBLE) y, d.n_chars / 10000.0 x FROM labels l JOIN documents d USING (doc_id)", "1 / (1 + exp(-e))", "m * (1 - m)", 3))
def glm_logit_steps(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").cast("double").alias("y"), (F.col("n_chars") / 10000.0).alias("x"))
    return _newton(t, "binomial", 3)


@query(_newton_sql("SELECT CAST(l_linenumber AS DOUBLE) y, l_discount x FROM lineitem", "exp(e)", "m", 2))
def glm_poisson_steps(spark, d):
    return _newton(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), F.col("l_discount").alias("x")), "poisson", 2)


@query()
def glm_binomial_fit(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("x", F.col("n_chars") / 10000.0)
    m = glm.fit_glm(t, "quality", ["x"], "binomial")
    return pd_frame(spark, m.summary())


def pd_frame(spark, rows: list[dict]):
    return spark.createDataFrame(pd.DataFrame(rows))


@query("SELECT CAST(10 AS BIGINT) AS folds, (SELECT count(*) FROM orders) AS n")
def glm_fold_counts(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", glm.fold_of("o_orderkey", 10).alias("f"))
    return t.groupBy("f").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("folds"), F.sum("c").alias("n"))


@query()
def glm_cross_validation(spark, d):
    t = table(spark, d, "supplier").withColumn("x", F.col("s_nationkey").cast("double"))
    m = glm.fit_glm(t, "s_acctbal", ["x"])
    rows = [("cv", *glm.cross_validation(t, m, "s_suppkey", 4)), ("split", *glm.split_validation(t, m, "s_suppkey"))]
    return spark.createDataFrame(rows, "kind string, cost double, adjusted double")


# -- clustering ------------------------------------------------------------------------------------------------------------

DIMS = [f"x{k}" for k in range(1, 65)]


def _points(spark, d, dims: list[str] = DIMS):
    return table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(dims)])


def _start(spark, d, dims: list[str] = DIMS) -> np.ndarray:
    return np.array([[r[c] for c in dims] for r in _points(spark, d, dims).where("vec_id < 3").orderBy("vec_id").collect()])


def _kmeans_sql(steps: int, final: str, dims: list[str] = DIMS) -> str:
    parts = ["p AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) {c}" for k, c in enumerate(dims)) + " FROM embeddings)", f"c0 AS (SELECT vec_id + 1 k, {', '.join(dims)} FROM p WHERE vec_id < 3)"]
    dist = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in dims)
    for s in range(steps + 1):
        parts.append(f"a{s} AS (SELECT vec_id, k, dd FROM (SELECT p.vec_id, c.k, {dist} dd, row_number() OVER (PARTITION BY p.vec_id ORDER BY {dist}, c.k) r FROM p, c{s} c) WHERE r = 1)")
        parts.append(f"c{s + 1} AS (SELECT c.k, " + ", ".join(f"coalesce(m.{c}, c.{c}) {c}" for c in dims) + f" FROM c{s} c LEFT JOIN (SELECT k, " + ", ".join(f"avg({c}) {c}" for c in dims) + f" FROM a{s} JOIN p USING (vec_id) GROUP BY k) m USING (k))")
    return f"WITH {', '.join(parts)} {final}"


@query(_kmeans_sql(0, "SELECT vec_id, CAST(k AS INTEGER) AS cluster FROM a0"))
def kmeans_assign(spark, d):
    return kmeans.apply_centers(_points(spark, d), DIMS, _start(spark, d)).select("vec_id", "cluster")


def _fit_three(spark, d, dims: list[str], complete: bool) -> kmeans.KMeansModel:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return kmeans.fit_kmeans(_points(spark, d, dims), _start(spark, d, dims), dims, iter_max=3, complete=complete)


def _three_steps(spark, d, dims: list[str]):
    m = _fit_three(spark, d, dims, False)
    rows = [(k + 1, int(n), round(float(w), 6)) for k, (n, w) in enumerate(zip(m.sizes, m.withinss)) if n]
    return spark.createDataFrame(rows, "k int, n long, withinss double")


_STEPS_3 = "SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(sum(dd), 6) AS withinss FROM a3 GROUP BY k"


@query(_kmeans_sql(3, _STEPS_3))
def kmeans_three_steps(spark, d):
    return _three_steps(spark, d, DIMS)


def _total_sql(n: int) -> str:
    return "WITH p AS (" + " UNION ALL ".join(f"SELECT {k} k, CAST(embedding[{k}] AS DOUBLE) x FROM embeddings" for k in range(1, n + 1)) + ") SELECT round(sum(v), 6) AS totss FROM (SELECT var_pop(x) * count(*) v FROM p GROUP BY k)"


@query(_total_sql(64))
def kmeans_total_squares(spark, d):
    m = _fit_three(spark, d, DIMS, True)  # the total does not depend on the steps
    return spark.createDataFrame([(round(m.totss, 6),)], "totss double")


# -- graphs ------------------------------------------------------------------------------------------------------------------

_EDGES = "SELECT l_suppkey AS s, l_partkey AS t, count(*) AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL"
_IDS = "range((SELECT CAST(max(greatest(l_suppkey, l_partkey)) + 1 AS BIGINT) FROM lineitem))"
_N = "(SELECT count(*) FROM v)"
_RANKS = "SELECT vertex, round(r, 12) AS rank FROM r{n}"


def _graph(spark, d, weighted: bool) -> graph.Graph:
    return graph.Graph.from_edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity" if weighted else None)


def _pagerank_sql(steps: int, share: str, base: str, final: str = _RANKS) -> str:
    parts = [f"e AS ({_EDGES})", f"o AS (SELECT s, sum({share}) g FROM e GROUP BY s)", f"f AS (SELECT s, t, 0.85 * {share} / g f FROM e JOIN o USING (s))", f"v AS (SELECT range AS vertex FROM {_IDS})", "r0 AS (SELECT vertex, 1 - 0.85 AS r FROM v)"]
    for k in range(steps):
        parts.append(f"u{k} AS (SELECT v.vertex, coalesce(q.z, 0) + {base} r FROM v LEFT JOIN (SELECT t, sum(f * r) z FROM f JOIN r{k} ON s = vertex GROUP BY t) q ON q.t = v.vertex)")
        parts.append(f"r{k + 1} AS (SELECT vertex, r / (SELECT sum(r) FROM u{k}) r FROM u{k})")
    return f"WITH {', '.join(parts)} {final.format(n=steps)}".replace(" AS (", " AS MATERIALIZED (")


@query(_pagerank_sql(5, "x", f"(1 - 0.85) / {_N}"))
def pagerank_five_rounds(spark, d):
    return graph.pagerank(_graph(spark, d, False), 5, 0).withColumn("rank", F.round("rank", 12))


@query(_pagerank_sql(4, "(x * w)", f"(1 - 0.85) / {_N}"))
def pagerank_weighted(spark, d):
    return graph.pagerank(_graph(spark, d, True), 4, 0).withColumn("rank", F.round("rank", 12))


@query(_pagerank_sql(4, "x", f"(1 - 0.85) * (v.vertex % 5) / (2.0 * {_N})"))
def pagerank_personalized(spark, d):
    g = _graph(spark, d, False)
    own = spark.range(g.n_vertices).select(F.col("id").alias("vertex"), ((F.col("id") % 5) / (2.0 * g.n_vertices)).alias("value"))
    return graph.pagerank(g, 4, 0, personalized=own).withColumn("rank", F.round("rank", 12))


@query(_pagerank_sql(5, "x", f"(1 - 0.85) / {_N}", "SELECT vertex + 1 AS vertex FROM r{n} ORDER BY r DESC, vertex LIMIT 1"))
def pagerank_top_vertex(spark, d):
    return graph.top_vertex(graph.pagerank(_graph(spark, d, False), 5, 0))


# -- trees -----------------------------------------------------------------------------------------------------------------

_BIN = "CAST(greatest(0, least(floor((l_extendedprice - lo) * 64 / (hi - lo)), 63)) AS INTEGER)"
_RANGE = "(SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)"


@query(f"SELECT {_BIN} AS bin, count(*) AS n, round(sum(l_quantity), 2) AS sum_y, round(sum(l_quantity * l_quantity), 2) AS sum_yy FROM lineitem, {_RANGE} GROUP BY 1")
def tree_histogram(spark, d):
    t = table(spark, d, "lineitem")
    lo, hi = grow.feature_ranges(t, ["l_extendedprice"])["l_extendedprice"]
    y = F.col("l_quantity")
    out = t.groupBy(grow.bin_of(F.col("l_extendedprice"), lo, hi, 64).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_yy"))
    return out.select("bin", "n", F.round("sum_y", 2).alias("sum_y"), F.round("sum_yy", 2).alias("sum_yy"))


@query(
    f"WITH h AS (SELECT {_BIN} b, CAST(count(*) AS DOUBLE) n, sum(l_quantity) s FROM lineitem, {_RANGE} GROUP BY 1), c AS (SELECT b, sum(n) OVER w nl, sum(s) OVER w sl, (SELECT sum(n) FROM h) nt, (SELECT sum(s) FROM h) st, lead(b) OVER (ORDER BY b) nb FROM h WINDOW w AS (ORDER BY b)), "
    f"g AS (SELECT nb, nl, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt gain FROM c WHERE nl >= 7 AND nt - nl >= 7) SELECT round(lo + nb * (hi - lo) / 64, 2) AS threshold, CAST(nl AS BIGINT) AS n_left, round(gain, 1) AS gain FROM g, {_RANGE} ORDER BY gain DESC LIMIT 1"
)
def tree_root_split(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    tree = forest.fit_tree(t, "l_quantity ~ l_extendedprice", "l_orderkey", cp=0.0, max_depth=1, n_bins=64).trees[0]
    return spark.createDataFrame([(round(tree[0].threshold, 2), int(tree[tree[0].left].n), round(tree[0].gain, 1))], "threshold double, n_left long, gain double")


@query("SELECT k AS key, CASE WHEN 2 * count_if(v = 1) >= 3 * count_if(v = 0) THEN 'y' ELSE 'n' END AS prediction FROM (SELECT o_orderkey k, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 2 v FROM orders UNION ALL SELECT o_orderkey, o_custkey % 2 FROM orders UNION ALL SELECT o_orderkey, (o_orderkey // 3) % 2 FROM orders) GROUP BY k".replace(">= 3", "> 3"))
def forest_votes(spark, d):
    t = table(spark, d, "orders")
    says = [F.substring("o_orderpriority", 1, 1).cast("int") % 2, F.col("o_custkey") % 2, F.floor(F.col("o_orderkey") / 3) % 2]
    votes = t.select(F.col("o_orderkey").alias("key"), F.inline(F.array(*[F.struct(F.lit(k).alias("tree"), v.cast("double").alias("vote")) for k, v in enumerate(says)])))
    return forest.combined_votes(votes, ["n", "y"], [0.4, 0.6])


def _iris_like(spark, d):
    """One row an order, with a class by rule from three measures of its lines: a tree can learn it exactly. Written once,
    as fits read it several times. Lines are dealt by order first: the largest text of a group takes a sort, which then
    is of one shuffled part and not of a whole split."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag").repartition("l_orderkey")
    t = t.groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("a"), F.max("l_returnflag").alias("flag"))
    return materialise(t.withColumn("kind", F.when(F.col("q") < 20, "low").when(F.col("a") < 0.05, "mid").otherwise("high")), "orders-by-rule")


@query("SELECT count(*) AS n, count(*) AS n_right FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def tree_learns_rule(spark, d):
    return _learned(_iris_like(spark, d))


def _learned(t):
    m = forest.fit_tree(t, "kind ~ q + a + flag", "l_orderkey", cp=0.0, min_split=2, min_leaf=1)
    return m.predict(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == F.col("prediction")).alias("n_right"))


@query()
def forest_out_of_bag(spark, d):
    t = _iris_like(spark, d)
    m = forest.fit_forest(t, "kind ~ .", "l_orderkey", n_trees=8, max_depth=6, seed=3)
    return forest.error_curve(m, t, "l_orderkey")


@query()
def forest_reduced(spark, d):
    t = _iris_like(spark, d)
    m = forest.fit_forest_by_parts(t, "kind ~ q + a", "l_orderkey", n_trees=6, parts=2, max_depth=5)
    small = forest.reduced(m, t, "l_orderkey")
    return small.predict(t).groupBy("kind", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'q' AS feature, true AS matters UNION ALL SELECT 'a', true UNION ALL SELECT 'flag', false")
def permutation_importance(spark, d):
    t = _iris_like(spark, d)
    m = forest.fit_tree(t, "kind ~ q + a + flag", "l_orderkey", cp=0.001)
    out = forest.permutation_importance(m, t, "l_orderkey", ["q", "a", "flag"], "kind", True)
    return out.select("feature", (F.col("importance") > 0.05).alias("matters"))


@query("SELECT o_orderkey AS key, median(v) AS prediction FROM (SELECT o_orderkey, o_totalprice v FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_orderkey FROM orders) GROUP BY 1")
def boosting_combined(spark, d):
    t = table(spark, d, "orders")
    values = [F.col("o_totalprice"), F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double")]
    scores = t.select(F.col("o_orderkey").alias("key"), F.inline(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value"), F.lit(0).alias("label")) for k, v in enumerate(values)])))
    return boost.combine(scores, "bernoulli")


@query("SELECT true AS better")
def boosting_fit(spark, d):
    t = _iris_like(spark, d).withColumn("y", (F.col("q") < 20).cast("int"))
    m = boost.fit_boosted(t, ["q", "a"], "y", "l_orderkey", "bernoulli", parts=2, n_trees=60)
    said = m.predict(t, "l_orderkey").join(t, F.col("key") == F.col("l_orderkey"))
    return said.agg((F.avg((F.col("prediction") == F.col("y").cast("string")).cast("double")) > 0.95).alias("better"))
