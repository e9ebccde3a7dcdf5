"""Metrics, sampling, regression, k-means, PageRank, trees, forests and boosting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions import scalars
from rowloom.operators import glm, graph, kmeans, metrics, sampling
from rowloom.operators.grid import Grid, with_row_id
from rowloom.trees import boost, forest, grow
from rowloom.trees.formula import variables


def pairs(spark, a, b, kind="string"):
    return spark.createDataFrame(list(zip(a, b)), f"observed {kind}, predicted {kind}")


def test_classification_errors(spark):
    p = pairs(spark, "t1 t2 t3 t4 t2 t4".split(), "t1 t3 t3 t2 t2 t1".split())
    assert {r["class"]: r["error"] for r in metrics.error_rate(p).collect()} == {"all": 0.5, "t1": 0, "t2": 0.5, "t3": 0, "t4": 1}
    m = {(r["observed"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(p).collect()}
    assert len(m) == 16 and m["t2", "t3"] == 1 and m["t4", "t4"] == 0 and sum(m.values()) == 6
    with pytest.raises(ValueError):
        metrics.confusion_matrix(pairs(spark, ["t1", "t2"], ["t1", "t5"]))


def test_regression_errors(spark):
    y, p = [10.1, 2.2, 30.5, 4.6, 50.7, 6.8], [11.1, 2.3, 32.5, 4.8, 40.7, 6.7]
    full = pairs(spark, y, p, "double")
    assert metrics.mean_squared(full).first()[0] == pytest.approx(17.51) and metrics.r_squared(full).first()[0] == pytest.approx(0.9524440223684199)
    part = pairs(spark, [y[0], None, *y[2:]], p, "double")
    assert metrics.mean_squared(part).first()[0] is None and metrics.r_squared(part).first()[0] is None
    assert metrics.mean_squared(part, True).first()[0] == pytest.approx(21.01) and metrics.r_squared(part, True).first()[0] == pytest.approx(0.9461520915081258)


@pytest.mark.parametrize("ratio", [0.1, 1.0, 2.0])
def test_sampler(spark, ratio):
    rows = spark.range(1001).select(F.col("id").alias("row_id"), (F.col("id") + 1).alias("a"), (F.col("id") + 2).alias("b"))
    out = sampling.sampled(rows, Grid.of(1001, 2, npartitions=4), 6, ratio, 3)
    sizes = {r["pid"]: r["n_rows"] for r in sampling.sample_sizes(out).collect()}
    assert len(sizes) == 6 and set(sizes.values()) == {3 * math.ceil(251 * ratio) + math.ceil(248 * ratio)}
    assert out.where("a + 1 <> b OR row_id + 1 <> a").isEmpty()
    assert out.exceptAll(sampling.sampled(rows, Grid.of(1001, 2, npartitions=4), 6, ratio, 3)).isEmpty()
    if ratio == 2.0:
        assert out.agg(F.avg("a")).first()[0] == pytest.approx(501, rel=0.1)
    with pytest.raises(ValueError):
        sampling.sampled(rows, Grid.of(1001, 2), 0, 1)


def test_tails_and_log_gamma(spark):
    assert scalars.normal_tail(1.959963984540054) == pytest.approx(0.05) and scalars.student_tail(2.2281388519649385, 10) == pytest.approx(0.05) and scalars.student_tail(1.0, 1) == pytest.approx(0.5)
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 10.0, 171.0)], "x double").withColumn("g", scalars.log_gamma(F.col("x")))
    for r in df.collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), abs=1e-10)


def numbers(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    eta = 0.5 + x @ [1.0, -2.0]
    rows = [(i, float(a), float(b), float(e + rng.normal()), float(rng.random() < 1 / (1 + math.exp(-e))), float(rng.poisson(math.exp(e / 3)))) for i, ((a, b), e) in enumerate(zip(x, eta))]
    return spark.createDataFrame(rows, "k long, a double, b double, g double, p double, c double")


def test_gaussian_equals_least_squares(spark):
    df = numbers(spark)
    m = glm.fit_glm(df, "g", ["a", "b"])
    rows = np.array([[1, r["a"], r["b"], r["g"]] for r in df.collect()])
    want, rss, *_ = np.linalg.lstsq(rows[:, :3], rows[:, 3], rcond=None)
    assert m.coefficients == pytest.approx(want) and m.deviance == pytest.approx(float(rss[0])) and m.df_residual == 397
    errors = np.sqrt(np.diag(np.linalg.inv(rows[:, :3].T @ rows[:, :3])) * rss[0] / 397)
    assert [s["std_error"] for s in m.summary()] == pytest.approx(errors.tolist())
    assert m.residuals(df, "response").agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-8)


@pytest.mark.parametrize("family, y", [("binomial", "p"), ("poisson", "c")])
def test_newton_equals_the_library(spark, family, y):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = numbers(spark)
    m = glm.fit_glm(df, y, ["a", "b"], family)
    known = GeneralizedLinearRegression(family=family, labelCol=y, featuresCol="f", tol=1e-10).fit(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df))
    assert m.coefficients == pytest.approx([known.intercept, *known.coefficients], abs=1e-6)
    assert m.deviance == pytest.approx(known.summary.deviance) and m.null_deviance == pytest.approx(known.summary.nullDeviance) and m.aic == pytest.approx(known.summary.aic)
    assert [s["p_value"] for s in m.summary()[1:]] == pytest.approx(known.summary.pValues[:2], abs=1e-6)
    cost, adjusted = glm.cross_validation(df, m, "k", 3)
    assert 0 < cost < 10 and math.isfinite(adjusted) and 0 < glm.split_validation(df, m, "k")[0] < 10


def test_glm_missing_values_and_checks(spark):
    df = numbers(spark).withColumn("a", F.when(F.col("k") % 10 > 0, F.col("a")))
    assert glm.fit_glm(df, "g", ["a"]).n == 360
    assert glm.fit_glm(df, "g", ["a"]).predict(df).where("prediction IS NULL").count() == 40
    with pytest.raises(ValueError):
        glm.fit_glm(df, "g", ["a"], na_action="fail")
    with pytest.raises(ValueError):
        glm.fit_glm(df, "g", ["a"], "binomial")
    with pytest.raises(ValueError):
        glm.fit_glm(df, "g", ["a"], "gamma")


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(999, None, 1.0)], "k long, x double, y double")
    m = kmeans.fit_kmeans(df, 3, ["x", "y"], nstart=3)
    assert sorted(m.sizes.tolist()) == [40, 40, 40] and m.totss == pytest.approx(((pts - pts.mean(axis=0)) ** 2).sum()) and m.betweenss > 0.9 * m.totss
    assert m.labels.where("cluster IS NULL").count() == 1
    again = kmeans.fit_kmeans(df, 3, ["x", "y"], nstart=3)
    assert np.array_equal(m.centers, again.centers)
    fixed = kmeans.apply_centers(df, ["x", "y"], np.array([[0, 0], [0, 0]]))
    assert fixed.where("cluster = 1").count() == 120  # ties go to the first
    ip = spark.createDataFrame([(19.0, 10.0), (4.0, 19.0), (8.0, 6.0), (20.0, 9.0), (19.0, 3.0)], "x double, y double")
    assert [r["cluster"] for r in kmeans.apply_centers(ip, ["x", "y"], np.array([[8, 6], [3, 11]])).collect()] == [1, 2, 1, 1, 1]
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(df, 500, ["x", "y"])
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(df, 2, ["x", "y"], na_action="fail")


EDGES = [(2, 1), (2, 3), (3, 1), (3, 2), (3, 4), (4, 5), (4, 6), (5, 4), (5, 6), (6, 4)]


def test_pagerank(spark):
    e = spark.createDataFrame([(a - 1, b - 1, 1.0) for a, b in EDGES], "s long, t long, w double")
    want = [0.05704882, 0.03939800, 0.04393000, 0.38021881, 0.19588465, 0.28351973]
    own = spark.range(6).select(F.col("id").alias("vertex"), F.lit(1 / 6).alias("value"))
    for g, kw in ((graph.Graph.from_edges(e, "s", "t"), {}), (graph.Graph.from_edges(e, "s", "t", "w"), {}), (graph.Graph.from_edges(e, "s", "t"), {"personalized": own})):
        ranks = graph.pagerank(g, **kw)
        assert [r["rank"] for r in ranks.orderBy("vertex").collect()] == pytest.approx(want, abs=1e-8)
    assert graph.top_vertex(ranks).first()[0] == 4
    bad = e.unionByName(spark.createDataFrame([(0, None, 1.0)], e.schema))
    assert graph.Graph.from_edges(bad, "s", "t").edges.count() == 10
    with pytest.raises(ValueError):
        graph.Graph.from_edges(bad, "s", "t", na_action="fail")
    with pytest.raises(ValueError):
        graph.Graph.from_edges(e, "s", "t", n_vertices=3)


def test_formula():
    assert variables("y ~ a + b", ["a", "b", "c", "y"]) == ("y", ["a", "b"])
    assert variables("y ~ . - b", ["a", "b", "c", "y"]) == ("y", ["a", "c"])
    for bad in ("y", "y ~ z", "z ~ a", "y ~ a - a"):
        with pytest.raises(ValueError):
            variables(bad, ["a", "y"])


@pytest.fixture(scope="module")
def maxima(spark):
    """y is the largest of its features, as a number and as a category."""
    rng = np.random.default_rng(4)
    rows = [(i, *(int(x) for x in v), int(max(v)), f"m{max(v)}", f"c{v[0]}") for i, v in enumerate(rng.integers(1, 4, (600, 3)))]
    return spark.createDataFrame(rows, "k long, a int, b int, c int, y int, label string, cat string").withColumn("y", F.col("y").cast("double"))


def test_tree_is_exact_on_rules(maxima):
    for formula, y in (("y ~ a + b + c", "y"), ("label ~ a + b + c", "label"), ("label ~ cat + b + c", "label"), ("y ~ cat + b + c", "y")):
        m = forest.fit_tree(maxima, formula, "k", cp=0.0, min_split=2, min_leaf=1)
        assert m.predict(maxima).where(F.col("prediction") != F.col(y)).isEmpty(), formula
        again = grow.Forest.from_json(m.to_json())
        assert again.predict(maxima).where(F.col("prediction") != F.col(y)).isEmpty()
    assert set(m.importance()) <= {"cat", "b", "c"} and m.node_table()[0]["n"] == 600


def test_tree_controls(maxima):
    stump = forest.fit_tree(maxima, "y ~ a + b + c", "k", max_depth=1, cp=0.0)
    assert len(stump.trees[0]) == 3
    assert len(forest.fit_tree(maxima, "y ~ a + b + c", "k", cp=1.0).trees[0]) == 1
    missing = stump.predict(maxima.withColumn(stump.features[stump.trees[0][0].feature], F.lit(None).cast("int"))).first()["prediction"]
    assert missing == pytest.approx(maxima.agg(F.avg("y")).first()[0])
    with pytest.raises(ValueError):
        forest.fit_tree(maxima, "y ~ a", "k", max_depth=31)


def test_forest(maxima):
    m = forest.fit_forest(maxima, "label ~ a + b + c", "k", n_trees=6, max_depth=8, seed=5)
    right = m.predict(maxima).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.9
    curve = forest.error_curve(m, maxima, "k").orderBy("trees").collect()
    assert [r["trees"] for r in curve] == list(range(1, 7)) and curve[-1]["error"] < 0.3
    oob = forest.oob_prediction(m, maxima, "k")
    assert oob.count() == 600 and oob.where("prediction IS NOT NULL").count() > 300
    assert 1 <= len(forest.reduced(m, maxima, "k").trees) <= 6
    two = forest.fit_forest_by_parts(maxima, "y ~ a + b + c", "k", n_trees=3, parts=2, max_depth=6)
    assert len(two.trees) == 3 and forest.error_curve(two, maxima, "k").where("rsq > 0.3").count() >= 1
    seen = {r["feature"]: r["importance"] for r in forest.permutation_importance(m, maxima, "k", ["a", "b", "c"], "label", True, 300).collect()}
    assert all(v > 0 for v in seen.values())


@pytest.mark.parametrize("formula", ["label ~ a + b + c", "y ~ a + b + c"])
def test_error_curve_runs_inside_the_rows(maxima, formula):
    m = forest.fit_forest(maxima, formula, "k", n_trees=4, max_depth=4, seed=5)
    curve = forest.error_curve(m, maxima, "k")
    plan = curve._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan  # no row meets its votes in another task
    truth = {r["k"]: m.classes.index(r["label"]) if m.classes else r["y"] for r in maxima.collect()}
    votes: dict = {}
    for r in forest.tree_votes(m, maxima, "k").orderBy("key", "tree").collect():
        votes.setdefault(r["key"], []).append(r)
    want = []
    for t in range(4):
        off = []
        for k, vs in votes.items():
            used = [v["vote"] for v in vs[: t + 1] if v["oob"]]
            if used and m.classes:
                off.append(max(range(len(m.classes)), key=lambda c: (used.count(c), -c)) != truth[k])  # noqa: B023
            elif used:
                off.append((sum(used) / len(used) - truth[k]) ** 2)
        want.append(sum(off) / len(off))
    assert [r["error"] for r in curve.orderBy("trees").collect()] == pytest.approx(want)


def test_reduction_counts_rows_with_equal_votes(maxima, monkeypatch):
    m = forest.fit_forest(maxima, "label ~ a + b + c", "k", n_trees=3, max_depth=2, seed=5)
    want = [vars(n) for t in forest.reduced(m, maxima, "k").trees for n in t]
    sizes, write = [], forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df, label: sizes.append((out := write(df, label)).count()) or out)
    assert [vars(n) for t in forest.reduced(m, maxima, "k").trees for n in t] == want
    assert len(sizes) == 1 and sizes[0] < 300 < maxima.count()


@pytest.mark.parametrize("formula", ["kind ~ a + b", "v ~ a + b"])
def test_rows_that_are_alike_grow_as_one(spark, formula, monkeypatch):
    t = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"))
    t = t.withColumn("v", (F.col("a") * F.col("b")).cast("double")).withColumn("kind", F.when(F.col("v") > 2, "high").otherwise("low"))
    sizes, write = [], grow.materialise
    monkeypatch.setattr(grow, "materialise", lambda df, label: sizes.append((out := write(df, label)).count()) or out)
    fit = lambda: forest.fit_forest(t, formula, "k", n_trees=3, max_depth=4, seed=2).to_json()
    few = fit()
    assert max(sizes) <= 15 * 3
    monkeypatch.setattr(grow, "ALIKE", math.inf, raising=False)
    assert fit() == few and max(sizes) > 15 * 3


def test_split_search():
    hist = np.array([[2, 0], [2, 0], [0, 3.0]])
    assert best(hist, "numeric", True)[1] == 2
    assert grow.best_split(np.array([[5.0, 10, 20]]), "numeric", False, 1, 0) is None
    cats = np.array([[4, 4, 4.0], [4, 40, 400], [4, 4, 4]])
    assert grow.best_split(cats, "categorical", False, 1, 0)[2] == [0, 2]


def best(hist, kind, classify):
    return grow.best_split(hist, kind, classify, 1, 0)


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (9.99,), (10.0,), (None,)], "x double")
    assert [r[0] for r in df.select(grow.bin_of(F.col("x"), 0, 10, 4)).collect()] == [0, 1, 3, 3, None]
    assert [r[0] for r in df.select(grow.bin_of(F.col("x"), 5, 5, 4)).collect()][:2] == [0, 0]
    u = spark.range(20_000).select(grow.poisson_weight(grow.uniform(F.lit(1), F.col("id"))).alias("w"))
    assert u.agg(F.avg("w")).first()[0] == pytest.approx(1, abs=0.05) and u.agg(F.var_pop("w")).first()[0] == pytest.approx(1, abs=0.1)


def chi(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x**2).sum(axis=1) > 3.357
    return spark.createDataFrame([(i, *map(float, r), int(t), float((r**2).sum()), f"q{int(t) + int(r[0] > 0)}") for i, (r, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, d double, y int, g double, m string")


@pytest.mark.parametrize("kind, y, least", [("bernoulli", "y", 0.8), ("adaboost", "y", 0.8), ("multinomial", "m", 0.6), ("gaussian", "g", 0.7)])
def test_boosting(spark, kind, y, least):
    train, test = chi(spark, 1500, 1), chi(spark, 800, 2)
    m = boost.fit_boosted(train, list("abcd"), y, "k", kind, parts=2, n_trees=120, depth=2, shrinkage=0.1)
    assert len(m.models) == 2 and all(one["best"] >= 50 for part in m.models for one in part)
    out = m.predict(test, "k").join(test, F.col("key") == F.col("k"))
    if kind == "gaussian":
        score = out.agg(1 - F.avg(F.pow(F.col("prediction") - F.col("g"), F.lit(2))) / F.var_pop("g")).first()[0]
    else:
        score = out.agg(F.avg((F.col("prediction") == F.col(y).cast("string")).cast("double"))).first()[0]
    assert score > least
    with pytest.raises(ValueError):
        m.predict(test.drop("a"), "k")


def test_row_ids(spark):
    assert with_row_id(spark.range(5), ["id"]).where("row_id <> id").isEmpty()


def test_whole_graph_pagerank(spark, tmp_path):
    """Every edge and vertex counts: ids past 60 and suppliers of any remainder, against plain Python."""
    from rowloom.plans import analytics

    rows = [(s, p, float(q)) for s, p, q in [(0, 61, 2), (3, 125, 1), (60, 61, 5), (61, 3, 4), (61, 3, 1), (125, 0, 3), (64, 60, 2)]]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, weighted, steps in [("pagerank_five_rounds", False, 5), ("pagerank_weighted", True, 4)]:
        x, w = {}, {}
        for s, p, q in rows:
            x[s, p], w[s, p] = x.get((s, p), 0) + 1, w.get((s, p), 0) + q
        share = {e: x[e] * w[e] if weighted else x[e] for e in x}
        r = [0.15] * 126
        for _ in range(steps):
            new = [0.15 / 126] * 126
            for (s, p), f in share.items():
                new[p] += 0.85 * f / sum(v for e, v in share.items() if e[0] == s) * r[s]
            r = [v / sum(new) for v in new]
        got = {v["vertex"]: v["rank"] for v in analytics.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == pytest.approx(dict(enumerate(r)), abs=1e-11)


def test_whole_vectors_decide_the_cluster(spark, tmp_path):
    """Vectors that agree on the first four entries and differ in the last one."""
    from rowloom.plans import analytics

    rows = [(i, [0.0] * 63 + [x]) for i, x in enumerate([0.0, 5.0, 9.0, 8.0, 4.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["cluster"] for r in analytics.QUERIES["kmeans_assign"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 2, 5: 1}
    assert analytics.QUERIES["kmeans_total_squares"](spark, str(tmp_path)).first()[0] == pytest.approx(65.5)
    assert {r["k"]: (r["n"], r["withinss"]) for r in analytics.QUERIES["kmeans_three_steps"](spark, str(tmp_path)).collect()} == {1: (2, 0.5), 2: (2, 0.5), 3: (2, 0.5)}


def test_every_line_reaches_the_orders(spark, tmp_path):
    """Orders without a line 1 count, and so do lines after the first."""
    from rowloom.plans import analytics

    rows = [(1, 1, 5.0, 0.01, "A"), (1, 2, 30.0, 0.07, "R"), (2, 3, 7.0, 0.02, "N"), (3, 2, 40.0, 0.01, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_orderkey"]: (r["q"], r["a"], r["flag"], r["kind"]) for r in analytics._iris_like(spark, str(tmp_path)).collect()}
    assert got == {1: (30.0, 0.07, "R", "high"), 2: (7.0, 0.02, "N", "low"), 3: (40.0, 0.01, "N", "mid")}


def _table(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), "xyz"[int(c)], "hi" if a + (c == 2) * 0.3 > 0.6 else "mid" if b > 0.5 else "lo", float(3 * a - b)) for i, (a, b, c) in enumerate(zip(rng.random(n), rng.random(n), rng.integers(0, 3, n)))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, kind string, v double")


def _shape(tree, at=0):
    n = tree[at]
    return (round(n.value, 9), n.n) if n.feature < 0 else (n.feature, round(n.threshold, 9), n.left_bins, _shape(tree, n.left), _shape(tree, n.right))


@pytest.mark.parametrize("formula", ["kind ~ a + b + c", "v ~ a + b + c"])
def test_small_nodes_finish_as_the_levels_would(spark, formula):
    t = _table(spark)
    trees = [grow.grow(t, formula, "id", grow.Growth(1, None, 5, 2, 12, local_rows=local)).trees[0] for local in (0, 100, 10_000)]
    assert len(trees[0]) > 10 and _shape(trees[0]) == _shape(trees[1]) == _shape(trees[2])


def test_forest_walk_equals_expressions(spark, monkeypatch):
    t = _table(spark)
    m = forest.fit_forest(t, "kind ~ a + b + c", "id", n_trees=5, max_depth=6)
    holes = t.unionByName(spark.createDataFrame([(-1, None, 0.2, "x", None, None), (-2, 0.1, None, None, None, None), (-3, float("nan"), 0.4, "unknown", None, None), (-4, 0.7, 0.1, "unknown", None, None)], t.schema))
    votes = []
    for most in (10**9, 0):
        monkeypatch.setattr(grow, "EXPRESSION_NODES", most)
        votes.append({r["id"]: list(r["__votes"]) for r in m.with_votes(holes).collect()})
    assert votes[0] == votes[1] and len(votes[0]) == 604
    monkeypatch.setattr(grow, "MODEL_BYTES", 10)
    with pytest.raises(MemoryError):
        m.predict(t)


def test_forest_scores_a_test_set(spark):
    t = _table(spark)
    m = forest.fit_forest(t.where("id < 400"), "kind ~ a + b + c", "id", n_trees=6, max_depth=8, test=t.where("id >= 400"))
    curve = {r["trees"]: r["error"] for r in m.test_error.collect()}
    said = m.test_prediction.join(t, m.test_prediction["key"] == t["id"]).toPandas()
    assert sorted(curve) == list(range(1, 7)) and len(said) == 200
    assert curve[6] == pytest.approx((said.prediction != said.kind).mean()) and curve[6] < 0.2


def test_imputation_takes_donors_of_the_leaf(spark):
    from rowloom.trees import impute

    t = _table(spark)
    m = forest.fit_forest(t, "kind ~ a + b + c", "id", n_trees=4, max_depth=6)
    holes = spark.createDataFrame([(1000 + i, 0.9, None, "x", None, None) for i in range(40)] + [(2000, None, None, None, None, None), (3000, 0.5, 0.5, "y", "lo", 1.0)], t.schema)
    out = {r["id"]: r for r in impute.imputed(m, holes, t, "id").collect()}
    known = {r["b"] for r in t.select("b").collect()}
    assert len(out) == 42 and out[3000]["b"] == 0.5
    assert all(out[1000 + i]["a"] == 0.9 and out[1000 + i]["b"] in known for i in range(40)) and len({out[1000 + i]["b"] for i in range(40)}) > 5
    assert None not in (out[2000]["a"], out[2000]["b"], out[2000]["c"])
    whole = {r["id"]: (r["a"], r["b"], r["c"]) for r in impute.imputed(m, holes, t, "id", everything=True).collect()}
    rows = {(r["a"], r["b"], r["c"]) for r in t.collect()}
    assert all(whole[1000 + i] in rows for i in range(40))
    donors = impute.donors(m, t, "id")
    assert donors.where(f"size(rows) > {impute.DONORS}").isEmpty() and {r["tree"] for r in donors.collect()} == {0, 1, 2, 3}


def test_many_labels_are_no_category(spark, monkeypatch):
    monkeypatch.setattr(grow, "MAX_LABELS", 2)
    with pytest.raises(ValueError, match="labels"):
        forest.fit_tree(_table(spark), "kind ~ c", "id")


def test_glm_starting_values(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    y = rng.poisson(np.exp(0.5 + 0.4 * x))
    t = spark.createDataFrame([(i, float(a), float(b), 0.2, 1.5, float(1 + i % 2), float(i % 2)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double, eta double, mu double, w double, mask double")
    fits = [glm.fit_glm(t, "y", ["x"], "poisson", **k) for k in ({}, {"etastart": "eta"}, {"mustart": "mu"}, {"start": np.zeros(2)})]
    assert all(np.allclose(m.coefficients, fits[0].coefficients, atol=1e-6) and m.converged for m in fits)
    # the first iteration is a weighted least squares on the working response at y + 0.1
    mu = y + 0.1
    z, a = np.log(mu) + (y - mu) / mu, np.stack([np.ones(300), x], axis=1)
    first = np.linalg.solve(a.T @ (a * mu[:, None]), a.T @ (mu * z))
    theta, _ = glm._first_step(glm.complete_cases(t, "y", ["x"]), "poisson", "y", ["x"], None, None, F.log(F.col("y") + 0.1), F.col("y") + 0.1)
    assert np.allclose(theta, first)
    with pytest.raises(ArithmeticError):
        glm.fit_glm(t, "y", ["x"], "poisson", start=np.array([5.0, 3.0]), maxit=1)
    masked = fits[0].predict(t, "response", mask="mask").toPandas()
    assert (masked.prediction.isna() == (masked["mask"] != 1)).all()
    assert "poisson model of y" in str(fits[0]) and fits[0].fitted(t).where("fitted > 0").count() == 300 == fits[0].working_weights(t).where("working_weight > 0").count()


def test_glm_validation_carries_weights(spark):
    rng = np.random.default_rng(8)
    t = spark.createDataFrame([(i, float(x), float(2 * x + e), float(1 + 5 * (i % 2)), 0.5) for i, (x, e) in enumerate(zip(rng.normal(size=80), rng.normal(size=80)))], "id long, x double, y double, w double, o double")
    m = glm.fit_glm(t, "y", ["x"], weight="w", offset="o")
    cost, adjusted = glm.cross_validation(t, m, "id", 3)
    p = t.select("*", glm.fold_of("id", 3).alias("f")).toPandas()
    want = 0.0
    for f in range(3):
        train, out = p[p.f != f], p[p.f == f]
        a = np.stack([np.ones(len(train)), train.x], axis=1)
        b = np.linalg.solve(a.T @ (a * train.w.to_numpy()[:, None]), a.T @ (train.w * (train.y - train.o)).to_numpy())
        want += ((out.y - b[0] - b[1] * out.x - out.o) ** 2).mean() / 3
    assert cost == pytest.approx(want) and glm.split_validation(t, m, "id")[0] > 0
    assert glm.bad_rows(t.unionByName(spark.createDataFrame([(-1, None, 1.0, 1.0, 0.0), (-2, 1.0, float("inf"), 1.0, 0.0), (-3, None, None, 1.0, 0.0)], t.schema)), "y", ["x"]) == {"response": 2, "predictors": 2, "either": 3}
