"""Random forests, single trees, their out-of-bag curves, reduction and permutation importance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.na import cleaned
from ..scratch import materialise, release
from .formula import variables
from .grow import Forest, Growth, grow, matrix_of, poisson_weight, uniform


def fit_tree(df: DataFrame, formula: str, key: str, weight: str | None = None, min_split: int = 20, min_leaf: int | None = None, cp: float = 0.01, max_depth: int = 30, n_bins: int = 256, na_action: str = "omit") -> Forest:
    """One tree over all rows and features. ``cp`` holds at every node; 0 grows as far as the counts allow."""
    if not 0 <= cp <= 1 or not 1 <= max_depth <= 30:
        raise ValueError("cp must lie in [0, 1] and max_depth in 1 .. 30")
    return grow(df, formula, key, Growth(1, None, min_split, min_leaf or max(1, round(min_split / 3)), max_depth, None, cp, n_bins), weight, na_action)


def fit_forest(df: DataFrame, formula: str, key: str, n_trees: int = 500, mtry: int | None = None, replace: bool = True, node_size: int | None = None, max_nodes: int | None = None, n_bins: int = 256, max_depth: int = 30, seed: int = 1, batch: int = 50, na_action: str = "omit", test: DataFrame | None = None) -> Forest:
    """Bagged trees, grown ``batch`` at a time so that rows times trees in flight stay bounded.

    ``test`` (the features, the response and the key) gives ``test_prediction`` and ``test_error``, the curve over
    1, 2, ... trees, as frames of the forest.
    """
    response, features = variables(formula, [c for c in df.columns if c != key])
    classify = dict(df.dtypes)[response] in ("string", "boolean")
    mtry = mtry or max(1, math.floor(math.sqrt(len(features))) if classify else len(features) // 3)
    size = node_size or (1 if classify else 5)
    out = None
    for start in range(0, n_trees, batch):
        g = Growth(min(batch, n_trees - start), mtry, max(2, size), max(1, size), max_depth, max_nodes, 0.0, n_bins, "poisson" if replace else "subsample", seed + start)
        part = grow(df, formula, key, g, na_action=na_action)
        out = part if out is None else out.joined(part)
    out.seeds = [(seed + t // batch * batch, t % batch) for t in range(n_trees)]
    out.bootstrap = "poisson" if replace else "subsample"
    if test is not None:
        out.test_prediction = out.predict(test).select(F.col(key).alias("key"), "prediction")
        out.test_error = error_curve(out, test, key, oob=False)
    return out


def fit_forest_by_parts(df: DataFrame, formula: str, key: str, n_trees: int = 500, parts: int = 4, **kw) -> Forest:
    """Sub-forests of n_trees / parts trees, the remainder to the first ones, joined."""
    seed, out = kw.pop("seed", 1), None
    for k in range(parts):
        n = n_trees // parts + (k < n_trees % parts)
        if n:
            part = fit_forest(df, formula, key, n, seed=seed + 1000 * k, **kw)
            if out is None:
                out = part
            else:
                seeds = out.seeds + part.seeds
                out = out.joined(part)
                out.seeds, out.bootstrap = seeds, part.bootstrap
    return out


def _voted(forest: Forest, df: DataFrame, key: str, truth: bool = True) -> DataFrame:
    """(key, votes, oob, y): for each row what each tree says, whether the row was not drawn for it, and the truth."""
    seeds = getattr(forest, "seeds", [(0, t) for t in range(len(forest.trees))])
    kind = getattr(forest, "bootstrap", "none")

    def drawn(seed: int, t: int) -> Column:
        u = uniform(F.lit(seed), F.lit(t), F.col(key))
        return {"none": F.lit(1), "poisson": poisson_weight(u), "subsample": (u < 0.632).cast("int")}[kind]

    voted = forest.with_votes(df.select(*dict.fromkeys([key, *forest.features, *([forest.response] if truth else [])])))
    oob = F.array(*[drawn(*seeds[t]) == 0 for t in range(len(forest.trees))])
    return voted.select(F.col(key).alias("key"), F.col("__votes").alias("votes"), oob.alias("oob"), *([_truth(forest).alias("y")] if truth else []))


def _truth(forest: Forest) -> Column:
    if forest.classes is None:
        return cleaned(F.col(forest.response))
    labels = F.array(*[F.lit(c) for c in forest.classes])
    return (F.array_position(labels, F.col(forest.response).cast("string")) - 1).cast("double")


def tree_votes(forest: Forest, df: DataFrame, key: str) -> DataFrame:
    """(key, tree, vote, oob): what each tree says of each row, and whether the row was not drawn for it."""
    each = F.arrays_zip("votes", "oob")
    return _voted(forest, df, key, truth=False).select("key", F.posexplode(each).alias("tree", "e")).select("key", "tree", F.col("e.votes").alias("vote"), F.col("e.oob").alias("oob"))


def oob_prediction(forest: Forest, df: DataFrame, key: str) -> DataFrame:
    """(key, prediction): from the trees that did not draw the row; null where all did."""
    votes = tree_votes(forest, df, key).where("oob")
    if forest.classes is None:
        said = votes.groupBy("key").agg(F.avg("vote").alias("prediction"))
    else:
        counts = votes.groupBy("key", "vote").agg(F.count(F.lit(1)).alias("n"))
        said = counts.groupBy("key").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).cast("int").alias("v"))
        said = said.select("key", F.get(F.array(*[F.lit(c) for c in forest.classes]), F.col("v")).alias("prediction"))
    return df.select(F.col(key).alias("key")).join(said, "key", "left")


def error_curve(forest: Forest, df: DataFrame, key: str, oob: bool = True) -> DataFrame:
    """(trees, error[, rsq]) after 1, 2, ... trees: error rate, or mean squared error and 1 - mse / variance.

    Votes are summed along the trees inside the row, over Arrow batches; what meets elsewhere is one sum for each tree.
    """
    n_classes = None if forest.classes is None else len(forest.classes)

    def running(batches):
        for batch in batches:
            votes = matrix_of(batch.column("votes"))
            use = matrix_of(batch.column("oob")) > 0 if oob else np.full(votes.shape, True)
            if n_classes is None:
                n = use.cumsum(axis=1)
                said = np.where(use, votes, 0.0).cumsum(axis=1) / np.maximum(n, 1)
            else:
                n, said = np.zeros(votes.shape, int), np.zeros(votes.shape)
                for c in range(n_classes):  # equal counts: the first class
                    own = ((votes == c) & use).cumsum(axis=1)
                    said[own > n] = c
                    n = np.maximum(n, own)
            offsets = pa.array(np.arange(0, votes.size + 1, votes.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(offsets, pa.array(said.ravel(), mask=(n == 0).ravel()))], ["y", "said"])

    said = _voted(forest, df, key).select("y", "votes", "oob").mapInArrow(running, "y double, said array<double>")
    scored = said.select("y", F.posexplode("said").alias("tree", "said")).where("said IS NOT NULL").groupBy("tree")
    trees = (F.col("tree") + 1).alias("trees")
    if forest.classes is None:
        d = F.col("said") - F.col("y")
        return scored.agg(F.avg(d * d).alias("error"), F.var_pop("y").alias("v")).select(trees, "error", (1 - F.try_divide(F.col("error"), F.col("v"))).alias("rsq"))
    return scored.agg(F.avg((F.col("said") != F.col("y")).cast("int")).alias("error")).select(trees, "error")


def combined_votes(votes: DataFrame, classes: list[str], cutoff: list[float] | None = None) -> DataFrame:
    """(key, prediction) of a table (key, tree, vote): most votes over the class's cutoff, ties to the first class."""
    cut = cutoff or [1 / len(classes)] * len(classes)
    counts = votes.groupBy("key", "vote").agg(F.count(F.lit(1)).alias("n"))
    weight = F.col("n") / F.get(F.array(*[F.lit(float(c)) for c in cut]), F.col("vote").cast("int"))
    best = counts.groupBy("key").agg(F.max_by("vote", F.struct(weight, -F.col("vote"))).cast("int").alias("v"))
    return best.select("key", F.get(F.array(*[F.lit(c) for c in classes]), F.col("v")).alias("prediction"))


def reduced(forest: Forest, df: DataFrame, key: str, gain: float = 0.001) -> Forest:
    """A forest of trees chosen one by one, each the one that lowers the error most, until no tree lowers it by
    ``gain`` and it is no worse than all trees together. One aggregate per step scores all candidates at once, over
    votes that are written once; of a classification, one row with its count for all that the trees answer alike."""
    votes = _voted(forest, df, key).select("y", "votes")
    if forest.classes is None:
        votes = votes.select("y", F.col("votes").alias("vs"), F.lit(1).alias("n"))
    else:
        votes = votes.groupBy("y", F.col("votes").cast("array<int>").alias("vs")).agg(F.count(F.lit(1)).alias("n"))
    votes = materialise(votes, "votes")
    known = F.sum(F.when(F.col("y").isNotNull(), F.col("n")))
    n, chosen, best = len(forest.trees), [], math.inf

    def errors(sets: list[list[int]]) -> list[float]:
        out = []
        for ts in sets:
            picked = F.array(*[F.get("vs", F.lit(t)) for t in ts])
            if forest.classes is None:
                d = F.aggregate(picked, F.lit(0.0), lambda a, v: a + v) / len(ts) - F.col("y")
                wrong = d * d
            else:
                tally = F.array(*[F.size(F.filter(picked, _equals(c))) for c in range(len(forest.classes))])
                wrong = ((F.array_position(tally, F.array_max(tally)) - 1) != F.col("y")).cast("int")
            out.append(F.try_divide(F.sum(wrong * F.col("n")), known))
        return [float(x) for x in votes.agg(*[e.alias(f"e{i}") for i, e in enumerate(out)]).first()]

    full = errors([list(range(n))])[0]
    while len(chosen) < n:
        rest = [t for t in range(n) if t not in chosen]
        found = errors([[*chosen, t] for t in rest])
        k = int(np.argmin(found))
        if best - found[k] < gain and best <= full:
            break
        chosen.append(rest[k])
        best = found[k]
    release(votes)
    return Forest(forest.features, forest.kinds, forest.levels, forest.response, forest.classes, [forest.trees[t] for t in chosen])


def _equals(c: int):
    return lambda v: v == F.lit(c)


def permutation_importance(model, df: DataFrame, key: str, features: list[str], response: str, classify: bool, n_rows: int = 1000, seed: int = 1) -> DataFrame:
    """(feature, importance): max(0, (error with the column shuffled - error) / error) on a seeded sample of rows.

    ``model.predict(df)`` adds ``prediction``. A column is shuffled by joining its values, ordered by another hash,
    to the rows by rank; the sample's size is the documented bound of these ranks.
    """
    sample = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n_rows)
    rank = lambda s: Window.orderBy(F.xxhash64(F.lit(s), F.col(key)), key)
    rows = sample.withColumn("__rank", F.row_number().over(rank(seed)))
    wrong = F.avg((~F.col("prediction").cast("string").eqNullSafe(F.col(response).cast("string"))).cast("double")) if classify else F.avg(F.pow(F.col("prediction") - F.col(response), F.lit(2)))
    base = model.predict(rows).agg(wrong).first()[0]
    out = []
    for k, f in enumerate(features):
        other = sample.select(F.col(f).alias("__new"), F.row_number().over(rank(seed + 1 + k)).alias("__rank"))
        shuffled = rows.join(other, "__rank").drop(f).withColumnRenamed("__new", f)
        error = model.predict(shuffled).agg(wrong).first()[0]
        out.append((f, max(0.0, (error - base) / base) if base else max(0.0, float(error))))
    return df.sparkSession.createDataFrame(out, "feature string, importance double")
