"""An ensemble of gradient-boosted trees: each output partition of a sample fits its own, in its own group.

The sample bounds what a group holds: ``sample_rows`` rows of each part, drawn with replacement. Parts are fitted in
parallel by a grouped map and combined by mean (gaussian), median probability (two classes) or majority (more).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Grid, with_row_id
from ..operators.sampling import sampled

DISTRIBUTIONS = ("gaussian", "bernoulli", "adaboost", "multinomial")
LEAST_ITERATIONS = 50
#: Most rows of a part: they meet in one group.
PART_ROWS = 1_000_000


def _tree(x: np.ndarray, r: np.ndarray, depth: int, min_leaf: int) -> list:
    """Best-first tree with ``depth`` splits on residuals: [feature, threshold, left, right] or leaf row masks."""
    leaves = [(np.arange(len(r)), None)]
    nodes: list = [None]
    where = [0]

    def best(rows: np.ndarray):
        top = (1e-12, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, s = x[order, f], np.cumsum(r[order])
            n = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (n >= min_leaf) & (len(order) - n >= min_leaf)
            if not ok.any():
                continue
            gain = np.where(ok, s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(order) - n) - s[-1] ** 2 / len(order), -1)
            k = int(gain.argmax())
            if gain[k] > top[0]:
                top = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        return top

    found = [best(leaves[0][0])]
    for _ in range(depth):
        k = int(np.argmax([g[0] for g in found]))
        gain, f, cut = found[k]
        if f < 0:
            break
        rows, at = leaves[k][0], where[k]
        left = x[rows, f] < cut
        nodes[at] = [f, cut, len(nodes), len(nodes) + 1]
        for part in (rows[left], rows[~left]):
            leaves.append((part, None))
            where.append(len(nodes))
            nodes.append(None)
            found.append(best(part))
        for xs in (leaves, where, found):
            xs.pop(k)
    return [nodes, [(w, rows) for w, (rows, _) in zip(where, leaves)]]


def _value(nodes: list, x: np.ndarray) -> np.ndarray:
    out, stack = np.zeros(len(x)), [(0, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        node = nodes[at]
        if isinstance(node, float):
            out[rows] = node
        elif len(rows):
            f, cut, a, b = node
            left = x[rows, f] < cut
            stack += [(a, rows[left]), (b, rows[~left])]
    return out


def _negative_gradient(kind: str, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(residuals, curvature for the leaf step, mean loss)."""
    if kind == "gaussian":
        return y - score, np.ones_like(y), float(((y - score) ** 2).mean())
    if kind == "bernoulli":
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p), float((np.logaddexp(0, score) - y * score).mean())
    s = 2 * y - 1
    e = np.exp(-s * score)
    return s * e, e, float(e.mean())


def boost(x: np.ndarray, y: np.ndarray, kind: str, n_trees: int, depth: int, min_leaf: int, shrinkage: float, bag: float, seed: int) -> dict:
    """One boosted model: start value, trees and the iteration that the out-of-bag improvement favours (at least 50)."""
    rng = np.random.default_rng(seed)
    mean = y.mean()
    start = {"gaussian": mean, "bernoulli": np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)), "adaboost": 0.5 * np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))}[kind]
    score, trees, gains = np.full(len(y), float(start)), [], []
    for _ in range(n_trees):
        inside = rng.permutation(len(y))[: max(2 * min_leaf + 1, int(bag * len(y)))]
        outside = np.setdiff1d(np.arange(len(y)), inside)
        r, h, _ = _negative_gradient(kind, y, score)
        nodes, leaves = _tree(x[inside], r[inside], depth, min_leaf)
        for at, rows in leaves:
            rr = inside[rows]
            nodes[at] = float(shrinkage * r[rr].sum() / max(h[rr].sum(), 1e-9))
        before = _negative_gradient(kind, y[outside], score[outside])[2] if len(outside) else 0.0
        score = score + _value(nodes, x)
        gains.append(before - _negative_gradient(kind, y[outside], score[outside])[2] if len(outside) else 0.0)
        trees.append(nodes)
    best = int(np.cumsum(gains).argmax()) + 1
    return {"start": float(start), "trees": trees, "best": min(n_trees, max(LEAST_ITERATIONS, best))}


def score(model: dict, x: np.ndarray, n_trees: int | None = None) -> np.ndarray:
    out = np.full(len(x), model["start"])
    for nodes in model["trees"][: n_trees or model["best"]]:
        out += _value(nodes, x)
    return out


@dataclass
class BoostedEnsemble:
    distribution: str
    features: list[str]
    classes: list | None
    models: list[list[dict]]  # for each part one model, or one for each class

    def scores(self, df: DataFrame, key: str) -> DataFrame:
        """(key, part, value, label): each part's mean or probability, or its winning class."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def each(batches):
            m = shared.value
            for pdf in batches:
                x = pdf[m.features].to_numpy(float)
                for part, models in enumerate(m.models):
                    raw = np.stack([score(one, x) for one in models], axis=1)
                    label = raw.argmax(axis=1) if m.distribution == "multinomial" else np.zeros(len(x), int)
                    scale = 2 if m.distribution == "adaboost" else 1
                    value = raw[:, 0] if m.distribution in ("gaussian", "multinomial") else 1 / (1 + np.exp(-scale * raw[:, 0]))
                    yield pd.DataFrame({"key": pdf[key], "part": part, "value": value, "label": label})

        return df.select(key, *self.features).mapInPandas(each, f"key {dict(df.dtypes)[key]}, part int, value double, label int")

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, prediction) with the names of the training features."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        said = combine(self.scores(df, key), self.distribution)
        if self.distribution == "gaussian":
            return said
        labels = F.array(*[F.lit(str(c)) for c in self.classes])
        k = F.col("prediction").cast("int") if self.distribution == "multinomial" else (F.col("prediction") > 0.5).cast("int")
        return said.select("key", F.col("prediction").alias("score"), F.get(labels, k).alias("prediction"))

    def to_json(self) -> str:
        return json.dumps(vars(self))


def combine(scores: DataFrame, distribution: str) -> DataFrame:
    """(key, prediction) from (key, part, value, label)."""
    if distribution == "gaussian":
        return scores.groupBy("key").agg(F.avg("value").alias("prediction"))
    if distribution in ("bernoulli", "adaboost"):
        return scores.groupBy("key").agg(F.median("value").alias("prediction"))
    counts = scores.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("key").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))


def fit_boosted(df: DataFrame, features: list[str], response: str, key: str, distribution: str = "gaussian", parts: int = 4, n_trees: int = 500, depth: int = 1, min_leaf: int = 10, shrinkage: float = 0.05, bag: float = 0.5, sample: bool = True, sample_thresh: int = 100, seed: int = 1) -> BoostedEnsemble:
    """Fit ``parts`` models on samples of ratio min(0.9, thresh * classes * features / n); without sampling every
    part gets each row once, spread by hash."""
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"distribution must be one of {DISTRIBUTIONS}")
    rows = with_row_id(df.select(key, *features, F.col(response).alias("__y")), [key])
    classes = None if distribution == "gaussian" else [r[0] for r in rows.select("__y").distinct().orderBy("__y").collect()]
    if distribution in ("bernoulli", "adaboost") and len(classes) != 2:
        raise ValueError("two classes are needed")
    n = rows.count()
    if not sample and n > parts * PART_ROWS:
        raise ValueError(f"{n} rows are more than {parts} parts of {PART_ROWS}; use more parts or a sample")
    label = F.col("__y").cast("double") if classes is None else F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("__y")).cast("double") - 1
    used = rows.select("row_id", *[F.col(c).cast("double").alias(c) for c in features], label.alias("__t"))
    if sample:
        ratio = min(0.9, sample_thresh * max(1, len(classes or [1])) * len(features) / max(1, n))
        drawn = sampled(used, Grid.of(n, 1, npartitions=parts), parts, ratio, seed)
    else:
        drawn = used.withColumn("pid", F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(parts)) + 1).withColumn("pos", F.col("row_id"))

    def fit(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "row_id"])
        x, y, s = pdf[features].to_numpy(float), pdf["__t"].to_numpy(float), seed + int(key_[0])
        if classes is not None and len(np.unique(y)) < len(classes):
            raise ValueError("a sample lacks a class; raise sample_thresh")
        run = lambda t, kind: boost(x, t, kind, n_trees, depth, min_leaf, shrinkage, bag, s)
        models = [run((y == c).astype(float), "bernoulli") for c in range(len(classes))] if distribution == "multinomial" else [run(y, distribution)]
        return pd.DataFrame({"pid": [int(key_[0])], "model": [json.dumps(models)]})

    found = drawn.groupBy("pid").applyInPandas(fit, "pid long, model string").orderBy("pid").collect()
    return BoostedEnsemble(distribution, features, classes, [json.loads(r["model"]) for r in found])
