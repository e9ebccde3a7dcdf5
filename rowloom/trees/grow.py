"""Trees and forests grown level by level from distributed histograms.

Rows are binned once, and rows that are alike in all bins and the response are summed where many are. A level of all trees together is one job: rows in open nodes are exploded by (tree, feature) and
summed by (tree, node, feature, bin), with map-side partial sums; each node's histogram, whose size is set by bins and
features, is searched in a group of its own, and the driver gets one row for each open node. Rows learn their nodes by
a broadcast table of splits. A node of at most ``local_rows`` rows leaves the levels: its rows meet in one group, which
grows the rest of its subtree, so that deep trees cost no job for each of their last levels.

A model's nodes are on the driver, as everywhere; a forest of many nodes predicts by walking them as arrays, broadcast
once and vectorised over Arrow batches, a small one as an expression.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, release
from .formula import variables

N_BINS = 256
#: Rows that finish their subtree in one group, nodes up to which a forest is an expression, bytes of nodes that may be
#: broadcast, and most categories of a column or classes (their labels become part of the plan).
LOCAL_ROWS, EXPRESSION_NODES, MODEL_BYTES, MAX_LABELS = 10_000, 256, 1 << 30, 10_000
#: Rows are summed by their bins and response where that leaves at most one in so many.
ALIKE = 4


@dataclass
class Node:
    """A split (feature, threshold or left-hand categories) or a leaf; ``value`` is what a row that stops here gets."""

    value: float
    n: float
    feature: int = -1
    threshold: float = 0.0
    left_bins: list[int] | None = None
    left: int = -1
    right: int = -1
    gain: float = 0.0


@dataclass
class Forest:
    features: list[str]
    kinds: list[str]  # numeric or categorical
    levels: dict[str, list[str]]
    response: str
    classes: list[str] | None  # labels of a classification
    trees: list[list[Node]] = field(default_factory=list)
    oob: DataFrame | None = None

    # -- use ---------------------------------------------------------------------------------------------------------

    def tree_value(self, k: int) -> Column:
        """Value of tree k as one nested expression over the raw columns; a missing value stops at its node."""
        nodes = self.trees[k]

        def at(i: int) -> Column:
            node = nodes[i]
            if node.feature < 0:
                return F.lit(float(node.value))
            name = self.features[node.feature]
            if node.left_bins is None:
                goes_left = F.col(name).cast("double") < F.lit(float(node.threshold))
            else:
                labels = [self.levels[name][b] for b in node.left_bins]
                goes_left = F.col(name).cast("string").isin(labels)
            stops = F.col(name).isNull() if node.left_bins is not None else F.col(name).isNull() | F.isnan(F.col(name).cast("double"))
            return F.when(stops, F.lit(float(node.value))).when(goes_left, at(node.left)).otherwise(at(node.right))

        return at(0)

    def arrays(self) -> dict[str, np.ndarray]:
        """All trees' nodes as arrays, a tree's root at ``roots``; children are counted from the start of all nodes.

        A categorical node has its row of ``lefts`` at ``left_row``: whether each level goes left."""
        roots = np.cumsum([0, *(len(t) for t in self.trees)])[:-1]
        nodes = [(n, r) for t, r in zip(self.trees, roots) for n in t]
        width = max((len(v) for v in self.levels.values()), default=0) + 1
        lefts, left_row = [np.zeros(width, bool)], np.zeros(len(nodes), np.int32)
        for i, (n, _) in enumerate(nodes):
            if n.feature >= 0 and n.left_bins is not None:
                mask = np.zeros(width, bool)
                mask[n.left_bins] = True
                left_row[i] = len(lefts)
                lefts.append(mask)
        column = lambda f, kind: np.array([f(n, r) for n, r in nodes], kind)
        return {
            "roots": roots, "lefts": np.stack(lefts), "left_row": left_row, "feature": column(lambda n, r: n.feature, np.int32), "threshold": column(lambda n, r: n.threshold, float), "value": column(lambda n, r: n.value, float),
            "left": column(lambda n, r: n.left + r, np.int64), "right": column(lambda n, r: n.right + r, np.int64), "n": column(lambda n, r: n.n, float),
        }

    def inputs(self) -> Column:
        """array<double> of the features: numbers, or 0-based levels (unknown ones past the last); missing is null."""
        out = []
        for c, kind in zip(self.features, self.kinds):
            if kind == "numeric":
                v = F.col(c).cast("double")
                out.append(F.when(~F.isnan(v), v))
            else:
                at = F.array_position(F.array(*[F.lit(x) for x in self.levels[c]]).cast("array<string>"), F.col(c).cast("string")).cast("double")
                out.append(F.when(F.col(c).isNotNull(), F.when(at > 0, at - 1).otherwise(F.lit(float(len(self.levels[c]))))))
        return F.array(*out)

    def with_votes(self, df: DataFrame, name: str = "__votes") -> DataFrame:
        """``df`` with the value of every tree as array<double>."""
        if sum(map(len, self.trees)) <= EXPRESSION_NODES:
            return df.withColumn(name, F.array(*[self.tree_value(k) for k in range(len(self.trees))]))
        model = self.arrays()
        size = sum(v.nbytes for v in model.values())
        if size > MODEL_BYTES:
            raise MemoryError(f"{size} bytes of nodes are too many to broadcast; predict with fewer trees at a time")
        shared = df.sparkSession.sparkContext.broadcast(model)

        def emit(batches):
            for batch in batches:
                x = matrix_of(batch.column("x"))
                votes = np.stack([shared.value["value"][walk(shared.value, x, r)] for r in shared.value["roots"]], axis=1)
                offsets = pa.array(np.arange(0, votes.size + 1, votes.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(votes.ravel()))], ["row", "votes"])

        rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), self.inputs().alias("x"))
        out = rows.mapInArrow(emit, rows.select("row", F.col("x").alias("votes")).schema)
        return out.select("row.*", F.col("votes").alias(name))

    def predict(self, df: DataFrame, cutoff: list[float] | None = None) -> DataFrame:
        """``df`` with ``prediction``: the class with most votes over its cutoff (ties: the first), or the mean."""
        voted = self.with_votes(df)
        if self.classes is None:
            said = F.aggregate("__votes", F.lit(0.0), lambda a, v: a + v) / len(self.trees)
        else:
            said = self._elected(F.col("__votes"), cutoff)
        return voted.withColumn("prediction", said).drop("__votes")

    def _elected(self, votes: Column, cutoff: list[float] | None) -> Column:
        cut = cutoff or [1 / len(self.classes)] * len(self.classes)
        if len(cut) != len(self.classes) or min(cut) <= 0:
            raise ValueError("a positive cutoff for each class")
        won = [F.struct((F.size(F.filter(votes, _is(c))) / F.lit(float(cut[c]))).alias("v"), F.lit(-c).alias("first"), F.lit(label).alias("label")) for c, label in enumerate(self.classes)]
        return (F.array_max(F.array(*won)) if len(won) > 1 else won[0])["label"]

    def importance(self) -> dict[str, float]:
        """Sum of the gains of each feature's splits."""
        total: dict[str, float] = defaultdict(float)
        for tree in self.trees:
            for node in tree:
                if node.feature >= 0:
                    total[self.features[node.feature]] += node.gain
        return dict(total)

    def node_table(self, k: int = 0) -> list[dict]:
        return [{"node": i, "feature": self.features[n.feature] if n.feature >= 0 else "<leaf>", "n": n.n, "value": n.value, "threshold": n.threshold, "left": n.left, "right": n.right, "gain": n.gain} for i, n in enumerate(self.trees[k])]

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "kinds": self.kinds, "levels": self.levels, "response": self.response, "classes": self.classes, "trees": [[vars(n) for n in t] for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        d = json.loads(text)
        d["trees"] = [[Node(**n) for n in t] for t in d["trees"]]
        return cls(**d)

    def joined(self, other: Forest) -> Forest:
        """Both forests' trees; they must describe the same columns and classes."""
        if (self.features, self.levels, self.classes) != (other.features, other.levels, other.classes):
            raise ValueError("forests of different data cannot be joined")
        return Forest(self.features, self.kinds, self.levels, self.response, self.classes, self.trees + other.trees)


def matrix_of(lists: pa.Array) -> np.ndarray:
    """(rows, features) of a list column; missing values are NaN."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(lists), -1)


def walk(model: dict[str, np.ndarray], x: np.ndarray, root: int, missing=None) -> np.ndarray:
    """The node in which each row of ``x`` ends. A missing value stops there, or goes where ``missing(nodes, rows)`` says
    (True: left)."""
    at, going = np.full(len(x), root), np.arange(len(x))
    while len(going):
        node = at[going]
        inner = model["feature"][node] >= 0
        going, node = going[inner], node[inner]
        v = x[going, model["feature"][node]]
        known = ~np.isnan(v)
        if missing is None:
            going, node, v = going[known], node[known], v[known]
        row = model["left_row"][node]
        level = np.clip(np.nan_to_num(v), 0, model["lefts"].shape[1] - 1).astype(int)
        left = np.where(row > 0, model["lefts"][row, level], v < model["threshold"][node])
        if missing is not None and not known.all():
            left = np.where(known, left, missing(node, going))
        at[going] = np.where(left, model["left"][node], model["right"][node])
    return at


def labels_of(rows: DataFrame, column: str) -> list[str]:
    """Sorted labels of a column, which must be few."""
    found = [r[0] for r in rows.select(F.col(column).cast("string").alias("l")).where("l IS NOT NULL").distinct().limit(MAX_LABELS + 1).collect()]
    if len(found) > MAX_LABELS:
        raise ValueError(f"{column} has more than {MAX_LABELS} labels: no category; use a number")
    return sorted(found)


def _is(c: int):
    return lambda v: v == F.lit(float(c))


# -- binning -------------------------------------------------------------------------------------------------------


def feature_ranges(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{k}") for k, c in enumerate(features)], *[F.max(F.col(c).cast("double")).alias(f"hi{k}") for k, c in enumerate(features)]).first()
    return {c: (r[f"lo{k}"], r[f"hi{k}"]) for k, c in enumerate(features)}


def bin_of(c: Column, lo: float, hi: float, n_bins: int = N_BINS) -> Column:
    """Equal-width bin; the largest value falls in the last bin, a constant feature in bin 0."""
    if lo is None or hi is None or hi <= lo:
        return F.when(c.isNotNull(), F.lit(0))
    bin_ = F.floor((c.cast("double") - F.lit(float(lo))) * n_bins / F.lit(float(hi - lo))).cast("int")
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(bin_, F.lit(n_bins - 1))))


def bin_threshold(b: int, lo: float, hi: float, n_bins: int = N_BINS) -> float:
    """Raw value at which bin ``b`` begins, so that raw and binned rows part alike."""
    return lo + b * (hi - lo) / n_bins


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a uniform number."""
    p, total, cuts = np.exp(-1.0), 0.0, []
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(u >= F.lit(float(c)), 1).otherwise(0)
    return out


def uniform(*parts) -> Column:
    """A uniform number from a hash of a seed and keys."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


# -- split search --------------------------------------------------------------------------------------------------


def best_split(hist: np.ndarray, kind: str, classify: bool, min_count: float, cp: float) -> tuple[float, float, list[int], bool] | None:
    """(gain, bin, left-hand bins, ordered) of one node and feature.

    ``hist``: (bins, 3) of weight, weighted sum and weighted squares, or (bins, classes) of weights. The gain must
    exceed ``cp`` times the node's impurity; a classification also needs 1 % of the node's weight on either side.
    """
    weight = hist.sum(axis=1) if classify else hist[:, 0]
    seen = np.flatnonzero(weight > 0)
    if len(seen) < 2:
        return None
    if kind == "categorical":
        if classify:
            top = int(hist.sum(axis=0).argmax())
            mean = hist[seen, top] / weight[seen]
        else:
            mean = hist[seen, 1] / weight[seen]
        seen = seen[np.argsort(mean, kind="stable")]
    left = np.cumsum(hist[seen], axis=0)[:-1]
    whole = hist[seen].sum(axis=0)
    right = whole - left
    if classify:
        nl, nr = left.sum(axis=1), right.sum(axis=1)
        total = nl + nr
        impurity = whole.sum() - (whole**2).sum() / whole.sum()
        after = nl - (left**2).sum(axis=1) / nl + nr - (right**2).sum(axis=1) / nr
        fits = (nl >= min_count) & (nr >= min_count) & (nl > 0.01 * total) & (nr > 0.01 * total)
    else:
        nl, nr = left[:, 0], right[:, 0]
        impurity = whole[2] - whole[1] ** 2 / whole[0]
        after = left[:, 2] - left[:, 1] ** 2 / nl + right[:, 2] - right[:, 1] ** 2 / nr
        fits = (nl >= min_count) & (nr >= min_count)
    gain = np.where(fits, impurity - after, -np.inf)
    k = int(gain.argmax())
    if not np.isfinite(gain[k]) or gain[k] <= max(cp * impurity, 1e-12 * max(1.0, abs(impurity))):
        return None
    return float(gain[k]), int(seen[k + 1]), sorted(int(b) for b in seen[: k + 1]), kind != "categorical"


# -- growing -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Growth:
    n_trees: int = 1
    mtry: int | None = None
    min_split: int = 20
    min_leaf: int = 7
    max_depth: int = 30
    max_nodes: int | None = None
    cp: float = 0.0
    n_bins: int = N_BINS
    bootstrap: str = "none"  # none, poisson, or subsample (63.2 % without replacement)
    seed: int = 1
    local_rows: int = LOCAL_ROWS


def grow(df: DataFrame, formula: str, key: str, growth: Growth, weight: str | None = None, na_action: str = "omit") -> Forest:
    """Grow ``growth.n_trees`` trees over ``df``; ``key`` names its rows (for seeded draws)."""
    response, features = variables(formula, [c for c in df.columns if c not in (key, weight)])
    if response is None:
        raise ValueError("a response is needed")
    kinds_of = dict(df.dtypes)
    text = lambda c: kinds_of[c] in ("string", "boolean")
    kinds = ["categorical" if text(c) else "numeric" for c in features]
    used = [response, *features]
    bad = F.lit(False)
    for c in used:
        bad = bad | F.col(c).isNull() | (F.lit(False) if text(c) else F.isnan(F.col(c).cast("double")))
    if na_action == "fail" and not df.where(bad).isEmpty():
        raise ValueError("missing values")
    rows = df.where(~bad) if na_action in ("omit", "exclude") else df.where(F.col(response).isNotNull())
    classes = labels_of(rows, response) if text(response) else None
    levels = {c: labels_of(rows, c) for c, k in zip(features, kinds) if k == "categorical"}
    numeric = [c for c, k in zip(features, kinds) if k == "numeric"]
    ranges = feature_ranges(rows, numeric) if numeric else {}

    def binned(c: str, kind: str) -> Column:
        if kind == "numeric":
            return bin_of(F.col(c), *ranges[c], growth.n_bins)
        return (F.array_position(F.array(*[F.lit(x) for x in levels[c]]), F.col(c).cast("string")) - 1).cast("int")

    y = (F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(response).cast("string")) - 1).cast("double") if classes else F.col(response).cast("double")
    base = rows.select(F.col(key).alias("key"), F.array(*[binned(c, k) for c, k in zip(features, kinds)]).alias("bins"), y.alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w0"))
    u = uniform(F.lit(growth.seed), F.col("tree"), F.col("key"))
    draw = {"none": F.lit(1), "poisson": poisson_weight(u), "subsample": (u < 0.632).cast("int")}[growth.bootstrap]
    # Every row goes to every tree that drew it: trees times rows, spread over all tasks.
    drawn = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(growth.n_trees - 1))).alias("tree")).withColumn("w", F.col("w0") * draw).where("w > 0")
    # Rows of a tree with equal bins and response go the same way: where many do, one row has the weight of all.
    seen = base.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct("bins", "y")).alias("kinds")).first()
    if seen["n"] >= ALIKE * seen["kinds"]:
        drawn = drawn.groupBy("tree", "bins", "y").agg(F.sum("w").alias("w"))
    state = materialise(drawn.select("tree", "bins", "y", "w", F.lit(0).alias("node")), "tree-rows")
    forest = Forest(features, kinds, levels, response, classes)
    trees: list[list[Node]] = [[Node(0.0, 0.0)] for _ in range(growth.n_trees)]
    p, mtry = len(features), growth.mtry or len(features)
    if not 1 <= mtry <= p:
        raise ValueError("mtry must lie between 1 and the number of features")
    classify = classes is not None
    measures = [F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)).alias(f"m{c}") for c in range(len(classes))] if classify else [F.sum("w").alias("m0"), F.sum(F.col("w") * F.col("y")).alias("m1"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("m2")]
    names = [f"m{k}" for k in range(len(measures))]
    sizes = [growth.n_bins if k == "numeric" else len(levels[c]) for c, k in zip(features, kinds)]

    def choose(hists, n: float, *draw: int) -> dict:
        """The best split of a node over ``mtry`` features drawn by a seeded generator; ``hists(f)`` sums feature f."""
        out = {"f": -1, "gain": 0.0, "cut": -1, "lefts": []}
        if n >= growth.min_split:
            for f in sorted(np.random.default_rng([growth.seed, *draw]).choice(p, mtry, replace=False)):
                found = best_split(hists(f), kinds[f], classify, growth.min_leaf, growth.cp)
                if found and found[0] >= out["gain"]:  # equal gains: the later feature
                    out |= {"f": int(f), "gain": found[0], "cut": found[1] if found[3] else -1, "lefts": [] if found[3] else found[2]}
        return out

    def stands_for(sums: np.ndarray) -> tuple[float, float]:
        """(value, weight) of a node with these sums."""
        return (float(sums.argmax()), float(sums.sum())) if classify else (float(sums[1] / sums[0]), float(sums[0]))

    def search(key_: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        """The node's value and weight, and its best split."""
        tree, node = int(key_[0]), int(key_[1])
        value, n = stands_for(rows_[rows_["feature"] == 0][names].to_numpy(float).sum(axis=0))

        def hists(f: int) -> np.ndarray:
            own = rows_[(rows_["feature"] == f) & rows_["bin"].notna()]
            hist = np.zeros((sizes[f], len(names)))
            hist[own["bin"].to_numpy(int)] = own[names].to_numpy(float)
            return hist

        return pd.DataFrame([{"tree": tree, "node": node, "value": value, "n": n} | choose(hists, n, tree, node)])

    def finish(key_: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        """The whole subtree of a small node: entries numbered by ``at``, 0 for the node itself, children by l and r."""
        tree, node, depth = (int(k) for k in key_)
        bins = np.array(rows_["bins"].tolist(), float)
        y, w = rows_["y"].to_numpy(), rows_["w"].to_numpy(float)
        each = np.where(y[:, None] == np.arange(len(names)), w[:, None], 0.0) if classify else np.stack([w, w * y, w * y * y], axis=1)
        out, stack = [], [(np.arange(len(y)), depth, 0)]
        n_nodes = 1
        while stack:
            own, level, at = stack.pop()
            value, n = stands_for(each[own].sum(axis=0))

            def hists(f: int, own=own) -> np.ndarray:
                hist = np.zeros((sizes[f], len(names)))
                there = own[~np.isnan(bins[own, f])]
                np.add.at(hist, bins[there, f].astype(int), each[there])
                return hist

            found = choose(hists, n, tree, node, at) if level < growth.max_depth else {"f": -1, "gain": 0.0, "cut": -1, "lefts": []}
            entry = {"tree": tree, "node": node, "at": at, "value": value, "n": n, "l": -1, "r": -1} | found
            if found["f"] >= 0:
                b = bins[own, found["f"]]
                left = b < found["cut"] if found["cut"] >= 0 else np.isin(b, found["lefts"])
                entry |= {"l": n_nodes, "r": n_nodes + 1}
                stack += [(own[left], level + 1, n_nodes), (own[~left & ~np.isnan(b)], level + 1, n_nodes + 1)]
                n_nodes += 2
            out.append(entry)
        return pd.DataFrame(out)

    schema = "tree int, node int, value double, n double, f int, gain double, cut int, lefts array<int>"
    n_splits = [0] * growth.n_trees
    local = growth.local_rows if weight is None and not growth.max_nodes else 0  # weights of 1 and more: no fewer than rows
    put_off: list[DataFrame] = []

    def split_into(tree: list[Node], node: Node, f: int, cut: int, lefts: list[int], l_: int, r_: int) -> None:
        node.feature, node.left, node.right = f, l_, r_
        if cut >= 0:
            node.threshold = bin_threshold(cut, *ranges[features[f]], growth.n_bins)
        else:
            node.left_bins = list(lefts)

    for depth in range(growth.max_depth + 1):
        feats = F.posexplode("bins").alias("feature", "bin")
        hist = state.select("tree", "node", "y", "w", feats).groupBy("tree", "node", "feature", "bin").agg(*measures)
        splits, small = [], []
        for r in sorted(hist.groupBy("tree", "node").applyInPandas(search, schema).collect(), key=lambda r: (r["tree"], -r["n"], r["node"])):
            t, i = r["tree"], r["node"]
            node = trees[t][i]
            node.value, node.n = r["value"], r["n"]
            if r["f"] < 0 or depth == growth.max_depth or (growth.max_nodes and n_splits[t] >= (growth.max_nodes - 1) // 2):
                continue
            if r["n"] <= local:
                small.append((t, i))
                continue
            node.gain = r["gain"]
            split_into(trees[t], node, r["f"], r["cut"], r["lefts"], len(trees[t]), len(trees[t]) + 1)
            trees[t] += [Node(node.value, 0.0), Node(node.value, 0.0)]
            n_splits[t] += 1
            splits.append((t, i, r["f"], r["cut"], list(r["lefts"]), node.left, node.right))
        if small:
            table = F.broadcast(df.sparkSession.createDataFrame(small, "tree int, node int"))
            put_off.append(materialise(state.join(table, ["tree", "node"]).withColumn("depth", F.lit(depth)), "small-nodes"))
        if not splits:
            break
        # One row for each open node, made here: it goes to all tasks, so that no node's rows meet in one.
        table = F.broadcast(df.sparkSession.createDataFrame(splits, "tree int, node int, f int, cut int, lefts array<int>, l int, r int"))
        moved = state.join(table, ["tree", "node"])  # rows of closed nodes leave
        b = F.get("bins", F.col("f"))
        goes_left = F.when(F.col("cut") >= 0, b < F.col("cut")).otherwise(F.array_contains("lefts", b))
        moved = moved.where(b.isNotNull()).select("tree", "bins", "y", "w", F.when(goes_left, F.col("l")).otherwise(F.col("r")).alias("node"))
        after = materialise(moved, "tree-rows")
        release(state)
        state = after
    if put_off:
        rest = put_off[0]
        for more in put_off[1:]:
            rest = rest.unionByName(more)
        entries: dict[tuple[int, int], dict[int, object]] = defaultdict(dict)
        for r in rest.groupBy("tree", "node", "depth").applyInPandas(finish, "tree int, node int, at int, value double, n double, f int, gain double, cut int, lefts array<int>, l int, r int").collect():
            entries[r["tree"], r["node"]][r["at"]] = r
        for (t, i), subtree in sorted(entries.items()):
            tree, base_at = trees[t], len(trees[t]) - 1
            place = lambda at: i if at == 0 else base_at + at  # noqa: B023, E731
            tree += [Node(0.0, 0.0) for _ in range(len(subtree) - 1)]
            for at, r in subtree.items():
                node = tree[place(at)]
                node.value, node.n, node.gain = r["value"], r["n"], r["gain"]
                if r["f"] >= 0:
                    split_into(tree, node, r["f"], r["cut"], r["lefts"], place(r["l"]), place(r["r"]))
        for table in put_off:
            release(table)
    release(state)
    forest.trees = [_merged(t) for t in trees]
    return forest


def _merged(tree: list[Node]) -> list[Node]:
    """Sibling leaves with one prediction become their parent's leaf; unused nodes leave."""
    for i in range(len(tree) - 1, -1, -1):
        n = tree[i]
        if n.feature >= 0:
            a, b = tree[n.left], tree[n.right]
            if a.feature < 0 and b.feature < 0 and a.value == b.value:
                n.feature, n.left, n.right, n.gain, n.left_bins = -1, -1, -1, 0.0, None
    out: list[Node] = []

    def copy(i: int) -> int:
        n = tree[i]
        at = len(out)
        out.append(Node(**vars(n)))
        if n.feature >= 0:
            out[at].left = copy(n.left)
            out[at].right = copy(n.right)
        return at

    copy(0)
    return out
