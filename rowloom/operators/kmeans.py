"""k-means by Lloyd's steps: assignment is an expression against literal centers, an update is one small aggregate."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.na import all_finite
from .array import DistArray


@dataclass
class KMeansModel:
    centers: np.ndarray
    sizes: np.ndarray
    withinss: np.ndarray
    totss: float | None
    iterations: int
    columns: list[str]
    labels: DataFrame | None = None

    @property
    def tot_withinss(self) -> float:
        return float(self.withinss.sum())

    @property
    def betweenss(self) -> float | None:
        return None if self.totss is None else self.totss - self.tot_withinss

    def predict(self, df: DataFrame) -> DataFrame:
        return apply_centers(df, self.columns, self.centers)

    def fitted(self, df: DataFrame, kind: str = "centers") -> DataFrame:
        """``df`` with the center of each row's cluster as ``fitted`` (array), or with its number as ``cluster``."""
        if kind not in ("centers", "classes"):
            raise ValueError("kind must be centers or classes")
        said = self.predict(df)
        if kind == "classes":
            return said
        table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in self.centers])
        return said.withColumn("fitted", F.get(table, F.col("cluster") - 1)).drop("cluster")

    def __str__(self) -> str:
        lines = [f"k-means, {len(self.sizes)} clusters of sizes {', '.join(str(int(n)) for n in self.sizes)}"]
        lines += [f"{k + 1:>4} " + " ".join(f"{v:12.5g}" for v in c) for k, c in enumerate(self.centers)]
        return "\n".join([*lines, f"within squares {self.tot_withinss:.6g}" + ("" if self.totss is None else f" of {self.totss:.6g}")])

    def to_dict(self) -> dict:
        """What is deployed: centers and sizes, no distributed members."""
        return {"kind": "kmeans", "columns": self.columns, "centers": self.centers.tolist(), "sizes": self.sizes.tolist()}


def _distances(columns: list[str], centers: np.ndarray) -> list[Column]:
    if len(columns) > 16:  # one loop over an array: nested sums of many terms take minutes to compile
        values = F.array(*columns)
        square = lambda a, b: (a - b) * (a - b)
        return [F.aggregate(F.zip_with(values, F.array(*[F.lit(float(x)) for x in center]), square), F.lit(0.0), lambda s, x: s + x) for center in centers]
    out = []
    for center in centers:
        d = F.lit(0.0)
        for c, x in zip(columns, center):
            d = d + (F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x)))
        out.append(d)
    return out


def nearest(columns: list[str], centers: np.ndarray) -> Column:
    """struct(d, k): squared distance and 1-based number of the nearest center; ties go to the lowest number."""
    each = [F.struct(d.alias("d"), F.lit(k + 1).alias("k")) for k, d in enumerate(_distances(columns, centers))]
    return F.array_min(F.array(*each)) if len(each) > 1 else each[0]


def apply_centers(df: DataFrame, columns: list[str], centers: np.ndarray) -> DataFrame:
    """``df`` with ``cluster``; rows with a missing or infinite value get null."""
    if centers.shape[1] != len(columns):
        raise ValueError("centers and columns differ in number")
    good = all_finite([F.col(c) for c in columns])
    return df.withColumn("cluster", F.when(good, nearest(columns, centers)["k"]))


def pick_centers(rows: DataFrame, columns: list[str], k: int, seed: int) -> np.ndarray:
    """k different rows in the order of a seeded hash: a distributed top-k, no sort of the table."""
    order = F.xxhash64(F.lit(seed), *columns)
    different = rows.select(*columns).groupBy(*columns).agg(F.first(F.lit(1)).alias("one"))
    picked = different.orderBy(order, *columns).limit(k).select(*columns).collect()
    if len(picked) < k:
        raise ValueError(f"fewer than {k} different rows")
    return np.array([list(r) for r in picked], float)


def _step(rows: DataFrame, columns: list[str], centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, sums, within-cluster squares) of the assignment to ``centers``."""
    near = rows.select(nearest(columns, centers).alias("n"), *columns).select(F.col("n.k").alias("k"), F.col("n.d").alias("d"), *columns)
    got = near.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).collect()
    sizes, sums, within = np.zeros(len(centers)), np.zeros(centers.shape), np.zeros(len(centers))
    for r in got:
        sizes[r["k"] - 1], within[r["k"] - 1] = r["n"], r["d"]
        sums[r["k"] - 1] = [r[f"s{i}"] for i in range(len(columns))]
    return sizes, sums, within


def _lloyd(rows: DataFrame, columns: list[str], centers: np.ndarray, iter_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    for it in range(1, iter_max + 1):
        sizes, sums, within = _step(rows, columns, centers)
        new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
        if np.array_equal(new, centers):
            return centers, sizes, within, it
        centers = new
    warnings.warn(f"k-means did not settle in {iter_max} iterations", stacklevel=3)
    sizes, _, within = _step(rows, columns, centers)
    return centers, sizes, within, iter_max


def fit_kmeans(x: DistArray | DataFrame, centers, columns: list[str] | None = None, iter_max: int = 10, nstart: int = 1, na_action: str = "exclude", seed: int = 1, complete: bool = True) -> KMeansModel:
    """``centers``: a matrix, or how many to pick. Several starts count only with picked centers and ``complete``."""
    df, columns = (x.to_rows().df, x.columns) if isinstance(x, DistArray) else (x, columns)
    good = all_finite([F.col(c) for c in columns])
    if na_action == "fail" and not df.where(~good).isEmpty():
        raise ValueError("missing values")
    rows = df.where(good).select(*[c for c in df.columns if c not in columns], *[F.col(c).cast("double").alias(c) for c in columns])
    given = not isinstance(centers, int)
    best = None
    for s in range(1 if given or not complete else max(1, nstart)):
        start = np.asarray(centers, float) if given else pick_centers(rows, columns, centers, seed + s)
        run = _lloyd(rows, columns, start, iter_max)
        if best is None or run[2].sum() < best[2].sum():
            best = run
    total = None
    if complete:
        spread = rows.agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in columns]).first()
        total = float(sum(spread))
    return KMeansModel(best[0], best[1], best[2], total, best[3], columns, apply_centers(df, columns, best[0]) if complete else None)
