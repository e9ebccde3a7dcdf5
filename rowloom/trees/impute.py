"""Missing values filled from rows that end in the same leaf of a forest.

A row goes down a tree drawn for it; where its value is missing it goes left or right by chance, in the shares of the
training weight. In the leaf where it ends a donor is drawn, and its values take the place of the missing ones (or of
all features). Draws are hashes of a seed and the row's key, the same on every cluster.

A leaf keeps at most ``DONORS`` donors: its rows are dealt into so many lots by a hash, and the one of smallest hash in
each lot stays, which is a random sample of the leaf and one aggregate with partial results. The donors' table is as
large as the model, not as the data. Rows without a missing feature stay as they are; a leaf without donors leaves the
row as it is; a null key is a key like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grow import Forest, matrix_of, uniform, walk

DONORS = 32


def leaves(forest: Forest, df: DataFrame, key: str, tree, seed: int) -> DataFrame:
    """``df`` with ``tree`` (a column expression: which tree to go down) and ``leaf``, the node it ends in."""
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays())

    def emit(batches):
        for batch in batches:
            model, x = shared.value, matrix_of(batch.column("x"))
            trees, draws = batch.column("tree").to_numpy(), batch.column("draw").to_numpy()
            leaf = np.zeros(len(x), np.int64)
            for t in np.unique(trees):
                own = np.flatnonzero(trees == t)

                def by_share(node: np.ndarray, rows: np.ndarray, own=own) -> np.ndarray:
                    left, right = model["n"][model["left"][node]], model["n"][model["right"][node]]
                    # A number of its own for each row and node, from the row's draw.
                    u = np.modf((draws[own[rows]] + 1) * (node + 1) * 0.6180339887498949)[0]
                    return u * (left + right) < left

                leaf[own] = walk(model, x[own], model["roots"][t], by_share)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("tree"), pa.array(leaf)], ["row", "tree", "leaf"])

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), forest.inputs().alias("x"), tree.alias("tree"), (uniform(F.lit(seed), F.lit("way"), F.col(key)) * 1000).alias("draw"))
    out = rows.mapInArrow(emit, rows.select("row", "tree", F.lit(0).cast("long").alias("leaf")).schema)
    return out.select("row.*", "tree", "leaf")


def donors(forest: Forest, df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """(tree, leaf, rows): up to ``DONORS`` rows without missing features of each leaf of each tree."""
    complete = df.select(key, *forest.features)
    for c in forest.features:
        complete = complete.where(F.col(c).isNotNull())
    n = len(forest.trees)
    every = complete.withColumn("__tree", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = leaves(forest, every, key, F.col("__tree"), seed).drop("__tree")
    order = F.xxhash64(F.lit(seed), F.col("tree"), F.col(key))
    lots = placed.groupBy("tree", "leaf", F.pmod(order, F.lit(DONORS)).alias("lot")).agg(F.min_by(F.struct(*[F.col(c) for c in forest.features]), F.struct(order, F.col(key))).alias("donor"))
    return lots.groupBy("tree", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("lot", "donor"))), lambda s: s["donor"]).alias("rows"))


def imputed(forest: Forest, df: DataFrame, known: DataFrame, key: str, seed: int = 1, everything: bool = False) -> DataFrame:
    """``df`` with missing features filled from ``known``; with ``everything`` all features of such a row are the donor's."""
    missing = F.lit(False)
    for c in forest.features:
        missing = missing | F.col(c).isNull()
    tree = F.least(F.floor(uniform(F.lit(seed), F.lit("tree"), F.col(key)) * len(forest.trees)), F.lit(len(forest.trees) - 1)).cast("int")
    asked = leaves(forest, df.where(missing), key, tree, seed)
    found = donors(forest, known, key, seed).select(F.col("tree").alias("__t"), F.col("leaf").alias("__l"), "rows")
    drawn = F.floor(uniform(F.lit(seed), F.lit("donor"), F.col(key)) * F.size("rows")).cast("int")
    met = asked.join(found, (F.col("tree") == F.col("__t")) & (F.col("leaf") == F.col("__l")), "left").withColumn("__donor", F.get("rows", drawn))
    donor = lambda c: F.col("__donor")[c]
    filled = [(F.coalesce(donor(c), F.col(c)) if everything else F.coalesce(F.col(c), donor(c))).alias(c) if c in forest.features else F.col(c) for c in df.columns]
    return df.where(~missing).unionByName(met.select(*filled))
