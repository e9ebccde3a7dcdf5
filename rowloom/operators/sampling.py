"""Sampling with replacement into aligned output partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Grid


def sampled(df: DataFrame, grid: Grid, n_out: int, ratio: float, seed: int = 0) -> DataFrame:
    """(pid, pos, source row_id and its columns): every output partition draws ceil(size * ratio) rows, with
    replacement, from each input block, so that all output partitions have one size. ``ratio`` may exceed 1.

    ``df`` has row_id and whatever columns are to stay aligned. Draws are hashes of (seed, output, block, draw), so a
    seed gives the same rows on any cluster; the drawn ids are joined to the rows.
    """
    if n_out < 1 or ratio <= 0:
        raise ValueError("a positive number of partitions and a positive ratio are needed")
    spark = df.sparkSession
    blocks = grid.sizes(spark).where("n_rows > 0 AND col_offset = 0").select(F.col("pid").alias("block"), "n_rows", "row_offset")
    blocks = blocks.withColumn("draws", F.ceil(F.col("n_rows") * F.lit(float(ratio))))
    outs = blocks.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_out).cast("long"))).alias("pid"))
    draws = outs.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "draws")).alias("draw"))
    pick = F.pmod(F.xxhash64(F.lit(seed), "pid", "block", "draw"), F.col("n_rows"))
    chosen = draws.select("pid", F.xxhash64(F.lit(seed + 1), "pid", "block", "draw").alias("pos"), (F.col("row_offset") + pick).alias("row_id"))
    return chosen.join(df, "row_id").select("pid", "pos", "row_id", *[c for c in df.columns if c != "row_id"])


def sample_sizes(sample: DataFrame) -> DataFrame:
    return sample.groupBy("pid").agg(F.count(F.lit(1)).alias("n_rows"))
