"""Error measures of predictions. Observed and predicted values stand in one frame, or are joined on row_id first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.na import cleaned, guarded


def aligned(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """(row_id, observed, predicted) of two frames (row_id, value); different row counts are an error."""
    a, b = observed.select("row_id", F.col("value").alias("observed")), predicted.select("row_id", F.col("value").alias("predicted"))
    if a.count() != b.count():
        raise ValueError("observed and predicted have different numbers of rows")
    return a.join(b, "row_id")


def confusion_matrix(pairs: DataFrame, check: bool = True) -> DataFrame:
    """(observed, predicted, n) over the observed levels, empty cells included."""
    counts = pairs.groupBy("observed", "predicted").agg(F.count(F.lit(1)).alias("n"))
    levels = pairs.select(F.col("observed").alias("level")).where("level IS NOT NULL").distinct()
    if check and not counts.select("predicted").distinct().join(levels, F.col("predicted") == F.col("level"), "left_anti").where("predicted IS NOT NULL").isEmpty():
        raise ValueError("a predicted label was never observed")
    every = levels.agg(F.array_sort(F.collect_set("level")).alias("ls"))  # one row: the levels of a factor
    grid = every.select(F.explode("ls").alias("observed"), "ls").select("observed", F.explode("ls").alias("predicted"))
    return grid.join(counts, ["observed", "predicted"], "left").select("observed", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def error_rate(pairs: DataFrame) -> DataFrame:
    """(class, error): share of wrong predictions of each class, and overall under the name 'all'."""
    wrong = F.avg(F.when(F.col("observed").eqNullSafe(F.col("predicted")), 0.0).otherwise(1.0))
    return pairs.groupBy(F.col("observed").cast("string").alias("class")).agg(wrong.alias("error")).unionByName(pairs.agg(wrong.alias("error")).select(F.lit("all").alias("class"), "error"))


def mean_squared(pairs: DataFrame, na_rm: bool = False) -> DataFrame:
    """One row (value)."""
    d = cleaned(F.col("observed")) - cleaned(F.col("predicted"))
    return pairs.agg(guarded(F.avg(d * d), d, na_rm).alias("value"))


def r_squared(pairs: DataFrame, na_rm: bool = False) -> DataFrame:
    """1 - mean squared error / sample variance: n below the errors, n - 1 below the variance."""
    y, p = cleaned(F.col("observed")), cleaned(F.col("predicted"))
    rows = pairs.select(y.alias("y"), (y - p).alias("d"))
    rows = rows.where("d IS NOT NULL") if na_rm else rows
    return rows.agg(guarded(1 - F.try_divide(F.avg(F.col("d") * F.col("d")), F.var_samp("y")), F.col("d"), na_rm).alias("value"))
