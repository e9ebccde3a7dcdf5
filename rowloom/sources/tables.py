"""Arrays and frames from tables: column lists, exceptions and type checks; scans prune to what is selected."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.array import DistArray
from ..operators.frame import DistFrame
from ..operators.grid import Grid, with_row_id

#: A local matrix may have this many cells.
LOCAL_CELLS = 20_000_000


def chosen(df: DataFrame, features: list[str] | None = None, exclude: list[str] | None = None, drop: list[str] | None = None) -> list[str]:
    """Feature names less the exceptions, compared without case; unknown names are an error."""
    by_name = {c.lower(): c for c in df.columns}
    for c in [*(features or []), *(exclude or [])]:
        if c.lower() not in by_name:
            raise ValueError(f"no column {c}")
    out = [by_name[c.lower()] for c in features] if features else [c for c in df.columns if c not in (drop or [])]
    gone = {c.lower() for c in exclude or []}
    out = [c for c in out if c.lower() not in gone]
    if not out:
        raise ValueError("no columns are left")
    return out


def _relation(spark: SparkSession, table: str | DataFrame) -> DataFrame:
    df = spark.table(table) if isinstance(table, str) else table
    return df


def _filled(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def table_to_array(spark: SparkSession, table: str | DataFrame, keys: list[str], features: list[str] | None = None, exclude: list[str] | None = None, npartitions: int | None = None) -> DistArray:
    df = _filled(_relation(spark, table))
    return DistArray.from_frame(df, chosen(df, features, exclude), keys, npartitions=npartitions)


def table_to_arrays(spark: SparkSession, table: str | DataFrame, keys: list[str], response: list[str], predictors: list[str] | None = None, exclude: list[str] | None = None, npartitions: int | None = None) -> tuple[DistArray, DistArray]:
    """(Y, X) with one row order: ids are given once, then projected twice."""
    df = _filled(_relation(spark, table))
    ys = chosen(df, response)
    xs = chosen(df, predictors, exclude, drop=ys)
    both = DistArray.from_frame(df, [*ys, *xs], keys, npartitions=npartitions)
    part = lambda cols, at: DistArray(both.df.select("row_id", *[F.col(f"c{at + k + 1}").alias(f"c{k + 1}") for k in range(len(cols))]), Grid.of(both.nrow, len(cols), npartitions=npartitions), "rows", names=(None, cols))
    return part(ys, 0), part(xs, len(ys))


def table_to_frame(spark: SparkSession, table: str | DataFrame, keys: list[str], features: list[str] | None = None, exclude: list[str] | None = None, npartitions: int | None = None) -> DistFrame:
    df = _filled(_relation(spark, table))
    return DistFrame.from_frame(df, keys, chosen(df, features, exclude), npartitions=npartitions)


def table_to_frames(spark: SparkSession, table: str | DataFrame, keys: list[str], response: list[str], predictors: list[str] | None = None, exclude: list[str] | None = None) -> tuple[DistFrame, DistFrame]:
    df = _filled(_relation(spark, table))
    ys = chosen(df, response)
    xs = chosen(df, predictors, exclude, drop=ys)
    rows = with_row_id(df.select(*dict.fromkeys([*keys, *ys, *xs])), keys)
    n = rows.count()
    return tuple(DistFrame(rows.select("row_id", *cols), cols, Grid.of(n, len(cols))) for cols in (ys, xs))


def table_to_matrix(spark: SparkSession, table: str | DataFrame, features: list[str] | None = None, keys: list[str] | None = None) -> np.ndarray:
    """A local matrix, for tables of a checked size."""
    df = _relation(spark, table)
    cols = chosen(df, features)
    if df.count() * len(cols) > LOCAL_CELLS:
        raise MemoryError("too many cells for the driver; use table_to_array")
    return (df.orderBy(*keys) if keys else df).select(*[F.col(c).cast("double") for c in cols]).toPandas().to_numpy(float)


def dummy_columns(df: DataFrame, features: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Categorical columns as 0/1 columns ``<name>_<k>``, k from levels - 1 down to 1, in sorted level order; the last
    level is the base. A column with one level is dropped. Columns that are not categorical stay."""
    names = [c for c in features if c.lower() not in {x.lower() for x in exclude or []}]
    kinds = dict(df.dtypes)
    text = [c for c in names if kinds[c] in ("string", "boolean")]
    levels = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"l{k}") for k, c in enumerate(text)]).first() if text else None
    out = []
    for c in names:
        if c not in text:
            out.append(F.col(c))
            continue
        found = levels[f"l{text.index(c)}"]
        out += [F.when(F.col(c).isNotNull(), (F.col(c).cast("string") == found[k - 1]).cast("int")).alias(f"{c}_{k}") for k in range(len(found) - 1, 0, -1)]
    return df.select(*out)


def dummy_relation(spark: SparkSession, source: str, features: list[str], target: str, exclude: list[str] | None = None, view: bool = True) -> DataFrame:
    """The same as a named view or table."""
    df = dummy_columns(spark.table(source), features, exclude)
    if view:
        df.createOrReplaceTempView(target)
    else:
        df.write.saveAsTable(target)
    return spark.table(target)
