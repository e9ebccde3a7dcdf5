"""Distributed frames: typed columns in a known row order, with categorical columns.

A categorical column holds integer codes (1, 2, ...) whose labels, in sorted order, are kept with the frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.na import cleaned, guarded
from ..scratch import materialise
from .grid import LIVE, Grid, with_row_id

_NUMERIC = ("boolean", "double", "float", "int", "bigint", "smallint", "tinyint")


@dataclass(frozen=True)
class DistFrame:
    """``df`` has row_id and the columns ``names``; ``factors`` maps coded columns to a table (code, label)."""

    df: DataFrame
    names: list[str]
    grid: Grid
    factors: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        LIVE[id(self)] = self

    @classmethod
    def constant(cls, spark: SparkSession, nrow: int, ncol: int, value: float = 0.0, blocks=None, npartitions=None) -> DistFrame:
        names = [f"X{k + 1}" for k in range(ncol)]
        df = spark.range(nrow).select(F.col("id").alias("row_id"), *[F.lit(value).alias(c) for c in names])
        return cls(df, names, Grid.of(nrow, ncol, blocks, npartitions))

    @classmethod
    def from_frame(cls, df: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None, blocks=None, npartitions=None) -> DistFrame:
        columns = columns or [c for c in df.columns if c != "row_id"]
        df = with_row_id(df.select(*dict.fromkeys([*keys, *columns])), keys) if keys else df
        return cls(df.select("row_id", *columns), columns, Grid.of(df.count(), len(columns), blocks, npartitions))

    @property
    def dim(self) -> tuple[int, int]:
        return self.grid.nrow, self.grid.ncol

    def filled(self, value) -> DistFrame:
        return replace(self, df=self.df.select("row_id", *[F.lit(value).alias(c) for c in self.names]), factors={})

    def renamed(self, names: list[str]) -> DistFrame:
        if len(names) != len(self.names) or len(set(names)) != len(names):
            raise ValueError("one name for each column, all different")
        return replace(self, df=self.df.toDF("row_id", *names), names=list(names), factors={names[self.names.index(c)]: t for c, t in self.factors.items()})

    def get_partition(self, k: int, c: int | None = None) -> DataFrame:
        r0, r1, c0, c1 = self.grid.bounds(self.grid.number(k, c))
        return self.df.where((F.col("row_id") >= r0) & (F.col("row_id") < r1)).select("row_id", *self.names[c0:c1])

    def partition_sizes(self) -> DataFrame:
        return self.grid.sizes(self.df.sparkSession).select("pid", "n_rows", "n_cols")

    def with_pid(self) -> DataFrame:
        return self.df.select(self.grid.pid(F.col("row_id")).alias("pid"), "*")

    # -- arithmetic and reductions -----------------------------------------------------------------------------------

    def _numeric(self, names: list[str] | None = None) -> list[str]:
        kinds = dict(self.df.dtypes)
        names = names or self.names
        wrong = [c for c in names if c in self.factors or not (kinds[c] in _NUMERIC or kinds[c].startswith("decimal"))]
        if wrong:
            raise TypeError(f"not numeric: {wrong}")
        return names

    def map_cells(self, f) -> DistFrame:
        self._numeric()
        return replace(self, df=self.df.select("row_id", *[f(F.col(c)).alias(c) for c in self.names]))

    def _paired(self, other: DistFrame, sign: int) -> DistFrame:
        if self.dim != other.dim:
            raise ValueError(f"dimensions differ: {self.dim} and {other.dim}")
        b = other.df.select(F.col("row_id").alias("__r"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(other._numeric())])
        pairs = self.df.join(b, F.col("row_id") == F.col("__r"))
        return replace(self, df=pairs.select("row_id", *[(F.col(c) + sign * F.col(f"__{k}")).alias(c) for k, c in enumerate(self._numeric())]))

    def __add__(self, other) -> DistFrame:
        return self._paired(other, 1) if isinstance(other, DistFrame) else self.map_cells(lambda v: v + F.lit(other))

    __radd__ = __add__

    def __sub__(self, other) -> DistFrame:
        return self._paired(other, -1) if isinstance(other, DistFrame) else self.map_cells(lambda v: v - F.lit(other))

    def __rsub__(self, s) -> DistFrame:
        return self.map_cells(lambda v: F.lit(s) - v)

    def reduced(self, kind: str, na_rm: bool = False) -> DataFrame:
        """One row (value): sum, max or min over all cells; an error with a column that is not numeric."""
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        pick = {"max": F.greatest, "min": F.least}
        parts = [guarded(agg(cleaned(F.col(c))), cleaned(F.col(c)), na_rm).alias(f"p{k}") for k, c in enumerate(self._numeric())]
        cols = [F.col(f"p{k}") for k in range(len(parts))]
        value, missing = cols[0], F.lit(False)
        for c in cols[1:]:
            value = (F.coalesce(value, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))) if kind == "sum" else pick[kind](value, c)
        for c in cols:
            missing = missing | c.isNull()
        return self.df.agg(*parts).select((value if na_rm else F.when(~missing, value)).alias("value"))

    def by_column(self, kind: str, na_rm: bool = False) -> DataFrame:
        """(name, value): sum or mean of each column."""
        agg = {"sum": F.sum, "mean": F.avg}[kind]
        names = self._numeric()
        one = self.df.agg(*[guarded(agg(cleaned(F.col(c))), cleaned(F.col(c)), na_rm).alias(f"p{k}") for k, c in enumerate(names)])
        return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"p{k}").alias("value")) for k, c in enumerate(names)])))

    def by_row(self, kind: str, na_rm: bool = False) -> DataFrame:
        """(row_id, value): sum or mean across each row."""
        total, n = F.lit(0.0), F.lit(0)
        for c in self._numeric():
            v = cleaned(F.col(c))
            total = total + (F.coalesce(v, F.lit(0.0)) if na_rm else v)
            n = n + (v.isNotNull().cast("int") if na_rm else F.lit(1))
        return self.df.select("row_id", (total if kind == "sum" else F.try_divide(total, n)).alias("value"))

    def head(self, n: int = 6) -> DataFrame:
        """First rows; none for n <= 0."""
        return self.df.where(F.col("row_id") < n)

    def tail(self, n: int = 6) -> DataFrame:
        return self.df.where(F.col("row_id") >= self.grid.nrow - max(0, n))

    # -- categories --------------------------------------------------------------------------------------------------

    def categorical(self) -> list[str]:
        kinds = dict(self.df.dtypes)
        return [c for c in self.names if c in self.factors or kinds[c] in ("string", "boolean")]

    def levels(self, columns: list[str | int] | None = None) -> DataFrame:
        """(name, code, label): distinct labels of each column in sorted order, codes from 1."""
        names = [self.names[c - 1] if isinstance(c, int) else c for c in columns] if columns else self.categorical()
        unknown = [c for c in names if c not in self.names]
        if unknown:
            raise ValueError(f"no columns {unknown}")
        if not names:
            return self.df.sparkSession.createDataFrame([], "name string, code int, label string")
        plain = self.unfactored([c for c in names if c in self.factors]).df if self.factors else self.df
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("label")) for c in names])
        found = plain.select(F.inline(pairs)).where("label IS NOT NULL").distinct()
        placed = with_row_id(found, ["name", "label"], "__at")  # a range sort: no column's labels meet in one task
        first = F.broadcast(placed.groupBy("name").agg(F.min("__at").alias("__first")))  # one row a column
        return placed.join(first, "name").select("name", (F.col("__at") - F.col("__first") + 1).cast("int").alias("code"), "label")

    def factored(self, columns: list[str] | None = None) -> DistFrame:
        """Columns as codes; the label table is joined, broadcast or not as its measured size asks."""
        names = [c for c in columns or self.categorical() if c not in self.factors]
        levels = materialise(self.levels(names), "levels")  # one pass over the data, however many columns
        df, factors = self.df, dict(self.factors)
        for c in names:
            table = levels.where(F.col("name") == c).select("code", "label")
            df = df.join(table, df[c].cast("string") == table["label"], "left").drop(c, "label").withColumnRenamed("code", c)
            factors[c] = table
        return replace(self, df=df.select("row_id", *self.names), factors=factors)

    def unfactored(self, columns: list[str] | None = None) -> DistFrame:
        """Codes back to labels."""
        df, factors = self.df, dict(self.factors)
        for c in columns or list(self.factors):
            table = factors.pop(c)
            df = df.join(table, df[c] == table["code"], "left").drop(c, "code").withColumnRenamed("label", c)
        return replace(self, df=df.select("row_id", *self.names), factors=factors)
