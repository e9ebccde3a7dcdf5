"""Distributed two-dimensional arrays.

Two forms: *rows* ``(row_id, c1 ... cp)`` for tall dense data and *coo* ``(i, j, v)`` for sparse or square data, where an
absent cell of a sparse array is 0. Blocks are arithmetic on positions (``Grid``), not physical Spark partitions.
Missing values are nulls and spread like NA: a sum, product or norm that meets one is missing.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.na import cleaned, guarded
from .grid import LIVE, Grid, with_row_id

#: fetch() refuses more cells than this.
FETCH_CELLS = 50_000_000
#: reduce_blocks with a function keeps a column for each part up to this many parts, and a map of those there beyond.
WIDE_PARTS = 8


class DistArray:
    def __init__(self, df: DataFrame, grid: Grid, form: str, sparse: bool = False, names: tuple[list | None, list | None] = (None, None), placed: bool = True):
        self.df, self.grid, self.form, self.sparse, self._names, self._placed = df, grid, form, sparse, names, placed
        LIVE[id(self)] = self

    # -- construction ------------------------------------------------------------------------------------------------

    @classmethod
    def constant(cls, spark: SparkSession, nrow: int, ncol: int, value: float = 0.0, blocks=None, npartitions=None, sparse: bool = False) -> DistArray:
        """Dense and filled with a number, or sparse and empty."""
        if isinstance(value, bool | int | float) is False:
            raise TypeError("data must be a number or a logical")
        if sparse and value != 0:
            raise ValueError("a sparse array can only be filled with zero")
        grid = Grid.of(nrow, ncol, blocks, npartitions)
        if sparse:
            return cls(spark.createDataFrame([], "i long, j long, v double"), grid, "coo", True)
        cols = [F.lit(float(value)).alias(f"c{k + 1}") for k in range(ncol)]
        return cls(spark.range(nrow).select(F.col("id").alias("row_id"), *cols), grid, "rows")

    @classmethod
    def from_numpy(cls, spark: SparkSession, m: np.ndarray, blocks=None, sparse: bool = False, names=(None, None)) -> DistArray:
        m = np.asarray(m, float)
        if m.ndim != 2:
            raise ValueError("a matrix is needed")
        grid = Grid.of(*m.shape, blocks)
        if sparse:
            i, j = np.nonzero(m)
            rows = [(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)]
            return cls(spark.createDataFrame(rows, "i long, j long, v double"), grid, "coo", True, names)
        schema = "row_id long, " + ", ".join(f"c{k + 1} double" for k in range(m.shape[1]))
        rows = [(i, *(None if np.isnan(x) else float(x) for x in r)) for i, r in enumerate(m)]
        return cls(spark.createDataFrame(rows, schema), grid, "rows", False, names)

    @classmethod
    def from_frame(cls, df: DataFrame, columns: list[str], keys: list[str] | None = None, blocks=None, npartitions=None) -> DistArray:
        """Numeric or logical columns of a table. ``keys`` give the row order; without them ``df`` has ``row_id``."""
        kinds = dict(df.dtypes)
        for c in columns:
            if c not in kinds:
                raise ValueError(f"no column {c}")
            if not (kinds[c] in ("boolean", "double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")):
                raise TypeError(f"column {c} is neither numeric nor logical")
        values = df.select(*(keys or ["row_id"]), *[cleaned(F.col(c)).alias(f"__{c}") for c in columns])
        values = with_row_id(values, keys) if keys else values
        out = values.select("row_id", *[F.col(f"__{c}").alias(f"c{k + 1}") for k, c in enumerate(columns)])
        return cls(out, Grid.of(out.count(), len(columns), blocks, npartitions), "rows", names=(None, list(columns)))

    @classmethod
    def unordered(cls, df: DataFrame, columns: list[str]) -> DistArray:
        """Like ``from_frame`` for work that needs no positions (reductions): no sort. What asks for a position raises."""
        out = df.select(F.monotonically_increasing_id().alias("row_id"), *[cleaned(F.col(c)).alias(f"c{k + 1}") for k, c in enumerate(columns)])
        return cls(out, Grid.of(df.count(), len(columns)), "rows", names=(None, list(columns)), placed=False)

    @classmethod
    def from_coo(cls, df: DataFrame, shape: tuple[int, int], blocks=None, sparse: bool = True, base: int = 0) -> DistArray:
        """Triplets (i, j, v); cells that occur more than once are summed, and missing when one of them is."""
        cells = df.select((F.col("i") - base).cast("long").alias("i"), (F.col("j") - base).cast("long").alias("j"), cleaned(F.col("v")).alias("v"))
        return cls(cells.groupBy("i", "j").agg(guarded(F.sum("v"), F.col("v"), False).alias("v")), Grid.of(*shape, blocks), "coo", sparse)

    # -- shape -------------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def dim(self) -> tuple[int, int]:
        return self.grid.nrow, self.grid.ncol

    @property
    def nrow(self) -> int:
        return self.grid.nrow

    @property
    def ncol(self) -> int:
        return self.grid.ncol

    @property
    def npartitions(self) -> int:
        return self.grid.n

    @property
    def npartitions2d(self) -> tuple[int, int]:
        return self.grid.shape2d

    @property
    def columns(self) -> list[str]:
        return [f"c{k + 1}" for k in range(self.grid.ncol)]

    @property
    def dimnames(self) -> tuple[list | None, list | None]:
        return self._names

    def with_dimnames(self, rows: list | None, cols: list | None) -> DistArray:
        if rows is not None and len(rows) != self.nrow or cols is not None and len(cols) != self.ncol:
            raise ValueError("names do not fit the dimensions")
        return DistArray(self.df, self.grid, self.form, self.sparse, (rows, cols), self._placed)

    def partition_sizes(self, k: int | None = None) -> DataFrame:
        sizes = self.grid.sizes(self.spark).select("pid", "n_rows", "n_cols")
        return sizes if k is None else sizes.where(F.col("pid") == self.grid.number(k))

    def partition_offsets(self) -> DataFrame:
        return self.grid.sizes(self.spark).select("pid", "row_offset", "col_offset")

    def _like(self, df: DataFrame, form: str | None = None, sparse: bool | None = None) -> DistArray:
        return DistArray(df, self.grid, form or self.form, self.sparse if sparse is None else sparse, self._names, self._placed)

    def _need_positions(self) -> None:
        if not self._placed:
            raise ValueError("an array without row order has no positions; build it with from_frame and keys")

    # -- forms -------------------------------------------------------------------------------------------------------

    def to_coo(self) -> DistArray:
        """Cells as (i, j, v). Cells of a dense array are all there, missing ones with a null."""
        if self.form == "coo":
            return self
        self._need_positions()
        cells = F.array(*[F.struct(F.lit(k).cast("long").alias("j"), F.col(c).alias("v")) for k, c in enumerate(self.columns)])
        return self._like(self.df.select(F.col("row_id").alias("i"), F.inline(cells)), "coo", False)

    def densified(self) -> DistArray:
        """A sparse array with its zeros written out."""
        if self.form == "rows" or not self.sparse:
            return self
        cols = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.ncol - 1).cast("long")))
        every = self.spark.range(self.nrow).select(F.col("id").alias("i"), cols.alias("j"))
        return self._like(every.join(self.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), "coo", False)

    def to_rows(self) -> DistArray:
        if self.form == "rows":
            return self
        wide = self.df.groupBy("i").agg(*[F.max(F.when(F.col("j") == k, F.col("v"))).alias(c) for k, c in enumerate(self.columns)])
        if self.sparse:
            ids = self.spark.range(self.nrow).select(F.col("id").alias("i"))
            wide = ids.join(wide, "i", "left").select("i", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in self.columns])
        return self._like(wide.withColumnRenamed("i", "row_id"), "rows", False)

    def cells(self) -> DataFrame:
        """All cells (i, j, v), implicit zeros included."""
        return self.densified().to_coo().df

    def fetch(self) -> np.ndarray:
        """The whole array on the driver; only for arrays of a checked size."""
        if self.nrow * self.ncol > FETCH_CELLS:
            raise MemoryError(f"{self.nrow} x {self.ncol} cells are too many for the driver")
        out = np.zeros(self.dim) if self.sparse else np.full(self.dim, np.nan)
        cells = self.to_coo().df.where("v IS NOT NULL").toPandas()
        out[cells["i"].to_numpy(int), cells["j"].to_numpy(int)] = cells["v"]
        return out

    def get_partition(self, k: int, c: int | None = None) -> DataFrame:
        """One block, with original positions. In the rows form a range filter on row_id, which scans push down."""
        self._need_positions()
        r0, r1, c0, c1 = self.grid.bounds(self.grid.number(k, c))
        if self.form == "rows":
            return self.df.where((F.col("row_id") >= r0) & (F.col("row_id") < r1)).select("row_id", *self.columns[c0:c1])
        return self.df.where((F.col("i") >= r0) & (F.col("i") < r1) & (F.col("j") >= c0) & (F.col("j") < c1))

    def with_pid(self) -> DataFrame:
        self._need_positions()
        if self.form == "rows" and self.grid.shape2d[1] == 1:
            return self.df.select(self.grid.pid(F.col("row_id")).alias("pid"), "*")
        coo = self.to_coo().df
        return coo.select(self.grid.pid(F.col("i"), F.col("j")).alias("pid"), "*")

    def clone(self, value: float | None = None, nrow: int | None = None, ncol: int | None = None, sparse: bool = False) -> DistArray:
        """A copy (frames are immutable), or, with a value, the same grid filled with it; nrow or ncol may be changed."""
        if value is None:
            return self._like(self.df)
        if nrow is not None and ncol is not None:
            raise ValueError("change nrow or ncol, not both")
        blocks = (self.grid.rb if nrow is None else max(1, -(-nrow // self.grid.shape2d[0])), self.grid.cb if ncol is None else max(1, -(-ncol // self.grid.shape2d[1])))
        return DistArray.constant(self.spark, nrow or self.nrow, ncol or self.ncol, value, blocks, sparse=sparse)

    # -- element-wise ------------------------------------------------------------------------------------------------

    def map_cells(self, f) -> DistArray:
        """``f`` on every stored cell."""
        if self.form == "rows":
            return self._like(self.df.select("row_id", *[f(F.col(c)).alias(c) for c in self.columns]))
        return self._like(self.df.select("i", "j", f(F.col("v")).alias("v")))

    def _check(self, other: DistArray) -> None:
        self._need_positions()
        other._need_positions()
        if self.dim != other.dim:
            raise ValueError(f"dimensions differ: {self.dim} and {other.dim}")

    def _paired(self, other: DistArray, sign: int) -> DistArray:
        self._check(other)
        if self.sparse and other.sparse:
            both = self.df.unionByName(other.df.select("i", "j", (F.col("v") * sign).alias("v")))
            return self._like(both.groupBy("i", "j").agg(guarded(F.sum("v"), F.col("v"), False).alias("v")))
        if self.form == other.form == "rows":
            b = other.df.select(F.col("row_id").alias("__r"), *[F.col(c).alias(f"__{c}") for c in other.columns])
            pairs = self.df.join(b, F.col("row_id") == F.col("__r"))
            return self._like(pairs.select("row_id", *[(F.col(c) + sign * F.col(f"__{c}")).alias(c) for c in self.columns]), sparse=False)
        a, b = self.cells(), other.cells().withColumnRenamed("v", "w")
        return self._like(a.join(b, ["i", "j"]).select("i", "j", (F.col("v") + sign * F.col("w")).alias("v")), "coo", False)

    def __mul__(self, s: float) -> DistArray:
        return self.map_cells(lambda v: v * F.lit(float(s)))

    __rmul__ = __mul__

    def __add__(self, other) -> DistArray:
        """With a number a sparse array becomes dense, as its zeros change too."""
        return self._paired(other, 1) if isinstance(other, DistArray) else self.densified().map_cells(lambda v: v + F.lit(float(other)))

    __radd__ = __add__

    def __sub__(self, other) -> DistArray:
        return self._paired(other, -1) if isinstance(other, DistArray) else self + (-other)

    def __rsub__(self, s: float) -> DistArray:
        return self.densified().map_cells(lambda v: F.lit(float(s)) - v)

    def power(self, p: float) -> DistArray:
        return (self if p > 0 else self.densified()).map_cells(lambda v: F.pow(v, F.lit(float(p))))

    def equal_frame(self, other: DistArray) -> DataFrame:
        """One row (equal boolean); missing equals missing."""
        self._check(other)
        if self.form == other.form == "rows":
            b = other.df.select(F.col("row_id").alias("__r"), *[F.col(c).alias(f"__{c}") for c in other.columns])
            same = F.lit(True)
            for c in self.columns:
                same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
            return self.df.join(b, F.col("row_id") == F.col("__r")).agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))
        a, b = self.to_coo(), other.to_coo()
        both = a.df.withColumnRenamed("v", "a").join(b.df.withColumnRenamed("v", "b"), ["i", "j"], "full")
        zero = lambda x, c: F.coalesce(c, F.lit(0.0)) if x.sparse else c
        return both.agg(F.coalesce(F.bool_and(zero(a, F.col("a")).eqNullSafe(zero(b, F.col("b")))), F.lit(True)).alias("equal"))

    def equals(self, other: DistArray) -> bool:
        return self.equal_frame(other).first()[0]

    def matmul(self, other: DistArray) -> DistArray:
        """Index join and sum; the join strategy is left to sizes that Spark measures.

        A missing cell makes every product of its row (or column) missing. Cells that a sparse array does not store
        are 0 and meet nothing, so there only stored cells spread.
        """
        if self.ncol != other.nrow:
            raise ValueError(f"cannot multiply {self.dim} by {other.dim}")
        a = self.to_coo().df.select("i", F.col("j").alias("k"), F.col("v").alias("a"))
        b = other.to_coo().df.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
        out = a.join(b, "k").select("i", "j", (F.col("a") * F.col("b")).alias("v")).groupBy("i", "j").agg(guarded(F.sum("v"), F.col("v"), False).alias("v"))
        grid = Grid.of(self.nrow, other.ncol, (self.grid.rb, other.grid.cb))
        return DistArray(out, grid, "coo", True)

    __matmul__ = matmul

    # -- reductions --------------------------------------------------------------------------------------------------

    def _reduced(self, kind: str, na_rm: bool) -> DataFrame:
        """One row (value) with one partial aggregate over all cells."""
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        if self.form == "rows":
            parts = [guarded(agg(c), F.col(c), na_rm).alias(c) for c in self.columns]
            whole = self.df.agg(*parts)
            cols = [F.col(c) for c in self.columns]
            if kind == "sum":
                value = cols[0]
                for c in cols[1:]:
                    value = value + c if not na_rm else F.coalesce(value, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))
            else:
                pick = F.greatest if kind == "max" else F.least
                value = pick(*cols) if len(cols) > 1 else cols[0]
                if not na_rm:
                    missing = F.lit(False)
                    for c in cols:
                        missing = missing | c.isNull()
                    value = F.when(~missing, value)
            return whole.select(value.alias("value"))
        value = guarded(agg("v"), F.col("v"), na_rm)
        if self.sparse and kind == "sum":
            value = F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(value)
        elif self.sparse:  # implicit zeros take part where there are any
            pick = F.greatest if kind == "max" else F.least
            value = F.when(F.count(F.lit(1)) == self.nrow * self.ncol, value).when(F.lit(na_rm) | (F.count(F.lit(1)) == F.count("v")), pick(value, F.lit(0.0)))
        return self.df.agg(value.alias("value"))

    def sum_frame(self, na_rm: bool = False) -> DataFrame:
        return self._reduced("sum", na_rm)

    def max_frame(self, na_rm: bool = False) -> DataFrame:
        return self._reduced("max", na_rm)

    def min_frame(self, na_rm: bool = False) -> DataFrame:
        return self._reduced("min", na_rm)

    def mean_frame(self, na_rm: bool = False, trim: float = 0) -> DataFrame:
        if trim:
            raise NotImplementedError("trimmed means are not supported")
        if self.form == "coo" and self.sparse:
            n = F.lit(self.nrow * self.ncol) - (F.count(F.lit(1)) - F.count("v") if na_rm else F.lit(0))
            return self.df.agg(F.try_divide(F.coalesce(guarded(F.sum("v"), F.col("v"), na_rm), F.when(F.count(F.lit(1)) == 0, F.lit(0.0))), n).alias("value"))
        if self.form == "coo":
            return self.df.agg(guarded(F.avg("v"), F.col("v"), na_rm).alias("value"))
        total, n, missing = F.lit(0.0), F.lit(0), F.lit(0)
        for c in self.columns:
            total, n = total + F.coalesce(F.sum(c), F.lit(0.0)), n + F.count(c)
            missing = missing + F.count(F.lit(1)) - F.count(c)
        mean = F.try_divide(total, n)
        return self.df.agg((mean if na_rm else F.when(missing == 0, mean)).alias("value"))

    def norm_frame(self) -> DataFrame:
        """Root of the sum of squares; missing when a cell is."""
        squares = F.lit(0.0)
        for c in self.columns if self.form == "rows" else ["v"]:
            square = F.col(c) * F.col(c)
            squares = squares + F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(square), F.lit(0.0)))
        return self.df.agg(F.sqrt(squares).alias("value"))

    def sum(self, na_rm: bool = False):
        return self.sum_frame(na_rm).first()[0]

    def max(self, na_rm: bool = False):
        return self.max_frame(na_rm).first()[0]

    def min(self, na_rm: bool = False):
        return self.min_frame(na_rm).first()[0]

    def mean(self, na_rm: bool = False, trim: float = 0):
        return self.mean_frame(na_rm, trim).first()[0]

    def norm(self) -> float:
        return self.norm_frame().first()[0]

    def col_sums(self, na_rm: bool = False) -> DataFrame:
        """(j, value)."""
        return self._by_column(F.sum, na_rm)

    def col_means(self, na_rm: bool = False) -> DataFrame:
        return self._by_column(F.avg, na_rm)

    def _by_column(self, agg, na_rm: bool) -> DataFrame:
        if self.form == "rows":
            one = self.df.agg(*[guarded(agg(c), F.col(c), na_rm).alias(c) for c in self.columns])
            return one.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("j"), F.col(c).alias("value")) for k, c in enumerate(self.columns)])))
        return self._by_index("j", agg, na_rm)

    def _by_index(self, key: str, agg, na_rm: bool) -> DataFrame:
        """Sums or means by row or column of coo cells; a sparse mean divides by the full extent."""
        size, across = (self.ncol, self.nrow) if key == "j" else (self.nrow, self.ncol)
        if not self.sparse:
            return self.df.groupBy(key).agg(guarded(agg("v"), F.col("v"), na_rm).alias("value"))
        value = guarded(F.sum("v"), F.col("v"), na_rm)
        if agg is F.avg:
            value = F.try_divide(value, F.lit(across) - (F.count(F.lit(1)) - F.count("v") if na_rm else F.lit(0)))
        some = self.df.groupBy(key).agg(value.alias("value"), F.lit(True).alias("there"))
        ids = self.spark.range(size).select(F.col("id").alias(key))
        return ids.join(some, key, "left").select(key, F.when(F.col("there"), F.col("value")).otherwise(F.lit(0.0)).alias("value"))

    def row_sums(self, na_rm: bool = False) -> DataFrame:
        """(i, value)."""
        if self.form == "coo":
            return self._by_index("i", F.sum, na_rm)
        self._need_positions()
        return self.df.select(F.col("row_id").alias("i"), self._across(na_rm)[0].alias("value"))

    def row_means(self, na_rm: bool = False) -> DataFrame:
        if self.form == "coo":
            return self._by_index("i", F.avg, na_rm)
        self._need_positions()
        total, n = self._across(na_rm)
        return self.df.select(F.col("row_id").alias("i"), F.try_divide(total, n).alias("value"))

    def _across(self, na_rm: bool) -> tuple[Column, Column]:
        total, n = F.lit(0.0), F.lit(0)
        for c in self.columns:
            total = total + (F.coalesce(c, F.lit(0.0)) if na_rm else F.col(c))
            n = n + (F.col(c).isNotNull().cast("int") if na_rm else F.lit(1))
        return total, n

    # -- ends and extremes -------------------------------------------------------------------------------------------

    def _first(self, n: int) -> int:
        n = int(np.floor(n))
        return max(0, self.nrow + n) if n < 0 else min(n, self.nrow)

    def head(self, n: float = 6) -> DataFrame:
        """First rows; n < 0: all but the last -n. A filter on positions, no sort."""
        self._need_positions()
        return self.to_rows().df.where(F.col("row_id") < self._first(n))

    def tail(self, n: float = 6) -> DataFrame:
        """Last rows with their original positions."""
        self._need_positions()
        return self.to_rows().df.where(F.col("row_id") >= self.nrow - self._first(n))

    def argmax_frame(self) -> DataFrame:
        """1-based position of the first largest cell, counted along the rows."""
        place = F.col("i") * self.ncol + F.col("j") + 1
        return self.cells().agg(F.max_by(place, F.struct(F.col("v"), -place)).alias("value"))

    def to_json(self) -> str:
        return json.dumps({"dim": self.dim, "blocks": [self.grid.rb, self.grid.cb], "sparse": self.sparse})


def reduce_blocks(parts: list[DistArray], f="sum") -> DistArray:
    """Cell by cell over arrays of equal size: sum, max, min or product, or any associative function of two columns,
    applied in the order of ``parts``, as one grouped aggregate over stored cells.

    A cell that a sparse part does not store counts as 0 and is not written out. The result is sparse when all parts are
    and ``f`` of zeros is 0; where it is not, every cell of the result differs from 0 and has to be there."""
    first, n = parts[0], len(parts)
    for p in parts[1:]:
        first._check(p)
    sparse = all(p.sparse for p in parts)
    fold = lambda vs: F.aggregate(F.slice(vs, 2, max(1, n)), F.get(vs, F.lit(0)), lambda a, v: f(a, v))
    if sparse and callable(f):
        zeros = first.spark.range(1).select(F.array(*[F.lit(0.0)] * n).alias("vs"))
        sparse = zeros.select(fold(F.col("vs"))).first()[0] == 0

    def stored(k: int) -> DataFrame:
        p = parts[k]
        if p.sparse and (sparse or k):
            return p.df.select("i", "j", F.lit(k).alias("k"), F.coalesce("v", F.lit(0.0)).alias("v"))
        return p.cells().select("i", "j", F.lit(k).alias("k"), "v")

    every = stored(0)
    for k in range(1, n):
        every = every.unionByName(stored(k))
    cells = every.groupBy("i", "j")
    if callable(f):
        if n <= WIDE_PARTS:
            values = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(n)]  # one value at most
            gathered, own = cells.agg(*values), [F.col(f"v{k}") for k in range(n)]
        else:
            gathered = cells.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("held"))
            own = [F.col("held")[F.lit(k)] for k in range(n)]
        filled = [F.coalesce(v, F.lit(0.0)) if p.sparse else v for v, p in zip(own, parts)]
        out = gathered.select("i", "j", F.array(*filled).alias("vs")).select("i", "j", fold(F.col("vs")).alias("v"))
    else:
        zero = F.lit(0.0)
        agg, with_zero = {
            "sum": (F.sum, lambda v: F.coalesce(v, zero)), "max": (F.max, lambda v: F.greatest(v, zero)), "min": (F.min, lambda v: F.least(v, zero)), "product": (F.product, lambda v: F.coalesce(v * zero, zero)),
        }[f]
        out = cells.agg(F.when(F.count(F.lit(1)) < n, with_zero(agg("v"))).otherwise(agg("v")).alias("v"))
    return first._like(out, "coo", sparse)
