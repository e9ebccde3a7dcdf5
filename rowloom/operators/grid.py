"""Block arithmetic: how a matrix-like object is cut into numbered blocks, left to right, then top to bottom."""

from __future__ import annotations

import weakref
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialise

#: Arrays and frames in use, by identity: for listings.
LIVE: weakref.WeakValueDictionary = weakref.WeakValueDictionary()


@dataclass(frozen=True)
class Grid:
    nrow: int
    ncol: int
    rb: int
    cb: int

    def __post_init__(self):
        if self.nrow < 0 or self.ncol < 0:
            raise ValueError("dimensions must not be negative")
        if self.rb < 1 or self.cb < 1:
            raise ValueError("block sizes must be positive")

    @classmethod
    def of(cls, nrow: int, ncol: int, blocks: tuple[int, int] | None = None, npartitions: int | None = None) -> Grid:
        """Given blocks; or row blocks that make ``npartitions`` parts; or one block."""
        if blocks is not None and npartitions is not None:
            raise ValueError("give blocks or npartitions, not both")
        if blocks is None:
            blocks = (max(1, -(-nrow // (npartitions or 1))), max(1, ncol))
        return cls(nrow, ncol, min(blocks[0], max(1, nrow)), min(blocks[1], max(1, ncol)))

    @property
    def shape2d(self) -> tuple[int, int]:
        return max(1, -(-self.nrow // self.rb)), max(1, -(-self.ncol // self.cb))

    @property
    def n(self) -> int:
        return self.shape2d[0] * self.shape2d[1]

    def pid(self, i: Column, j: Column | int = 0) -> Column:
        """1-based number of the block that holds cell (i, j), both 0-based."""
        j = F.lit(j) if isinstance(j, int) else j
        return (F.floor(i / self.rb) * self.shape2d[1] + F.floor(j / self.cb) + 1).cast("long")

    def number(self, k: int, c: int | None = None) -> int:
        """Block number of ``k``, or of row ``k`` and column ``c`` of the grid; an error outside of it."""
        if c is not None:
            if not (1 <= k <= self.shape2d[0] and 1 <= c <= self.shape2d[1]):
                raise IndexError(f"no block ({k}, {c}) in a grid of {self.shape2d}")
            k = (k - 1) * self.shape2d[1] + c
        if not 1 <= k <= self.n:
            raise IndexError(f"no block {k} of {self.n}")
        return k

    def bounds(self, k: int) -> tuple[int, int, int, int]:
        """(first row, row after the last, first column, column after the last) of block k."""
        r, c = divmod(self.number(k) - 1, self.shape2d[1])
        return r * self.rb, min(self.nrow, (r + 1) * self.rb), c * self.cb, min(self.ncol, (c + 1) * self.cb)

    def sizes(self, spark: SparkSession) -> DataFrame:
        """pid, n_rows, n_cols, row_offset, col_offset of every block."""
        across = self.shape2d[1]
        at = spark.range(1, self.n + 1).select(F.col("id").alias("pid"), F.floor((F.col("id") - 1) / across).alias("r"), ((F.col("id") - 1) % across).alias("c"))
        size = lambda k, step, total: F.greatest(F.lit(0), F.least(F.lit(step), F.lit(total) - F.col(k) * step)).cast("long")
        return at.select(
            "pid", size("r", self.rb, self.nrow).alias("n_rows"), size("c", self.cb, self.ncol).alias("n_cols"), (F.col("r") * self.rb).cast("long").alias("row_offset"), (F.col("c") * self.cb).cast("long").alias("col_offset")
        )


def with_row_id(df: DataFrame, keys: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive ids from 0 in the order of ``keys``, without a one-task sort.

    Rows are range-sorted and written down; a row's id is its place in its partition plus the rows of the partitions
    before it. The offsets are one row for each partition.
    """
    place = F.monotonically_increasing_id()
    rows = materialise(df.orderBy(*keys).withColumn("__at", place), "row-id")
    part = F.shiftright("__at", 33).alias("__part")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(offsets), "__part")
    return out.select((F.col("__off") + inside).alias(name), *[F.col(c) for c in df.columns])
