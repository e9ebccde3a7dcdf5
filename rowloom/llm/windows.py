"""Word windows inside one row, as array expressions: no row leaves its task and nothing is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words_of(text: Column, separators: str) -> Column:
    """Words between runs of the separator class; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def _pair(a: Column, b: Column, gap: int) -> Column:
    return F.zip_with(a, F.slice(b, F.lit(gap + 1), F.size(b)), lambda x, y: F.xxhash64(x, y))


def with_window_hashes(df: DataFrame, hashes: str, widths: list[int], prefix: str) -> DataFrame:
    """Add ``<prefix><w>`` for each width: the hash of the window that starts at each word.

    Windows are built by doubling (1, 2, 4, 8, then sums), so a width costs log2(width) passes over the array. Every
    array has as many entries as there are words; those whose window would pass the end are meaningless.
    Each step is a column of its own that the next one uses twice, which keeps the optimizer from inlining it.
    """
    base = {1: hashes}
    top = 1
    while 2 * top <= max(widths, default=1):
        df = df.withColumn(f"{prefix}p{2 * top}", _pair(F.col(base[top]), F.col(base[top]), top))
        base[2 * top] = f"{prefix}p{2 * top}"
        top *= 2
    for w in widths:
        bits = [b for b in sorted(base, reverse=True) if w & b]
        df = df.withColumn(f"{prefix}{w}", F.col(base[bits[0]]))
        done = bits[0]
        for b in bits[1:]:
            df = df.withColumn(f"{prefix}{w}", _pair(F.col(f"{prefix}{w}"), F.col(base[b]), done))
            done += b
    return df


def covered(intervals: Column) -> Column:
    """Positions that sorted intervals (struct<at, width>) cover, each counted once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        end = x["at"] + x["width"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"]))).alias("total"))

    return F.aggregate(intervals, start, step, lambda acc: acc["total"])
