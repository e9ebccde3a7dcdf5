"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or the script of the rest."""
    return F.translate(text, UPPER, LOWER)


def packed(docs: DataFrame, name: str = "row") -> DataFrame:
    """One struct column with all of ``docs``, so that no input column can clash with an operator's own."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(name))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, rid): ``docs`` packed, each row with a number of its own, written down so that every reader sees the same one."""
    return materialise(packed(spread(docs)).withColumn("rid", F.monotonically_increasing_id()), "keyed")


#: Most bytes of row numbers that are broadcast, and what one takes in a hash set.
BROADCAST_BYTES, ID_BYTES = 64 << 20, 64


def without_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` (row, rid) but those whose rid is in ``dropped`` (rid).

    The dropped numbers are written and counted; up to BROADCAST_BYTES of them are broadcast, so that the kept rows
    stay where they are. Beyond that the same join shuffles both sides by rid, where no key is hot.
    """
    dropped = materialise(dropped.select(F.col("rid").alias("gone")), "gone")
    gone = F.broadcast(dropped) if dropped.count() * ID_BYTES <= BROADCAST_BYTES else dropped
    return rows.join(gone, F.col("rid") == F.col("gone"), "left_anti")


def inline_rows(spark, json_rows: str, schema: str) -> DataFrame:
    """A small driver-side table as a literal, without any Python or RDD node in the plan."""
    rows = F.from_json(F.lit(json_rows), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(rows))


def text_slices(batches, max_bytes: int = 8 << 20):
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of its ``text`` column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size) + 1
        yield batch.slice(start)


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it is too small to give every second core a file split of its own.

    Only then is the shuffle that this takes small as well; larger inputs keep their splits and shuffle nothing.
    """
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < split * cores // 2 else df
