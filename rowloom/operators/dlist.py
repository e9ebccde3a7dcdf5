"""Distributed lists: partitions that hold any number of serialised values."""

from __future__ import annotations

import base64
import pickle
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "pid long, pos long, payload binary"


@dataclass(frozen=True)
class DistList:
    """``df``: (pid, pos, payload). Values are pickled; read only what your own jobs wrote."""

    df: DataFrame
    npartitions: int

    @classmethod
    def empty(cls, spark: SparkSession, npartitions: int) -> DistList:
        if npartitions < 1:
            raise ValueError("a list needs a partition")
        return cls(spark.createDataFrame([], _SCHEMA), npartitions)

    def with_partition(self, k: int, values: list) -> DistList:
        """Partition ``k`` (1-based) replaced."""
        if not 1 <= k <= self.npartitions:
            raise IndexError(f"no partition {k} of {self.npartitions}")
        rows = [(k, i, bytearray(pickle.dumps(v))) for i, v in enumerate(values)]
        return DistList(self.df.where(F.col("pid") != k).unionByName(self.df.sparkSession.createDataFrame(rows, _SCHEMA)), self.npartitions)

    def partition(self, k: int) -> list:
        rows = self.df.where(F.col("pid") == k).orderBy("pos").select("payload").collect()
        return [pickle.loads(bytes(r[0])) for r in rows]

    def partition_sizes(self) -> DataFrame:
        """(pid, n_items), empty partitions included."""
        ids = self.df.sparkSession.range(1, self.npartitions + 1).select(F.col("id").alias("pid"))
        counts = self.df.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
        return ids.join(counts, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("n_items"))


def packed(value) -> str:
    return base64.b64encode(pickle.dumps(value)).decode()
