"""Cutting lineage: intermediate tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_LOCAL = "/tmp/checkpoints/rowloom"
_local_folders: set[str] = set()
_scopes: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only in local mode with none named.

    A cluster without ``spark.checkpoint.dir`` is an error: a machine-local folder would lose rows there.
    """
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"set {_SETTING} to a folder that driver and executors share")
    folder = f"{_LOCAL}/{spark.sparkContext.applicationId}"
    if folder not in _local_folders:
        _local_folders.add(folder)
        atexit.register(shutil.rmtree, folder, True)
    return _LOCAL


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing uses yet."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: later failures restart from there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rowloom_path = path
    for scope in _scopes:
        scope.append(out)
    return out


@contextmanager
def only_kept(kept: list[DataFrame]):
    """Release at the end all tables that were written inside, but those that have been added to ``kept``."""
    written: list[DataFrame] = []
    _scopes.append(written)
    try:
        yield
    finally:
        _scopes.pop()
        for df in written:
            if not any(df is k for k in kept):
                release(df)


def release(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``; nothing lazy may still read it."""
    path = getattr(df, "_rowloom_path", None)
    if path is None:
        return
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
