"""Session control: start, stop, status, configuration tables, shared code and stored models."""

from __future__ import annotations

import json
import os
import re
import sys
import xml.etree.ElementTree as ET

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.grid import LIVE

#: Settings of a session that this library starts; those of a running session are left alone.
DEFAULTS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def start(master: str | None = None, memory: str | None = None, cores: int | None = None, app: str = "rowloom", **conf: str) -> SparkSession:
    """A session; with one running already, that one (its static settings stay)."""
    if cores is not None and cores < 1:
        raise ValueError("cores must be positive")
    b = SparkSession.builder.appName(app)
    if master or cores:
        b = b.master(master or f"local[{cores}]")
    if memory:
        b = b.config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shutdown(spark: SparkSession) -> None:
    spark.stop()


def status(spark: SparkSession) -> DataFrame:
    """(worker, instances, memory_total, memory_used, memory_free, array_quota, array_used) of every host, in bytes.

    Totals and free memory are those of the block managers, which also hold what is cached: the quota and the use of
    stored arrays are the same numbers here. Memory of the machines themselves is not known to a session.
    """
    memory = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    hosts: dict[str, list[int]] = {}
    it = memory.iterator()
    while it.hasNext():
        entry = it.next()
        own = hosts.setdefault(entry._1().rsplit(":", 1)[0], [0, 0, 0])
        for k, x in enumerate((1, int(entry._2()._1()), int(entry._2()._2()))):
            own[k] += x
    rows = [(h, n, total, total - free, free, total, total - free) for h, (n, total, free) in sorted(hosts.items())]
    return spark.createDataFrame(rows, "worker string, instances int, memory_total long, memory_used long, memory_free long, array_quota long, array_used long")


def master_info(spark: SparkSession) -> dict[str, str]:
    sc = spark.sparkContext
    return {"master": sc.master, "application": sc.applicationId, "user": sc.sparkUser(), "version": spark.version}


def list_objects(spark: SparkSession) -> DataFrame:
    """(name, kind, nrow, ncol): tables and views that the session can name, and arrays and frames that are in use."""
    rows = [(t.name, t.tableType, None, None) for t in spark.catalog.listTables()]
    rows += [(f"{type(x).__name__}-{k}", "DISTRIBUTED", x.grid.nrow, x.grid.ncol) for k, x in enumerate(list(LIVE.values()))]
    return spark.createDataFrame(rows, "name string, kind string, nrow long, ncol long")


_shipped: dict[str, set[str]] = {}


def load_code(spark: SparkSession, path: str) -> None:
    """Ship a Python file or archive to every executor."""
    spark.sparkContext.addPyFile(path)
    _shipped.setdefault(spark.sparkContext.applicationId, set()).add(os.path.basename(path))


def unload_code(spark: SparkSession, path: str) -> None:
    """Forget shipped code: an archive leaves the import path of later tasks and of the driver, a module leaves the
    driver. Spark deletes no shipped file before the application ends, so workers that have it may go on using it."""
    sc, name = spark.sparkContext, os.path.basename(path)
    if name not in _shipped.get(sc.applicationId, ()):
        raise LookupError(f"{name} was not loaded")
    _shipped[sc.applicationId].remove(name)
    if name in sc._python_includes:
        sc._python_includes.remove(name)
    shipped = os.path.join(SparkFiles.getRootDirectory(), name)
    sys.path[:] = [p for p in sys.path if p != shipped]
    sys.modules.pop(os.path.splitext(name)[0], None)


def configuration(spark: SparkSession, xml: str | None = None) -> DataFrame:
    """(name, value): the session's settings; or (hosts, ports, executors, memory as names) of a cluster file's workers."""
    if xml is None:
        return spark.createDataFrame(sorted(spark.sparkContext.getConf().getAll()), "name string, value string")
    rows = [(f"{k}.{e.tag}", (e.text or "").strip()) for k, worker in enumerate(ET.fromstring(xml).iter("Worker")) for e in worker.iter() if e is not worker and (e.text or "").strip()]
    return spark.createDataFrame(rows, "name string, value string")


MODEL_TABLE = "deployed_models"
_MODEL_SCHEMA = "model string, owner string, model_type string, description string, size long, payload string, deploy_time timestamp"


def deploy_model(spark: SparkSession, model, name: str, description: str = "", table: str = MODEL_TABLE) -> None:
    """Store a model's description (``to_dict`` or ``to_json``) in a table. Names are words and unique for an owner."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name):
        raise ValueError("a model's name starts with a letter and holds letters, digits and _")
    owner = spark.sparkContext.sparkUser()
    if spark.catalog.tableExists(table) and not spark.table(table).where((F.col("model") == name) & (F.col("owner") == owner)).isEmpty():
        raise ValueError(f"{owner} has a model {name} already")
    payload = json.dumps(model.to_dict()) if hasattr(model, "to_dict") else model.to_json()
    row = [(name, owner, type(model).__name__, description, len(payload), payload)]
    df = spark.createDataFrame(row, "model string, owner string, model_type string, description string, size long, payload string").withColumn("deploy_time", F.current_timestamp())
    df.write.mode("append").saveAsTable(table)


def stored_model(spark: SparkSession, name: str, table: str = MODEL_TABLE) -> dict:
    row = spark.table(table).where(F.col("model") == name).select("payload").first()
    if row is None:
        raise KeyError(name)
    return json.loads(row[0])
