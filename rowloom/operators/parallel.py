"""The partition-wise loop: a function runs once for each index over aligned partitions of distributed objects.

It becomes one grouped map. Inputs are tagged and united, so any number of them is aligned by one shuffle on the task
number. Outputs are typed columns of one table, one struct for each output. A function may return a pandas frame, a
matrix, a vector or a list for an output. A failing task fails the job and nothing is changed, as frames are immutable.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..scratch import materialise

#: A whole object goes to every task only up to this many rows.
WHOLE_ROWS = 1_000_000


@dataclass(frozen=True)
class Split:
    """For task i, partition i of ``source``; or the partitions that ``pick(i)`` lists. Functions get a pandas frame, in
    the order of positions where the source has them (arrays and frames)."""

    source: object  # anything with with_pid(), or a DataFrame with pid
    pick: Callable[[int], int | list[int]] | None = None

    def table(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source.with_pid()


@dataclass(frozen=True)
class Whole:
    """All of ``source`` for every task."""

    source: object

    def frame(self) -> pd.DataFrame:
        df = self.source if isinstance(self.source, DataFrame) else self.source.df
        rows = df.limit(WHOLE_ROWS + 1).toPandas()
        if len(rows) > WHOLE_ROWS:
            raise MemoryError(f"a whole object of more than {WHOLE_ROWS} rows cannot go to every task; join it instead")
        return _in_place(rows, _places(self.source, df.columns))


def split(x):
    raise NotImplementedError("use Split(x) to name the partitions of a distributed object")


def foreach(spark: SparkSession, indexes: Iterable[int], func: Callable, inputs: dict[str, object], outputs: dict[str, str], writes: dict[str, Callable[[int], int]] | None = None, scheduler: int = 0) -> dict[str, DataFrame]:
    """Run ``func(**arguments)`` for each index and gather what it returns.

    ``inputs``: Split, Whole, a function of the index, or a plain value. ``outputs``: name -> columns as DDL; ``func``
    returns a dict of pandas frames, or of what ``_as_frame`` turns into one. ``scheduler`` (0 or 1) is accepted and
    changes nothing: placement is Spark's. ``writes`` says which partition of an output a task sets (its index by default);
    two tasks that set the same one are an error before anything runs. Returns name -> DataFrame (pid, columns).
    """
    if scheduler not in (0, 1):
        raise ValueError("scheduler must be 0 or 1")
    indexes = list(indexes)
    if not indexes:
        raise ValueError("no index to run over")
    parameters = inspect.signature(func).parameters
    if set(parameters) != set(inputs):
        raise ValueError(f"arguments {sorted(parameters)} and inputs {sorted(inputs)} differ")
    writes = writes or {}
    if unknown := set(writes) - set(outputs):
        raise ValueError(f"no output {sorted(unknown)}")
    targets = {name: {i: writes.get(name, lambda i: i)(i) for i in indexes} for name in outputs}
    for name, to in targets.items():
        if len(set(to.values())) < len(to):
            raise ValueError(f"several tasks set the same partition of {name}")

    splits = {k: v for k, v in inputs.items() if isinstance(v, Split)}
    whole = {k: v.frame() for k, v in inputs.items() if isinstance(v, Whole)}
    plain = {k: v for k, v in inputs.items() if not isinstance(v, Split | Whole)}
    every = spark.createDataFrame([(i,) for i in indexes], "__task long").select("__task", F.lit("").alias("__tag"), F.lit(0).cast("long").alias("__part"))
    columns: dict[str, list[str]] = {}
    places: dict[str, list[str]] = {}
    for name, s in splits.items():
        table = s.table()
        pairs = [(i, p) for i in indexes for p in _listed(s.pick(i) if s.pick else i)]
        tasks = F.broadcast(spark.createDataFrame(pairs, "__task long, __part long"))  # as long as the driver's list of indexes
        own = [c for c in table.columns if c != "pid"]
        columns[name], places[name] = own, _places(s.source, own)
        tagged = table.join(tasks, table["pid"] == tasks["__part"]).select("__task", F.lit(name).alias("__tag"), "__part", *[F.col(c).alias(f"{name}__{c}") for c in own])
        every = every.unionByName(tagged, allowMissingColumns=True)

    picks = {name: s.pick for name, s in splits.items()}  # what tasks need of the splits: no frames
    fields = {n: StructType.fromDDL(ddl) for n, ddl in outputs.items()}
    schema = StructType([StructField("tag", StringType()), StructField("pid", LongType()), StructField("pos", LongType()), *[StructField(f"r_{n}", t) for n, t in fields.items()]])
    arrow = to_arrow_schema(schema)

    def task(key: tuple, table: pa.Table) -> pa.Table:
        i, rows = key[0].as_py(), table.to_pandas()
        arguments = dict(whole)
        for k, v in plain.items():
            arguments[k] = v(i) if callable(v) else v
        for k in picks:
            own = _in_place(rows[rows["__tag"] == k], [f"{k}__{c}" for c in places[k]])  # a shuffle keeps no order
            part = own[[f"{k}__{c}" for c in columns[k]]].set_axis(columns[k], axis=1)
            arguments[k] = part.reset_index(drop=True) if picks[k] is None else [part[own["__part"] == p].reset_index(drop=True) for p in _listed(picks[k](i))]
        result = func(**arguments)
        if set(result) - set(outputs):
            raise ValueError(f"outputs {sorted(set(result) - set(outputs))} were not declared")
        parts = []
        for name, value in result.items():
            frame = _as_frame(value, fields[name].names)
            own = {c: pa.array(frame[c], arrow.field(f"r_{name}").type.field(c).type, from_pandas=True) for c in fields[name].names}
            column = pa.StructArray.from_arrays(list(own.values()), fields=[arrow.field(f"r_{name}").type.field(c) for c in own])
            n = len(frame)
            head = [pa.array([name] * n, pa.string()), pa.array([targets[name][i]] * n, pa.int64()), pa.array(np.arange(n), pa.int64())]
            parts.append(pa.Table.from_arrays([*head, *[column if o == name else pa.nulls(n, arrow.field(f"r_{o}").type) for o in fields]], schema=arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()

    done = materialise(every.groupBy("__task").applyInArrow(task, schema), "foreach")
    return {name: done.where(F.col("tag") == name).select("pid", "pos", f"r_{name}.*") for name in outputs}


def _places(source, columns: list[str]) -> list[str]:
    """The columns that say where a row stands: none for a plain DataFrame."""
    if isinstance(source, DataFrame):
        return []
    return ["row_id"] if "row_id" in columns else [c for c in ("i", "j") if c in columns]


def _in_place(rows: pd.DataFrame, places: list[str]) -> pd.DataFrame:
    return rows.sort_values(places, kind="stable").reset_index(drop=True) if places else rows


def _as_frame(value, names: list[str]) -> pd.DataFrame:
    """A frame with the declared columns: as it is, a matrix by columns, a vector or list as the only column, a number
    as its only row."""
    if isinstance(value, pd.DataFrame):
        return value
    if isinstance(value, list | tuple):
        return pd.DataFrame({names[0]: pd.Series(list(value), dtype=object)})
    value = np.asarray(value)
    if value.ndim < 2:
        value = value.reshape(-1, 1)
    if value.shape[1] != len(names):
        raise ValueError(f"{value.shape[1]} columns for the declared {len(names)}")
    return pd.DataFrame(value, columns=names)


def _listed(x) -> list[int]:
    return list(x) if isinstance(x, list | tuple | range) else [x]
