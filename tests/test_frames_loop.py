"""Frames with categories, lists, and the partition-wise loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.operators.array import DistArray
from rowloom.operators.dlist import DistList
from rowloom.operators.frame import DistFrame
from rowloom.operators.parallel import Split, Whole, foreach, split


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, c, k * 2, k % 2 == 0) for k, c in enumerate(["us", "de", None, "fr", "de", "us"])]
    return DistFrame.from_frame(spark.createDataFrame(rows, "k long, country string, a long, even boolean"), ["k"], ["country", "a", "even"], blocks=(2, 3))


def test_levels_and_factors(frame):
    assert [tuple(r) for r in frame.levels(["country"]).orderBy("code").collect()] == [("country", 1, "de"), ("country", 2, "fr"), ("country", 3, "us")]
    coded = frame.factored()
    assert [r["country"] for r in coded.df.orderBy("row_id").collect()] == [3, 1, None, 2, 1, 3]
    back = coded.unfactored()
    assert [r["country"] for r in back.df.orderBy("row_id").collect()] == ["us", "de", None, "fr", "de", "us"]
    assert coded.levels().count() == 5
    with pytest.raises(ValueError):
        frame.levels(["nope"])
    with pytest.raises(TypeError):
        frame.reduced("sum")


def test_frame_numbers(spark):
    f = DistFrame.constant(spark, 5, 2, 3.0)
    assert f.reduced("sum").first()[0] == 30 and (f + 1 - f).reduced("max").first()[0] == 1 and (10 - f).reduced("min").first()[0] == 7
    assert f.filled(1).df.agg(F.sum("X1")).first()[0] == 5 and f.renamed(["p", "q"]).df.columns == ["row_id", "p", "q"]
    assert f.head(0).isEmpty() and f.head(-3).isEmpty() and f.tail(2).count() == 2 and f.get_partition(1).count() == 5
    with pytest.raises(ValueError):
        f.renamed(["p", "p"])
    with pytest.raises(ValueError):
        f + DistFrame.constant(spark, 4, 2)


def test_list(spark):
    x = DistList.empty(spark, 3).with_partition(2, [1, {"a": [2]}]).with_partition(3, ["z"])
    assert x.partition(2) == [1, {"a": [2]}] and x.partition(1) == [] and x.with_partition(2, []).partition(2) == []
    with pytest.raises(IndexError):
        x.with_partition(4, [])


def test_loop(spark):
    x = DistArray.constant(spark, 6, 2, 1.0, blocks=(2, 2))

    def task(part, every, i, pair):
        return {"s": pd.DataFrame({"v": [part["c1"].sum() * i + len(every)]}), "n": pd.DataFrame({"m": [len(pair), len(pair[0])]})}

    out = foreach(spark, [1, 2, 3], task, {"part": Split(x), "every": Whole(x), "i": lambda i: i * 10, "pair": Split(x, lambda i: [i, i % 3 + 1])}, {"s": "v double", "n": "m long"}, {"s": lambda i: i + 5})
    assert sorted((r["pid"], r["v"]) for r in out["s"].collect()) == [(6, 26.0), (7, 46.0), (8, 66.0)]
    assert [r["m"] for r in out["n"].orderBy("pid", "pos").collect()] == [2, 2] * 3


def test_loop_checks(spark):
    x = DistArray.constant(spark, 2, 1)
    ok = lambda part: {"o": pd.DataFrame({"v": [1.0]})}
    with pytest.raises(ValueError, match="same partition"):
        foreach(spark, [1, 2], ok, {"part": Split(x)}, {"o": "v double"}, {"o": lambda i: 1})
    with pytest.raises(ValueError, match="no output"):
        foreach(spark, [1], ok, {"part": Split(x)}, {"o": "v double"}, {"p": lambda i: i})
    with pytest.raises(ValueError, match="differ"):
        foreach(spark, [1], ok, {"other": Split(x)}, {"o": "v double"})
    with pytest.raises(ValueError):
        foreach(spark, [], ok, {"part": Split(x)}, {"o": "v double"})
    with pytest.raises(NotImplementedError):
        split(x)

    def broken(part):
        raise RuntimeError("task failed")

    with pytest.raises(Exception, match="task failed"):
        foreach(spark, [1], broken, {"part": Split(x)}, {"o": "v double"})
    assert x.sum() == 0


def test_loop_parts_are_in_order(spark):
    n = 2000
    x = DistArray.from_numpy(spark, np.arange(float(n)).reshape(n, 1), (500, 1))
    mixed = x._like(x.df.repartition(8, F.xxhash64("row_id")))
    cells = x._like(mixed.to_coo().df, "coo")

    def task(part, pair, cells, every):
        return {"o": [float((np.diff(t.to_numpy()) == 1).all()) for t in (part["c1"], pair[0]["c1"], pair[1]["c1"], cells["v"], every["c1"])]}

    out = foreach(spark, range(1, 5), task, {"part": Split(mixed), "pair": Split(mixed, lambda i: [i, i % 4 + 1]), "cells": Split(cells), "every": Whole(mixed)}, {"o": "v double"})["o"]
    assert [r["v"] for r in out.collect()] == [1.0] * 20
