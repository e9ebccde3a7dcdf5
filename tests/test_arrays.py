"""Arrays, grids and reductions against numpy, on fixed and on random shapes."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators.array import DistArray, reduce_blocks
from rowloom.operators.grid import Grid, with_row_id

A = np.zeros((4, 4))
A[1, [1, 2, 3]] = A[3, [1, 2]] = 1
B = np.zeros((4, 4))
for i, j in ((1, 1), (3, 1), (1, 2), (1, 3), (3, 2)):
    B[i, j] = 1
C = np.arange(1, 17, dtype=float).reshape(4, 4).T


def values(df, key):
    return [r["value"] for r in df.orderBy(key).collect()]


def test_fixed_matrices(spark):
    a, b, c = (DistArray.from_numpy(spark, m, (2, 2), sparse=s) for m, s in ((A, True), (B, True), (C, False)))
    assert (a @ b).fetch().tolist() == [[0, 0, 0, 0], [0, 2, 2, 1], [0, 0, 0, 0], [0, 1, 1, 1]]
    assert c.sum() == 136 and c.norm() == pytest.approx(38.67815921162743)
    assert values(c.col_sums(), "j") == [10, 26, 42, 58] and values(c.row_sums(), "i") == [28, 32, 36, 40]
    with pytest.raises(ValueError):
        a.matmul(DistArray.from_numpy(spark, np.ones((3, 2))))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("sparse", [False, True])
def test_random_shapes(spark, seed, sparse):
    rng = np.random.default_rng(seed)
    n, p = rng.integers(1, 12, 2)
    m = rng.integers(-3, 4, (n, p)).astype(float)
    o = rng.integers(-3, 4, (n, p)).astype(float)
    block = (int(rng.integers(1, n + 1)), int(rng.integers(1, p + 1)))
    x, y = DistArray.from_numpy(spark, m, block, sparse=sparse), DistArray.from_numpy(spark, o, block)
    for got, want in ((x.sum(), m.sum()), (x.max(), m.max()), (x.min(), m.min()), (x.mean(), m.mean()), (x.norm(), math.sqrt((m * m).sum()))):
        assert got == pytest.approx(want)
    assert values(x.col_means(), "j") == pytest.approx(m.mean(axis=0).tolist()) and values(x.row_means(), "i") == pytest.approx(m.mean(axis=1).tolist())
    for got, want in ((x + y, m + o), (x - y, m - o), (2 * x, 2 * m), (x + 1, m + 1), (3 - x, 3 - m), (x.power(2), m**2), (x.to_rows(), m)):
        assert np.array_equal(got.fetch(), want)
    assert x.equals(x) and x.equals(DistArray.from_numpy(spark, m)) and x.equals(y) == np.array_equal(m, o)
    assert sum(r["n_rows"] * r["n_cols"] for r in x.partition_sizes().collect()) == n * p
    part = x.densified().to_coo().get_partition(1)
    assert part.count() == min(block[0], n) * min(block[1], p)
    assert x.argmax_frame().first()[0] == int(m.argmax()) + 1


def test_missing_values_poison(spark):
    x = DistArray.from_numpy(spark, np.array([[1.0, np.nan], [3.0, 4.0]]))
    assert x.sum() is None and x.max() is None and x.mean() is None and values(x.col_sums(), "j") == [4, None] and values(x.row_means(), "i") == [None, 3.5]
    assert x.sum(True) == 8 and x.max(True) == 4 and x.mean(True) == pytest.approx(8 / 3) and values(x.row_sums(True), "i") == [1, 7]
    with pytest.raises(NotImplementedError):
        x.mean_frame(trim=0.1)


def test_sparse_zeros_count(spark):
    x = DistArray.from_coo(spark.createDataFrame([(0, 0, -2.0), (0, 0, -1.0), (1, 1, -4.0)], "i long, j long, v double"), (2, 2))
    assert x.max() == 0 and x.min() == -4 and x.sum() == -7 and x.mean() == -7 / 4
    assert np.array_equal((x + 1).fetch(), [[-2, 1], [1, -3]])


def test_head_tail_partitions(spark):
    x = DistArray.from_numpy(spark, np.arange(20.0).reshape(10, 2), (3, 1))
    ids = lambda df: sorted(r["row_id"] for r in df.collect())
    assert ids(x.head(2.9)) == [0, 1] and ids(x.head(-8)) == [0, 1] and ids(x.tail(2)) == [8, 9] and ids(x.head(0)) == [] and ids(x.tail(-9)) == [9]
    assert x.npartitions == 8 and x.npartitions2d == (4, 2)
    assert [tuple(r) for r in x.get_partition(4, 2).collect()] == [(9, 19.0)] and x.get_partition(8).count() == 1
    for bad in ((9,), (0,), (5, 1), (1, 3)):
        with pytest.raises(IndexError):
            x.get_partition(*bad)
    assert [tuple(r) for r in x.partition_offsets().orderBy("pid").collect()][:3] == [(1, 0, 0), (2, 0, 1), (3, 3, 0)]


def test_arguments(spark):
    for bad in ({"nrow": -1, "ncol": 2}, {"nrow": 2, "ncol": 2, "blocks": (0, 1)}, {"nrow": 2, "ncol": 2, "value": 1, "sparse": True}, {"nrow": 2, "ncol": 2, "blocks": (1, 1), "npartitions": 2}):
        with pytest.raises(ValueError):
            DistArray.constant(spark, **bad)
    with pytest.raises(TypeError):
        DistArray.constant(spark, 2, 2, "a")
    x, y = DistArray.constant(spark, 2, 3, 5), DistArray.constant(spark, 3, 2)
    for f in (lambda: x + y, lambda: x - y, lambda: x.equals(y)):
        with pytest.raises(ValueError):
            f()
    assert x.clone(1.0, nrow=4).dim == (4, 3) and x.clone().equals(x) and x.with_dimnames(["a", "b"], None).dimnames == (["a", "b"], None)
    with pytest.raises(ValueError):
        x.with_dimnames(["a"], None)
    assert reduce_blocks([x, x, x]).sum() == 90


def test_row_ids_follow_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = with_row_id(df, ["k"]).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1000)) and all(r["row_id"] == r["k"] for r in rows)
    assert with_row_id(df.limit(0), ["k"]).isEmpty()


def test_grid_arithmetic():
    g = Grid.of(10, 5, (4, 2))
    assert g.shape2d == (3, 3) and g.n == 9 and g.bounds(9) == (8, 10, 4, 5)
    with pytest.raises(ValueError):
        Grid.of(10**6, 10**6, (1, 1))


def test_missing_values_spread(spark):
    nan = float("nan")
    a = DistArray.from_numpy(spark, np.array([[1, nan], [2, 3]]))
    assert a.norm() is None and DistArray.from_numpy(spark, np.array([[1, 2], [2, 4]])).norm() == 5
    cells = {(r["i"], r["j"]): r["v"] for r in (a @ DistArray.from_numpy(spark, np.eye(2))).df.collect()}
    assert cells == {(0, 0): None, (0, 1): None, (1, 0): 2.0, (1, 1): 3.0}
    t = spark.createDataFrame([(0, 0, None), (0, 0, 2.0), (1, 1, 1.0), (1, 1, 4.0)], "i long, j long, v double")
    assert {(r["i"], r["j"]): r["v"] for r in DistArray.from_coo(t, (2, 2)).df.collect()} == {(0, 0): None, (1, 1): 5.0}


def test_arrays_without_order_have_no_positions(spark):
    x = DistArray.unordered(spark.range(1000).repartition(4).toDF("v"), ["v"])
    assert x.sum() == 499500 and (2 * x).max() == 1998
    for ask in (lambda: x.tail(5), lambda: x.head(5), lambda: x.row_sums(), lambda: x.get_partition(1), lambda: x.with_pid(), lambda: x + x, lambda: (x * 2).tail(1), lambda: x.fetch(), lambda: x.argmax_frame()):
        with pytest.raises(ValueError, match="positions"):
            ask()


def test_reduce_by_any_associative_function(spark):
    from rowloom.operators.array import reduce_blocks

    parts = [DistArray.from_numpy(spark, np.array([[k, 2.0], [k * k, 1]])) for k in (1, 2, 3)]
    assert (reduce_blocks(parts, lambda x, y: x + y + x * y).fetch() == [[23, 26], [99, 7]]).all()
    first = reduce_blocks(parts, lambda x, y: x).fetch()  # not commutative: the order of the parts
    assert (first == parts[0].fetch()).all() and (reduce_blocks(parts, "sum").fetch() == [[6, 6], [14, 3]]).all()


def _sparse_and_dense(spark, n, seed):
    rng = np.random.default_rng(seed)
    ms = [np.where(rng.random((5, 6)) < 0.3, rng.integers(-4, 5, (5, 6)), 0).astype(float) for _ in range(n)]
    return ms, [DistArray.from_numpy(spark, m, sparse=True) for m in ms]


@pytest.mark.parametrize("kind", ["sum", "max", "min", "product"])
def test_reduced_sparse_arrays_stay_sparse(spark, kind):
    ms, parts = _sparse_and_dense(spark, 3, 4)
    want = {"sum": np.sum, "max": np.max, "min": np.min, "product": np.prod}[kind](ms, axis=0)
    out = reduce_blocks(parts, kind)
    assert out.sparse and out.df.count() == int(np.any(ms, axis=0).sum()) < 30 and np.array_equal(out.fetch(), want)
    dense = reduce_blocks([DistArray.from_numpy(spark, ms[0]), *parts[1:]], kind)
    assert not dense.sparse and np.array_equal(dense.fetch(), want)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_functions_of_sparse_arrays(spark, n):
    ms, parts = _sparse_and_dense(spark, n, n)
    fold = lambda f: functools.reduce(f, ms)
    out = reduce_blocks(parts, lambda x, y: x + y + x * y)  # 0 of zeros: only stored cells
    assert out.sparse and out.df.count() == int(np.any(ms, axis=0).sum()) and np.array_equal(out.fetch(), fold(lambda x, y: x + y + x * y))
    first = reduce_blocks(parts, lambda x, y: x)  # not commutative
    assert first.sparse and np.array_equal(first.fetch(), ms[0])
    ones = reduce_blocks(parts, lambda x, y: x + y + 1)  # zeros give n - 1: every cell
    assert ones.sparse == (n == 1) and np.array_equal(ones.fetch(), fold(lambda x, y: x + y + 1))
    mixed = reduce_blocks([*parts, DistArray.from_numpy(spark, ms[0])], lambda x, y: x - y)
    assert not mixed.sparse and np.array_equal(mixed.fetch(), functools.reduce(lambda x, y: x - y, [*ms, ms[0]]))
