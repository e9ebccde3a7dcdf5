"""Registered queries on arrays, frames, lists and the partition-wise loop, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.array import DistArray, reduce_blocks
from ..operators.dlist import DistList
from ..operators.frame import DistFrame
from ..operators.parallel import Split, foreach

FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Lines may share their first four keys, so the order goes on with all other columns; what still ties is equal.
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_IDS = f"row_number() OVER (ORDER BY {', '.join(LINE_KEYS)}) - 1"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, d) -> DistArray:
    return DistArray.unordered(table(spark, d, "lineitem"), FOUR)


def _orders(spark, d) -> DistArray:
    return DistArray.from_frame(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"], blocks=(100, 2))


def _lines(spark, d, columns=("l_quantity", "l_tax")) -> DistArray:
    return DistArray.from_frame(table(spark, d, "lineitem"), list(columns), LINE_KEYS)


def _sales(spark, d, value: str = "l_quantity") -> DistArray:
    """Supplier x part, quantities summed: sparse."""
    t = table(spark, d, "lineitem")
    top = t.agg(F.max("l_suppkey"), F.max("l_partkey")).first()
    return DistArray.from_coo(t.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col(value).alias("v")), (top[0] + 1, top[1] + 1))


def _rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    for c in names or ("value",):
        df = df.withColumn(c, F.round(c, digits))
    return df


_CELLS = " UNION ALL ".join(f"SELECT {c} v FROM lineitem" for c in FOUR)


@query(f"SELECT round(sum(v), 2) AS value FROM ({_CELLS})")
def array_sum(spark, d):
    return _rounded(_items(spark, d).sum_frame(), 2)


@query(f"SELECT min(v) AS value FROM ({_CELLS})")
def array_min(spark, d):
    return _items(spark, d).min_frame()


@query(f"SELECT max(v) AS value FROM ({_CELLS})")
def array_max(spark, d):
    return _items(spark, d).max_frame()


@query(f"SELECT round(avg(v), 4) AS value FROM ({_CELLS})")
def array_mean(spark, d):
    return _rounded(_items(spark, d).mean_frame())


@query(f"SELECT round(sqrt(sum(v * v)), 2) AS value FROM ({_CELLS})")
def array_norm(spark, d):
    return _rounded(_items(spark, d).norm_frame(), 2)


@query("SELECT CASE WHEN count(*) = count(nullif(l_discount, 0)) THEN sqrt(sum(l_discount * l_discount)) END AS missing, round(sqrt(sum(l_discount * l_discount)), 6) AS whole FROM lineitem")
def array_norm_missing(spark, d):
    t = table(spark, d, "lineitem").select("l_discount", F.nullif("l_discount", F.lit(0.0)).alias("v"))
    k = lambda c, n: DistArray.unordered(t, [c]).norm_frame().select(F.lit(1).alias("k"), F.round("value", 6).alias(n))
    return k("v", "missing").join(k("l_discount", "whole"), "k").drop("k")


@query("SELECT l_suppkey AS i, l_partkey AS j, CASE WHEN count(*) = count(nullif(l_discount, 0)) THEN round(sum(l_discount), 4) END AS v FROM lineitem GROUP BY ALL")
def sparse_triplets_missing(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.nullif("l_discount", F.lit(0.0)).alias("v"))
    top = t.agg(F.max("i"), F.max("j")).first()
    return _rounded(DistArray.from_coo(t, (top[0] + 1, top[1] + 1)).df, 4, "v")


@query(
    "WITH a AS (SELECT l_suppkey i, l_linenumber k, CASE WHEN count(*) = count(nullif(l_discount, 0)) THEN sum(l_discount) END v FROM lineitem GROUP BY ALL), b AS (SELECT l_linenumber k, ascii(l_returnflag) j, sum(l_quantity) v FROM lineitem GROUP BY ALL) "
    "SELECT i, CAST(j AS BIGINT) AS j, CASE WHEN count(*) = count(a.v) THEN round(sum(a.v * b.v), 2) END AS v FROM a JOIN b USING (k) GROUP BY ALL"
)
def matrix_product_missing(spark, d):
    t = table(spark, d, "lineitem")
    top = t.agg(F.max("l_suppkey"), F.max("l_linenumber")).first()
    a = DistArray.from_coo(t.select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j"), F.nullif("l_discount", F.lit(0.0)).alias("v")), (top[0] + 1, top[1] + 1))
    b = DistArray.from_coo(t.select(F.col("l_linenumber").alias("i"), F.ascii("l_returnflag").alias("j"), F.col("l_quantity").alias("v")), (top[1] + 1, 128))
    return _rounded((a @ b).df, 2, "v")


@query("SELECT l_suppkey AS i, l_partkey AS j, round(greatest(sum(l_quantity), 100 * sum(l_tax)) * sum(l_discount), 4) AS v FROM lineitem GROUP BY ALL")
def reduce_blocks_by_function(spark, d):
    """An associative function of the caller, here max of the first two and then the product with the third."""
    a, b, c = _sales(spark, d), 100 * _sales(spark, d, "l_tax"), _sales(spark, d, "l_discount")
    out = reduce_blocks([reduce_blocks([a, b], F.greatest), c], lambda x, y: x * y)
    return _rounded(out.df, 4, "v")


@query("SELECT CAST(NULL AS DOUBLE) AS strict, round(sum(nullif(l_discount, 0)), 4) AS removed, round(avg(nullif(l_discount, 0)), 6) AS removed_mean, max(nullif(l_discount, 0)) AS removed_max FROM lineitem")
def array_missing_values(spark, d):
    x = DistArray.unordered(table(spark, d, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("v")), ["v"])
    parts = [x.sum_frame().toDF("strict"), _rounded(x.sum_frame(True)).toDF("removed"), _rounded(x.mean_frame(True), 6).toDF("removed_mean"), x.max_frame(True).toDF("removed_max")]
    one = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        one = one.join(p.withColumn("k", F.lit(1)), "k")
    return one.drop("k")


def _by_column_sql(agg: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS j, round({agg}({c}), {digits}) AS value FROM lineitem" for k, c in enumerate(FOUR))


@query(_by_column_sql("sum", 2))
def array_col_sums(spark, d):
    return _rounded(_items(spark, d).col_sums(), 2)


@query(_by_column_sql("avg", 4))
def array_col_means(spark, d):
    return _rounded(_items(spark, d).col_means())


@query(f"SELECT {_IDS} AS i, round(l_quantity + l_extendedprice + l_discount + l_tax, 2) AS value FROM lineitem")
def array_row_sums(spark, d):
    return _rounded(_lines(spark, d, FOUR).row_sums(), 2)


@query(f"SELECT {_IDS} AS i, round((l_quantity + l_tax) / 2, 4) AS value FROM lineitem")
def array_row_means(spark, d):
    return _rounded(_lines(spark, d).row_means())


_ORDER_ROWS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_totalprice AS c1, CAST(o_custkey AS DOUBLE) AS c2 FROM orders"


@query(f"SELECT * FROM ({_ORDER_ROWS}) WHERE row_id < 25")
def array_head(spark, d):
    return _orders(spark, d).head(25.7)


@query(f"SELECT * FROM ({_ORDER_ROWS}) WHERE row_id >= (SELECT count(*) FROM orders) - 12")
def array_tail(spark, d):
    return _orders(spark, d).tail(12)


@query(f"SELECT * FROM ({_ORDER_ROWS}) WHERE row_id < (SELECT count(*) FROM orders) - 990")
def array_head_negative(spark, d):
    return _orders(spark, d).head(-990)


@query("SELECT CAST(first(p) AS BIGINT) AS value FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) * 2 + 1 AS p, o_totalprice AS v, o_orderkey FROM orders UNION ALL SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) * 2 + 2, o_custkey, o_orderkey FROM orders ORDER BY v DESC, p LIMIT 1)")
def array_argmax(spark, d):
    return _orders(spark, d).argmax_frame()


@query(f"SELECT {_IDS} AS row_id, round(l_quantity * 3 + 2 + l_quantity, 4) AS c1, round(l_tax * 3 + 2 + l_tax, 4) AS c2 FROM lineitem")
def array_scale_and_add(spark, d):
    x = _lines(spark, d)
    return _rounded((3 * x + 2 + x).df, 4, "c1", "c2")


@query(f"SELECT {_IDS} AS row_id, round(1 - l_quantity * l_quantity, 4) AS c1, round(1 - l_tax * l_tax, 6) AS c2 FROM lineitem")
def array_subtract_power(spark, d):
    x = (1 - _lines(spark, d).power(2)).df
    return x.select("row_id", F.round("c1", 4).alias("c1"), F.round("c2", 6).alias("c2"))


@query("SELECT true AS same, (SELECT count(*) = 0 FROM lineitem WHERE l_quantity IS DISTINCT FROM l_quantity + 0 * l_tax) AS shifted_back, false AS other")
def array_equality(spark, d):
    x = _lines(spark, d)
    one = lambda a, b, n: a.equal_frame(b).select(F.lit(1).alias("k"), F.col("equal").alias(n))
    return one(x, x, "same").join(one(x, x - 0, "shifted_back"), "k").join(one(x, x + 1, "other"), "k").drop("k")


@query("SELECT l_suppkey AS i, l_partkey AS j, round(sum(l_quantity) + sum(l_tax), 4) AS v FROM lineitem GROUP BY ALL")
def sparse_add(spark, d):
    return _rounded((_sales(spark, d) + _sales(spark, d, "l_tax")).df, 4, "v")


@query("SELECT l_suppkey AS i, l_partkey AS j, round(sum(l_quantity) - 2 * sum(l_tax), 4) AS v FROM lineitem GROUP BY ALL")
def sparse_subtract(spark, d):
    return _rounded((_sales(spark, d) - 2 * _sales(spark, d, "l_tax")).df, 4, "v")


@query("WITH c AS (SELECT -sum(l_quantity) v FROM lineitem GROUP BY l_suppkey, l_partkey), n AS (SELECT (max(l_suppkey) + 1) * (max(l_partkey) + 1) k FROM lineitem) SELECT CASE WHEN (SELECT count(*) FROM c) < (SELECT k FROM n) THEN greatest(max(v), 0) ELSE max(v) END AS top, CASE WHEN (SELECT count(*) FROM c) < (SELECT k FROM n) THEN least(min(v), 0) ELSE min(v) END AS bottom FROM c")
def sparse_extremes_with_zeros(spark, d):
    x = -1 * _sales(spark, d)
    k = lambda df, n: df.select(F.lit(1).alias("k"), F.col("value").alias(n))
    return k(x.max_frame(), "top").join(k(x.min_frame(), "bottom"), "k").drop("k")


@query("WITH c AS (SELECT l_suppkey i, sum(l_quantity) v FROM lineitem GROUP BY ALL), n AS (SELECT max(l_suppkey) + 1 a, max(l_partkey) + 1 b FROM lineitem) SELECT k.i, round(coalesce(v, 0) / (SELECT b FROM n), 6) AS value FROM (SELECT unnest(range((SELECT a FROM n))) i) k LEFT JOIN c USING (i)")
def sparse_row_means(spark, d):
    return _rounded(_sales(spark, d).row_means(), 6)


@query("SELECT l_suppkey AS i, CAST(substr(p_brand, 7) AS BIGINT) AS j, round(sum(l_quantity * p_size), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def matrix_product(spark, d):
    a = _sales(spark, d)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.substring("p_brand", 7, 9).cast("long").alias("j"), F.col("p_size").cast("double").alias("v"))
    b = DistArray.from_coo(part, (a.ncol, 100))
    return _rounded((a @ b).df, 2, "v")


@query("WITH n AS (SELECT count(*) c FROM orders), k AS (SELECT unnest(range(0, CAST(ceil((SELECT c FROM n) / 100.0) AS BIGINT))) p) SELECT p + 1 AS pid, least(100, c - p * 100) AS n_rows, CAST(2 AS BIGINT) AS n_cols FROM k, n")
def block_sizes(spark, d):
    return _orders(spark, d).partition_sizes()


@query("WITH n AS (SELECT count(*) c FROM orders) SELECT p + 1 AS pid, p * 100 AS row_offset, CAST(0 AS BIGINT) AS col_offset FROM (SELECT unnest(range(0, CAST(ceil((SELECT c FROM n) / 100.0) AS BIGINT))) p)")
def block_offsets(spark, d):
    return _orders(spark, d).partition_offsets()


@query(f"SELECT * FROM ({_ORDER_ROWS}) WHERE row_id >= 300 AND row_id < 400")
def block_fetch(spark, d):
    return _orders(spark, d).get_partition(4)


@query(f"SELECT row_id // 100 + 1 AS pid, count(*) AS n, round(sum(c1), 2) AS total FROM ({_ORDER_ROWS}) GROUP BY ALL")
def block_numbers(spark, d):
    return _rounded(_orders(spark, d).with_pid().groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum("c1").alias("total")), 2, "total")


@query("SELECT range AS row_id, 2.5 AS c1, 2.5 AS c2 FROM range(1000)".replace("2.5", "CAST(2.5 AS DOUBLE)"))
def array_constant(spark, d):
    return DistArray.constant(spark, 1000, 2, 2.5, blocks=(300, 1)).df


@query("SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, CAST(0 AS DOUBLE) AS v FROM range(6) t(a), range(3) s(b)")
def array_clone_sparse(spark, d):
    return DistArray.constant(spark, 3, 3, sparse=True).clone(0.0, nrow=6, sparse=True).densified().df


@query("SELECT l_suppkey AS i, l_partkey AS j, greatest(sum(l_quantity), sum(l_tax)) AS v FROM lineitem GROUP BY ALL")
def reduce_blocks_max(spark, d):
    a, b = _sales(spark, d), _sales(spark, d, "l_tax")
    return reduce_blocks([a, b], "max").df


# -- frames ----------------------------------------------------------------------------------------------------------


def _frame(spark, d) -> DistFrame:
    t = table(spark, d, "lineitem")
    return DistFrame.from_frame(t, LINE_KEYS, ["l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"])


@query("SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY label) AS INTEGER) AS code, label FROM (SELECT DISTINCT 'l_returnflag' AS name, l_returnflag AS label FROM lineitem UNION ALL SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem)")
def frame_levels(spark, d):
    return _frame(spark, d).levels()


@query(f"SELECT {_IDS} AS row_id, CAST(dense_rank() OVER (ORDER BY l_returnflag) AS INTEGER) AS l_returnflag, l_quantity FROM lineitem")
def frame_factor(spark, d):
    return _frame(spark, d).factored(["l_returnflag"]).df.select("row_id", "l_returnflag", "l_quantity")


@query(f"SELECT {_IDS} AS row_id, l_returnflag, l_linestatus FROM lineitem")
def frame_unfactor(spark, d):
    return _frame(spark, d).factored().unfactored().df.select("row_id", "l_returnflag", "l_linestatus")


def _numbers(spark, d) -> DistFrame:
    return DistFrame.from_frame(table(spark, d, "lineitem"), LINE_KEYS, ["l_quantity", "l_linenumber"])


@query("SELECT round(sum(l_quantity) + sum(l_linenumber), 2) AS total, greatest(max(l_quantity), max(l_linenumber)) AS top, least(min(l_quantity), min(l_linenumber)) AS bottom FROM lineitem")
def frame_reductions(spark, d):
    f = _numbers(spark, d)
    k = lambda kind, n: f.reduced(kind).select(F.lit(1).alias("k"), F.round("value", 2).alias(n))
    return k("sum", "total").join(k("max", "top"), "k").join(k("min", "bottom"), "k").drop("k")


@query("SELECT 'l_quantity' AS name, round(avg(l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'l_linenumber', round(avg(l_linenumber), 4) FROM lineitem")
def frame_col_means(spark, d):
    return _rounded(_numbers(spark, d).by_column("mean"))


@query("SELECT 'l_quantity' AS name, round(sum(l_quantity), 2) AS value FROM lineitem UNION ALL SELECT 'l_linenumber', round(sum(l_linenumber), 2) FROM lineitem")
def frame_col_sums(spark, d):
    return _rounded(_numbers(spark, d).by_column("sum"), 2)


@query(f"SELECT {_IDS} AS row_id, round(l_quantity + l_linenumber, 4) AS value FROM lineitem")
def frame_row_sums(spark, d):
    return _rounded(_numbers(spark, d).by_row("sum"))


@query(f"SELECT {_IDS} AS row_id, l_quantity + 10 - l_quantity AS l_quantity, CAST(l_linenumber + 10 - l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem")
def frame_arithmetic(spark, d):
    f = _numbers(spark, d)
    return ((f + 10) - f).df.select("row_id", "l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber"))


@query(f"SELECT * FROM (SELECT {_IDS} AS row_id, l_quantity, l_linenumber FROM lineitem) WHERE row_id < 7 OR row_id >= (SELECT count(*) FROM lineitem) - 3")
def frame_head_tail(spark, d):
    f = _numbers(spark, d)
    return f.head(7).unionByName(f.tail(3)).unionByName(f.head(0))


# -- lists and the loop ------------------------------------------------------------------------------------------------


@query("SELECT CAST(range + 1 AS BIGINT) AS pid, CAST(CASE WHEN range = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_items FROM range(3)")
def list_sizes(spark, d):
    return DistList.empty(spark, 3).with_partition(2, ["a"]).with_partition(2, [{"x": 1}, [2, 3]]).partition_sizes()


@query(f"SELECT row_id // 500 + 1 AS pid, CAST(count(*) AS BIGINT) AS n, round(max(c1) * (row_id // 500 + 1), 2) AS scaled FROM ({_ORDER_ROWS}) GROUP BY row_id // 500")
def loop_over_blocks(spark, d):
    import pandas as pd

    x = DistArray.from_frame(table(spark, d, "orders"), ["o_totalprice"], ["o_orderkey"], blocks=(500, 1))

    def task(part, i):
        return {"out": pd.DataFrame({"n": [len(part)], "scaled": [round(float(part["c1"].max()) * i, 2)]})}

    out = foreach(spark, range(1, x.npartitions + 1), task, {"part": Split(x), "i": lambda i: i}, {"out": "n long, scaled double"})
    return out["out"].select("pid", "n", "scaled")


@query(
    f"WITH b AS (SELECT row_id // 500 + 1 pid, row_id - (row_id // 500) * 500 k, c1, c2 FROM ({_ORDER_ROWS})) SELECT 'matrix' AS name, pid, CAST(0 AS BIGINT) AS pos, round(sum(c1), 2) AS v FROM b GROUP BY pid UNION ALL SELECT 'matrix', pid, 1, round(sum(c2), 2) FROM b GROUP BY pid "
    "UNION ALL SELECT 'vector', pid, k, round(c1 + c2, 2) FROM b WHERE k < 3 UNION ALL SELECT 'list', pid, CAST(0 AS BIGINT), CAST(count(*) AS DOUBLE) FROM b GROUP BY pid"
)
def loop_updates_of_each_kind(spark, d):
    """A loop with three outputs: a matrix, a vector and a list."""
    import numpy as np

    def task(part):
        m = part[["c1", "c2"]].to_numpy()
        return {"matrix": np.round(m.sum(axis=0), 2).reshape(2, 1), "vector": np.round(m.sum(axis=1)[:3], 2), "list": [float(len(m))]}

    x = DistArray.from_frame(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"], blocks=(500, 2))
    out = foreach(spark, range(1, x.npartitions + 1), task, {"part": Split(x)}, {n: "v double" for n in ("matrix", "vector", "list")})
    parts = [t.select(F.lit(n).alias("name"), "pid", "pos", "v") for n, t in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT g.pid, round(g.s - h.s, 2) AS diff FROM (SELECT row_id // 500 + 1 pid, sum(c1) s FROM ({_ORDER_ROWS}) GROUP BY 1) g JOIN (SELECT row_id // 500 + 1 pid, sum(c2) s FROM ({_ORDER_ROWS}) GROUP BY 1) h USING (pid)")
def loop_over_aligned_blocks(spark, d):
    import pandas as pd

    t = table(spark, d, "orders")
    a = DistArray.from_frame(t, ["o_totalprice"], ["o_orderkey"], blocks=(500, 1))
    b = DistArray.from_frame(t, ["o_custkey"], ["o_orderkey"], blocks=(500, 1))

    def task(left, right):
        return {"out": pd.DataFrame({"diff": [round(float(left["c1"].sum() - right["c1"].sum()), 2)]})}

    out = foreach(spark, range(1, a.npartitions + 1), task, {"left": Split(a), "right": Split(b)}, {"out": "diff double"})
    return out["out"].select("pid", "diff")
