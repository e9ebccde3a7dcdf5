"""Registered queries of the SQL client: what users of a pass-through client run, on Spark SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, scratch_root
from ..sources import files, tables
from ..sources.sqlclient import Channel
from ..operators.array import DistArray
from ..operators.graph import Graph
from ..streaming import events
from .arrays import LINE_KEYS, _IDS, table

NAMES = "region nation customer supplier part orders lineitem events embeddings labels documents".split()
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The same text runs on both engines.
SUITE = {
    "sql_inner_join": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_full_join": "SELECT coalesce(s_nationkey, c_nationkey) AS k, count(s_suppkey) AS s, count(c_custkey) AS c FROM supplier FULL JOIN (SELECT min(c_custkey) AS c_custkey, c_nationkey FROM customer GROUP BY c_nationkey) x ON s_nationkey = c_nationkey GROUP BY 1",
    "sql_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "sql_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_self_join": "SELECT a.o_custkey AS c, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey",
    "sql_asof_by_window": "SELECT event_id, user_id, max(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events",
    "sql_window_rank": "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "sql_window_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "sql_window_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_key FROM orders",
    "sql_window_ntile": "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS q FROM supplier",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT coalesce(c_mktsegment, 'all') AS seg, coalesce(c_nationkey, -1) AS nat, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "sql_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_distinct_aggregate": "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_union_all": "SELECT n_name AS k FROM nation UNION ALL SELECT r_name FROM region",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_case_decode": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    "sql_scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "sql_cte": "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM t WHERE s > (SELECT avg(s) FROM t)",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
}


def _channel(spark: SparkSession, d: str, sql: str = "") -> Channel:
    for name in NAMES:
        if not sql or name in sql:
            table(spark, d, name).createOrReplaceTempView(name)
    return Channel(spark)


def _pass_through(name: str, sql: str):
    def run(spark, d):
        return _channel(spark, d, sql).query(sql)

    run.__name__ = name
    return run


for _name, _sql in SUITE.items():
    QUERIES[_name], SQL[_name] = _pass_through(_name, _sql), _sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _new_table() -> str:
    return f"t_{uuid.uuid4().hex[:10]}"


def _kept(ch: Channel, name: str):
    out = materialise(ch.fetch(name), "client")
    ch.drop(name)
    return out


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def client_save_append(spark, d):
    ch, name, t = Channel(spark), _new_table(), table(spark, d, "nation").select("n_nationkey", "n_name")
    ch.save(t, name)
    ch.save(t.select((F.col("n_nationkey") + 100).cast("int").alias("n_nationkey"), "n_name"), name, append=True)
    return _kept(ch, name)


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 0 ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier")
def client_update(spark, d):
    ch, name, t = Channel(spark), _new_table(), table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    ch.save(t, name)
    ch.update(name, t.where("s_nationkey < 5").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), ["s_suppkey"])
    return _kept(ch, name)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def client_copy_query(spark, d):
    name = _new_table()
    ch = _channel(spark, d, "nation")
    ch.copy_query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", name)
    return _kept(ch, name)


@query("SELECT n_nationkey, n_name FROM nation WHERE false")
def client_copy_structure_clear(spark, d):
    ch, a, b = Channel(spark), _new_table(), _new_table()
    ch.save(table(spark, d, "nation").select("n_nationkey", "n_name"), a)
    ch.copy_structure(a, b)
    ch.clear(a)
    out = materialise(ch.fetch(a).unionByName(ch.fetch(b)), "client")
    ch.drop(a)
    ch.drop(b)
    return out


@query("SELECT 1 AS position, 'a' AS column_name, 'int' AS type_name, true AS nullable UNION ALL SELECT 2, 'b', 'string', true")
def client_columns(spark, d):
    ch, name = Channel(spark), _new_table()
    ch.save(spark.createDataFrame([], "a int, b string"), name)
    out = ch.columns(name)
    ch.drop(name)
    return out


@query("SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders WHERE o_totalprice > 150000")
def client_parameters(spark, d):
    ch = _channel(spark, d, "orders")
    return ch.query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > :low", {"low": 150000}, na_strings=["5-LOW"])


# -- loaders -----------------------------------------------------------------------------------------------------------


@query(f"SELECT {_IDS} AS row_id, l_extendedprice AS c1, l_discount AS c2 FROM lineitem")
def load_features_except(spark, d):
    return tables.table_to_array(spark, table(spark, d, "lineitem"), LINE_KEYS, ["l_extendedprice", "l_discount", "l_tax"], ["L_TAX"]).df


@query(f"SELECT {_IDS} AS row_id, l_quantity AS y, l_discount AS x FROM lineitem")
def load_response_predictors(spark, d):
    y, x = tables.table_to_arrays(spark, table(spark, d, "lineitem"), LINE_KEYS, ["l_quantity"], ["l_discount", "l_tax"], ["l_tax"])
    return y.df.withColumnRenamed("c1", "y").join(x.df.withColumnRenamed("c1", "x"), "row_id")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_name, c_acctbal FROM customer")
def load_frame(spark, d):
    return tables.table_to_frame(spark, table(spark, d, "customer"), ["c_custkey"], ["c_name", "c_acctbal"]).df


@query("WITH l AS (SELECT c_mktsegment AS s, dense_rank() OVER (ORDER BY c_mktsegment) AS k, c_custkey FROM customer) SELECT c_custkey, CAST(k = 4 AS INTEGER) AS c_mktsegment_4, CAST(k = 3 AS INTEGER) AS c_mktsegment_3, CAST(k = 2 AS INTEGER) AS c_mktsegment_2, CAST(k = 1 AS INTEGER) AS c_mktsegment_1 FROM l")
def dummy_encoding(spark, d):
    return tables.dummy_columns(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"])


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, CAST(count(*) AS DOUBLE) AS x, round(sum(l_quantity), 2) AS w FROM lineitem GROUP BY ALL")
def load_edges(spark, d):
    return Graph.from_edges(_edges(spark, d), "src", "dst", "w").edges.withColumn("w", F.round("w", 2))


@query("SELECT l_suppkey AS src, CAST(count(*) AS DOUBLE) AS degree FROM lineitem GROUP BY ALL")
def graph_out_degree(spark, d):
    return Graph.from_edges(_edges(spark, d), "src", "dst").out_degree()


def _path(spark) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


@query("SELECT CAST(n_nationkey AS BIGINT) AS a, n_name AS b FROM nation")
def csv_round_trip(spark, d):
    path = _path(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path, sep=";")
    return files.csv_frame(spark, path, "a:int64,b:character", ";")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def orc_round_trip(spark, d):
    path = _path(spark)
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.orc(path)
    return files.orc_frame(spark, path)


@query("SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL")
def triplet_round_trip(spark, d):
    t = table(spark, d, "lineitem")
    top = t.agg(F.max("l_suppkey"), F.max("l_partkey")).first()
    x = DistArray.from_coo(t.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")), (top[0] + 1, top[1] + 1), blocks=(64, 1024))
    path = _path(spark)
    files.save_triplets(x, path)
    return files.load_triplets(spark, path, x.dim).df


@query("SELECT o_custkey % 97 AS src, o_orderkey % 89 AS dst, CAST(count(*) AS DOUBLE) AS x, round(sum(round(o_totalprice, 2)), 2) AS w FROM orders GROUP BY ALL")
def edge_file_round_trip(spark, d):
    raw, parts = _path(spark), _path(spark)
    t = table(spark, d, "orders")
    line = F.concat_ws(" ", (F.col("o_custkey") % 97).cast("string"), (F.col("o_orderkey") % 89).cast("string"), F.round("o_totalprice", 2).cast("string"))
    t.select(line.alias("value")).unionByName(spark.createDataFrame([("# a comment",)], "value string")).write.text(raw)
    files.split_edges(files.edge_lines(spark, raw), parts, 20)
    return files.edges_graph(spark, parts, 97, True, 20).edges.withColumn("w", F.round("w", 2))


# -- events ------------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    t = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.window_counts(t).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    t = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(t).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_stream_totals(spark, d):
    source, name = _path(spark), f"s_{uuid.uuid4().hex[:10]}"
    t = table(spark, d, "events")
    t.write.parquet(source)
    stream = events.stream_events(spark, source, t.schema)
    out = events.drain(events.window_counts(stream, "1 hour", "30 days"), name, _path(spark), "complete")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
