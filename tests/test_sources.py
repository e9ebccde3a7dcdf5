"""Loaders, files, the SQL client, sessions and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom import session
from rowloom.operators.array import DistArray
from rowloom.operators.graph import Graph
from rowloom.operators.kmeans import fit_kmeans
from rowloom.sources import files, tables
from rowloom.sources.sqlclient import Channel, unique_names
from rowloom.streaming import events


@pytest.fixture(scope="module")
def numeric(spark):
    df = spark.range(200).select(F.col("id").alias("rowid"), *[(F.col("id") * k).cast("double").alias(f"col{k}") for k in range(1, 4)], (F.col("id") % 3).cast("string").alias("kind"))
    df.createOrReplaceTempView("numeric_table")
    return df


def test_table_loaders(spark, numeric):
    x = tables.table_to_array(spark, "numeric_table", ["rowid"], ["rowid", "col1", "col2"], ["COL2"], npartitions=4)
    assert x.dim == (200, 2) and x.npartitions == 4 and x.max() == 199 and x.min() == 0
    y, p = tables.table_to_arrays(spark, numeric, ["rowid"], ["col1"], exclude=["kind", "rowid"])
    assert y.dim == (200, 1) and p.dimnames[1] == ["col2", "col3"] and (2 * y).equals(DistArray(p.df.select("row_id", "c1"), y.grid, "rows"))
    f = tables.table_to_frame(spark, "numeric_table", ["rowid"])
    assert f.dim == (200, 5) and f.levels(["kind"]).count() == 3
    a, b = tables.table_to_frames(spark, numeric, ["rowid"], ["kind"])
    assert a.names == ["kind"] and b.names == ["rowid", "col1", "col2", "col3"]
    assert tables.table_to_matrix(spark, numeric, ["col1", "col3"], ["rowid"]).shape == (200, 2)
    with pytest.raises(TypeError):
        tables.table_to_array(spark, numeric, ["rowid"], ["kind"])
    for bad in (lambda: tables.chosen(numeric, ["nope"]), lambda: tables.chosen(numeric, ["col1"], ["col1"]), lambda: tables.table_to_array(spark, numeric.limit(0), ["rowid"], ["col1"])):
        with pytest.raises(ValueError):
            bad()


def test_dummies(spark, numeric):
    out = tables.dummy_columns(numeric.withColumn("one", F.lit("x")), ["col1", "kind", "one"])
    assert out.columns == ["col1", "kind_2", "kind_1"] and out.agg(F.sum("kind_1")).first()[0] == 67
    assert tables.dummy_relation(spark, "numeric_table", ["kind", "col1"], "dummies", ["col1"]).columns == ["kind_2", "kind_1"]


def test_csv_and_orc(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1;h2\n# no\n000;aaa\n7;b\n")
    out = files.csv_frame(spark, f"{tmp_path}/*.csv", "a:int64,b:character", ";", skip_header=True)
    assert [tuple(r) for r in out.orderBy("a").collect()] == [(0, "aaa"), (7, "b")]
    for bad in ("a:text", ":integer", "a"):
        with pytest.raises(ValueError):
            files.csv_schema(bad)
    df = spark.sql("SELECT 1Y b, 2S s, 3 i, 4L l, 1.5F f, 2.5D d, true t, 'x' c, X'01' n, named_struct('a', 1) st, array(1, 2) ar, map('k', 1) m, 1.25 dec, DATE '2020-01-02' day")
    df.write.orc(f"{tmp_path}/o")
    assert files.orc_frame(spark, f"{tmp_path}/o").collect() == df.collect()
    r = files.orc_frame(spark, f"{tmp_path}/o", as_character=True).first()
    assert r["dec"] == "1.25" and r["day"] == "2020-01-02"


def test_triplets(spark, tmp_path):
    (tmp_path / "t0").write_text("0 0 1\n0 1 2.5\n")
    (tmp_path / "t1").write_text("1 1 4\n1 1 1\n")
    x = files.triplet_array(spark, f"{tmp_path}/t*", (2, 2), blocks=(1, 2))
    assert np.array_equal(x.fetch(), [[1, 2.5], [0, 5]])
    assert np.array_equal(files.triplet_array(spark, f"{tmp_path}/t*", (2, 2), transpose=True).fetch(), [[1, 0], [2.5, 5]])
    files.save_triplets(x, f"{tmp_path}/out")
    assert files.load_triplets(spark, f"{tmp_path}/out", (2, 2)).equals(x)
    with pytest.raises(ValueError):
        files.triplet_array(spark, f"{tmp_path}/t*", (1, 2))
    with pytest.raises(ValueError):
        files.triplet_array(spark, f"{tmp_path}/t*", (2, 2), base=1)


def test_triplets_of_many_blocks_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_FOLDERS", 5, raising=False)
    m = np.arange(1.0, 145).reshape(12, 12)
    x = files.DistArray.from_numpy(spark, m, (3, 2), sparse=True)  # 24 blocks in runs of 5
    x = x._like(x.df.repartition(7))
    files.save_triplets(x, f"{tmp_path}/many")
    folders = sorted(int(f.name[4:]) for f in (tmp_path / "many").glob("pid=*"))
    assert folders == [1, 6, 11, 16, 21] and len(list((tmp_path / "many").rglob("*.csv"))) <= len(folders) + 4  # 4 partitions
    for k in folders:
        cells = spark.read.csv(f"{tmp_path}/many/pid={k}", schema="i long, j long, v double", sep=" ")
        assert {(r["pid"] - 1) // 5 * 5 + 1 for r in cells.select(x.grid.pid(cells["i"], cells["j"]).alias("pid")).collect()} == {k}
    assert np.array_equal(files.load_triplets(spark, f"{tmp_path}/many", (12, 12)).fetch(), m)


PLAIN = "# a graph\n0 1\n1 2\n2 6\n2 7\n3 4\n3 6\n5 3\n5 4\n6 7\n7 1\n"
SOME = PLAIN.replace("0 1\n", "0 1 2.2\n", 1).replace("2 6\n", "2 6 1.1\n").replace("7 1\n", "7 1 3\n")


@pytest.mark.parametrize("text, weighted, total", [(PLAIN, False, 10), (SOME, True, 13.3)])
def test_edge_files(spark, tmp_path, text, weighted, total):
    (tmp_path / "g.dat").write_text(text)
    edges = files.edge_lines(spark, f"{tmp_path}/g.dat")
    assert edges.count() == 10 and edges.where("w IS NULL").count() == (0 if weighted else 10)
    files.split_edges(edges, f"{tmp_path}/parts", 3)
    assert len(list((tmp_path / "parts").glob("part=*"))) == 3
    g = files.edges_graph(spark, f"{tmp_path}/parts", 8, weighted, 3)
    assert g.edges.agg(F.sum("x")).first()[0] == 10 and g.edges.agg(F.sum("w")).first()[0] == pytest.approx(total)
    assert Graph.from_edges(edges, "src", "dst").n_vertices == 8
    with pytest.raises(ValueError):
        files.edges_graph(spark, f"{tmp_path}/parts", 7, weighted)


def test_client(spark):
    ch = Channel(spark)
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "name string, v double")
    ch.save(df, "client_t")
    with pytest.raises(FileExistsError):
        ch.save(df, "client_t")
    ch.save(df, "client_t", append=True)
    assert ch.fetch("client_t").count() == 4 and len(ch.fetch("client_t", 3).collect()) == 3
    ch.save(df, "client_t", safer=False, types={"v": "int"})
    assert dict(ch.fetch("client_t").dtypes)["v"] == "int"
    ch.update("client_t", spark.createDataFrame([("b", 7)], "name string, v int"), ["name"])
    assert sorted(map(tuple, ch.fetch("client_t").collect())) == [("a", 1), ("b", 7)]
    with pytest.raises(ValueError):
        ch.update("client_t", spark.createDataFrame([("b", 7), ("b", 8)], "name string, v int"), ["name"])
    assert [tuple(r) for r in ch.query("SELECT name, name FROM client_t WHERE v > :k", {"k": 5}, na_strings=["b"]).collect()] == [(None, None)]
    ch.copy_query("SELECT * FROM client_t WHERE v > 5", "client_u")
    ch.copy_structure("client_t", "client_w")
    assert ch.fetch("client_u").count() == 1 and ch.fetch("client_w").isEmpty() and ch.tables("CLIENT__").count() == 3
    assert [len(p) for p in ch.pages(ch.fetch("client_t"), 1)] == [1, 1]
    assert [r["column_name"] for r in ch.columns("client_t").collect()] == ["name", "v"] and ch.primary_keys("client_t").isEmpty()
    assert ch.execute_many("INSERT INTO client_w VALUES (:name, :v)", ch.fetch("client_u")) == 1 and ch.fetch("client_w").count() == 1
    ch.clear("client_t")
    assert ch.fetch("client_t").isEmpty()
    for t in ("client_t", "client_u", "client_w"):
        ch.drop(t)
    assert not ch.table_exists("client_t")
    with pytest.raises(LookupError):
        ch.fetch("client_t")
    with pytest.raises(Exception):
        ch.query("SELECT nope")
    assert ch.last_error() and ch.info()["dbms"] == "Spark SQL" and ch.type_info("integer") == {"integer": "int"}
    for f in (lambda: ch.set_auto_commit(False), ch.end_transaction):
        with pytest.raises(NotImplementedError):
            f()
    with pytest.raises(ValueError):
        ch.name("a.b.c")
    ch.close()
    with pytest.raises(ConnectionError):
        ch.query("SELECT 1")
    assert unique_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"] and ch.reconnect().query("SELECT 1 AS x").first()[0] == 1


def test_client_pages_keys_and_types(spark):
    ch = Channel(spark)
    df = spark.createDataFrame([(f"r{k}", k, f"v{k}") for k in range(7)], "id string, n int, v string").coalesce(1)
    ch.save(df, "client_k", row_names="id", add_pk=True)
    assert ch.fetch("client_k").columns == ["rownames", "n", "v"] and [tuple(r) for r in ch.primary_keys("client_k").collect()] == [("rownames", 1)]
    first, second, third, last = ch.start_fetch("client_k", 3, "rownames"), ch.fetch_more(3), ch.fetch_more(3), ch.fetch_more(3)
    assert [len(x) for x in (first, second, third, last)] == [3, 3, 1, 0] and list(second.index) == ["r3", "r4", "r5"] and list(first.columns) == ["n", "v"]
    ch.update("client_k", spark.createDataFrame([("r1", 100)], "rownames string, n int"), ["rownames"])
    assert ch.fetch("client_k").where("n = 100").count() == 1 and not ch.primary_keys("client_k").isEmpty()
    assert ch.tables("client_k%").count() == 1  # nothing of the replacement stays
    for bad in (lambda: ch.save(df.unionAll(df), "client_z", row_names="id", add_pk=True), lambda: ch.save(df, "client_z", add_pk=True)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        ch.start_fetch("client_k", row_names="nope")
    ch.set_type_info("money", "decimal(12,2)")
    assert ch.type_info("money") == {"money": "decimal(12,2)"} and "money" not in Channel(spark).type_info()
    with pytest.raises(Exception):
        ch.set_type_info("odd", "no_such_type")
    ch.drop("client_k")
    assert Channel.close_all() >= 1 and ch.closed and Channel.close_all() == 0


def test_a_failed_replacement_keeps_the_table(spark, monkeypatch):
    ch = Channel(spark)
    ch.save(spark.range(3).toDF("x"), "client_f")
    real = ch.spark.sql
    fail = lambda text, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")) if "_after_" in text and "RENAME" in text else real(text, *a, **k)
    monkeypatch.setattr(type(ch.spark), "sql", lambda self, text, *a, **k: fail(text, *a, **k))
    with pytest.raises(RuntimeError):
        ch.save(spark.range(5).toDF("x"), "client_f", safer=False)
    monkeypatch.undo()
    assert ch.fetch("client_f").count() == 3
    for t in ch.tables("client_f%").collect():
        ch.drop(t["table_name"])


def test_dense_block_files(spark, tmp_path):
    for k, text in enumerate(["1 2\n5 6", "9 10 13 14", "3 4 7 8", "11\t12\n15 16\n"]):
        (tmp_path / f"C{k}").write_text(text)
    x = files.block_array(spark, f"{tmp_path}/C", (4, 4), (2, 2))
    assert np.array_equal(x.fetch(), np.arange(1, 17).reshape(4, 4).T) and x.sum() == 136
    turned = files.block_array(spark, f"{tmp_path}/C", (4, 4), (2, 2), transpose=True).fetch()
    assert np.array_equal(turned[:2, :2], [[1, 2], [5, 6]])
    (tmp_path / "C3").write_text("1 2 3")
    with pytest.raises(ValueError):
        files.block_array(spark, f"{tmp_path}/C", (4, 4), (2, 2))


def test_live_objects_and_code(spark, tmp_path):
    x = DistArray.constant(spark, 12, 3, 1.0)
    row = session.status(spark).first()
    assert row["instances"] >= 1 and row["memory_used"] + row["memory_free"] == row["memory_total"]
    assert session.list_objects(spark).where("kind = 'DISTRIBUTED' AND nrow = 12 AND ncol = 3").count() >= 1 and x.nrow == 12
    (tmp_path / "shipped_code.py").write_text("VALUE = 5\n")
    session.load_code(spark, f"{tmp_path}/shipped_code.py")
    session.unload_code(spark, f"{tmp_path}/shipped_code.py")
    with pytest.raises(LookupError):
        session.unload_code(spark, f"{tmp_path}/shipped_code.py")


def test_kmeans_fitted(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (None,)], "x double")
    m = fit_kmeans(df, np.array([[0.0], [5.0]]), ["x"])
    assert [r["fitted"] for r in m.fitted(df).collect()] == [[0.5], [0.5], [5.0], None] and [r["cluster"] for r in m.fitted(df, "classes").collect()] == [1, 1, 2, None]
    assert "2 clusters of sizes 2, 1" in str(m)


def test_session(spark):
    assert session.status(spark).count() >= 1 and session.master_info(spark)["master"].startswith("local") and session.configuration(spark).count() > 0
    xml = "<Cluster><Workers><Worker><Hostname>h1</Hostname><Executors>4</Executors></Worker></Workers></Cluster>"
    assert sorted(map(tuple, session.configuration(spark, xml).collect())) == [("0.Executors", "4"), ("0.Hostname", "h1")]
    model = fit_kmeans(spark.createDataFrame([(0.0,), (1.0,), (5.0,)], "x double"), np.array([[0.0], [5.0]]), ["x"])
    session.deploy_model(spark, model, "my_model", "two groups")
    assert session.stored_model(spark, "my_model")["sizes"] == [2, 1]
    for bad in ("my_model", "1x", "a b"):
        with pytest.raises(ValueError):
            session.deploy_model(spark, model, bad)
    spark.sql(f"DROP TABLE {session.MODEL_TABLE}")


def test_stream(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("event_id"), (F.lit(1_600_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = events.stream_events(spark, f"{tmp_path}/in", df.schema)
    out = events.drain(events.window_counts(stream, "10 minutes", "1 day"), "stream_out", f"{tmp_path}/cp", "complete")
    assert out.exceptAll(events.window_counts(df, "10 minutes")).isEmpty() and out.count() == events.window_counts(df, "10 minutes").count()
    assert events.sessions(df, "5 minutes").count() == 3
