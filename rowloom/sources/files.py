"""Files: CSV and ORC into frames, triplet and edge files into arrays and graphs, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.array import DistArray
from ..operators.graph import Graph
from ..operators.grid import Grid

#: Most block files that are named one by one.
MAX_BLOCK_FILES = 10_000
#: Most folders of triplets.
MAX_FOLDERS = 1_000
#: Type names in CSV schemas and their Spark types.
TYPES = {"logical": "boolean", "integer": "int", "int64": "bigint", "numeric": "double", "character": "string"}


def csv_schema(text: str) -> str:
    """``a:int64,b:character`` as DDL."""
    out = []
    for item in text.split(","):
        name, _, kind = item.strip().partition(":")
        if not name or kind not in TYPES:
            raise ValueError(f"bad column {item!r}; types are {sorted(TYPES)}")
        out.append(f"`{name}` {TYPES[kind]}")
    return ", ".join(out)


def csv_frame(spark: SparkSession, url: str | list[str], schema: str, delimiter: str = ",", comment: str = "#", skip_header: bool = False) -> DataFrame:
    """Any path, list or glob that Spark reads; large files are split by Spark, not by hand."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    return spark.read.csv(url, schema=csv_schema(schema), sep=delimiter, comment=comment, header=skip_header, enforceSchema=True)


def orc_frame(spark: SparkSession, url: str, as_character: bool = False) -> DataFrame:
    """``as_character``: decimals, timestamps and dates as text. Stripes cannot be selected: filters prune them."""
    df = spark.read.orc(url)
    if not as_character:
        return df
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith("decimal") or t in ("timestamp", "timestamp_ntz", "date") else F.col(c) for c, t in df.dtypes])


def triplet_array(spark: SparkSession, path: str, shape: tuple[int, int], blocks=None, base: int = 0, transpose: bool = False, sparse: bool = True) -> DistArray:
    """Lines ``i j v`` of one or many files; repeated cells are summed."""
    cells = spark.read.csv(path, schema="i long, j long, v double", sep=" ", ignoreLeadingWhiteSpace=True)
    if transpose:
        cells = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    out = cells.where(F.col("i").isNotNull() & F.col("j").isNotNull())
    limit = (out["i"] < base) | (out["j"] < base) | (out["i"] >= shape[0] + base) | (out["j"] >= shape[1] + base)
    if not out.where(limit).isEmpty():
        raise ValueError(f"cells outside of {shape}")
    return DistArray.from_coo(out, shape, blocks, sparse, base)


def save_triplets(x: DistArray, path: str) -> None:
    """Lines ``i j v`` with 0-based positions, in folders ``pid=<block>``: one for each block, or, where a grid has more
    than ``MAX_FOLDERS`` blocks, one for each run of neighbouring blocks, named after the first of them.

    Cells are dealt by ranges of folder and position, so a task writes few files and a large block goes to many tasks."""
    run = -(-x.grid.n // MAX_FOLDERS)
    pid = x.grid.pid(F.col("i"), F.col("j"))
    cells = x.to_coo().df.select("i", "j", "v", (pid - (pid - 1) % run).alias("pid"))
    cells.repartitionByRange("pid", "i", "j").write.partitionBy("pid").csv(path, sep=" ")


def load_triplets(spark: SparkSession, path: str, shape: tuple[int, int], blocks=None, sparse: bool = True) -> DistArray:
    cells = spark.read.schema("i long, j long, v double, pid long").csv(path, sep=" ").select("i", "j", "v")
    return DistArray(cells, Grid.of(*shape, blocks), "coo", sparse)


def block_array(spark: SparkSession, prefix: str, shape: tuple[int, int], blocks: tuple[int, int], transpose: bool = False) -> DistArray:
    """Dense block files ``<prefix>0``, ``<prefix>1``, ...: each holds the numbers of one block down its columns.

    A block is what one task holds, so its file is read whole; ``transpose`` turns each block (blocks must be square).
    """
    grid = Grid.of(*shape, blocks)
    if transpose and grid.rb != grid.cb:
        raise ValueError("only square blocks can be turned")
    if grid.n > MAX_BLOCK_FILES:
        raise ValueError(f"more than {MAX_BLOCK_FILES} block files; use one folder of triplets")
    texts = spark.read.text([f"{prefix}{k}" for k in range(grid.n)], wholetext=True).select((F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("long") + 1).alias("pid"), "value")
    numbers = F.transform(F.array_remove(F.split("value", r"\s+"), ""), lambda x: x.cast("double"))
    held = texts.join(grid.sizes(spark), "pid").withColumn("xs", numbers)
    wrong = held.where((F.size("xs") != F.col("n_rows") * F.col("n_cols")) | F.exists("xs", lambda x: x.isNull()))
    if held.count() != grid.n or not wrong.isEmpty():
        raise ValueError("a file is missing or holds other than its block's numbers")
    cells = held.select("n_rows", "row_offset", "col_offset", F.posexplode("xs").alias("k", "v"))
    down, across = F.col("k") % F.col("n_rows"), F.floor(F.col("k") / F.col("n_rows"))
    i, j = (across, down) if transpose else (down, across)
    return DistArray(cells.select((F.col("row_offset") + i).cast("long").alias("i"), (F.col("col_offset") + j).cast("long").alias("j"), "v"), grid, "coo", False)


def edge_lines(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) from lines ``s t [w]``; other lines are skipped. The file is weighted when any edge has a weight;
    in a weighted file a missing weight is 1, in another w is null throughout."""
    line = r"^\s*(\d+)\s+(\d+)(?:\s+([-+0-9.eE]+))?\s*$"
    text = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    edges = text.select(part(1).cast("long").alias("src"), part(2).cast("long").alias("dst"), F.when(part(3) != "", part(3).cast("double")).alias("w"))
    weighted = not edges.where("w IS NOT NULL").isEmpty()
    return edges.withColumn("w", F.coalesce("w", F.lit(1.0))) if weighted else edges


def split_edges(edges: DataFrame, path: str, vertices_per_file: int, by: str = "dst") -> None:
    """Edge files by ranges of ``vertices_per_file`` vertices of one end, for later reading by range."""
    if vertices_per_file < 1:
        raise ValueError("a positive number of vertices for each file is needed")
    part = edges.withColumn("part", F.floor(F.col(by) / vertices_per_file).cast("long"))
    part.repartition("part").write.partitionBy("part").csv(path, sep=" ")


def edges_graph(spark: SparkSession, path: str, n_vertices: int, weighted: bool, vertices_per_file: int | None = None, by: str = "dst") -> Graph:
    """A graph from split edge files; every edge must lie in the graph and, if a range is given, in its file's range."""
    edges = spark.read.schema("src long, dst long, w double, part long").csv(path, sep=" ")
    wrong = (F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= n_vertices) | (F.col("dst") >= n_vertices)
    if vertices_per_file:
        wrong = wrong | (F.floor(F.col(by) / vertices_per_file) != F.col("part"))
    if not edges.where(wrong).isEmpty():
        raise ValueError("edges outside of the graph or of their file's range")
    return Graph.from_edges(edges, "src", "dst", "w" if weighted else None, n_vertices)
