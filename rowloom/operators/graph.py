"""Graphs as edge tables (src, dst, w) with 0-based vertices, and PageRank on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, release


@dataclass(frozen=True)
class Graph:
    """``edges``: (src, dst, x, w), one row for each pair; x counts repeats, w sums weights."""

    edges: DataFrame
    n_vertices: int
    weighted: bool

    @classmethod
    def from_edges(cls, edges: DataFrame, src: str, dst: str, weight: str | None = None, n_vertices: int | None = None, na_action: str = "exclude") -> Graph:
        """n_vertices is the largest id + 1 unless given. Edges with a missing weight go, or are an error."""
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("w"))
        bad = F.col("src").isNull() | F.col("dst").isNull() | F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))
        if na_action == "fail" and not rows.where(bad).isEmpty():
            raise ValueError("missing values in the edges")
        rows = rows.where(~bad) if na_action != "pass" else rows
        facts = rows.agg(F.max(F.greatest("src", "dst")).alias("hi"), F.min(F.least("src", "dst")).alias("lo")).first()
        n = n_vertices or (facts["hi"] + 1 if facts["hi"] is not None else 0)
        if facts["hi"] is not None and (facts["lo"] < 0 or facts["hi"] >= n):
            raise ValueError(f"vertex ids must lie in 0 .. {n - 1}")
        return cls(rows.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("x"), F.sum("w").alias("w")), n, weight is not None)

    def out_degree(self) -> DataFrame:
        """(src, degree): sum of x, times w in a weighted graph."""
        return self.edges.groupBy("src").agg(F.sum(F.col("x") * F.col("w") if self.weighted else F.col("x")).alias("degree"))


def pagerank(g: Graph, niter: int = 1000, eps: float = 0.001, damping: float = 0.85, personalized: DataFrame | None = None) -> DataFrame:
    """(vertex, rank).

    Ranks start at 1 - damping. Each round sums damping * rank / out-degree along the edges, adds the teleport share
    ((1 - damping) / n, or (1 - damping) * personalized value) and divides by the total: vertices without out-edges
    lose their mass and only this last step restores it. Stops when no rank moves by eps, or after niter rounds
    (exactly niter with eps = 0). ``personalized``: (vertex, value). Each round is written down, so plans stay short.
    """
    if niter < 1 or not 0 <= damping < 1:
        raise ValueError("niter must be positive and damping in [0, 1)")
    spark = g.edges.sparkSession
    share = F.col("x") * F.col("w") if g.weighted else F.col("x")
    flow = g.edges.join(g.out_degree(), "src").where("degree != 0").select("src", "dst", (F.lit(damping) * share / F.col("degree")).alias("f"))
    flow = materialise(flow, "pagerank-flow")
    vertices = spark.range(g.n_vertices).select(F.col("id").alias("vertex"))
    if personalized is None:
        base = vertices.withColumn("t", F.lit((1 - damping) / max(1, g.n_vertices)))
    else:
        base = vertices.join(personalized, "vertex", "left").select("vertex", ((1 - damping) * F.coalesce("value", F.lit(0.0))).alias("t"))
    ranks, kept = vertices.withColumn("rank", F.lit(1 - damping)), None
    for _ in range(niter):
        sums = flow.join(ranks, flow["src"] == ranks["vertex"]).groupBy("dst").agg(F.sum(F.col("f") * F.col("rank")).alias("s"))
        raw = base.join(sums, base["vertex"] == sums["dst"], "left").select("vertex", (F.coalesce("s", F.lit(0.0)) + F.col("t")).alias("r"))
        raw = materialise(raw, "pagerank")
        total = raw.agg(F.sum("r")).first()[0]
        new = raw.select("vertex", (F.col("r") / F.lit(total)).alias("rank"))
        moved = None
        if eps > 0:
            moved = new.join(ranks.withColumnRenamed("rank", "old"), "vertex").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if kept is not None:
            release(kept)
        ranks, kept = new, raw
        if eps > 0 and (moved is None or moved < eps):
            break
    release(flow)
    return ranks


def top_vertex(ranks: DataFrame) -> DataFrame:
    """1-based number of the vertex with the largest rank, the first of equals."""
    return ranks.agg((F.max_by("vertex", F.struct("rank", -F.col("vertex"))) + 1).alias("vertex"))
