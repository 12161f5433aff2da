"""Connected components of an edge table, by large-star and small-star rounds.

Each round connects every node's larger neighbours to its least one, then every node's smaller neighbours
to the least of them; rounds go on until no edge changes, a number that grows with the logarithm of the
graph's size. Every round is written to the shared folder, so the plan stays short and survives the loss of
executors; hot nodes only ever send one row for each edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import drop_written, written


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b, one star step on."""
    if large:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        out = both.withColumn("m", m).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        m = F.min("b").over(Window.partitionBy("a"))
        step = e.withColumn("m", m)
        out = step.select("a", F.col("m").alias("b")).unionByName(step.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of each node of the edges (a, b); a root is its component's least node."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    before = None
    while True:
        step = written(_star(_star(e, True), False), "edges")
        now = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_written(e)
        e = step
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
