"""Places in a total order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.sources.shared import written

_BITS = 33  # monotonically_increasing_id() keeps the row's place in its partition in so many bits


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """The table with each row's place in order, from 0: a sort by ranges, a place in each range, and the ranges' sizes.

    One row for each partition is broadcast. Rows that tie get places next to each other in no certain order.
    """
    placed = written(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__place", _BITS).cast("int")
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    begin = df.sparkSession.createDataFrame(starts, "__part int, __begin long")
    inside = F.col("__place").bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(begin), "__part").withColumn(name, F.col("__begin") + inside).drop("__part", "__begin", "__place")
