"""Connected components of an edge table, without bringing nodes or edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each node of an edge: component is the smallest id that it reaches.

    Alternates large-star and small-star steps (edges always point to a smaller node) until the edges no
    longer change; they then are one star per component. Hot nodes only meet in joins, whose large
    partitions Spark can split, and in minima, which are combined before the shuffle. Each round is
    written to the shared folder. Edges with a null end and loops count as nothing; repeated edges as one;
    no edges give an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = written(e, "edges")
    before = _mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.expr("inline(array(struct(v as u, m as v), struct(u as u, m as v)))")).where("u != v").distinct()
        e = written(e, "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
