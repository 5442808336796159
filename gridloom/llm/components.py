"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _base


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the component's smallest node. Nodes without an edge to another are left out.

    Alternating large-star and small-star rounds; every round is two shuffles, and its result is
    written to the shared folder. The neighbourhood of a node is never gathered in one task: its
    minimum is aggregated map-side first and joined back, where skewed nodes can be split.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = _base.spill(now, "edges")
    before = None
    while True:
        mark = _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        for large in (True, False):
            near = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else now
            least = _base.spill(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
            each = near.join(least, "u")
            out = each.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else each.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
            after = _base.spill(out.filter("u > v").distinct(), "edges")
            _base.forget(now, least)
            now = after
