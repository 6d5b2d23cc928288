"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import durable


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: no u has two v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sums.agg(F.coalesce(F.bool_or(F.expr("up > 1 or up = 1 and down = 1")), F.lit(False))).first()[0]


ROWS = 100_000  # edges of a task that writes them


def _written(edges: DataFrame, rows: int, name: str) -> DataFrame:
    """``edges`` in distinct rows, written by as many tasks as ``rows`` need, not one for each shuffle partition: small tables are read again and again."""
    return durable(edges.distinct().coalesce(max(2 * edges.sparkSession.sparkContext.defaultParallelism, rows // ROWS)), name)


HUBS = 1000  # nodes at most whose edges stay where they are


def _lowest(edges: DataFrame, rows: int) -> DataFrame:
    """The edges (u, v) with m, the least neighbour of u.

    Edges meet by u, except those of nodes with more than a HUBS-th part of them: there are HUBS such nodes at most, so what they need is
    broadcast, and a hub's edges stay spread as they are.
    """
    limit = max(100, rows // HUBS)
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(low.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    heavy = edges.join(hubs, F.col("u") == F.col("hub")).select("u", "v", F.col("hub_m").alias("m"))
    rest = edges.join(hubs.select("hub"), F.col("u") == F.col("hub"), "left_anti")
    return heavy.unionByName(rest.join(low.where(F.col("n") <= limit).select("u", "m"), "u").select("u", "v", "m"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Label the nodes of ``edges`` (columns a, b; long) with the smallest node reachable.

    Returns (node, component), one row per node that has an edge to another one. Each round
    joins and aggregates only the edges left, O(log^2 n) rounds, until the edges are stars; nothing but a row count and that
    answer reaches the driver. Nulls, loops and repeated edges are ignored.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = durable(e, name)
    while not _stars(e):
        rows = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, 2 * rows).where("v > u")
        large = _written(low.select(F.col("v").alias("u"), F.least("m", "u").alias("v")), rows, name)
        low = _lowest(large, rows)
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = _written(small, rows, name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select("v", "v").distinct().toDF("node", "component"))
