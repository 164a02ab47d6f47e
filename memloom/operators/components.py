"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.scratch import cut


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour up to u, and u, is tied to the least of them. Edges come with u above v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each upper node has one edge and no lower node is an upper one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its least node. Nulls and loops
    are no edges; parallel edges count once.

    Rounds grow with the logarithm of the graph's diameter, no group of neighbours is gathered in a row, and the
    driver sees one truth value a round. Each round is cut in the shared folder in place of the one before. More than
    ``max_rounds`` are an error."""
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"`{u}` IS NOT NULL AND `{v}` IS NOT NULL AND `{u}` <> `{v}`").distinct()
    now = cut(now, "components")
    for _ in range(max_rounds):
        if _is_stars(now):
            break
        now = cut(_small(_large(now)), "components", now)
    else:
        raise RuntimeError(f"components aren't done after {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
