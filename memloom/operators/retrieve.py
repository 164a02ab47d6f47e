"""Retrieval over the graph: beam walks, rank fusion, routing, subgraph extraction. Batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.sources.scratch import cut


def walkable(edges: DataFrame, threshold: float = -0.1) -> DataFrame:
    """Edges that a walk may take."""
    return edges.where(F.col("weight") >= threshold)


def walk(seeds: DataFrame, edges: DataFrame, depth: int = 4, threshold: float = -0.1, beam: int = 8) -> DataFrame:
    """(qid, seed, nodes, cum, place) of beam walks from each (qid, seed); place: from 1, the best first. A step extends every path by edges of weight
    ``threshold`` or more to nodes not on it; paths that end stay, extended ones go; the ``beam`` best by summed
    weight go on, ties by their nodes."""
    steps = cut(walkable(edges, threshold).select("src", "dst", "weight"), "walk-edges")
    paths = seeds.select("qid", "seed", F.array("seed").alias("nodes"), F.lit(0.0).alias("cum"), F.lit(1).alias("place"))
    best = Window.partitionBy("qid", "seed").orderBy(F.desc("cum"), "nodes")
    for _ in range(depth):
        tail = paths.withColumn("src", F.element_at("nodes", -1)).withColumn("path", F.xxhash64("qid", "seed", "nodes"))
        more = tail.join(steps, "src").where(~F.array_contains("nodes", F.col("dst")))
        ended = tail.join(more.select("path").distinct(), "path", "left_anti").select("qid", "seed", "nodes", "cum")
        longer = more.select("qid", "seed", F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("cum") + F.col("weight")).alias("cum"))
        paths = cut(longer.union(ended).withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam), "walk", paths)
    return paths


def fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(qid, item, score) of rankings (qid, list, item, pos from 0, w): the sum of w / (k + pos + 1)."""
    return rankings.groupBy("qid", "item").agg(F.sum(F.col("w") / (k + F.col("pos") + 1)).alias("score"))


def prizes(edges: DataFrame) -> DataFrame:
    """(id, prize): positive weights of the incident edges."""
    ends = edges.select(F.col("src").alias("id"), "weight").union(edges.select("dst", "weight"))
    return ends.groupBy("id").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("prize"))


def costs(edges: DataFrame, penalty: float = 1.5) -> DataFrame:
    """Edges with the cost of either extraction."""
    w = F.col("weight")
    return edges.withColumns({"tree_cost": F.greatest(F.lit(0.0), -w), "forest_cost": F.when(w < 0, penalty * F.abs(w)).otherwise(F.greatest(F.lit(0.01), 0.1 * (1 - w)))})


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def route(query, density, clustering, mean_hops, seeds):
    """The mode for a query text and the features of its neighbourhood."""
    d, f = text.has_any(query, text.ROUTE_DIRECTIONAL), text.has_any(query, text.ROUTE_FACTUAL)
    return (
        F.when(seeds == 0, "symmetric").when(density < 0.5, "symmetric").when(f & ~d, "symmetric").when((clustering > 0.4) & ~d, "symmetric")
        .when(d & (mean_hops > 2), "walk_deep").when(d, "walk_short").when((mean_hops > 1.5) & (clustering < 0.3), "walk_short").otherwise("hybrid")
    )


def metrics(found: DataFrame, gold: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each kind of query: n, hit (mean share of a query's gold rows that were found) and mrr (mean of one over the
    rank of its first one, 0 without). found: (qid, id, rank), gold: (qid, id), kinds: (qid and other columns).
    Queries without gold rows aren't counted."""
    own = gold.distinct().join(found, ["qid", "id"], "left").groupBy("qid").agg((F.count("rank") / F.count("*")).alias("hit"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"))
    by = [c for c in kinds.columns if c != "qid"]
    return own.join(kinds, "qid").groupBy(*by).agg(F.count("*").alias("n"), F.avg("hit").alias("hit"), F.avg("mrr").alias("mrr"))


def junk_rate(rows: DataFrame, kind: str = "kind", genuine: str = "genuine") -> DataFrame:
    """One row, rate: the share of rows that aren't genuine; 0 of none."""
    return rows.agg(F.coalesce(F.avg((F.col(kind) != genuine).cast("double")), F.lit(0.0)).alias("rate"))
