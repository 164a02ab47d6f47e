"""Scores of regions (trajectories of nodes) that consolidation ranks them by. Nodes: region, id, s and more; edges:
src, dst, edge_type. Only edges with both ends in one region count for it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.operators import graph
from memloom.sources.scratch import cut

# Thresholds and weights of the score.
COLLAPSED, ALIKE = 0.05, 0.85
WEIGHTS = {"divergence": 1.0, "collapse": -1.0, "sycophancy": -1.0, "correction": 1.0, "uplift": 0.5, "rarity": 0.5}


def inner_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the region that holds both ends."""
    one = nodes.select(F.col("id").alias("src"), "region")
    two = nodes.select(F.col("id").alias("dst"), F.col("region").alias("other"))
    return edges.join(one, "src").join(two, "dst").where("region = other").drop("other")


def steps(nodes: DataFrame) -> DataFrame:
    """region, place (from 0, by id) and d: one less the cosine with the next node; null at the end."""
    order = Window.partitionBy("region").orderBy("id")
    rows = nodes.select("region", "id", "s", F.lead("s").over(order).alias("next"), (F.row_number().over(order) - 1).alias("place"))
    return rows.select("region", "place", F.when(F.col("next").isNotNull(), 1 - vec.cosine(F.col("s"), F.col("next"))).alias("d"))


def path_scores(nodes: DataFrame, collapsed: float = COLLAPSED) -> DataFrame:
    """region, divergence (mean step; 0 for one node) and collapse: the share of the path from the first step
    below ``collapsed`` on (0 for fewer than three nodes, or none)."""
    n = F.count("*")
    first = F.min(F.when(F.col("d") < collapsed, F.col("place")))
    out = steps(nodes).groupBy("region").agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("divergence"), n.alias("n"), first.alias("first"))
    collapse = F.when(F.col("n") >= 3, (F.col("n") - F.col("first")) / F.col("n"))
    return out.select("region", "divergence", F.coalesce(collapse, F.lit(0.0)).alias("collapse"))


def ends(nodes: DataFrame) -> DataFrame:
    """region, a and b: the first and the last node (id, s, quality) of its path."""
    end = F.struct("id", "s", "quality")
    return nodes.groupBy("region").agg(F.min(end).alias("a"), F.max(end).alias("b"))


def agreeing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, region, cos and the source's role of the ``agrees`` edges inside regions."""
    own = nodes.select("id", "role", "s")
    rows = inner_edges(nodes, edges.where("edge_type = 'agrees'")).select("src", "dst", "region")
    rows = rows.join(own.withColumnsRenamed({"id": "src", "s": "x"}), "src").join(own.select(F.col("id").alias("dst"), F.col("s").alias("y")), "dst")
    return rows.select("src", "dst", "region", vec.cosine(F.col("x"), F.col("y")).alias("cos"), "role")


def sycophancy(nodes: DataFrame, edges: DataFrame, alike: float = ALIKE) -> DataFrame:
    """region and the share of its ``agrees`` edges from a plain fact to a node that is nearly the same. Regions
    without such edges have 0."""
    hit = (F.col("cos") > alike) & F.coalesce("role", F.lit("")).isin("", "fact")
    share = agreeing(nodes, edges).groupBy("region").agg(F.avg(hit.cast("double")).alias("share"))
    return nodes.select("region").distinct().join(share, "region", "left").select("region", F.coalesce("share", F.lit(0.0)).alias("sycophancy"))


def correction(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """region and how far its path turned, times the gain in quality from the first to the last node; half as much
    again where a node pivots or corrects. One node has 0."""
    turned = inner_edges(nodes, edges.where("edge_type IN ('pivots', 'corrects')")).groupBy("region").agg(F.lit(1.5).alias("boost"))
    depth = F.coalesce("boost", F.lit(1.0)) * (1 - vec.cosine(F.col("a.s"), F.col("b.s"))) * (0.5 + F.col("b.quality") - F.col("a.quality"))
    return ends(nodes).join(turned, "region", "left").select("region", F.when(F.col("a.id") == F.col("b.id"), 0.0).otherwise(depth).alias("correction"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """region, v (nodes), e (inner edges), uplift and rarity among all nodes."""
    inner = inner_edges(nodes, edges).groupBy("region").agg(F.count("*").alias("e"))
    rows = nodes.groupBy("region").agg(F.count("*").alias("v")).join(inner, "region", "left").fillna(0, ["e"])
    rows = rows.join(F.broadcast(nodes.agg(F.count("*").alias("total"))))  # one row
    return rows.select("region", "v", "e", (F.col("e") / F.col("v") - 0.05 * F.log(1 + F.col("v"))).alias("uplift"), (1 / (1 + F.col("v") / F.sqrt("total"))).alias("rarity"))


def priority(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All parts of the score and their weighted sum for each region."""
    parts = path_scores(nodes).join(sycophancy(nodes, edges), "region").join(correction(nodes, edges), "region").join(density(nodes, edges).drop("v", "e"), "region")
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("priority", total)


def density_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """region and how far its edges a node are from those of the whole graph: the plain form of the distance
    between two graphs."""
    rows = density(nodes, edges)
    whole = nodes.agg(F.count("*").alias("n")).join(F.broadcast(edges.agg(F.count("*").alias("m"))))  # one row each
    return rows.join(F.broadcast(whole)).select("region", F.abs(F.col("e") / F.col("v") - F.col("m") / F.greatest(F.col("n"), F.lit(1))).alias("gap"))


def linearize(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """region and its text for a prompt: a line for each node (by id; ``[Nk] (role) text``, with the first 200
    characters of the drawers' texts where the nodes have a column drawers, an array), under it one for each edge
    inside the region. Regions are extracted subgraphs, so their size is bounded by the extraction's budget."""
    order = Window.partitionBy("region").orderBy("id")
    quoted = F.array_join("drawers", " | ") if "drawers" in nodes.columns else F.lit("")
    quoted = F.when(F.length(quoted) > 0, F.concat(F.lit('  (verbatim: "'), F.substring(quoted, 1, 200), F.lit('")'))).otherwise("")
    named = nodes.select("region", "id", F.concat(F.lit("[N"), F.row_number().over(order), F.lit("]")).alias("name"), F.concat(F.lit("("), F.coalesce("role", F.lit("fact")), F.lit(") "), F.coalesce("text", F.lit("")), quoted).alias("body"))
    to = named.select("region", F.col("id").alias("dst"), F.col("name").alias("to"))
    out = edges.join(named.select("region", F.col("id").alias("src")), "src").join(to, ["region", "dst"])
    arrow = F.format_string("    --(%s, w=%+.3f)--> %s", "edge_type", "weight", "to")
    lines = named.select("region", "id", F.lit(-1).cast("bigint").alias("dst"), F.concat_ws(" ", "name", "body").alias("line"), F.lit("").alias("kind"))
    lines = lines.unionByName(out.select("region", F.col("src").alias("id"), "dst", arrow.alias("line"), F.col("edge_type").alias("kind")))
    rows = lines.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("id", "dst", "kind", "line"))).alias("l"))
    return rows.select("region", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


# Consolidation.
def build(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes with region: the least node of their connected component."""
    return nodes.join(graph.components(nodes, edges).withColumnRenamed("component", "region"), "id")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """region, v and e (its nodes and inner edges), newest (the last edge's time), density (e / v) and spread (the
    deviation of the edges' weights)."""
    own = inner_edges(nodes, edges).groupBy("region").agg(F.count("*").alias("e"), F.max("created").alias("newest"), F.stddev_pop("weight").alias("spread"))
    rows = nodes.groupBy("region").agg(F.count("*").alias("v")).join(own, "region", "left").fillna(0, ["e", "spread"])
    return rows.select("region", "v", "e", "newest", (F.col("e") / F.greatest(F.lit(1), F.col("v"))).alias("density"), "spread")


def ranked(nodes: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """region and priority: 0.4 for what is new (halved after an hour), 0.3 for density and 0.3 for spread; 0 without
    edges."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("newest")) / 3600
    value = 0.4 / (1 + age) + 0.3 * F.col("density") + 0.3 * F.col("spread")
    return stats(nodes, edges).select("region", F.when(F.col("e") > 0, value).otherwise(0.0).alias("priority"))


class Consolidated(NamedTuple):
    regions: DataFrame  # region, n_nodes, n_edges, n_pruned, score
    pruned: DataFrame  # the edges that go
    refined: DataFrame  # the edges that stay, with refined weights
    motifs: DataFrame  # region, pattern, cnt
    audit: DataFrame  # operation, target_type, target_id, payload


def consolidate(nodes: DataFrame, edges: DataFrame, *, budget: int = 10, as_of: Column, induced: DataFrame | None = None) -> Consolidated:
    """One run over the ``budget`` regions of highest priority, all of them at once: edges whose evidence is weak go,
    the others are smoothed and searched for motifs, and the regions are scored. ``induced``: edges that are added
    first, for nodes that have none. nodes: id, s, role, quality; edges: with created, gamma_anti and s_squared."""
    if induced is not None:
        edges = cut(edges.unionByName(induced, allowMissingColumns=True), "with-induced")
    whole = cut(build(nodes, edges), "regions")
    top = cut(ranked(whole, edges, as_of).orderBy(F.desc("priority"), "region").limit(budget).select("region"), "top-regions")
    own = cut(whole.join(F.broadcast(top), "region"), "own-nodes")  # at most ``budget`` regions
    inner = cut(inner_edges(own, edges), "own-edges")
    judged = cut(graph.prune(inner), "judged")
    pruned, kept = judged.where("pruned"), judged.where("NOT pruned")
    refined = graph.mean_field(kept.select("region", "src", "dst", "edge_type", "weight"))
    chains = graph.motif_instances(kept.select("src", "dst", "edge_type", "weight"), 1).join(own.select(F.col("id").alias("a"), "region"), "a")
    found = cut(chains.groupBy("region", "pattern").agg(F.count("*").alias("cnt")).where("cnt >= 2"), "region-motifs")
    scores = priority(own, kept.drop("region"))
    count = lambda df, c: df.groupBy("region").agg(F.count("*").alias(c))
    rows = count(own, "n_nodes").join(count(inner, "n_edges"), "region", "left").join(count(pruned, "n_pruned"), "region", "left").join(scores.select("region", F.col("priority").alias("score")), "region", "left").fillna(0, ["n_edges", "n_pruned"])
    rows = cut(rows, "consolidated")
    entry = lambda df, op, kind, target, payload: df.select(F.lit(op).alias("operation"), F.lit(kind).alias("target_type"), target.cast("string").alias("target_id"), payload.alias("payload"))
    audit = entry(pruned, "PRUNE", "edge", F.concat_ws(">", "src", "dst"), F.to_json(F.struct("weight", "log_ratio")))
    audit = audit.union(entry(found, "MOTIF", "region", F.col("region"), F.to_json(F.struct("pattern", "cnt"))))
    audit = audit.union(entry(rows, "PMED_SCORE", "region", F.col("region"), F.to_json(F.struct("score"))))
    audit = audit.union(entry(rows.agg(F.count("*").alias("regions"), F.sum("n_pruned").alias("pruned")), "CONSOLIDATE", "global", F.lit("all"), F.to_json(F.struct("regions", "pruned"))))
    return Consolidated(rows, pruned, refined, found, audit)
