"""The engine's tables, built from the test tables: nodes with two views of their vectors, induced edges, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text, vec
from memloom.operators import graph
from memloom.operators.vectors import top_k
from memloom.sources.scratch import cut

NEIGHBOURS = 6
#: Texts of the nodes, by id modulo 8: between them they meet every rule of the edge types.
SAYINGS = [
    "We keep the store on one disk.", "However the store is not safe there.", "To clarify, the store should be larger.", "We switched to a second disk.",
    "The old disk is deprecated.", "Then the load went down.", "Exactly, the load is the same.", "The disk is slow because of the load.",
]
_edges: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, text, f, b, s, c of the embeddings: the first half of a vector is its forward view."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    rows = e.select("id", "label", F.element_at(F.array(*[F.lit(t) for t in SAYINGS]), (F.col("id") % 8 + 1).cast("int")).alias("text"), F.slice("v", 1, 32).alias("f"), F.slice("v", 33, 32).alias("b"))
    return rows.withColumns({"s": vec.semantic(F.col("f"), F.col("b")), "c": vec.causal(F.col("f"), F.col("b"))})


def knn(spark: SparkSession, sf_dir: str, k: int = NEIGHBOURS) -> DataFrame:
    """(i, j, cos, rank) of each node's nearest others."""
    n = nodes(spark, sf_dir)
    near = top_k(n.select(F.col("id").alias("qid"), F.col("s").alias("v")), n.select("id", F.col("s").alias("v")), k, other_than_self=True)
    return near.select(F.col("qid").alias("i"), F.col("id").alias("j"), F.col("score").alias("cos"), "rank")


def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unordered pair of near nodes once, with its cosine and both nodes' vectors and texts."""
    pairs = knn(spark, sf_dir).where("cos >= 0").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cos").groupBy("i", "j").agg(F.max("cos").alias("cos"))
    n = nodes(spark, sf_dir)
    own = lambda x: n.select(F.col("id").alias(x), *(F.col(c).alias(c[0] + x) for c in ("f", "b", "text")))
    return pairs.join(own("i"), "i").join(own("j"), "j")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges induced between each node and its nearest others, once for each unordered pair. Cut once for each
    session and input."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _edges:
        _edges[key] = cut(graph.induce(neighbour_pairs(spark, sf_dir)), "edges")
    return _edges[key]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with source: system turns are artifacts of earlier retrieval."""
    c = table(spark, sf_dir, "conversations")
    return c.withColumn("source", F.when(F.col("role") == "system", text.ARTIFACT_SOURCES[0]).otherwise("conversation"))
