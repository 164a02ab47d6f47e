"""Queries on spectra, vector statistics, shape and distance. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.operators import embed, graph, spectral
from memloom.plans.fixtures import edges, neighbour_pairs, nodes, table
from memloom.plans.queries import _EDGES, _NODES, query, r6
from memloom.sources.scratch import cut


def _eigenvalues(spark, d):
    return spectral.eigenvalues(nodes(spark, d), edges(spark, d))


@query("L03_laplacian_eigenvalues")
def _(spark, d):
    return spark.createDataFrame([(k, round(x, 6) + 0.0) for k, x in enumerate(_eigenvalues(spark, d))], "k int, value double")


@query("L04_spectral_gap")
def _(spark, d):
    return spark.createDataFrame([(round(spectral.spectral_gap(nodes(spark, d), edges(spark, d)), 6),)], "gap double")


@query("L05_cheeger_bounds")
def _(spark, d):
    low, high = spectral.cheeger(spectral.spectral_gap(nodes(spark, d), edges(spark, d)))
    return spark.createDataFrame([(round(low, 6), round(high, 6))], "low double, high double")


@query("L06_heat_kernel")
def _(spark, d):
    return spectral.heat_kernel(nodes(spark, d), edges(spark, d)).select("id", *(r6(F.col("hks")[k]).alias(f"h{k}") for k in range(3)))


@query("L07_graph_health")
def _(spark, d):
    return spectral.graph_health(nodes(spark, d), edges(spark, d)).select("n_nodes", "n_edges", *(r6(c).alias(c) for c in ("gap", "cheeger_low", "cheeger_high", "density")))


@query("L19_inconsistency")
def _(spark, d):
    return spectral.inconsistency(nodes(spark, d), edges(spark, d)).withColumns({"smallest": r6("smallest"), "frustration": r6("frustration")})


@query("L20_homology")
def _(spark, d):
    return spectral.homology(nodes(spark, d)).select("n_nodes", "betti_0", *(r6(c).alias(c) for c in ("mean_0", "max_0", "total_0")))


@query("L21_signature")
def _(spark, d):
    return spectral.signature(nodes(spark, d)).select(F.transform("signature", lambda x: F.round(x, 6)).alias("signature"))


def _part(spark, d, label):
    return nodes(spark, d).where(F.col("label") == label)


@query("L22_nearest_distance", f"""WITH {_NODES}, m AS (SELECT x.id AS i, y.id AS j, pow(list_distance(x.s, y.s), 2) AS m FROM nodes x JOIN nodes y ON y.label = 2 WHERE x.label = 1)
SELECT round(((SELECT avg(m) FROM (SELECT min(m) AS m FROM m GROUP BY i)) + (SELECT avg(m) FROM (SELECT min(m) AS m FROM m GROUP BY j))) / 2, 6) AS distance""")
def _(spark, d):
    return spectral.nearest_distance(_part(spark, d, 1), _part(spark, d, 2)).select(r6("distance").alias("distance"))


def _region(spark, d, label):
    n = _part(spark, d, label)
    ids = n.select("id")
    return n, edges(spark, d).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query("L24_way_lengths")
def _(spark, d):
    return spectral.way_lengths(*_region(spark, d, 3)).select("a", "b", r6("d").alias("d"))


@query("L25_drift")
def _(spark, d):
    return spectral.drift(_region(spark, d, 1), _region(spark, d, 2)).select(*(r6(c).alias(c) for c in ("signature", "nearest", "density")))


@query("F17_covariance", f"""WITH {_NODES}, x AS (SELECT id, unnest(range(32)) AS i, unnest(s) AS x FROM nodes), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1), n AS (SELECT count(*) AS n FROM nodes)
SELECT a.i::INT AS i, b.i::INT AS j, round((sum(a.x * b.x) - any_value(n) * any_value(p.m) * any_value(q.m)) / greatest(1, any_value(n) - 1), 6) AS value FROM x a JOIN x b ON b.id = a.id JOIN m p ON p.i = a.i JOIN m q ON q.i = b.i, n GROUP BY 1, 2""")
def _(spark, d):
    _, _, cov = spectral.covariance(nodes(spark, d), "s")
    return spark.createDataFrame([(i, j, round(float(x), 6) + 0.0) for i, row in enumerate(cov) for j, x in enumerate(row)], "i int, j int, value double")


@query("I27_whitening")
def _(spark, d):
    out = spectral.whitened(nodes(spark, d).select("id", "f", "b"))
    return out.select("id", r6(vec.dot(F.col("f"), F.col("b"))).alias("fb"), r6(F.col("f")[0]).alias("f1"))


@query("I30_causal_subspace")
def _(spark, d):
    own = spectral.Subspace.fit(nodes(spark, d))
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(own.values)] + [(-1, round(own.ratio(), 6))], "k int, value double")


@query("C13_projection")
def _(spark, d):
    out = spectral.Subspace.fit(nodes(spark, d)).project(nodes(spark, d).select("id", "f"), "f", "p")
    return out.select("id", r6(vec.norm(F.col("p"))).alias("size"))


@query("C14_subspace_scores")
def _(spark, d):
    own = spectral.Subspace.fit(nodes(spark, d))
    return own.scores(neighbour_pairs(spark, d)).select("i", "j", r6("plain").alias("plain"), r6("weighted").alias("weighted"))


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


@query("I23_gram_vectors")
def _(spark, d):
    rows = _turns(spark, d)
    out = embed.GramVectors.fit(rows, dim=64).embed(rows)
    return out.select("conv_id", "turn", r6(vec.dot(F.col("f"), F.col("b"))).alias("fb"))


@query("I25_embedder")
def _(spark, d):
    rows = _turns(spark, d)
    return embed.embedder(rows, dim=64)(rows).select("conv_id", "turn", r6(vec.norm(F.col("s"))).alias("size"))


@query("I26_paraphrases")
def _(spark, d):
    out = embed.paraphrased(_turns(spark, d), dim=64)
    return out.select("conv_id", "turn", r6(vec.dot(F.col("f"), F.col("b"))).alias("fb"), r6(vec.norm(F.col("s"))).alias("size"))


@query("I28_canonical_vectors")
def _(spark, d):
    out = spectral.whitened(cut(embed.paraphrased(_turns(spark, d), dim=64).select("conv_id", "turn", "f", "b"), "paraphrased"))
    return out.select("conv_id", "turn", r6(vec.dot(F.col("f"), F.col("b"))).alias("fb"))
