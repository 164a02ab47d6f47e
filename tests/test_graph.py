"""Hand graphs and closed forms with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import bounds, text, vec
from memloom.operators import graph, retrieve
from memloom.operators.components import connected_components


def graph_of(spark, links):
    rows = [(a, b, t, w, None) for a, b, t, w in links]
    return spark.createDataFrame(rows, "src long, dst long, edge_type string, weight double, gamma_anti double")


def nodes_of(spark, n):
    return spark.range(n)


def test_triangle_clusters(spark):
    e = graph_of(spark, [(0, 1, "agrees", 0.5), (1, 2, "agrees", 0.5), (0, 2, "agrees", 0.5)])
    assert [r.coefficient for r in graph.clustering(nodes_of(spark, 3), e).collect()] == [1.0] * 3


def test_two_cliques_and_a_bridge(spark):
    clique = lambda k: [(k + a, k + b, "agrees", 0.5) for a in range(4) for b in range(a + 1, 4)]
    got = {(r.src, r.dst): r.kappa for r in graph.forman(graph_of(spark, [*clique(0), *clique(4), (3, 4, "agrees", 0.5)])).collect()}
    assert got[3, 4] == -4 and all(1 <= k <= 2 for p, k in got.items() if p != (3, 4))


def test_star_hub_ranks_first(spark):
    e = graph_of(spark, [(0, k, "agrees", 0.5) for k in (1, 2, 3)])
    got = graph.pagerank(nodes_of(spark, 4), e, spark.createDataFrame([(0,)], "id long"), rounds=5).orderBy(F.desc("score")).first()
    assert got.id == 0


def test_components_of_a_long_path_and_nulls(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100
    assert connected_components(edges.limit(0)).count() == 0


def test_walk_keeps_ends_and_never_repeats(spark):
    e = graph_of(spark, [(1, 2, "agrees", 0.5), (2, 1, "agrees", 0.5), (2, 3, "agrees", -0.5)])
    got = retrieve.walk(spark.createDataFrame([(0, 1)], "qid long, seed long"), e, depth=5).collect()
    assert [list(r.nodes) for r in got] == [[1, 2]]


def test_motif_and_mean_field(spark):
    e = graph_of(spark, [(1, 2, "supports", 0.5), (2, 3, "pivots", 0.5), (4, 5, "supports", 0.5), (5, 6, "pivots", 0.5), (7, 8, "agrees", 0.5)])
    assert [(r.pattern, r.cnt) for r in graph.motifs(e).collect()] == [("supports → pivots", 2)]
    refined = {(r.src, r.dst): r.refined for r in graph.mean_field(graph_of(spark, [(1, 2, "supports", 0.1), (2, 3, "supports", 0.5), (3, 4, "supports", 0.1)])).collect()}
    assert refined[2, 3] < 0.5


def test_gamma_identities(spark):
    row = spark.createDataFrame([([0.1, 0.7], [0.3, -0.2], [0.5, 0.4], [-0.6, 0.9])], "fi array<double>, bi array<double>, fj array<double>, bj array<double>")
    a = [F.col(c) for c in row.columns]
    r = row.select(vec.gamma(*a).alias("g"), vec.gamma(a[2], a[3], a[0], a[1]).alias("back"), vec.gamma_sym(*a).alias("sym"), vec.gamma_anti(*a).alias("anti")).first()
    assert r.g == pytest.approx(r.sym + r.anti) and r.g - r.back == pytest.approx(2 * r.anti)


def test_gate_and_edge_types(spark):
    rows = [("ok", 0.05), ("As an AI language model, I cannot help with that.", 0.1), (" ".join(["yes"] * 15), 0.2), ("", 0.0)]
    for t, want in rows:
        assert spark.range(1).select(text.quality_score(F.lit(t)).alias("q")).first().q == pytest.approx(want)
    kinds = [("The pump runs at noon.", "Not at all; the pump is off.", -0.2, "contradicts"), ("We tried the small pump.", "They moved to a larger one.", 0.3, "pivots"), ("The valve was opened.", "Two weeks later the tank was full.", 0.0, "temporal_next"), ("The pump is loud.", "The fan hums.", 0.0, "pending")]
    for s, t, g, want in kinds:
        assert spark.range(1).select(text.edge_type(F.lit(s), F.lit(t), F.lit(g), F.lit(None).cast("double")).alias("k")).first().k == want
    bio = "User Jane Roe is a Google engineer based in San Francisco, age 32."
    for buffer, low in (("", False), (None, False), ("nothing known", True), ("Jane at Google in San Francisco", False)):
        got = spark.range(1).select(text.quality_score(F.lit(bio), F.lit(buffer)).alias("q")).first().q
        assert (got == 0.05) == low


def test_words_of_all_scripts_and_paragraphs(spark):
    row = spark.range(1).select(text.squash(F.lit("Él niño, café!")).alias("w"), text.paragraphs(F.lit("short\n\n  one line\nand its second line \n\ntoo short")).alias("p"), text.thoughts(F.lit("We decided on it. No. It failed!")).alias("t")).first()
    assert row.w == "él niño café" and row.p == ["one line\nand its second line"]
    assert [(x.sentence, x.role) for x in row.t] == [("We decided on it.", "decision"), ("It failed!", "outcome")]


def test_bounds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda *v: [F.lit(x) for x in v]
    assert one(bounds.bmrs_log_ratio(*lit(0.7, 0.01))) < 0 < one(bounds.bmrs_log_ratio(*lit(0.001, 0.01)))
    assert one(bounds.chebyshev_cantelli(*lit(0.5, 0.5, 0.1, 100))) is None
    assert one(bounds.crc_hoeffding(*lit(0.1, 0))) == 1.0
    assert one(bounds.rag_bound(*lit(0.1, 50, 0.05))) < one(bounds.rag_bound(*lit(0.1, 50, 0.5)))
    assert one(bounds.crc_hoeffding(*lit(0.0, 15))) == pytest.approx(math.sqrt(math.log(20) / 30))


def test_whole_queries_reach_beyond_the_samples(spark):
    import numpy as np

    from memloom.plans.fixtures import edges, nodes
    from memloom.plans import modes  # noqa: F401 - registers some of them
    from memloom.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = sorted((r.id, r.s) for r in nodes(spark, d).select("id", "s").collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in QUERIES["J01_earlier_neighbours"](spark, d).collect():
        got.setdefault(r.i, []).append((-r.cos, r.j))
    assert set(got) == set(ids[1:].tolist())
    for k in range(1, len(ids)):
        best = np.sort(-(v[:k] @ v[k]))[:10]
        assert np.allclose(sorted(c for c, _ in got[ids[k]]), best, atol=2e-6) and all(j < ids[k] for _, j in got[ids[k]])
    links = {(r.src, r.dst) for r in edges(spark, d).select("src", "dst").collect()}
    chains = sorted((a, b, c) for a, b in links for x, c in links if x == b and a != c)
    assert sorted(tuple(r) for r in QUERIES["E06_two_chains"](spark, d).select("a", "b", "c").distinct().collect()) == chains
    hundreds = {i for i in ids.tolist() if i % 100 == 0}
    assert len(hundreds) > 1
    for name, column in (("K01_symmetric_search", "qid"), ("K02_beam_walk", "qid"), ("K05_greedy_subgraph", "qid"), ("L11_hops", "source")):
        assert {r[0] for r in QUERIES[name](spark, d).select(column).distinct().collect()} <= hundreds
    assert {r[0] for r in QUERIES["K01_symmetric_search"](spark, d).select("qid").distinct().collect()} == hundreds
    items = {r.item_id for r in spark.read.parquet(f"{d}/benchmark.parquet").where("item_id % 100 = 0").collect()}
    assert {r[0] for r in QUERIES["I21_bm25"](spark, d).select("qid").distinct().collect()} <= items
