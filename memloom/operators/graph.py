"""Analytics of a typed, signed, directed graph given as nodes (id) and edges (src, dst, edge_type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import bounds, vec
from memloom.functions.text import edge_type
from memloom.operators.components import connected_components
from memloom.sources.scratch import cut

# Sign of an edge type at the target.
SIGNS = {"supports": 1.0, "agrees": 1.0, "temporal_next": 1.0, "pivots": 1.0, "contradicts": -1.0, "superseded": -1.0, "corrects": -0.5, "pending": 0.5}


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v) of both directions, distinct, without loops."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src"))
    return both.where("u <> v").distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes at no edge's end."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.select("id").join(ends, "id", "left_anti")


def weighted_adjacency(edges: DataFrame) -> DataFrame:
    """(u, v, a): absolute weights of both directions, parallel edges summed."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.abs("weight").alias("a")).union(edges.select("dst", "src", F.abs("weight")))
    return both.groupBy("u", "v").agg(F.sum("a").alias("a"))


def laplacian(nodes: DataFrame, edges: DataFrame, normalized: bool = True) -> DataFrame:
    """(u, v, value) of D - A, or of I - D^-1/2 A D^-1/2, where a node without edges keeps 1."""
    a = weighted_adjacency(edges)
    degree = a.groupBy("u").agg(F.sum("a").alias("d"))
    own = nodes.select(F.col("id").alias("u")).join(degree, "u", "left")
    if not normalized:
        return own.select("u", F.col("u").alias("v"), F.coalesce("d", F.lit(0.0)).alias("value")).union(a.select("u", "v", -F.col("a")))
    off = a.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    return own.select("u", F.col("u").alias("v"), F.lit(1.0).alias("value")).union(off.select("u", "v", -F.col("a") / F.sqrt(F.col("d") * F.col("e"))))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the node's component; nodes without edges are their own."""
    tied = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.select("id").join(tied.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(u, v, common) of adjacent pairs u < v. Wedges start at the end of lower degree, so a hub isn't paired with
    itself over all its neighbours."""
    adj = adjacency(edges)
    degree = adj.groupBy("u").agg(F.count("*").alias("d"))
    full = adj.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    up = full.where((F.col("d") < F.col("e")) | ((F.col("d") == F.col("e")) & (F.col("u") < F.col("v")))).select("u", "v")
    wedge = up.join(up.select("u", F.col("v").alias("w")), "u").where("v <> w")
    triangles = wedge.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    pairs = triangles.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("u", "v"), ("u", "w"), ("v", "w"))])).alias("p")).select("p.*")
    count = pairs.groupBy("u", "v").agg(F.count("*").alias("common"))
    return adj.where("u < v").join(count, ["u", "v"], "left").select("u", "v", F.coalesce("common", F.lit(0)).alias("common"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, coefficient): 2 T / (k (k - 1)), 0 below two neighbours."""
    degree = adjacency(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    shared = common_neighbours(edges)
    twice = shared.select(F.col("u").alias("id"), "common").union(shared.select("v", "common")).groupBy("id").agg(F.sum("common").alias("t2"))
    rows = nodes.select("id").join(degree, "id", "left").join(twice, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("t2", F.lit(0)).alias("t2"))
    return rows.select("id", "degree", F.when(F.col("degree") < 2, 0.0).otherwise(F.col("t2") / F.greatest(F.col("degree") * (F.col("degree") - 1), F.lit(1))).alias("coefficient"))


def forman(edges: DataFrame) -> DataFrame:
    """Edges with kappa = 4 - deg(u) - deg(v) + 2 common neighbours; a loop has 0."""
    degree = adjacency(edges).groupBy(F.col("u").alias("n")).agg(F.count("*").alias("d"))
    pairs = common_neighbours(edges).join(degree.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v")
    kappa = pairs.select(F.col("u").alias("lo"), F.col("v").alias("hi"), (4 - F.col("du") - F.col("dv") + 2 * F.col("common")).cast("double").alias("k"))
    keyed = edges.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    return keyed.join(kappa, ["lo", "hi"], "left").withColumn("kappa", F.coalesce("k", F.lit(0.0))).drop("lo", "hi", "k")


def ollivier(edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(u, v, kappa) of adjacent pairs u < v: 1 - (1 - shared mass) / max(1 / max(w, .01), 1), where a node keeps
    ``alpha`` of its mass and its neighbours get the rest by weight (the greatest of parallel edges)."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.abs("weight").alias("a")).union(edges.select("dst", "src", F.abs("weight"))).where("u <> v")
    w = both.groupBy("u", "v").agg(F.max("a").alias("a"))
    total = w.groupBy("u").agg(F.sum("a").alias("t"), F.count("*").alias("n"))
    share = F.when(F.col("t") > 0, F.col("a") / F.col("t")).otherwise(1 / F.col("n"))
    mass = w.join(total, "u").select("u", F.col("v").alias("k"), ((1 - alpha) * share).alias("m")).union(total.select("u", F.col("u").alias("k"), F.lit(alpha)))
    pairs = w.where("u < v")
    # the masses of the end of lower degree are looked up at the other one, so a hub isn't expanded for each neighbour
    size = total.select("u", "n")
    sized = pairs.join(size, "u").join(size.select(F.col("u").alias("v"), F.col("n").alias("n2")), "v")
    ends = sized.select("u", "v", F.when(F.col("n") <= F.col("n2"), F.col("u")).otherwise(F.col("v")).alias("x"), F.when(F.col("n") <= F.col("n2"), F.col("v")).otherwise(F.col("u")).alias("y"))
    shared = ends.join(mass.withColumnRenamed("u", "x"), "x").join(mass.select(F.col("u").alias("y"), "k", F.col("m").alias("m2")), ["y", "k"]).groupBy("u", "v").agg(F.sum(F.least("m", "m2")).alias("s"))
    length = F.greatest(1 / F.greatest("a", F.lit(0.01)), F.lit(1.0))
    return pairs.join(shared, ["u", "v"], "left").select("u", "v", (1 - (1 - F.coalesce("s", F.lit(0.0))) / length).alias("kappa"))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(id, score) after ``rounds`` steps of personalised PageRank on signed weights, row-normalised by their
    absolute sum; mass of nodes without outgoing edges is lost. Of parallel edges the last counts: by the column
    created, where there is one, then by type. Ranks are
    cut every round, so the lineage stays short."""
    last = [c for c in ("created", "edge_type") if c in edges.columns]
    w = edges.groupBy("src", "dst").agg(F.max_by("weight", F.struct(*last, "weight")).alias("w"))
    out = w.join(w.groupBy("src").agg(F.sum(F.abs("w")).alias("t")), "src").where("t > 0").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))
    out = cut(out, "pagerank-steps")
    chosen = seeds.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    start = chosen.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("n")))).select("id", (1.0 / F.col("n")).alias("q"))
    base = cut(nodes.select("id").join(start, "id", "left").select("id", F.coalesce("q", F.lit(0.0)).alias("q")), "pagerank-base")
    rank = base.select("id", F.col("q").alias("score"))
    for _ in range(rounds):
        flow = out.join(rank, out.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("flow"))
        rank = cut(base.join(flow, "id", "left").select("id", ((1 - damping) * F.col("q") + damping * F.coalesce("flow", F.lit(0.0))).alias("score")), "pagerank", rank)
    return rank


def pagerank_of(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(qid, id, score) of the same from each query's seeds (qid, id) at once. Only nodes that a seed reaches have a
    row. Rounds end when no query's scores change by more than ``tolerance`` in all."""
    last = [c for c in ("created", "edge_type") if c in edges.columns]
    w = edges.groupBy("src", "dst").agg(F.max_by("weight", F.struct(*last, "weight")).alias("w"))
    out = cut(w.join(w.groupBy("src").agg(F.sum(F.abs("w")).alias("t")), "src").where("t > 0").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "pagerank-steps")
    chosen = seeds.select("qid", "id").distinct().join(nodes.select("id"), "id", "left_semi")
    start = cut(chosen.join(chosen.groupBy("qid").agg(F.count("*").alias("n")), "qid").select("qid", "id", (1.0 / F.col("n")).alias("q")), "pagerank-start")
    rank = start.withColumnRenamed("q", "score")
    for _ in range(rounds):
        flow = out.join(rank, out.src == rank.id).select("qid", F.col("dst").alias("id"), (damping * F.col("p") * F.col("score")).alias("x"))
        both = flow.union(start.select("qid", "id", (1 - damping) * F.col("q"))).groupBy("qid", "id").agg(F.sum("x").alias("score"))
        new = cut(both.join(rank.withColumnRenamed("score", "was"), ["qid", "id"], "left"), "pagerank")
        rank = new.select("qid", "id", "score")
        if new.groupBy("qid").agg(F.sum(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0)))).alias("d")).where(F.col("d") >= tolerance).isEmpty():
            break
    return rank


def hops(edges: DataFrame, sources: DataFrame, most: int = 6) -> DataFrame:
    """(source, id, hops) of all nodes within ``most`` steps of each source, itself left out."""
    adj = cut(adjacency(edges), "adjacency")
    seen = edge = cut(sources.select(F.col("id").alias("source"), F.col("id")).distinct().withColumn("hops", F.lit(0)), "hops")
    for step in range(1, most + 1):
        edge = edge.join(adj, edge.id == adj.u).select("source", F.col("v").alias("id")).distinct().join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(step))
        edge = cut(edge, "hops")  # only what is new is written
        if edge.isEmpty():
            break
        seen = seen.union(edge)
    return seen.where("hops > 0")


def hops_between(edges: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """(a, b, hops) of the pairs (a, b) of different nodes that are at most ``most`` steps apart. Both ends go half of
    the way and meet, so a pair costs what is near its ends and not all that ``most`` steps reach."""
    pairs = cut(pairs.select("a", "b").distinct(), "hop-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    near = hops(edges, ends, -(-most // 2)).unionByName(ends.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")))
    one, two = (near.select(F.col("source").alias(x), F.col("id").alias("mid"), F.col("hops").alias(f"h{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, ["b", "mid"]).groupBy("a", "b").agg(F.min(F.col("ha") + F.col("hb")).alias("hops"))
    return met.where(F.col("hops") <= most)


def signed_incidence(edges: DataFrame) -> DataFrame:
    """(src, dst, node, value): -1 at the source and the type's sign at the target of each edge."""
    sign = F.coalesce(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])[F.col("edge_type")], F.lit(0.5))
    return edges.select("src", "dst", "edge_type", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(-1.0).alias("value")), F.struct(F.col("dst").alias("node"), sign.alias("value")))).alias("x")).select("src", "dst", "edge_type", "x.*")


def sheaf_laplacian(edges: DataFrame) -> DataFrame:
    """(u, v, value) of the incidence's transpose times itself."""
    d = signed_incidence(edges)
    other = d.select("src", "dst", "edge_type", F.col("node").alias("v"), F.col("value").alias("w"))
    return d.join(other, ["src", "dst", "edge_type"]).groupBy(F.col("node").alias("u"), "v").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def motifs(edges: DataFrame, least: int = 2) -> DataFrame:
    """(pattern, cnt) of positive two-step chains a -> b -> c with c other than a, at least ``least`` of them. The
    middle node's edges are counted by type first, so a hub isn't expanded into its paths; chains back to a are
    taken off by an equi-join."""
    up = edges.where("weight > 0")
    into = up.groupBy(F.col("dst").alias("b"), F.col("edge_type").alias("t1")).agg(F.count("*").alias("x"))
    out = up.groupBy(F.col("src").alias("b"), F.col("edge_type").alias("t2")).agg(F.count("*").alias("y"))
    back = up.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_type").alias("t1")).join(up.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.col("edge_type").alias("t2")), ["a", "b"])
    name = F.concat_ws(" → ", "t1", "t2").alias("pattern")
    whole = into.join(out, "b").groupBy(name).agg(F.sum(F.col("x") * F.col("y")).alias("n"))
    returns = back.groupBy(name).agg(F.count("*").alias("r"))
    return whole.join(returns, "pattern", "left").select("pattern", (F.col("n") - F.coalesce("r", F.lit(0))).cast("bigint").alias("cnt")).where(F.col("cnt") >= least)


def motif_instances(edges: DataFrame, least: int = 2) -> DataFrame:
    """(pattern, a, b, c): the chains of the patterns that :func:`motifs` counts. As many rows as there are chains,
    which a hub makes many; the counts alone don't need them."""
    up = edges.where("weight > 0")
    one = up.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_type").alias("t1"))
    two = up.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("edge_type").alias("t2"))
    chains = one.join(two, "b").where("a <> c").select(F.concat_ws(" → ", "t1", "t2").alias("pattern"), "a", "b", "c")
    return chains.join(F.broadcast(motifs(edges, least).select("pattern")), "pattern")  # pairs of types


def mean_field(edges: DataFrame, rounds: int = 5, alpha: float = 0.3, beta: float = 1.0) -> DataFrame:
    """Edges with refined: synchronous smoothing towards the mean of edges of the same type at either end. A
    neighbour that shares both ends counts twice; without neighbours the mean is 0. Sums at each (node, type) take
    the place of pairs of edges, so a hub costs its degree and not its square."""
    now = edges.withColumn("refined", F.col("weight"))
    for _ in range(rounds):
        ends = now.select(F.col("src").alias("n"), "edge_type", "refined").union(now.where("src <> dst").select("dst", "edge_type", "refined"))
        sums = ends.groupBy("n", "edge_type").agg(F.sum("refined").alias("s"), F.count("*").alias("c"))
        a = now.join(sums.select(F.col("n").alias("src"), "edge_type", F.col("s").alias("s1"), F.col("c").alias("c1")), ["src", "edge_type"]).join(sums.select(F.col("n").alias("dst"), "edge_type", F.col("s").alias("s2"), F.col("c").alias("c2")), ["dst", "edge_type"])
        count = F.col("c1") + F.col("c2") - 2
        mean = F.when(count > 0, (F.col("s1") + F.col("s2") - 2 * F.col("refined")) / F.greatest(count, F.lit(1))).otherwise(0.0)
        now = cut(a.withColumn("refined", ((1 - alpha) * F.col("refined") + alpha * mean + beta * F.col("weight")) / (1 + beta)).drop("s1", "c1", "s2", "c2"), "mean-field", now)
    return now


def like_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type, n): how many other edges of its type share an end with each edge that has one."""
    ends = edges.select(F.col("src").alias("x"), "edge_type").union(edges.where("src <> dst").select("dst", "edge_type"))
    degree = ends.groupBy("x", "edge_type").agg(F.count("*").alias("d"))
    # edges with both ends in common were counted at either end
    pair = [F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")]
    twins = edges.where("src <> dst").groupBy(*pair, "edge_type").agg(F.count("*").alias("twins"))
    rows = edges.join(degree.select(F.col("x").alias("src"), "edge_type", F.col("d").alias("a")), ["src", "edge_type"]).join(degree.select(F.col("x").alias("dst"), "edge_type", F.col("d").alias("b")), ["dst", "edge_type"])
    rows = rows.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(twins, ["lo", "hi", "edge_type"], "left")
    n = F.when(F.col("src") == F.col("dst"), F.col("a") - 1).otherwise(F.col("a") + F.col("b") - 1 - F.coalesce("twins", F.lit(1)))
    return rows.select("src", "dst", "edge_type", n.cast("bigint").alias("n")).where("n > 0")


def unprotected(edges: DataFrame, protected: DataFrame) -> DataFrame:
    """Edges that aren't among the protected ones."""
    return edges.join(protected.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def prune(edges: DataFrame, protect: float = 0.7) -> DataFrame:
    """Edges with kappa, s2, log_ratio and pruned: the evidence speaks for a zero weight, and no bottleneck
    (kappa below -``protect``) is touched. A stored variance (column s_squared) counts where it lies between 0 and
    0.99."""
    own = bounds.cosine_edge_variance(F.col("weight"), F.col("gamma_anti"))
    if "s_squared" in edges.columns:
        own = F.when((F.col("s_squared") > 0) & (F.col("s_squared") < 0.99), F.col("s_squared")).otherwise(own)
    scored = forman(edges).withColumn("s2", own)
    scored = scored.withColumn("log_ratio", bounds.bmrs_log_ratio(F.col("weight"), F.col("s2")))
    return scored.withColumn("pruned", (F.col("kappa") >= -protect) & (F.col("log_ratio") > 0))


def decompose(pairs: DataFrame) -> DataFrame:
    """The pairs with sym, anti (the two parts of their score) and strength of the direction."""
    fi, bi, fj, bj = (F.col(c) for c in ("fi", "bi", "fj", "bj"))
    scored = pairs.withColumns({"anti": vec.gamma_anti(fi, bi, fj, bj), "sym": vec.gamma_sym(fi, bi, fj, bj)})
    return scored.withColumn("strength", vec.direction_strength(F.col("anti"), vec.causal(fi, bi), vec.causal(fj, bj)))


def direction(strength: Column, anti: Column, directional: float = 0.2) -> Column:
    """Which ways an edge goes: both where the direction is weak, else the one that the antisymmetric part points to."""
    return F.when(strength < directional, "both").when(anti > 0, "there").otherwise("back")


def induce(pairs: DataFrame, directional: float = 0.2) -> DataFrame:
    """(src, dst, edge_type, weight, gamma_score, gamma_anti) of pairs (i, j, cos, fi, bi, fj, bj and texts ti, tj):
    both directions where the antisymmetric part is weak, else the one that it points to. Null texts are empty."""
    scored = decompose(pairs).withColumn("way", direction(F.col("strength"), F.col("anti"), directional))
    there = F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("sym") + F.col("anti")).alias("gamma_score"), F.col("anti").alias("gamma_anti"), F.col("ti").alias("said"), F.col("tj").alias("answer"))
    back = F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), (F.col("sym") - F.col("anti")).alias("gamma_score"), (-F.col("anti")).alias("gamma_anti"), F.col("tj").alias("said"), F.col("ti").alias("answer"))
    chosen = F.when(F.col("way") == "both", F.array(there, back)).when(F.col("way") == "there", F.array(there)).otherwise(F.array(back))
    rows = scored.select("cos", F.explode(chosen).alias("e")).select("e.*", "cos")
    kind = edge_type(F.col("said"), F.col("answer"), F.col("gamma_score"), F.col("gamma_anti"))
    return rows.withColumn("edge_type", kind).withColumn("weight", vec.signed_weight(F.col("edge_type"), F.col("cos"))).select("src", "dst", "edge_type", "weight", "gamma_score", "gamma_anti")


def potentials(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, x): values that agree along a tree of shortest ways from each component's least node, where
    an edge asks that its source be its type's sign times its target. As many rounds as the graph is deep."""
    sign = F.coalesce(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])[F.col("edge_type")], F.lit(0.5))
    arcs = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), (1 / sign).alias("gain")).union(edges.where("src <> dst").select("dst", "src", sign))
    arcs = cut(arcs.groupBy("u", "v").agg(F.min("gain").alias("gain")), "arcs")
    own = cut(components(nodes, edges), "potentials")
    known = new = cut(own.where("id = component").withColumn("x", F.lit(1.0)), "potentials")
    while True:
        step = new.join(arcs, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id"), "component").agg(F.min(F.col("x") * F.col("gain")).alias("x"))
        new = cut(step.join(known.select("id"), "id", "left_anti"), "potentials")  # only what is new is written
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def harmonic_dimension(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(component, harmonic): whether values other than 0 meet all its edges, which they do where the signs round
    every cycle multiply to one. The number of true rows is the dimension of the sheaf Laplacian's kernel."""
    x = potentials(nodes, edges)
    sign = F.coalesce(F.create_map(*[F.lit(v) for kv in SIGNS.items() for v in kv])[F.col("edge_type")], F.lit(0.5))
    ends = edges.join(x.select(F.col("id").alias("src"), "component", F.col("x").alias("a")), "src").join(x.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst")
    off = F.abs(F.col("a") - sign * F.col("b")) > tolerance * (F.abs("a") + F.abs("b"))
    broken = ends.where(off).select("component").distinct().withColumn("broken", F.lit(True))
    return x.select("component").distinct().join(broken, "component", "left").select("component", F.col("broken").isNull().alias("harmonic"))
