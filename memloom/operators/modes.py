"""Retrieval modes for batches of queries: by vectors alone, by walks and an extracted subgraph, by both fused, chosen
by the query's words and the graph around its seeds; by hops over entities; and answers bounded by their support."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import bounds, text, vec
from memloom.operators import graph, retrieve
from memloom.operators.embed import hash_vectors
from memloom.operators.vectors import top_k
from memloom.sources.scratch import cut

ALGORITHMS = ("greedy", "steiner", "forest", "pagerank")
# Share of an entity's similarity that counts, and how many entities a text and a round give.
ENTITY_SHARE, ENTITIES_EACH, ENTITY_BUDGET = 0.6, 4, 8


def seeds_of(queries: DataFrame, nodes: DataFrame, k: int, *, scope: str | None = None) -> DataFrame:
    """(qid, seed, rank, score): the k nearest nodes (id, s) of each query (qid, v)."""
    more = [scope] if scope else []
    got = top_k(queries.select("qid", "v", *more), nodes.select("id", F.col("s").alias("v"), *more), k, scope=scope)
    return cut(got.select("qid", F.col("id").alias("seed"), "rank", "score"), "seeds")


def union_of(paths: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (qid, id, first) and edges (qid, src, dst, weight, first) on the walks from the seeds, each once, in
    the order in which they come up: by the seed's rank, the walk's place and the step."""
    ranked = paths.join(seeds.select("qid", "seed", F.col("rank").alias("seed_rank")), ["qid", "seed"])
    at = lambda k: F.struct("seed_rank", "place", k)
    steps = ranked.select("qid", "seed_rank", "place", F.posexplode("nodes").alias("k", "id"))
    on = steps.groupBy("qid", "id").agg(F.min(at("k")).alias("first"))
    hops = ranked.select("qid", "seed_rank", "place", F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("src"), F.expr("slice(nodes, 2, size(nodes))").alias("dst"))).alias("k", "x"))
    used = hops.select("qid", F.col("x.src").alias("src"), F.col("x.dst").alias("dst"), at("k").alias("first")).groupBy("qid", "src", "dst").agg(F.min("first").alias("first"))
    return on, used.join(edges.select("src", "dst", "weight"), ["src", "dst"]).select("qid", "src", "dst", "weight", "first")


class _Graph:
    """One query's subgraph: nodes and edges in the order in which they came up."""

    def __init__(self, ids: list[int], links: list[tuple[int, int, float]]) -> None:
        self.ids, self.links = ids, links
        self.prize = dict.fromkeys(ids, 0.0)
        self.around: dict[int, list[tuple[int, int]]] = defaultdict(list)  # node -> (edge, other end)
        for e, (a, b, w) in enumerate(links):
            for x, y in ((a, b), (b, a)):
                self.prize[x] = self.prize.get(x, 0.0) + max(0.0, w)
                self.around[x].append((e, y))

    def grow(self, start: set[int], cost, budget: float, inside: set[int] | None = None) -> tuple[set[int], set[int]]:
        """The frontier node of greatest prize less cost is taken while that is above 0; the first that would break
        the budget ends it."""
        chosen, used, spent = set(start), set(), 0.0
        open_ = [(cost(e) - self.prize[y], e, y) for x in start for e, y in self.around[x]]
        heapq.heapify(open_)
        while open_:
            loss, e, y = heapq.heappop(open_)
            if y in chosen or inside is not None and y not in inside:
                continue
            if loss >= 0 or spent + cost(e) > budget:
                break
            chosen.add(y)
            used.add(e)
            spent += cost(e)
            for more in self.around[y]:
                heapq.heappush(open_, (cost(more[0]) - self.prize[more[1]], *more))
        return chosen, used

    def closed(self, chosen: set[int], used: set[int]) -> tuple[set[int], set[int]]:
        """With all positive edges between chosen nodes."""
        return chosen, used | {e for e, (a, b, w) in enumerate(self.links) if w > 0 and a in chosen and b in chosen}

    def greedy(self, seeds: list[int], budget: float) -> tuple[set[int], set[int]]:
        if not self.links:
            return set(self.ids), set()
        start = {s for s in seeds if s in self.prize} or {max(self.ids, key=lambda x: self.prize[x])}
        return self.closed(*self.grow(start, lambda e: max(0.0, -self.links[e][2]), budget))

    def forest(self, seeds: list[int], budget: float, penalty: float = 1.5) -> tuple[set[int], set[int]]:
        if not self.links:
            return set(self.ids), set()

        def cost(e: int) -> float:
            w = self.links[e][2]
            return penalty * -w if w < 0 else max(0.01, 0.1 * (1 - w))

        label = {x: x for x in self.prize}

        def root(x: int) -> int:
            while label[x] != x:
                label[x] = x = label[label[x]]
            return x

        for a, b, w in self.links:
            if w > 0:
                label[root(a)] = root(b)
        parts: dict[int, list[int]] = defaultdict(list)
        for x in self.ids:
            parts[root(x)].append(x)
        chosen, used = set(), set()
        for part in parts.values():
            head = max(part, key=lambda x: self.prize[x])
            if self.prize[head] > 0:
                tree, edges = self.grow({head}, cost, budget, set(part))
                chosen |= tree
                used |= edges
        return self.closed(chosen, used)

    def steiner(self, seeds: list[int], budget: float, terminals: int = 3) -> tuple[set[int], set[int]]:
        """A tree that joins the nodes of greatest prize over short ways (length 1 / weight): the shortest ways
        between them, of which a least spanning tree is kept. Without two such nodes in one part: greedy."""
        if not self.links:
            return set(self.ids), set()
        length = {e: 1 / max(0.05, w) for e, (_, _, w) in enumerate(self.links) if w > 0}
        ends = [x for x in sorted(self.prize, key=lambda x: -self.prize[x]) if any(e in length for e, _ in self.around[x])][:terminals]
        ways: dict[int, dict[int, tuple[float, int, int]]] = {}
        for t in ends:  # shortest ways from each terminal: node -> (length, last edge, node before)
            far, open_ = {}, [(0.0, t, -1, t)]
            while open_:
                d, x, e, before = heapq.heappop(open_)
                if x not in far:
                    far[x] = d, e, before
                    for e2, y in self.around[x]:
                        if e2 in length and y not in far:
                            heapq.heappush(open_, (d + length[e2], y, e2, x))
            ways[t] = far
        ends = [t for t in ends if t in ways[ends[0]]] if ends else []
        if len(ends) < 2:
            return self.greedy([], budget)
        joined, used = {ends[0]}, set()
        while len(joined) < len(ends):
            _, a, b = min((ways[x][y][0], x, y) for x in joined for y in ends if y not in joined)
            joined.add(b)
            while b != a:
                _, e, b = ways[a][b]
                used.add(e)
        # a spanning tree of what the ways cover, without loose ends that are no terminals
        label: dict[int, int] = {}

        def root(x: int) -> int:
            while label.setdefault(x, x) != x:
                x = label[x]
            return x

        tree = set()
        for e in sorted(used, key=lambda e: (length[e], e)):
            a, b = root(self.links[e][0]), root(self.links[e][1])
            if a != b:
                label[a] = b
                tree.add(e)
        while True:
            degree: dict[int, int] = defaultdict(int)
            for e in tree:
                degree[self.links[e][0]] += 1
                degree[self.links[e][1]] += 1
            loose = {e for e in tree if any(degree[x] == 1 and x not in ends for x in self.links[e][:2])}
            if not loose:
                return {x for e in tree for x in self.links[e][:2]}, tree
            tree -= loose


def extract(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, algorithm: str = "greedy", budget: float = 10.0) -> DataFrame:
    """(qid, kind, a, b, place) of the subgraph chosen for each query: its nodes (kind n, id in a) and edges (kind e,
    src and dst), in order. nodes: (qid, id, first), edges: (qid, src, dst, weight, first), seeds: (qid, seed, rank).
    One query's subgraph is one group; it has at most seeds x beam x depth nodes."""
    import pandas as pd

    if algorithm not in ALGORITHMS[:3]:
        raise ValueError(f"no such extraction: {algorithm}")
    none = F.lit(None)
    rows = nodes.select("qid", F.lit("n").alias("kind"), F.col("id").alias("a"), none.cast("bigint").alias("b"), F.lit(0.0).alias("w"), "first")
    rows = rows.unionByName(edges.select("qid", F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"), "first"))
    start = F.struct(F.col("rank").alias("seed_rank"), F.lit(0).alias("place"), F.lit(0).alias("k"))
    rows = rows.unionByName(seeds.select("qid", F.lit("s").alias("kind"), F.col("seed").alias("a"), none.cast("bigint").alias("b"), F.lit(0.0).alias("w"), start.alias("first")))
    rows = rows.select("qid", "kind", "a", "b", "w", F.col("first.seed_rank").alias("x"), F.col("first.place").alias("y"), F.col("first.k").alias("z"))

    def choose(key, part):
        part = part.sort_values(["x", "y", "z", "a", "b"], kind="stable")
        of = lambda kind: part[part.kind == kind]
        held = _Graph([int(x) for x in of("n").a], [(int(a), int(b), float(w)) for a, b, w in of("e")[["a", "b", "w"]].itertuples(index=False)])
        chosen, used = getattr(held, algorithm)([int(x) for x in of("s").a], budget)
        out = [("n", x, None) for x in held.ids if x in chosen] + [("e", *held.links[e][:2]) for e in sorted(used)]
        return pd.DataFrame({"qid": key[0], "kind": [o[0] for o in out], "a": [o[1] for o in out], "b": pd.array([o[2] for o in out], "Int64"), "place": range(len(out))})

    return rows.groupBy("qid").applyInPandas(choose, "qid bigint, kind string, a bigint, b bigint, place int")


def by_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int, *, rounds: int = 50) -> DataFrame:
    """The same of the max(k, 5) nodes of greatest personalised PageRank from each query's seeds, with the edges
    between them. Only nodes that the seeds reach have a score and a row."""
    score = graph.pagerank_of(nodes, edges, seeds.select("qid", F.col("seed").alias("id")), rounds=rounds)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = cut(score.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < max(k, 5)), "pagerank-top")
    ends = top.select("qid", "id")
    inner = edges.select("src", "dst").join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["qid", "dst"])
    return top.select("qid", F.lit("n").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "place").union(inner.select("qid", F.lit("e"), "src", "dst", F.lit(max(k, 5))))


def by_paths(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, *, k: int = 10, depth: int = 4, algorithm: str = "greedy", budget: float = 10.0) -> DataFrame:
    """(qid, kind, a, b, place) of each query's subgraph: walks from its seeds, and what the algorithm chooses of
    them; the seeds where it chooses nothing."""
    if algorithm == "pagerank":
        out = by_pagerank(nodes, edges, seeds, k)
    else:
        paths = retrieve.walk(seeds.select("qid", "seed"), edges, depth=depth)
        out = extract(*union_of(paths, edges, seeds), seeds, algorithm=algorithm, budget=budget)
    out = cut(out, "subgraphs")
    plain = seeds.join(out.select("qid").distinct(), "qid", "left_anti")
    return out.unionByName(plain.select("qid", F.lit("n").alias("kind"), F.col("seed").alias("a"), F.lit(None).cast("bigint").alias("b"), (F.col("rank") - 1).cast("int").alias("place")))


def hybrid(seeds: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(qid, id, place, score): the nodes of the subgraph and the seeds, fused by their places, the k best. Ties keep
    the subgraph's order, then the seeds'."""
    on = chosen.where("kind = 'n'")
    lists = on.select("qid", F.col("a").alias("item"), F.lit(1.0).alias("w"), F.col("place").alias("pos"), F.lit(0).alias("list"))
    lists = lists.unionByName(seeds.select("qid", F.col("seed").alias("item"), F.lit(1.0).alias("w"), (F.col("rank") - 1).cast("int").alias("pos"), F.lit(1).alias("list")))
    fused = retrieve.fuse(lists).join(lists.groupBy("qid", "item").agg(F.min(F.struct("list", "pos")).alias("first")), ["qid", "item"])
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "first")
    return fused.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < k).select("qid", F.col("item").alias("id"), "place", "score")


def features(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """(qid, n_seeds, clustering, hops) of each query's seeds: their mean clustering, and the mean hops between those
    that reach each other within ``most`` steps (``most`` where none does, 0 for one seed)."""
    around = graph.clustering(nodes, edges).select(F.col("id").alias("seed"), "coefficient")
    mean = seeds.join(around, "seed", "left").groupBy("qid").agg(F.count("*").alias("n_seeds"), F.avg(F.coalesce("coefficient", F.lit(0.0))).alias("clustering"))
    both = seeds.select("qid", F.col("seed").alias("a")).join(seeds.select("qid", F.col("seed").alias("b")), "qid").where("a < b")
    both = both.join(graph.hops_between(edges, both, most), ["a", "b"])
    apart = both.groupBy("qid").agg(F.avg("hops").alias("hops"))
    return mean.join(apart, "qid", "left").select("qid", "n_seeds", "clustering", F.when(F.col("n_seeds") < 2, 0.0).otherwise(F.coalesce("hops", F.lit(float(most)))).alias("hops"))


def routed(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, mode) of each query (qid, text): symmetric, walk_short, walk_deep or hybrid."""
    n, e = nodes.count(), edges.where("weight > 0").count()
    rows = queries.select("qid", F.coalesce("text", F.lit("")).alias("text")).join(features(seeds, nodes, edges), "qid", "left").fillna(0, ["n_seeds", "clustering", "hops"])
    return rows.select("qid", retrieve.route(F.col("text"), F.lit(e / max(1, n)), F.col("clustering"), F.col("hops"), F.col("n_seeds")).alias("mode"))


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, *, mode: str = "auto", k: int = 5, depth: int = 4, algorithm: str = "greedy", scope: str | None = None) -> DataFrame:
    """(qid, mode, id, place) of the nodes found for each query (qid, text, v) in one of the modes symmetric, path,
    hybrid or auto. auto: as the query is routed, with walks of at least 4 steps for a deep and at most 2 for a short
    walk; each mode's queries go through it together."""
    seeds = seeds_of(queries, nodes, k, scope=scope)
    if mode == "auto":
        ways = cut(routed(queries, seeds, nodes, edges), "routed")
    else:
        ways = queries.select("qid", F.lit(mode).alias("mode"))
    out = seeds.join(ways.where("mode = 'symmetric'"), "qid").select("qid", "mode", F.col("seed").alias("id"), (F.col("rank") - 1).alias("place"))
    steps = {"path": depth, "walk_deep": max(depth, 4), "walk_short": min(depth, 2), "hybrid": depth}
    present = {r.mode for r in ways.select("mode").distinct().collect()}  # the names of modes
    for name in sorted(present & steps.keys()):
        own = cut(seeds.join(ways.where(F.col("mode") == name).select("qid"), "qid", "left_semi"), "mode-seeds")
        chosen = by_paths(own, nodes, edges, k=k, depth=steps[name], algorithm=algorithm)
        if name == "hybrid":
            found = hybrid(own, chosen, k).select("qid", "id", "place")
        else:
            found = chosen.where("kind = 'n'").select("qid", F.col("a").alias("id"), "place")
        out = out.unionByName(found.select("qid", F.lit(name).alias("mode"), "id", "place"))
    return out


def multi_hop(queries: DataFrame, nodes: DataFrame, *, k_init: int = 5, k_each: int = 3, k_final: int = 10, hops: int = 2, embed=hash_vectors) -> DataFrame:
    """(qid, id, score, place) for queries (qid, text) over nodes (id, text, s): the seeds of the query, then in each
    round the nodes nearest to the entities of the query and of the nodes that the round before raised. A node's score
    is the greatest of its similarity to the query and 0.6 of that to an entity."""
    asked = cut(embed(queries.select("qid", "text")).select("qid", "text", F.col("s").alias("v")), "asked")
    rows = nodes.select("id", F.col("s").alias("v"))
    texts = nodes.select("id", text.entities(F.col("text"), most=ENTITIES_EACH).alias("names"))
    seeds = seeds_of(asked, nodes, k_init)
    known = seeds.select("qid", F.col("seed").alias("id"), "score")
    frontier = seeds.select("qid", F.col("seed").alias("id"), F.col("rank").alias("place"))
    for hop in range(hops):
        listed = frontier.join(texts, "id").select("qid", "place", "names")
        if hop == 0:
            listed = listed.union(asked.select("qid", F.lit(0), text.entities(F.col("text"), most=ENTITIES_EACH)))
        # texts are asked in order until their entities are enough
        gathered = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "names"))).alias("l"))
        start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("full"))
        enough = ENTITY_BUDGET * (hop + 1)
        step = lambda acc, x: F.when(acc["full"], acc).otherwise(F.struct(F.concat(acc["names"], x["names"]).alias("names"), ((x["place"] > 0) & (F.size(acc["names"]) + F.size(x["names"]) >= enough)).alias("full")))
        names = gathered.select("qid", F.aggregate("l", start, step, lambda acc: acc["names"]).alias("names"))
        first = F.filter("names", lambda e, i: F.array_position(F.transform("names", F.lower), F.lower(e)) == i + 1)
        entities = cut(names.select("qid", F.posexplode(F.slice(first, 1, ENTITY_BUDGET)).alias("place", "text")), "entities")
        if entities.isEmpty():
            break
        distinct = cut(embed(entities.select("text").distinct()).select(F.col("text").alias("qid"), F.col("s").alias("v")), "entity-vectors")
        near = top_k(distinct, rows, k_each).select(F.col("qid").alias("text"), "id", F.col("score").alias("to_entity"), "rank")
        hits = entities.join(near, "text").join(asked.select("qid", F.col("v").alias("q")), "qid").join(nodes.select("id", "s"), "id")
        hits = hits.select("qid", "id", ((F.col("place") * k_each) + F.col("rank")).alias("place"), F.greatest(vec.cosine_eps(F.col("q"), F.col("s")), ENTITY_SHARE * F.col("to_entity")).alias("score"))
        before = Window.partitionBy("qid", "id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        hits = hits.join(known.withColumnRenamed("score", "was"), ["qid", "id"], "left").withColumn("bar", F.greatest("was", F.max("score").over(before)))
        raised = cut(hits.where(F.col("bar").isNull() | (F.col("score") > F.col("bar"))).select("qid", "id", "place", "score"), "raised")
        known = cut(known.union(raised.select("qid", "id", "score")).groupBy("qid", "id").agg(F.max("score").alias("score")), "known")
        frontier = raised.select("qid", "id", "place")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return known.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < k_final)


def echo(prompt: Column) -> Column:
    """A stand-in for a language model: the prompt's last 200 characters."""
    return F.expr("right(prompt, 200)") if prompt is None else F.substring(prompt, F.greatest(F.lit(1), F.length(prompt) - 199), F.lit(200))


def bounded_answers(queries: DataFrame, context: DataFrame, *, model=echo, method: str = "lexical", delta: float = 0.05) -> DataFrame:
    """(qid, answer, n_claims, flagged, bound, blocked) for queries (qid, text) and their retrieved rows: context
    (qid, id, text of the node, prompt text of the whole subgraph, n_edges). Each claim of the answer is held against
    each text and all together; claims that none supports are flagged, and the share of them goes into the bound."""
    entails = text.tfidf_entails if method == "tfidf" else text.lexical_entails
    held = context.groupBy("qid").agg(F.first("prompt").alias("prompt"), F.array_sort(F.collect_list(F.struct("id", "text"))).alias("held"), F.count("*").alias("n"), F.first("n_edges").alias("e"))
    rows = queries.select("qid", F.col("text").alias("query")).join(held, "qid", "left")
    rows = cut(rows, "asked-models")
    rows = rows.withColumn("answer", model(F.concat(F.lit("Context:\n"), F.coalesce("prompt", F.lit("(no context)")), F.lit("\n\nQuestion: "), F.col("query"))))
    rows = rows.withColumns({"claims": text.claims(F.col("answer")), "texts": F.transform("held", lambda x: x["text"])})
    rows = rows.withColumn("union", F.array_join("texts", " "))
    backed = lambda c: F.coalesce(F.exists("texts", lambda t: entails(t, c)) | entails(F.col("union"), c), F.lit(False))
    # written once each, as the plan would repeat these expressions at every use
    rows = cut(rows.drop("held"), "answers")
    rows = cut(rows.withColumn("flagged", F.filter("claims", lambda c: ~backed(c))).drop("texts", "union"), "checked-answers")
    rows = rows.withColumn("off", F.size("flagged") / F.greatest(F.size("claims"), F.lit(1)))
    n, e = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)), F.coalesce("e", F.lit(0))
    spectral = F.when(e > 0, bounds.spectral_bound(e, bounds.estimate_cheeger(e, F.coalesce("n", F.lit(0)))))
    rows = rows.withColumn("bound", bounds.composite_bound(bounds.rag_bound(F.col("off"), n, F.col("off"), delta), spectral))
    return rows.select("qid", "answer", F.size("claims").alias("n_claims"), "flagged", "bound", (F.size("flagged") > 0).alias("blocked"))
