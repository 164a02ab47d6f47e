"""Retrieval, write path, shape and spectra against plain Python on small graphs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text, vec
from memloom.operators import embed, graph, modes, observe, ranks, regions, retrieve, spectral
from memloom.operators.store import OPERATIONS
from memloom.operators.vectors import top_k


def random_graph(n=24, m=60, seed=1):
    rnd = random.Random(seed)
    pairs = rnd.sample([(a, b) for a in range(n) for b in range(n) if a != b], m)
    return [(a, b, rnd.choice(["supports", "agrees", "contradicts", "pivots"]), round(rnd.uniform(-0.6, 1), 3)) for a, b in pairs]


def frame(spark, links):
    return spark.createDataFrame(links, "src long, dst long, edge_type string, weight double")


def walks(links, seed, depth, beam=8, least=-0.1):
    paths = [([seed], 0.0)]
    for _ in range(depth):
        out = []
        for nodes, cum in paths:
            more = [(nodes + [b], cum + w) for a, b, _, w in links if a == nodes[-1] and w >= least and b not in nodes]
            out += more or [(nodes, cum)]
        paths = sorted(out, key=lambda p: (-p[1], p[0]))[:beam]
    return [p for p, _ in paths]


def gathered(links, seeds, depth):
    """Nodes and edges on the walks, in order."""
    ids, used, weight = [], [], {(a, b): w for a, b, _, w in links}
    for s in seeds:
        for p in walks(links, s, depth):
            ids += [x for x in p if x not in ids]
            used += [e for e in zip(p, p[1:]) if e not in used]
    return ids, [(a, b, weight[a, b]) for a, b in used]


def prize_of(ids, links):
    prize = dict.fromkeys(ids, 0.0)
    for a, b, w in links:
        prize[a] += max(0, w)
        prize[b] += max(0, w)
    return prize


def grown(start, ids, links, cost, budget, inside):
    prize, chosen, used, spent = prize_of(ids, links), set(start), set(), 0.0
    while True:
        open_ = [(prize[y] - cost(w), -e, y) for e, (a, b, w) in enumerate(links) for x, y in ((a, b), (b, a)) if x in chosen and y not in chosen and y in inside]
        if not open_:
            return chosen, used
        net, e, y = max(open_)
        if net <= 0 or spent + cost(links[-e][2]) > budget:
            return chosen, used
        chosen.add(y)
        used.add(-e)
        spent += cost(links[-e][2])


def closed(chosen, used, links):
    return chosen, {links[e][:2] for e in used} | {(a, b) for a, b, w in links if w > 0 and a in chosen and b in chosen}


def parts(ids, links):
    left, out = set(ids), []
    for x in ids:
        if x in left:
            comp, stack = set(), [x]
            while stack:
                y = stack.pop()
                if y not in comp:
                    comp.add(y)
                    stack += [b if a == y else a for a, b, w in links if w > 0 and y in (a, b)]
            out.append(comp)
            left -= comp
    return out


@pytest.fixture(scope="module")
def searched(spark):
    links = random_graph()
    seeds = [(q, s, r) for q, own in ((1, [0, 5, 7]), (2, [3, 9, 11])) for r, s in enumerate(own, 1)]
    return links, frame(spark, links), spark.createDataFrame([(q, s, r, 1.0) for q, s, r in seeds], "qid long, seed long, rank int, score double"), spark.range(24)


def chosen_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, (set(), set()))[0 if r.kind == "n" else 1].add(r.a if r.kind == "n" else (r.a, r.b))
    return out


@pytest.mark.parametrize("budget", [10.0, 0.3])
def test_greedy_and_forest_against_brute_force(spark, searched, budget):
    links, edges, seeds, nodes = searched
    got = {a: chosen_of(modes.by_paths(seeds, nodes, edges, depth=3, algorithm=a, budget=budget)) for a in ("greedy", "forest")}
    for qid, own in ((1, [0, 5, 7]), (2, [3, 9, 11])):
        ids, held = gathered(links, own, 3)
        assert got["greedy"][qid] == closed(*grown(own, ids, held, lambda w: max(0.0, -w), budget, set(ids)), held)
        chosen, used, prize = set(), set(), prize_of(ids, held)
        for part in parts(ids, held):
            head = max(sorted(part, key=ids.index), key=lambda x: prize[x])
            if prize[head] > 0:
                c, u = grown({head}, ids, held, lambda w: 1.5 * -w if w < 0 else max(0.01, 0.1 * (1 - w)), budget, part)
                chosen |= c
                used |= u
        assert got["forest"][qid] == closed(chosen, used, held)


def test_steiner_joins_the_greatest_prizes(spark, searched):
    links, edges, seeds, nodes = searched
    got = chosen_of(modes.by_paths(seeds, nodes, edges, depth=3, algorithm="steiner"))
    for qid, own in ((1, [0, 5, 7]), (2, [3, 9, 11])):
        ids, held = gathered(links, own, 3)
        prize = prize_of(ids, held)
        ends = [x for x in sorted(ids, key=lambda x: -prize[x]) if any(w > 0 and x in (a, b) for a, b, w in held)][:3]
        ends = [x for x in ends if any({x, ends[0]} <= p for p in parts(ids, held))]
        tree, used = got[qid]
        assert set(ends) <= tree and len(used) == len(tree) - 1 and all(w > 0 for a, b, w in held if (a, b) in used)
        length = lambda es: sum(1 / max(0.05, w) for a, b, w in held if (a, b) in es)
        good = [(a, b) for a, b, w in held if w > 0]
        if len(good) <= 14:  # no more than twice the best tree
            best = min(length(set(es)) for k in range(len(good) + 1) for es in itertools.combinations(good, k) if any(set(ends) <= p for p in parts(ids, [(a, b, 1.0) for a, b in es])))
            assert length(used) <= 2 * best + 1e-9


def test_hand_subgraphs(spark):
    nodes, seeds = spark.range(1, 5), spark.createDataFrame([(1, 1, 1, 1.0)], "qid long, seed long, rank int, score double")
    costly = frame(spark, [(1, 2, "contradicts", -0.05)])
    assert chosen_of(modes.by_paths(seeds, nodes, costly))[1] == ({1}, set())
    chain = frame(spark, [(1, 2, "agrees", 0.6), (2, 3, "agrees", 0.4)])
    assert chosen_of(modes.by_paths(seeds, nodes, chain))[1][0] == {1, 2, 3}
    assert chosen_of(modes.by_paths(seeds, nodes, chain.limit(0)))[1] == ({1}, set())


def test_hybrid_fuses_by_places(spark, searched):
    _, edges, seeds, nodes = searched
    chosen = modes.by_paths(seeds, nodes, edges, depth=2)
    places = {}
    for r in chosen.where("kind = 'n'").collect():
        places.setdefault(r.qid, {}).setdefault(r.a, []).append((0, r.place))
    for r in seeds.collect():
        places[r.qid].setdefault(r.seed, []).append((1, r["rank"] - 1))
    for r in modes.hybrid(seeds, chosen, 4).collect():
        want = sorted(places[r.qid], key=lambda x: (-round(sum(1 / (61 + p) for _, p in places[r.qid][x]), 12), min(places[r.qid][x])))
        assert want[r.place] == r.id


def test_top_k_kinds_and_conditions(spark, monkeypatch):
    monkeypatch.setattr("memloom.operators.vectors.BLOCK", 7)
    monkeypatch.setattr("memloom.operators.vectors.STEP", 5)
    rng = np.random.default_rng(3)
    v, label = rng.integers(-2, 3, (30, 3)).astype(float), [k % 3 for k in range(30)]
    for kind, cast in (("int", int), ("string", lambda k: f"{k:03}")):
        df = spark.createDataFrame([(cast(k), [float(x) for x in v[k]], label[k]) for k in range(30)], f"id {kind}, v array<double>, label int")
        asked = df.withColumnRenamed("id", "qid")
        size = np.linalg.norm(v, axis=1)
        for metric, options in (("cosine", {}), ("cosine", {"scope": "label"}), ("cosine", {"apart": "label", "earlier": True}), ("l2", {"other_than_self": True})):
            got = {}
            for r in top_k(asked, df, 4, metric=metric, **options).collect():
                got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
            for q in range(30):
                if metric == "cosine":
                    ok = [k for k in range(30) if size[k] > 0 and size[q] > 0]
                    score = {k: v[q] @ v[k] / (size[q] * size[k]) for k in ok}
                else:
                    score = {k: -((v[q] - v[k]) ** 2).sum() for k in range(30)}
                score = {k: s for k, s in score.items() if ("scope" not in options or label[k] == label[q]) and ("apart" not in options or label[k] != label[q]) and (not options.get("earlier") or k < q) and (not options.get("other_than_self") or k != q)}
                own = sorted(got.get(cast(q), []))
                assert np.allclose([s for _, _, s in own], sorted(score.values(), reverse=True)[:4])
                assert all(abs(score[int(i)] - s) < 1e-9 for _, i, s in own)


def test_numbers_and_order_statistics(spark):
    rows = [(g, random.Random(g * 100 + k).randint(0, 5), k) for g in (1, 2) for k in range(50)]
    df = spark.createDataFrame(rows, "g int, x int, k int")
    for g in (1, 2):
        want = sorted((x, k) for h, x, k in rows if h == g)
        got = ranks.numbered(df, ["x", "k"], group=["g"], start=10).where(F.col("g") == g).orderBy("seq").collect()
        assert [(r.x, r.k) for r in got] == want and [r.seq for r in got] == list(range(11, 61))
    s = ranks.order_statistics(df, "x", {"low": F.lit(1), "mid": F.ceil(F.col("n") / 2)}, group=["g"]).orderBy("g").collect()
    assert [(r.low, r.mid, r.n) for r in s] == [(0, sorted(x for h, x, _ in rows if h == g)[24], 50) for g in (1, 2)]


def test_entities_and_hops_over_them(spark):
    said = ["The river Tay runs past Perth", "Perth lies near Scone", "Scone has a Palace", "Nothing here", "A Palace of Perth"]
    nodes = embed.hash_vectors(spark.createDataFrame(list(enumerate(said)), "id long, text string"), dim=64).select("id", "text", "s")
    asks = spark.createDataFrame([(1, "Where is Perth?"), (2, "no names")], "qid long, text string")
    small = lambda rows: embed.hash_vectors(rows, dim=64)
    got = {}
    for r in modes.multi_hop(asks, nodes, k_init=2, k_each=2, embed=small).collect():
        got.setdefault(r.qid, {})[r.id] = r.score
    s = {r.id: np.array(r.s) for r in nodes.collect()}
    names = {r.id: r.e for r in nodes.select("id", text.entities(F.col("text"), most=4).alias("e")).collect()}
    vector = lambda t: np.array(small(spark.createDataFrame([(t,)], "text string")).first().s)
    near = lambda q, k: sorted(s, key=lambda i: (-q @ s[i], i))[:k]
    for qid, ask in ((1, "Where is Perth?"), (2, "no names")):
        q = vector(ask)
        known = {i: float(q @ s[i]) for i in near(q, 2)}
        front, start = near(q, 2), list(spark.range(1).select(text.entities(F.lit(ask), most=4).alias("e")).first().e)
        for hop in range(2):
            listed = list(start) if hop == 0 else []
            for i in front:
                listed += names[i]
                if len(listed) >= 8 * (hop + 1):
                    break
            kept = [e for k, e in enumerate(listed) if e.lower() not in [x.lower() for x in listed[:k]]][:8]
            front = []
            for e in kept:
                for i in near(vector(e), 2):
                    score = max(float(q @ s[i]), 0.6 * float(vector(e) @ s[i]))
                    if i not in known or known[i] < score:
                        known[i] = score
                        front.append(i)
        assert got[qid].keys() == known.keys() and all(abs(got[qid][i] - known[i]) < 1e-9 for i in known)


def turns_of(spark, said, source="conversation"):
    return spark.createDataFrame([(k, t, source, {"p": "infra"}) for k, t in enumerate(said)], "seq long, text string, source string, scope map<string,string>")


def test_write_path(spark):
    said = ["We keep all our queue state inside one Postgres table for now.", "We switched to Redis Streams for the queue after the outage last week.", "We keep all our queue state inside one Postgres table for now.", "ok", None, ""]
    got = observe.observe(turns_of(spark, said))
    status = {r.id // observe.MOST_SENTENCES: r.quality_status for r in got.nodes.collect()}
    assert status == {0: "promoted", 1: "promoted"}
    assert {(r.operation, r.seq) for r in got.audit.collect()} >= {("SKIP_DUPLICATE_DRAWER", 2), ("WRITE", 0), ("PROMOTE", 1)}
    edges = got.edges.collect()
    assert all(r.edge_type == "pivots" for r in edges if r.dst > r.src)
    assert observe.observe(turns_of(spark, said, "document")).edges.count() == 0
    looped = observe.observe(turns_of(spark, said, text.ARTIFACT_SOURCES[0]))
    assert looped.drawers.count() == 0 and {r.operation for r in looped.audit.collect()} == {OPERATIONS[0]}
    again = observe.observe(turns_of(spark, said), known_drawers=got.drawers.select("id"))
    assert again.nodes.count() == 0


def test_gate_sees_the_buffer(spark):
    bio = "User Jane Roe is a Google engineer based in San Francisco, age 32."
    first = "The weather in the valley stayed cold for the whole of the winter."
    knows = "Jane told Google that the San Francisco office opens at nine every day."
    for said, want in (([first, bio], "rejected"), ([knows, bio], "promoted"), ([bio], "promoted")):
        got = observe.observe(turns_of(spark, said)).nodes
        assert {r.text: r.quality_status for r in got.collect()}[bio] == want


def small_graph(spark, seed=4):
    links = [(a, b, t, abs(w) + 0.05) for a, b, t, w in random_graph(12, 26, seed)]
    return links, spark.range(12), frame(spark, links)


def laplacian(links, n):
    a = np.zeros((n, n))
    for x, y, _, w in links:
        a[x, y] += abs(w)
        a[y, x] += abs(w)
    d = a.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.eye(n) - np.nan_to_num(a / np.sqrt(np.outer(d, d)))


@pytest.mark.parametrize("dense", [2_000, 4])
def test_spectra(spark, monkeypatch, dense):
    monkeypatch.setattr(spectral, "DENSE", dense)
    links, nodes, edges = small_graph(spark)
    values, vectors = np.linalg.eigh(laplacian(links, 12))
    assert np.allclose(spectral.eigenvalues(nodes, edges, 5), values[:5], atol=1e-6)
    assert spectral.cheeger(spectral.spectral_gap(nodes, edges)) == pytest.approx((values[1] / 2, math.sqrt(2 * values[1])), abs=1e-6)
    for r in spectral.heat_kernel(nodes, edges).collect():
        assert np.allclose(r.hks, [(np.exp(-t * values) * vectors[r.id] ** 2).sum() for t in spectral.TIMES], atol=1e-6)


def test_sections_and_health(spark):
    links, nodes, edges = small_graph(spark)
    d = np.zeros((len(links), 12))
    for k, (a, b, t, _) in enumerate(links):
        d[k, a], d[k, b] = -1, graph.SIGNS[t]
    values = np.linalg.eigvalsh(d.T @ d)
    r = spectral.inconsistency(nodes, edges).first()
    assert r.n_sections == (values < 1e-9).sum() and r.smallest == pytest.approx(values[0], abs=1e-9)
    assert spectral.graph_health(nodes, edges).first().density == pytest.approx(26 / 12)


def test_ways_and_merges(spark):
    links, nodes, edges = small_graph(spark)
    far = np.full((12, 12), np.inf)
    np.fill_diagonal(far, 0)
    for a, b, _, w in links:
        far[a, b] = far[b, a] = min(far[a, b], 1 / max(w, 0.05))
    for k in range(12):
        far = np.minimum(far, far[:, [k]] + far[[k]])
    far[np.isinf(far)] = 2 * far[np.isfinite(far)].max()
    assert all(abs(far[r.a, r.b] - r.d) < 1e-9 for r in spectral.way_lengths(nodes, edges).collect())
    v = np.random.default_rng(2).standard_normal((20, 4))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist, label, merged = 1 - unit @ unit.T, list(range(20)), []
    for d, a, b in sorted((dist[a, b], a, b) for a in range(20) for b in range(a + 1, 20)):
        if d <= 0.4 and label[a] != label[b]:
            merged.append(d)
            label = [label[a] if x == label[b] else x for x in label]
    r = spectral.homology(spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(20)], "id long, s array<double>"), 0.4).first()
    assert r.betti_0 == 20 - len(merged) and r.total_0 == pytest.approx(sum(merged), abs=1e-6) and r.max_0 == pytest.approx(max(merged), abs=1e-6)


def test_vector_statistics(spark):
    rng = np.random.default_rng(5)
    f, b = rng.standard_normal((40, 6)), rng.standard_normal((40, 6))
    rows = spark.createDataFrame([(k, [float(x) for x in f[k]], [float(x) for x in b[k]]) for k in range(40)], "id long, f array<double>, b array<double>")
    n, mean, cov = spectral.covariance(rows, "f")
    assert n == 40 and np.allclose(mean, f.mean(0)) and np.allclose(cov, np.cov(f.T))
    values, vectors = np.linalg.eigh(np.cov(f.T) + 1e-3 * np.eye(6))
    want = (f - f.mean(0)) @ (vectors @ np.diag(values**-0.5) @ vectors.T)
    for r in spectral.whitened(rows).collect():
        assert np.allclose(r.f, want[r.id] / np.linalg.norm(want[r.id]))
    own = spectral.Subspace.fit(rows)
    s, c = (f + b) / 2, (f - b) / 2
    ridge = np.cov(s.T) + 0.01 * np.trace(np.cov(s.T)) / 6 * np.eye(6)
    assert np.allclose(sorted(own.values, reverse=True), sorted(np.linalg.eigvals(np.linalg.solve(ridge, np.cov(c.T))).real, reverse=True)[: len(own.values)])
    assert np.allclose(own.p.T @ ridge @ own.p, np.eye(len(own.values)))
    pair = rows.where("id = 0").selectExpr("id AS i", "f AS fi", "b AS bi").crossJoin(rows.where("id = 1").selectExpr("id AS j", "f AS fj", "b AS bj"))
    (ci, cj, si, sj), w = (x @ own.p for x in (c[0], c[1], s[0], s[1])), own.values
    r = own.scores(pair).first()
    assert r.plain == pytest.approx(ci @ sj - si @ cj - ci @ cj) and r.weighted == pytest.approx((w * ci) @ sj - si @ (w * cj) - (w * ci) @ cj)


def test_gram_vectors_and_paraphrases(spark):
    rows = spark.createDataFrame([(0, "the cat sat"), (1, "the cat sat down"), (2, "zzz qqq"), (3, None)], "k long, text string")
    out = {r.k: r for r in embed.GramVectors.fit(rows, dim=32).embed(rows).collect()}
    dot = lambda a, b: float(np.dot(out[a].s, out[b].s))
    assert dot(0, 1) > dot(0, 2) and abs(np.linalg.norm(out[0].f) - 1) < 1e-9
    same = embed.paraphrased(rows.where("k = 0"), prompts=1, dim=32).first()
    assert np.allclose(same.f, embed.hash_vectors(rows.where("k = 0"), dim=32).first().f)


def test_regions_are_consolidated(spark):
    links = [(0, 1, "agrees", 0.9), (1, 2, "agrees", 0.001), (2, 0, "agrees", 0.8), (5, 6, "supports", 0.7)]
    edges = frame(spark, links).withColumns({"gamma_anti": F.lit(0.0), "s_squared": F.lit(1.0), "created": F.expr("TIMESTAMP '2024-01-01 00:00:00'")})
    nodes = spark.range(8).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("s"), F.lit("fact").alias("role"), F.lit(0.5).alias("quality"))
    done = regions.consolidate(nodes, edges, budget=2, as_of=F.expr("TIMESTAMP '2024-01-01 01:00:00'"))
    assert {r.region: (r.n_nodes, r.n_edges) for r in done.regions.collect()} == {0: (3, 3), 5: (2, 1)}
    assert [(r.src, r.dst) for r in done.pruned.collect()] == [(1, 2)]
    assert {r.operation for r in done.audit.collect()} >= {"PRUNE", "PMED_SCORE", "CONSOLIDATE"}


def test_prune_takes_stored_variances(spark):
    edges = frame(spark, [(0, 1, "agrees", 0.05), (2, 3, "agrees", 0.05)]).withColumns({"gamma_anti": F.lit(0.0), "s_squared": F.when(F.col("src") == 0, 0.5).otherwise(1.0)})
    assert {r.src: round(r.s2, 6) for r in graph.prune(edges).collect()} == {0: 0.5, 2: 0.0032}


def test_answers_and_their_support(spark):
    asks = spark.createDataFrame([(1, "what?"), (2, "and?")], "qid long, text string")
    context = spark.createDataFrame([(1, 7, "The cat sat on the warm mat today.", "x", 1)], "qid long, id long, text string, prompt string, n_edges long")
    for method in ("lexical", "tfidf"):
        got = {r.qid: r for r in modes.bounded_answers(asks, context, model=lambda p: F.lit("The cat sat on the warm mat. Purple engines invade distant galaxies."), method=method).collect()}
        assert [got[1].n_claims, len(got[1].flagged), len(got[2].flagged)] == [2, 1, 2] and got[1].bound <= 1
    assert spark.range(1).select(text.tfidf_cosine(F.lit("same words"), F.lit("same words")).alias("x")).first().x == pytest.approx(1)
    assert spark.range(1).select(vec.sigmoid(F.lit(0.0)).alias("x"), retrieve.route(F.lit("why?"), F.lit(1.0), F.lit(0.1), F.lit(3.0), F.lit(2)).alias("m")).first().m == "walk_deep"


def against_sql(spark, at, name, table, rows):
    """A query's rows and those of its SQL over ``rows`` (a frame) as the only input table."""
    import duckdb

    from memloom.plans import queries, store  # noqa: F401 - registers its queries

    rows.write.parquet(f"{at}/{table}.parquet")
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
        want = c.execute(queries.ORACLE_SQL[name]).fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: [(x is None, str(x)) for x in r])
    return order(queries.QUERIES[name](spark, str(at)).collect()), order(want)


def test_rolling_buffer(spark, tmp_path):
    import memloom.plans.modes  # noqa: F401 - registers its queries

    turns = [(c, t, f"{c} {t}") for c in range(3) for t in range(30) if (c, t) != (2, 5)] + [(3, 5, "alone")]
    repeated = [(0, 5, "again"), (0, 5, None), (1, 5, None), (None, 5, "x"), (None, 5, "y"), (4, None, "z"), *[(5, 5, None)] * 25]
    got, want = against_sql(spark, tmp_path, "P05_rolling_buffer", "conversations", spark.createDataFrame(turns + repeated, "conv_id long, turn long, text string"))
    assert got == want and len(want) == 33 and max(n or 0 for _, _, n in want) == 20
    # the operator itself sees every turn before
    rows = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    for r in observe.buffers(rows, ["conv_id"], "turn", "text").collect():
        assert r.buffer == [x for c, t, x in turns if c == r.conv_id and t < r.turn][-20:]


@pytest.mark.parametrize("n", [0, 30, 60])
def test_audit_order(spark, tmp_path, n):
    import memloom.plans.store  # noqa: F401 - registers its queries

    for name in ("conversations", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    times = [None if k % 10 == 3 else f"{1900 + 7 * k % 180}-0{k % 9 + 1}-11 10:20:{k % 60}.25" for k in range(n)]  # a third or more before 1970
    rows = spark.createDataFrame([(k, t, k % 7, "click", 1.0) for k, t in enumerate(times)], "event_id long, ts string, user_id long, event_type string, value double")
    got, want = against_sql(spark, tmp_path, "G13_audit_order", "events", rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert got == want and want[0][1] == min(n, 50)


def _brute(v, label, q, k, *, scope=False, apart=False, earlier=False, other=False):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = {j: round(float(unit[q] @ unit[j]), 12) for j in range(len(v)) if (not scope or label[j] == label[q]) and (not apart or label[j] != label[q]) and (not earlier or j < q) and (not other or j != q)}
    return sorted(score, key=lambda j: (-score[j], j))[:k]


def test_many_queries_stay_in_their_scope_and_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr("memloom.operators.vectors.FEW", 3, raising=False)
    monkeypatch.setattr("memloom.operators.vectors.BLOCK", 9)
    monkeypatch.setattr("memloom.operators.vectors.STEP", 16)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("vectors went through the driver"))
    rng = np.random.default_rng(8)
    v = rng.standard_normal((150, 4))
    v[100:] = v[rng.integers(0, 5, 50)]  # equal vectors, so that ids decide
    label = [k % 30 if k < 60 else 31 for k in range(150)]
    df = spark.createDataFrame([(k, [float(x) for x in v[k]], label[k]) for k in range(150)], "id long, v array<double>, label int")
    asked = df.withColumnRenamed("id", "qid")
    for options in ({"scope": "label"}, {"scope": "label", "earlier": True}, {"apart": "label"}, {"other_than_self": True}):
        got = {}
        for r in top_k(asked, df, 3, **options).collect():
            got.setdefault(r.qid, {})[r["rank"]] = r.id
        for q in range(150):
            want = _brute(v, label, q, 3, scope="scope" in options, apart="apart" in options, earlier=options.get("earlier"), other=options.get("other_than_self"))
            assert [got.get(q, {})[k + 1] for k in range(len(want))] == want and len(got.get(q, {})) == len(want)


def test_merging_searches_all_vectors_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal((30, 3)), np.repeat([[1.0, 0.2, 0.1]], 15, 0), rng.normal([0, 1, 0], 0.05, (15, 3))])  # more equal and near ones than are looked up
    asked = []
    monkeypatch.setattr(spectral, "top_k", lambda q, *args, **options: (asked.append(q.count()), top_k(q, *args, **options))[1])
    got = spectral.merges(spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(60)], "id long, s array<double>"), 1.0).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = sorted((max(0.0, round(1 - float(unit[a] @ unit[b]), 9)), a, b) for a in range(60) for b in range(a) if unit[a] @ unit[b] >= 0)
    label, want = list(range(60)), []
    for d, a, b in links:
        if label[a] != label[b]:
            want.append(d)
            label = [label[b] if x == label[a] else x for x in label]
    assert np.allclose(sorted(r.d for r in got), want, atol=1e-8)
    assert asked[0] == 60 and all(n <= 30 for n in asked[1:])


def test_features_go_no_farther_than_half_way(spark, monkeypatch):
    links = [(a, b, "supports", 0.5) for a, b in [(k, k + 1) for k in range(14)] + [(20, 21), (3, 9), (0, 0)]]
    edges = frame(spark, links)
    steps = []
    monkeypatch.setattr(graph, "hops", lambda e, s, most, own=graph.hops: (steps.append(most), own(e, s, most))[1])
    pairs = [(0, 3), (0, 4), (0, 12), (3, 9), (5, 14), (1, 20), (20, 21), (2, 8), (7, 14)]
    got = {(r.a, r.b): r.hops for r in graph.hops_between(edges, spark.createDataFrame(pairs, "a long, b long")).collect()}
    around = {}
    for a, b, *_ in links:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)

    def far(a, b):
        seen, edge, n = {a}, {a}, 0
        while edge and b not in seen:
            edge, n = set().union(*(around[x] for x in edge)) - seen, n + 1
            seen |= edge
        return n if b in seen else 99

    assert got == {(a, b): far(a, b) for a, b in pairs if far(a, b) <= 6}
    seeds = spark.createDataFrame([(1, 0, 1), (1, 4, 2), (1, 12, 3), (2, 5, 1), (2, 14, 2), (3, 7, 1)], "qid long, seed long, rank int")
    found = {r.qid: r.hops for r in modes.features(seeds, spark.range(25), edges).collect()}
    own = [far(0, 4), *[x for x in (far(0, 12), far(4, 12)) if x <= 6]]
    assert found == {1: sum(own) / len(own), 2: 6.0 if far(5, 14) > 6 else float(far(5, 14)), 3: 0.0} and set(steps) == {3}


def test_lanczos_steps_send_nothing_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(spectral, "DENSE", 5)
    plans = []
    monkeypatch.setattr(spectral, "cut", lambda df, name, *more, own=spectral.cut: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), own(df, name, *more))[1])
    edges = frame(spark, random_graph(12, 20))
    values, _ = spectral.eigenpairs(spark.range(12), graph.laplacian(spark.range(12), edges), 3, steps=3)
    steps = [plan for name, plan in plans if name == "lanczos" and "Join" in plan and "NestedLoop" not in plan]
    assert len(values) == 3 and len(steps) == 3 and not any("BroadcastHashJoin" in plan for plan in steps)


def test_broadcast_queries_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr("memloom.operators.vectors.BLOCK_BYTES", 8 * 4 * 10, raising=False)
    sent, own = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: (sent.append(len(value[0])), own(sc, value))[1])
    v = np.random.default_rng(2).standard_normal((35, 4))
    df = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(35)], "id long, v array<double>")
    got = {}
    for r in top_k(df.withColumnRenamed("id", "qid"), df, 3, other_than_self=True).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.id
    assert [[got[q][k] for k in (1, 2, 3)] for q in range(35)] == [_brute(v, None, q, 3, other=True) for q in range(35)]
    assert len(sent) == 4 and sum(sent) == 35 and max(sent) < 25
