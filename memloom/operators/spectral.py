"""Spectra of a graph, statistics of vectors and what is made of them: eigenvalues, heat kernels, covariances,
whitening, the causal subspace, merging of near vectors, and distances between graphs.

Matrices of the graph are (u, v, value) rows. Up to ``DENSE`` nodes they are solved as one dense matrix; a larger one
by Lanczos steps, each a join and a few sums, with the basis kept as an array for each node."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vec
from memloom.operators import graph
from memloom.operators.components import connected_components
from memloom.operators.vectors import top_k
from memloom.sources.scratch import cut

DENSE, STEPS = 2_000, 60
# Diffusion times, pairs that a heat kernel takes from a large graph, and the projector's defaults.
TIMES, PAIRS = (0.1, 1.0, 10.0), 32
THRESHOLD, RIDGE, LEAST_DIMENSIONS = 1.0, 0.01, 4
#: Neighbours of each vector that merging looks up before it searches.
NEAR = 8


def eigenpairs(ids: DataFrame, matrix: DataFrame, k: int | None = None, *, steps: int = STEPS) -> tuple[np.ndarray, DataFrame]:
    """The least ``k`` eigenvalues (all, if None and the matrix is small), ascending, and (id, vec): each node's entries
    in their eigenvectors. matrix: (u, v, value), symmetric, over the nodes ids (id)."""
    spark, n = ids.sparkSession, ids.count()
    if n <= DENSE:
        names = sorted(r.id for r in ids.select("id").collect())  # at most DENSE rows, and so of the matrix
        at = {x: i for i, x in enumerate(names)}
        a = np.zeros((n, n))
        for r in matrix.select("u", "v", "value").collect():
            a[at[r.u], at[r.v]] += r.value
        values, vectors = np.linalg.eigh(a) if n else (np.zeros(0), np.zeros((0, 0)))
        values, vectors = values[:k], vectors[:, :k]
        return values, spark.createDataFrame([(x, [float(y) for y in vectors[i]]) for x, i in at.items()], "id bigint, vec array<double>")
    matrix = cut(matrix.select("u", "v", "value"), "matrix")
    start = ids.select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20) - 0.5).alias("w"))
    basis = cut(start.crossJoin(start.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s"))).select("id", F.array(F.col("w") / F.col("s")).alias("q")), "lanczos")  # one row
    alphas, betas = [], []
    for j in range(min(steps, n)):
        # sorted and merged: as broadcasts they would pass through the driver at every step
        moved = matrix.join(basis.select(F.col("id").alias("v"), F.col("q")[j].alias("x")).hint("merge"), "v").groupBy(F.col("u").alias("id")).agg(F.sum(F.col("value") * F.col("x")).alias("w"))
        now = cut(basis.join(moved.hint("merge"), "id", "left").select("id", "q", F.coalesce("w", F.lit(0.0)).alias("w")), "lanczos")
        for again in range(2):  # what the basis holds already is taken off, twice for exactness
            sums = now.agg(*[F.sum(F.col("q")[i] * F.col("w")).alias(f"d{i}") for i in range(j + 1)]).first()
            if not again:
                alphas.append(float(sums[j]))
            part = F.array(*[F.lit(float(x)) for x in sums])
            now = now.withColumn("w", F.col("w") - vec.dot(F.col("q"), part))
        size = float(now.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0])
        if size < 1e-10 or j + 1 == min(steps, n):
            break
        betas.append(size)
        basis = cut(now.select("id", F.concat("q", F.array(F.col("w") / size)).alias("q")), "lanczos")
    small = np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1)
    values, turned = np.linalg.eigh(small)
    values, turned = values[:k], turned[:, :k]
    columns = [vec.dot(F.col("q"), F.array(*[F.lit(float(x)) for x in turned[:, i]])) for i in range(turned.shape[1])]
    return values, basis.select("id", F.array(*columns).alias("vec"))


def eigenvalues(nodes: DataFrame, edges: DataFrame, k: int = 6, normalized: bool = True) -> list[float]:
    """The least ``k`` eigenvalues of the graph's Laplacian, ascending."""
    return [float(x) for x in eigenpairs(nodes.select("id"), graph.laplacian(nodes, edges, normalized), k)[0]]


def spectral_gap(nodes: DataFrame, edges: DataFrame) -> float:
    """The second least eigenvalue; 0 below two nodes."""
    found = eigenvalues(nodes, edges, 4)
    return found[1] if len(found) > 1 else 0.0


def cheeger(gap: float) -> tuple[float, float]:
    """Bounds of the cut constant: half the gap, and the root of twice the gap."""
    return (gap / 2, (2 * gap) ** 0.5) if gap > 0 else (0.0, 0.0)


def heat_kernel(nodes: DataFrame, edges: DataFrame, times: tuple[float, ...] = TIMES) -> DataFrame:
    """(id, hks): for each time the heat that stays at a node. Beyond 32 nodes the least 32 eigenpairs count."""
    n = nodes.count()
    values, vectors = eigenpairs(nodes.select("id"), graph.laplacian(nodes, edges), None if n <= PAIRS else min(n - 2, PAIRS))
    at = [F.array(*[F.lit(float(np.exp(-t * x))) for x in values]) for t in times]
    return vectors.select("id", F.array(*[F.aggregate(F.zip_with("vec", a, lambda x, y: x * x * y), F.lit(0.0), lambda s, x: s + x) for a in at]).alias("hks"))


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, gap, cheeger_low, cheeger_high, density."""
    gap = spectral_gap(nodes, edges)
    low, high = cheeger(gap)
    rows = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each
    return rows.select("n_nodes", "n_edges", F.lit(gap).alias("gap"), F.lit(low).alias("cheeger_low"), F.lit(high).alias("cheeger_high"), (F.col("n_edges") / F.greatest(F.lit(1), F.col("n_nodes"))).alias("density"))


def inconsistency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_sections (dimension of the sheaf's kernel), smallest (its least eigenvalue), n_components, consistent
    (both numbers are equal) and frustration (share of negative edges)."""
    parts = graph.harmonic_dimension(nodes, edges).agg(F.count_if("harmonic").alias("n_sections"), F.count("*").alias("n_components"))
    least, _ = eigenpairs(nodes.select("id"), graph.sheaf_laplacian(edges), 4)
    negative = F.coalesce(F.avg(F.col("edge_type").isin([k for k, v in graph.SIGNS.items() if v < 0]).cast("double")), F.lit(0.0))
    out = parts.crossJoin(edges.agg(negative.alias("frustration")))  # one row each
    return out.withColumns({"consistent": F.col("n_sections") == F.col("n_components"), "smallest": F.lit(float(least[0]) if len(least) else 0.0)})


# Vectors.
def covariance(rows: DataFrame, column: str, center: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors ``column`` has, their mean and their covariance (n - 1). Each task sums its own; a sum of the
    dimension's square for each task is added up in the cluster, and one reaches the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, None, None
        for batch in batches:
            if len(batch):
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                n, one, two = n + len(v), v.sum(0) if one is None else one + v.sum(0), v.T @ v if two is None else two + v.T @ v
        if n:
            flat = np.concatenate([[n], one, two.ravel()])
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat)).astype(np.int32)), "x": pa.array(flat)})

    sums = rows.where(F.col(column).isNotNull()).select(column).mapInArrow(scan, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i")
    flat = np.array([r.x for r in sums.collect()])  # 1 + d + d * d numbers
    if not len(flat):
        return 0, np.zeros(0), np.zeros((0, 0))
    n, d = int(flat[0]), int(round((-1 + (1 + 4 * (len(flat) - 1)) ** 0.5) / 2))
    mean, second = flat[1 : d + 1] / n, flat[d + 1 :].reshape(d, d)
    return n, mean, (second - n * np.outer(mean, mean)) / max(1, n - 1) if center else second / max(1, n - 1)


def _apply(rows: DataFrame, column: str, shift: np.ndarray, turn: np.ndarray, to: str, unit: bool) -> DataFrame:
    """``rows`` with ``to``: (v - shift) @ turn, as a unit vector if ``unit``. The matrix goes along as a broadcast."""
    held = rows.sparkSession.sparkContext.broadcast((shift, turn))
    names = [c for c in rows.columns if c != to]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, turn = held.value
        for batch in batches:
            v = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, len(shift)))
            out = (v - shift) @ turn
            if unit:
                size = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.where(size > 1e-12, out / np.maximum(size, 1e-12), out)
            at = pa.array(np.arange(len(out) + 1, dtype=np.int32) * turn.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], [*names, to])

    from pyspark.sql import types as T

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField(to, T.ArrayType(T.DoubleType()))])
    return rows.where(F.col(column).isNotNull()).select(*names).mapInArrow(scan, schema)


def whitened(rows: DataFrame, columns: tuple[str, ...] = ("f", "b"), *, fit: DataFrame | None = None, ridge: float = 1e-3) -> DataFrame:
    """The rows with each of the vector columns centred, turned so that the covariance of ``fit`` (or the rows) is
    one, and made unit again. Rows with a null vector go."""
    for c in columns:
        n, mean, cov = covariance(rows if fit is None else fit, c)
        if not n:
            return rows
        values, vectors = np.linalg.eigh(cov + ridge * np.eye(len(mean)))
        turn = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
        rows = _apply(rows, c, mean, turn, "turned_", True).drop(c).withColumnRenamed("turned_", c)
    return rows


class Subspace:
    """The directions in which the causal parts vary most against the semantic ones."""

    def __init__(self, p: np.ndarray, values: np.ndarray) -> None:
        self.p, self.values = p, values

    @classmethod
    def fit(cls, rows: DataFrame, *, threshold: float = THRESHOLD, ridge: float = RIDGE, least: int = LEAST_DIMENSIONS) -> Subspace:
        """From rows with f and b. Directions whose ratio is ``threshold`` or more are kept, ``least`` of them at
        least. Covariances are summed in the cluster, the small problem is solved on the driver."""
        parts = rows.select(vec.semantic(F.col("f"), F.col("b")).alias("s"), vec.causal(F.col("f"), F.col("b")).alias("c"))
        n, _, plain = covariance(parts, "s")
        if not n:
            raise ValueError("no vectors to fit")
        _, _, causal = covariance(parts, "c")
        d = len(plain)
        root = np.linalg.inv(np.linalg.cholesky(plain + ridge * np.trace(plain) / d * np.eye(d)))
        values, vectors = np.linalg.eigh(root @ causal @ root.T)
        order = np.argsort(-values)
        keep = min(d, max(least, int((values >= threshold).sum())))
        return cls((root.T @ vectors)[:, order[:keep]], values[order[:keep]])

    def ratio(self) -> float:
        return float(np.sqrt(self.values.mean()))

    def project(self, rows: DataFrame, column: str, to: str) -> DataFrame:
        return _apply(rows, column, np.zeros(len(self.p)), self.p, to, False)

    def scores(self, pairs: DataFrame) -> DataFrame:
        """pairs (i, j, fi, bi, fj, bj) -> i, j, plain and weighted: the directional score inside the subspace, and
        with each direction weighted by its ratio."""
        rows = pairs.select("i", "j", *(make(F.col(f"f{x}"), F.col(f"b{x}")).alias(f"{name}{x}") for x in "ij" for name, make in (("s", vec.semantic), ("c", vec.causal))))
        for c in ("si", "ci", "sj", "cj"):
            rows = self.project(rows, c, f"{c}_").drop(c)
        w = F.array(*[F.lit(float(x)) for x in self.values])
        ci, cj = F.col("ci_"), F.col("cj_")
        wi, wj = (F.zip_with(c, w, lambda x, y: x * y) for c in (ci, cj))
        return rows.select("i", "j", (vec.dot(ci, F.col("sj_")) - vec.dot(F.col("si_"), cj) - vec.dot(ci, cj)).alias("plain"), (vec.dot(wi, F.col("sj_")) - vec.dot(F.col("si_"), wj) - vec.dot(wi, cj)).alias("weighted"))


# Shape and distance.
def merges(nodes: DataFrame, longest: float = 1.0) -> DataFrame:
    """(a, b, d) of the pairs by which the nodes (id, s) merge as the cosine distance grows up to ``longest``: a least
    spanning forest. In each round every component but the largest finds the nearest vector outside it, so there are at
    most as many rounds as the logarithm of the nodes. ``NEAR`` neighbours of each vector are searched once; all rows
    are searched again only for the vectors outside the largest component whose neighbours are all in their own one,
    and no farther than the nearest that is known outside it."""
    rows = cut(nodes.where(F.col("s").isNotNull()).select("id", F.col("s").alias("v")), "merge-rows")
    asked = rows.withColumnRenamed("id", "qid")
    distance, pair = F.round(1 - F.col("score"), 12).alias("d"), F.struct("d", F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b"))
    near = cut(top_k(asked, rows, NEAR, other_than_self=True).select("qid", "id", "rank", distance).where(F.col("d") <= longest), "merge-near")
    reach = near.where(F.col("rank") == NEAR).select(F.col("qid").alias("id"), F.col("d").alias("reach"))  # what is farther isn't known
    full = cut(rows.select("id").join(reach, "id"), "merge-reach")
    part = cut(rows.select("id", F.col("id").alias("part")), "merge-parts")
    open_ = near.select("qid", "id", "d")
    found = []
    while True:
        own = part.select(F.col("id").alias("qid"), "part")
        out = open_.join(own, "qid").join(part.select("id", F.col("part").alias("other")), "id").where("part <> other")
        out = cut(out.select("qid", "id", "d", "part"), "merge-open")
        largest = part.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").first()
        few = F.col("part") != largest.part if found else F.lit(True)
        best = out.where(few).groupBy("part").agg(F.min(pair).alias("x"))
        lost = full.join(part, "id").where(few).join(out.select(F.col("qid").alias("id")).distinct(), "id", "left_anti").join(best, "part", "left").where("x IS NULL OR reach <= x.d")
        lost = cut(lost.join(rows, "id").groupBy("part", "v").agg(F.min("id").alias("qid")), "merge-lost")  # of equal vectors one is enough
        if not lost.isEmpty():
            more = top_k(lost, rows.join(part, "id"), 1, apart="part").select("qid", "id", distance).where(F.col("d") <= longest)
            best = best.unionByName(more.join(own, "qid").groupBy("part").agg(F.min(pair).alias("x"))).groupBy("part").agg(F.min("x").alias("x"))
        chosen = cut(best.select("x.*").distinct(), "merges")
        if chosen.isEmpty():
            break
        found.append(chosen.select("a", "b", "d"))
        joins = chosen.join(part.select(F.col("id").alias("a"), F.col("part").alias("u")), "a").join(part.select(F.col("id").alias("b"), F.col("part").alias("v")), "b")
        named = connected_components(joins, "u", "v").withColumnRenamed("node", "part")
        part = cut(part.join(named, "part", "left").select("id", F.coalesce("component", "part").alias("part")), "merge-parts")
        open_ = out.select("qid", "id", "d")
    if not found:
        return rows.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"))
    return reduce(DataFrame.unionByName, found)


def homology(nodes: DataFrame, longest: float = 1.0) -> DataFrame:
    """One row: n_nodes, betti_0 (components at the end), mean_0, max_0 and total_0 of the distances at which two of
    them merged; betti_1 is null, as loops aren't looked for. Below three vectors all but n_nodes are null."""
    n = nodes.where(F.col("s").isNotNull()).agg(F.count("*").alias("n_nodes"))
    m = merges(nodes, longest).agg(F.count("*").alias("k"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_0"), F.coalesce(F.max("d"), F.lit(0.0)).alias("max_0"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("total_0"))
    enough = lambda c: F.when(F.col("n_nodes") >= 3, c)
    return n.crossJoin(m).select("n_nodes", enough(F.col("n_nodes") - F.col("k")).alias("betti_0"), F.lit(None).cast("bigint").alias("betti_1"), *(enough(F.col(c)).alias(c) for c in ("mean_0", "max_0", "total_0")))  # one row each


def signature(nodes: DataFrame) -> DataFrame:
    """One row, signature: betti_0, betti_1, mean_0, max_0 and the same two of loops; what is missing is 0."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("betti_0", "betti_1", "mean_0", "max_0")]
    return homology(nodes).select(F.array(*parts, F.lit(0.0), F.lit(0.0)).alias("signature"))


def nearest_distance(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row, distance: the mean squared distance of each vector (id, s) to the nearest of the other set, both ways
    averaged; 0 where a set is empty."""
    q = lambda df: df.select(F.col("id").alias("qid"), F.col("s").alias("v"))
    r = lambda df: df.select("id", F.col("s").alias("v"))
    there = top_k(q(one), r(two), 1, metric="l2").agg(F.avg(-F.col("score")).alias("x"))
    back = top_k(q(two), r(one), 1, metric="l2").agg(F.avg(-F.col("score")).alias("y"))
    return there.crossJoin(back).select(F.coalesce((F.col("x") + F.col("y")) / 2, F.lit(0.0)).alias("distance"))  # one row each


def way_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, d) of all ordered pairs of a small graph's nodes: the shortest way over positive edges of length
    1 / max(w, 0.05), either way; twice the longest such way where there is none. Lengths are relaxed until none gets
    shorter, at most as often as the longest way has edges."""
    step = edges.where("weight > 0").select(F.col("src").alias("u"), F.col("dst").alias("v"), (1 / F.greatest("weight", F.lit(0.05))).alias("w"))
    step = cut(step.union(step.select("v", "u", "w")).groupBy("u", "v").agg(F.min("w").alias("w")), "ways-steps")
    known = new = cut(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d")), "ways")
    while True:
        tried = new.join(step, F.col("b") == F.col("u")).groupBy("a", F.col("v").alias("b")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        new = cut(tried.join(known.withColumnRenamed("d", "was"), ["a", "b"], "left").where("was IS NULL OR d < was - 1e-12").select("a", "b", "d"), "ways-new")
        if new.isEmpty():
            break
        known = cut(known.union(new).groupBy("a", "b").agg(F.min("d").alias("d")), "ways")
    far = known.agg((2 * F.coalesce(F.max("d"), F.lit(0.5))).alias("far"))
    pairs = nodes.select(F.col("id").alias("a")).crossJoin(nodes.select(F.col("id").alias("b")))  # the answer's own rows
    return pairs.join(known, ["a", "b"], "left").crossJoin(F.broadcast(far)).select("a", "b", F.coalesce("d", "far").alias("d"))


def drift(one: tuple[DataFrame, DataFrame], two: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row on how far a graph (nodes, edges) has moved to another: signature (distance of the two signatures),
    nearest (distance of the vectors) and density (gap of edges a node)."""
    first, second = (signature(g[0]).first().signature for g in (one, two))
    size = lambda g: g[0].agg(F.count("*").alias("n")).crossJoin(g[1].agg(F.count("*").alias("e"))).select((F.col("e") / F.greatest(F.lit(1), F.col("n"))).alias("x"))
    gap = size(one).crossJoin(size(two).withColumnRenamed("x", "y")).select(F.abs(F.col("x") - F.col("y")).alias("density"))  # one row each
    away = float(np.linalg.norm(np.array(first) - np.array(second)))
    return nearest_distance(one[0], two[0]).withColumnRenamed("distance", "nearest").crossJoin(gap).withColumn("signature", F.lit(away))
