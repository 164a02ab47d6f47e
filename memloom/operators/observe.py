"""The write path for batches of turns: provenance, deduplication, sentences, vectors, the gate, and edges to earlier
nodes of the same scope. The order of arrival is a number of the turns, so a batch gives what its turns one after
another would."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text, vec
from memloom.operators import graph
from memloom.operators.embed import hash_vectors
from memloom.operators.store import OPERATIONS, drawer_id
from memloom.operators.vectors import top_k
from memloom.sources.ingest import is_fast
from memloom.sources.scratch import cut

NEIGHBOURS, LEAST_COSINE, MOST_EDGES, BUFFER, LEAST_GAMMA = 10, 0.0, 6, 20, 0.05
#: Sentences of one turn, for their numbers: a turn's number times this and the sentence's place.
MOST_SENTENCES = 1 << 20


class Observed(NamedTuple):
    drawers: DataFrame  # id, seq, text, source, scope
    nodes: DataFrame  # id, drawer_id, text, role, scope, f, b, s, quality_score, quality_status
    edges: DataFrame  # src, dst, edge_type, weight, gamma_score, gamma_anti
    audit: DataFrame  # seq, operation, target_type, target_id, reason


def buffers(rows: DataFrame, group: list[str], order: str, value: str, n: int = BUFFER) -> DataFrame:
    """The rows with buffer: the values of the ``n`` rows before each in its group."""
    return rows.withColumn("buffer", F.collect_list(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(-n, -1)))


def gate(near: DataFrame, least: float = LEAST_COSINE, most: int = MOST_EDGES) -> DataFrame:
    """The first ``most`` neighbours of each query (qid, id, score, rank) whose cosine is ``least`` or more, with
    their place."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return near.where(F.col("score") >= least).withColumn("place", place).where(F.col("place") <= most)


def _ends(near: DataFrame, nodes: DataFrame) -> DataFrame:
    own = lambda x: nodes.select(F.col("id").alias(x), *(F.col(c).alias(c[0] + x) for c in ("f", "b", "text")))
    return near.select(F.col("qid").alias("i"), F.col("id").alias("j"), F.col("score").alias("cos")).join(own("i"), "i").join(own("j"), "j")


def induce_for_isolated(nodes: DataFrame, edges: DataFrame, k: int = 6, least: float = LEAST_GAMMA) -> DataFrame:
    """Edges for the nodes (id, f, b, s, text) at no edge's end: to and from their ``k`` nearest others, where the
    directional score is ``least`` or more either way; that score is the weight."""
    lonely = graph.isolated(nodes, edges).join(nodes.select("id", "s"), "id")
    near = top_k(lonely.select(F.col("id").alias("qid"), F.col("s").alias("v")), nodes.select("id", F.col("s").alias("v")), k, other_than_self=True)
    pairs = _ends(near, nodes)
    fi, bi, fj, bj = (F.col(c) for c in ("fi", "bi", "fj", "bj"))
    anti = vec.gamma_anti(fi, bi, fj, bj)
    way = lambda a, b, g, x, said, answer: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), g.alias("gamma_score"), x.alias("gamma_anti"), F.col(said).alias("said"), F.col(answer).alias("answer"))
    both = F.array(way("i", "j", vec.gamma(fi, bi, fj, bj), anti, "ti", "tj"), way("j", "i", vec.gamma(fj, bj, fi, bi), -anti, "tj", "ti"))
    rows = pairs.select(F.explode(both).alias("e")).select("e.*").where(F.abs("gamma_score") >= least)
    rows = rows.withColumn("edge_type", text.edge_type(F.col("said"), F.col("answer"), F.col("gamma_score"), F.col("gamma_anti")))
    return rows.select("src", "dst", "edge_type", vec.signed_weight(F.col("edge_type"), F.col("gamma_score")).alias("weight"), "gamma_score", "gamma_anti")


def observe(turns: DataFrame, *, known_drawers: DataFrame | None = None, known_texts: DataFrame | None = None, fast: Column | None = None, tenant: str = "default", embed=hash_vectors) -> Observed:
    """What the turns (seq, text, source, scope) add to a store. seq: their order, below 2 ** 43, not null and without
    repeats; null and empty texts add nothing. known_drawers: (id) and known_texts: (scope_key, text_hash) are there
    already, and count as earlier. Turns of a bulk source, or where ``fast`` is true, get no edges and meet the gate
    without a buffer.

    A node's buffer holds the last 20 nodes promoted before it in its scope, which depend on their own buffers: the
    gate is repeated until no status changes; each pass settles at least one more node of every scope, and nearly all
    in the first two. One scope's nodes are ordered in one window (they spill, they aren't held)."""
    scope_key = text.canonical_map(F.col("scope"))
    rows = turns.withColumns({"text": F.trim("text"), "id": drawer_id(F.trim("text"), F.col("scope"), F.col("source"), F.lit(tenant))}).where(F.length("text") > 0)
    looped = F.col("source").isin(*text.ARTIFACT_SOURCES)
    passed = rows.where(~looped)
    first = passed.groupBy("id").agg(F.min("seq").alias("seq"))
    if known_drawers is not None:
        first = first.join(known_drawers.select("id"), "id", "left_anti")
    drawers = cut(passed.join(first, ["id", "seq"], "left_semi"), "observed-drawers")
    spans = drawers.select(F.col("id").alias("drawer_id"), "seq", "scope", scope_key.alias("scope_key"), is_fast(F.col("source"), fast).alias("fast"), F.posexplode(text.pack(text.sentences(F.col("text")))).alias("pos", "text"))
    spans = spans.withColumns({"id": F.col("seq") * MOST_SENTENCES + F.col("pos"), "role": text.role(F.col("text")), "text_hash": text.text_hash(F.col("text"))})
    spans = cut(embed(spans), "observed-spans")
    scored = spans.withColumn("plain", text.quality_score(F.col("text")))
    # what the gate says without a buffer, and the first of equal texts among what passes
    now = cut(scored.select("id", "scope_key", "text", "text_hash", "fast", F.col("plain").alias("score")), "observed-gate")
    while True:
        status = _statuses(now, known_texts)
        live = Window.partitionBy("scope_key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        marked = status.withColumn("n", F.coalesce(F.count(F.when(F.col("status") == "promoted", 1)).over(live), F.lit(0)))
        promoted = marked.where("status = 'promoted'").select("scope_key", F.col("n").alias("m"), F.col("text").alias("said"))
        doubtful = marked.where(~F.col("fast") & (text.bio_attributes(F.col("text")) >= 3))
        before = doubtful.join(promoted, "scope_key").where((F.col("m") < F.col("n")) & (F.col("m") >= F.col("n") - BUFFER)).groupBy("id").agg(F.array_join(F.collect_list("said"), "\n").alias("buffer"))
        again = scored.join(before, "id", "left").select("id", "scope_key", "text", "text_hash", "fast", F.when(F.col("fast") | F.col("buffer").isNull(), F.col("plain")).otherwise(text.quality_score(F.col("text"), F.col("buffer"))).alias("score"))
        again = cut(again, "observed-gate")
        if again.join(now.select("id", F.col("score").alias("was")), "id").where("score <> was").isEmpty():
            break
        now = again
    status = _statuses(now, known_texts)
    nodes = cut(spans.join(status.select("id", F.col("score").alias("quality_score"), F.col("status").alias("quality_status")), "id"), "observed-nodes")
    promoted = nodes.where("quality_status = 'promoted'")
    asks = promoted.where(~F.col("fast")).select(F.col("id").alias("qid"), F.col("s").alias("v"), "scope_key")
    near = gate(top_k(asks, promoted.select("id", F.col("s").alias("v"), "scope_key"), NEIGHBOURS, earlier=True, scope="scope_key"))
    edges = cut(graph.induce(_ends(near, promoted)), "observed-edges")
    entry = lambda df, seq, op, kind, target, why: df.select(seq.alias("seq"), F.lit(op).alias("operation"), F.lit(kind).alias("target_type"), target.cast("string").alias("target_id"), F.lit(why).alias("reason"))
    seq = F.col("seq")
    audit = entry(rows.where(looped), seq, OPERATIONS[0], "drawer", F.lit("<unwritten>"), "provenance_firewall")
    audit = audit.union(entry(passed.join(drawers.select("seq"), "seq", "left_anti"), seq, "SKIP_DUPLICATE_DRAWER", "drawer", F.col("id"), "hash_dedup"))
    audit = audit.union(entry(drawers, seq, "WRITE", "drawer", F.col("id"), None))
    for kind, op, why in (("rejected", "REJECT", "low_quality"), ("duplicate", "SKIP_DUPLICATE_NODE", "text_hash_dedup"), ("promoted", "PROMOTE", None)):
        audit = audit.union(entry(nodes.where(F.col("quality_status") == kind), seq, op, "node", F.col("id"), why))
    later = F.floor(F.greatest("src", "dst") / MOST_SENTENCES)
    audit = audit.union(entry(edges, later, "WRITE", "edge", F.concat_ws(">", "src", "dst"), None))
    kept = nodes.where("quality_status <> 'duplicate'").select("id", "drawer_id", "text", "role", "scope", "f", "b", "s", "quality_score", "quality_status")
    return Observed(drawers.select("id", "seq", "text", "source", "scope"), kept, edges, audit)


def _statuses(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """The rows with status: rejected by the gate, duplicate of an earlier node's text in the scope (rejected ones are
    stored and count), or promoted."""
    order = Window.partitionBy("scope_key", "text_hash").orderBy("id")
    out = rows.withColumn("k", F.row_number().over(order))
    was = F.col("k") > 1
    if known is not None:
        out = out.join(known.select("scope_key", "text_hash").distinct().withColumn("there", F.lit(True)), ["scope_key", "text_hash"], "left")
        was = was | F.coalesce("there", F.lit(False))
    return out.withColumn("status", F.when(F.col("score") < text.QUALITY, "rejected").when(was, "duplicate").otherwise("promoted"))
