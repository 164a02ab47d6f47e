"""The engine as one object: a store, a way to make vectors, a language model's column function and settings. Every
method takes and gives DataFrames, so a batch of turns or queries is one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.config import Config
from memloom.functions import text
from memloom.operators import modes, observe, regions
from memloom.operators.embed import hash_vectors
from memloom.operators.store import Store
from memloom.sources.scratch import cut


class Memory:
    """``embed(rows, text, dim)`` adds f, b and s; ``model(prompt)`` gives an answer column."""

    def __init__(self, store: Store, config: Config | None = None, *, embed: Callable = hash_vectors, model: Callable[[Column], Column] = modes.echo) -> None:
        self.store, self.config, self.embed, self.model = store, config or Config(), embed, model

    def _nodes(self, scope: dict[str, str] | None = None) -> DataFrame:
        return self.store.active_nodes(scope)

    def observe(self, turns: DataFrame, at: Column, fast: Column | None = None) -> observe.Observed:
        """Turns (seq, text, source, scope) go through the gates into the store."""
        known = self.store.latest("nodes").select(text.canonical_map(F.col("scope")).alias("scope_key"), text.text_hash(F.col("text")).alias("text_hash"))
        got = observe.observe(turns, known_drawers=cut(self.store.table("drawers").select("id"), "known"), known_texts=cut(known, "known"), fast=fast, tenant=self.store.tenant, embed=lambda rows: self.embed(rows, "text", self.config.dim))
        self.store.append("drawers", got.drawers.withColumns({"created": at, "text_hash": F.sha2("text", 256)}))
        own = got.nodes.withColumns({"drawer_ids": F.array("drawer_id"), "created": at, "text_hash": text.text_hash(F.col("text"))})
        self.store.upsert("nodes", cut(own, "new-nodes"))
        self.store.upsert("edges", cut(got.edges.withColumns({"created": at, "s_squared": F.lit(1.0)}), "new-edges"))
        self.store.append_audit(cut(got.audit.withColumns({"ts": at, "actor": F.lit("writer")}).drop("seq"), "new-audit"))
        return got

    def search(self, queries: DataFrame, *, mode: str = "auto", k: int = 5, scope: dict[str, str] | None = None) -> DataFrame:
        """(qid, mode, id, place) for queries (qid, text)."""
        asked = cut(self.embed(queries.select("qid", "text"), "text", self.config.dim).select("qid", "text", F.col("s").alias("v")), "asked")
        return modes.search(asked, self._nodes(scope), self.store.active_edges(), mode=mode, k=k, depth=self.config.depth, algorithm=self.config.algorithm)

    def multi_hop(self, queries: DataFrame, *, k: int = 10, scope: dict[str, str] | None = None) -> DataFrame:
        return modes.multi_hop(queries, self._nodes(scope).select("id", "text", "s"), k_final=k, embed=lambda rows: self.embed(rows, "text", self.config.dim))

    def answer(self, queries: DataFrame, *, mode: str = "hybrid", k: int = 10, strict: bool = False) -> DataFrame:
        """(qid, answer, n_claims, flagged, bound, blocked); ``strict``: a blocked answer isn't told. The log gets an
        entry for each."""
        edges = self.store.active_edges()
        found = self.search(queries, mode=mode, k=k).select(F.col("qid").alias("region"), "id")
        held = cut(found.join(self._nodes().select("id", "text", "role"), "id"), "found")
        count = regions.inner_edges(held.select("id", "region"), edges).groupBy("region").agg(F.count("*").alias("n_edges"))
        prompts = regions.linearize(held, edges).withColumnRenamed("text", "prompt")
        context = held.join(prompts, "region").join(count, "region", "left").select(F.col("region").alias("qid"), "id", "text", "prompt", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
        out = cut(modes.bounded_answers(queries, context, model=self.model, method=self.config.support, delta=self.config.delta), "answers")
        stop = F.col("blocked") if strict else F.lit(False)
        self.store.append_audit(out.select(F.current_timestamp().alias("ts"), F.when(stop, "GENERATION_BLOCKED").otherwise("GENERATE").alias("operation"), F.lit("query").alias("target_type"), F.col("qid").cast("string").alias("target_id"), F.to_json(F.struct("flagged", "bound")).alias("payload")))
        return out.withColumn("answer", F.when(~stop, F.col("answer")))

    def consolidate(self, as_of: Column, *, induce: bool = False) -> regions.Consolidated:
        """Weak edges are deprecated, the rest get their refined weights, the log says what was done."""
        nodes = cut(self._nodes().select("id", "text", "f", "b", "s", "role", F.col("quality_score").alias("quality")), "nodes")
        edges = cut(self.store.active_edges(), "edges")
        more = observe.induce_for_isolated(nodes, edges).withColumns({"created": as_of, "s_squared": F.lit(1.0)}) if induce else None
        done = regions.consolidate(nodes.drop("text", "f", "b"), edges, budget=self.config.regions, as_of=as_of, induced=more)
        if more is not None:
            self.store.upsert("edges", cut(more, "induced"))
        self.store.deprecate("edges", cut(done.pruned.select("src", "dst", "edge_type"), "pruned"), "pruned", as_of)
        self.store.append_audit(cut(done.audit.withColumns({"ts": as_of, "actor": F.lit("consolidator")}), "audit"))
        return done

    def forget(self, nodes: DataFrame, reason: str, at: Column) -> DataFrame:
        return self.store.forget(nodes, reason, at)
