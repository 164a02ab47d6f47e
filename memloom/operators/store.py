"""The engine's store: drawers, nodes, edges and an audit log as append-only Parquet tables in one folder. A row of an
id that is there already is a new version; reading takes the last one. Nothing is rewritten in place, so a lost
executor or a broken write never harms what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions import text
from memloom.operators.ranks import numbered
from memloom.sources.scratch import cut

SCHEMAS = {
    "drawers": "id string, tenant string, text string, text_hash string, source string, scope map<string,string>, created timestamp",
    "nodes": "id bigint, tenant string, text string, text_hash string, drawer_ids array<string>, role string, f array<double>, b array<double>, s array<double>, "
    "quality_score double, quality_status string, scope map<string,string>, created timestamp, deprecated timestamp, reason string, version int",
    "edges": "src bigint, dst bigint, edge_type string, tenant string, weight double, gamma_score double, gamma_anti double, s_squared double, created timestamp, deprecated timestamp, reason string, version int",
    "audit": "seq bigint, ts timestamp, tenant string, operation string, actor string, target_type string, target_id string, payload string, reason string",
}
KEYS = {"nodes": ["id"], "edges": ["src", "dst", "edge_type"]}
# The operations of the audit log.
OPERATIONS = "REJECT_RECALL_LOOP SKIP_DUPLICATE_DRAWER WRITE REJECT SKIP_DUPLICATE_NODE PROMOTE GENERATE GENERATION_BLOCKED FORGET INDUCE_EDGE PRUNE MOTIF PMED_SCORE CONSOLIDATE".split()


def drawer_id(body: Column, scope: Column, source: Column, tenant: Column) -> Column:
    """A stable id of a drawer: the hash of its tenant, canonical scope, source and text."""
    return F.sha2(F.concat_ws("\x1f", tenant, text.canonical_map(scope), source, body), 256)


def active(kind: str) -> Column:
    """Whether a node (promoted ones) or an edge hasn't been deprecated."""
    live = F.col("deprecated").isNull()
    return live & (F.col("quality_status") == "promoted") if kind == "nodes" else live


def in_scope(wanted: dict[str, str] | None, scope: str = "scope") -> Column:
    """Whether a row's scope holds all pairs of ``wanted``; an empty one holds for all rows."""
    out = F.lit(True)
    for k, v in (wanted or {}).items():
        out = out & F.coalesce(F.col(scope)[k] == v, F.lit(False))
    return out


class Store:
    """Tables under ``path``, of one tenant; rows of others are never seen."""

    def __init__(self, spark: SparkSession, path: str, tenant: str = "default") -> None:
        self.spark, self.path, self.tenant = spark, path.rstrip("/"), tenant

    def create(self) -> Store:
        """Empty tables, where there are none."""
        for name, ddl in SCHEMAS.items():
            self.spark.createDataFrame([], ddl).write.mode("append").parquet(f"{self.path}/{name}")
        return self

    def table(self, name: str) -> DataFrame:
        """All rows and versions; columns that older files lack are null."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}").where(F.col("tenant") == self.tenant)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows with some of the table's columns; the others are null."""
        schema = T.StructType.fromDDL(SCHEMAS[name])
        rows = rows.withColumn("tenant", F.lit(self.tenant))
        whole = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*whole).write.mode("append").parquet(f"{self.path}/{name}")

    def latest(self, name: str) -> DataFrame:
        """The last version of each node or edge."""
        df, keys = self.table(name), KEYS[name]
        rest = [c for c in df.columns if c not in keys]
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("version", F.lit(0)), "created")).alias("x"))
        return last.select(*keys, "x.*").select(*df.columns)

    # drawers
    def insert_drawers(self, rows: DataFrame) -> DataFrame:
        """Drawers (text, source, scope, created) that aren't there yet are added, once each, and returned."""
        new = rows.withColumn("id", drawer_id(F.col("text"), F.col("scope"), F.col("source"), F.lit(self.tenant)))
        first = new.groupBy("id").agg(F.min_by(F.struct("text", "source", "scope", "created"), F.col("created")).alias("x")).select("id", "x.*")
        first = first.join(self.table("drawers").select("id"), "id", "left_anti").withColumn("text_hash", F.sha2("text", 256))
        first = cut(first, "new-drawers")
        self.append("drawers", first)
        return first

    def drawers_of(self, nodes: DataFrame) -> DataFrame:
        """(id, drawer_id, text) of the drawers that each node of ``nodes`` (id) came from; null texts where one is
        missing."""
        held = self.latest("nodes").join(nodes.select("id"), "id", "left_semi").select("id", F.explode("drawer_ids").alias("drawer_id"))
        return held.join(self.table("drawers").select(F.col("id").alias("drawer_id"), "text"), "drawer_id", "left").select("id", "drawer_id", "text")

    # nodes and edges
    def upsert(self, name: str, rows: DataFrame) -> None:
        """New versions of nodes or edges."""
        now = self.table(name).groupBy(*KEYS[name]).agg(F.max(F.coalesce("version", F.lit(0))).alias("was"))
        self.append(name, rows.drop("version").join(now, KEYS[name], "left").withColumn("version", F.coalesce(F.col("was") + 1, F.lit(0))).drop("was"))

    def deprecate(self, name: str, keys: DataFrame, reason: str, at: Column) -> DataFrame:
        """The live rows of ``keys`` get a version with the time and the reason; they are returned."""
        gone = self.latest(name).where(F.col("deprecated").isNull()).join(keys.select(*KEYS[name]).distinct(), KEYS[name], "left_semi")
        gone = gone.withColumns({"deprecated": at, "reason": F.lit(reason), "version": F.coalesce("version", F.lit(0)) + 1})
        gone = cut(gone, "deprecated")
        self.append(name, gone)
        return gone

    def active_nodes(self, scope: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
        """Promoted nodes of the scope; with ``limit`` the last ones in order of creation."""
        rows = self.latest("nodes").where(active("nodes") & in_scope(scope))
        return rows if limit is None else rows.orderBy(F.desc("created"), F.desc("id")).limit(limit)

    def active_edges(self) -> DataFrame:
        return self.latest("edges").where(active("edges"))

    def edges_of(self, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
        """Live edges with an end among ``nodes`` (id), of one type if it is named."""
        rows = self.active_edges()
        rows = rows if edge_type is None else rows.where(F.col("edge_type") == edge_type)
        ends = nodes.select(F.col("id").alias("end_")).distinct()
        touched = rows.select(*KEYS["edges"], F.explode(F.array("src", "dst")).alias("end_")).join(ends, "end_", "left_semi").select(*KEYS["edges"]).distinct()
        return rows.join(touched, KEYS["edges"], "left_semi")

    def has_text(self, hashes: DataFrame, scope: dict[str, str] | None = None) -> DataFrame:
        """Those of ``hashes`` (text_hash) that a node of exactly this scope has."""
        want = F.create_map(*[F.lit(x) for kv in sorted((scope or {}).items()) for x in kv]) if scope else F.expr("map()").cast("map<string,string>")
        same = text.canonical_map(F.col("scope")) == text.canonical_map(want)
        return hashes.join(self.latest("nodes").where(same).select("text_hash").distinct(), "text_hash", "left_semi")

    # audit
    def append_audit(self, rows: DataFrame) -> None:
        """Entries (ts, operation, actor, target_type, target_id, payload, reason), numbered on from the last one in
        the order of their time and target."""
        last = self.table("audit").agg(F.max("seq")).first()[0] or 0
        self.append("audit", numbered(rows, ["ts", "target_id", "operation"], name="seq", start=int(last)))

    def audit_for(self, targets: DataFrame) -> DataFrame:
        """Entries of ``targets`` (target_id), in order."""
        return self.table("audit").join(targets.select("target_id").distinct(), "target_id", "left_semi").orderBy("seq")

    def audit_since(self, ts=None, limit: int | None = None) -> DataFrame:
        """Entries from a time on (without one all, also those that have none), in order; with ``limit`` the last
        ones."""
        rows = self.table("audit")
        rows = rows if ts is None else rows.where(F.col("ts") >= ts)
        return rows.orderBy("seq") if limit is None else rows.orderBy(F.desc("seq")).limit(limit).orderBy("seq")

    def export_jsonl(self) -> DataFrame:
        """The audit log as JSON lines, in order."""
        rows = self.table("audit")
        return rows.orderBy("seq").select("seq", F.to_json(F.struct(*[c for c in rows.columns])).alias("line"))

    # forgetting
    def forget(self, nodes: DataFrame, reason: str, at: Column) -> DataFrame:
        """Nodes (id) and their live edges are deprecated, and the log says so. (id, status, n_edges) of each id asked
        for: ``forgotten``, or ``not_found`` where no live node has it."""
        asked = nodes.select("id").distinct()
        edges = self.edges_of(asked)
        gone = self.latest("nodes").where(F.col("deprecated").isNull()).join(asked, "id", "left_semi").select("id")
        ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("n_edges"))
        out = asked.join(gone.withColumn("status", F.lit("forgotten")), "id", "left").join(ends, "id", "left")
        out = out.select("id", F.coalesce("status", F.lit("not_found")).alias("status"), F.when(F.col("status").isNotNull(), F.coalesce("n_edges", F.lit(0))).otherwise(0).alias("n_edges"))
        out = cut(out, "forget")
        found = out.where("status = 'forgotten'").select("id")
        self.deprecate("edges", cut(self.edges_of(found).select(*KEYS["edges"]), "forget-edges"), reason, at)
        self.deprecate("nodes", found, reason, at)
        self.append_audit(found.select(at.alias("ts"), F.lit("FORGET").alias("operation"), F.lit("user").alias("actor"), F.lit("node").alias("target_type"), F.col("id").cast("string").alias("target_id"), F.lit(reason).alias("reason")))
        return out

    def trace(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Where a result of nodes (id) and edges (src, dst) came from: its drawers, one row for each node and drawer,
        and the log's entries on its nodes and edges."""
        targets = nodes.select(F.col("id").cast("string").alias("target_id")).union(edges.select(F.concat_ws(">", "src", "dst")))
        return self.drawers_of(nodes), self.audit_for(targets)

    def stats(self) -> DataFrame:
        """One row: n_nodes, n_edges (live ones), n_audit."""
        one = lambda df, c: df.agg(F.count("*").alias(c))
        return one(self.active_nodes(), "n_nodes").crossJoin(one(self.active_edges(), "n_edges")).crossJoin(one(self.table("audit"), "n_audit"))  # one row each
