"""Queries over the engine's store, filled from the test tables. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import graph, ranks, store
from memloom.operators.store import Store
from memloom.plans.fixtures import edges, nodes, table
from memloom.plans.queries import _ADJ, _EDGES, _NODES, query, r6
from memloom.config import Config
from memloom.memory import Memory
from memloom.sources import ingest
from memloom.sources.scratch import cut, scratch
from memloom.streaming import jobs

_AT = "TIMESTAMP '2024-01-01 00:00:00'"
_kept: dict[tuple[str, str], Store] = {}


def _scope(*names: str):
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


def _drawers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as drawers: their conversation is the scope."""
    c = table(spark, d, "conversations")
    return c.select("text", F.when(F.col("role") == "system", "document").otherwise("conversation").alias("source"), _scope("conv_id").alias("scope"), F.expr(f"{_AT} + make_interval(0, 0, 0, 0, 0, 0, turn)").alias("created"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the vectors; every tenth is rejected, their label is the scope, one drawer in three is theirs."""
    n = nodes(spark, d)
    drawer = F.sha2(F.concat(F.lit("d"), (F.col("id") % 50).cast("string")), 256)
    return n.select(
        "id", "text", F.sha2(F.lower(F.trim("text")), 256).alias("text_hash"), F.array(drawer).alias("drawer_ids"), F.when(F.col("id") % 3 == 0, "fact").otherwise("outcome").alias("role"), "f", "b", "s",
        (F.col("id") % 10 / 10).alias("quality_score"), F.when(F.col("id") % 10 == 0, "rejected").otherwise("promoted").alias("quality_status"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("scope"), F.expr(f"{_AT} + make_interval(0, 0, 0, 0, 0, 0, id)").alias("created"),
    )


def filled(spark: SparkSession, d: str) -> Store:
    """A store with the drawers, nodes, edges and events of an input; made once for each session and input."""
    key = spark.sparkContext.applicationId, d
    if key not in _kept:
        at = Store(spark, scratch(spark, "store")).create()
        at.insert_drawers(_drawers(spark, d))
        at.append("drawers", spark.range(40).select(F.sha2(F.concat(F.lit("d"), F.col("id").cast("string")), 256).alias("id"), F.concat(F.lit("drawer "), F.col("id").cast("string")).alias("text")))
        at.upsert("nodes", _nodes(spark, d))
        at.upsert("edges", edges(spark, d).withColumn("created", F.expr(f"{_AT} + make_interval(0, 0, 0, 0, 0, 0, src)")))
        e = table(spark, d, "events")
        at.append_audit(e.select("ts", F.upper("event_type").alias("operation"), F.lit("node").alias("target_type"), F.col("user_id").cast("string").alias("target_id"), F.col("event_id").cast("string").alias("payload")))
        _kept[key] = at
    return _kept[key]


_LIVE = _EDGES + ", live AS (SELECT * FROM nodes WHERE id % 10 <> 0)"


@query("A01_schema", "SELECT * FROM (VALUES ('audit', 9), ('drawers', 7), ('edges', 12), ('nodes', 16)) AS t(name, columns)")
def _(spark, d):
    at = Store(spark, scratch(spark, "schema")).create().create()
    made = [at.table(n).groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), F.lit(len(at.table(n).columns)).alias("columns"), "n") for n in store.SCHEMAS]
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out.where("n = 0").select("name", "columns")


@query("A02_insert_drawers", "SELECT DISTINCT conv_id::VARCHAR AS conv, CASE WHEN role = 'system' THEN 'document' ELSE 'conversation' END AS source, text FROM conversations")
def _(spark, d):
    at = Store(spark, scratch(spark, "drawers")).create()
    rows = _drawers(spark, d)
    one, two = at.insert_drawers(rows.where("scope['conv_id'] % 2 = 0")), at.insert_drawers(rows.union(rows))
    return cut(one.unionByName(two), "inserted").select(F.col("scope")["conv_id"].alias("conv"), "source", "text")


@query("A03_upsert_nodes", f"WITH {_NODES} SELECT id, CASE WHEN label = 3 THEN 'decision' WHEN id % 3 = 0 THEN 'fact' ELSE 'outcome' END AS role, CASE WHEN label = 3 THEN 1 ELSE 0 END AS version FROM nodes")
def _(spark, d):
    at = Store(spark, scratch(spark, "nodes")).create()
    rows = _nodes(spark, d)
    at.upsert("nodes", rows)
    at.upsert("nodes", rows.where("scope['label'] = '3'").withColumn("role", F.lit("decision")))
    return at.latest("nodes").select("id", "role", "version")


@query("A04_upsert_edges", f"WITH {_EDGES} SELECT src, dst, edge_type, round(CASE WHEN src < dst THEN weight / 2 ELSE weight END, 6) AS weight FROM edges")
def _(spark, d):
    at = Store(spark, scratch(spark, "edges")).create()
    rows = edges(spark, d)
    at.upsert("edges", rows)
    at.upsert("edges", rows.where("src < dst").withColumn("weight", F.col("weight") / 2))
    return at.latest("edges").select("src", "dst", "edge_type", r6("weight").alias("weight"))


@query("A05_audit_continues", "SELECT event_id, row_number() OVER (ORDER BY event_id % 2, ts, user_id::VARCHAR, upper(event_type), event_id) AS seq FROM events QUALIFY count(*) OVER (PARTITION BY event_id % 2, ts, user_id, event_type) = 1")
def _(spark, d):
    at = Store(spark, scratch(spark, "audit")).create()
    e = table(spark, d, "events").select("ts", F.upper("event_type").alias("operation"), F.col("user_id").cast("string").alias("target_id"), F.col("event_id").cast("string").alias("payload"))
    for part in (0, 1):
        at.append_audit(e.where(F.col("payload").cast("bigint") % 2 == part))
    twins = at.table("audit").groupBy("ts", "target_id", "operation", (F.col("payload").cast("bigint") % 2).alias("p")).agg(F.count("*").alias("n"), F.first("payload").alias("payload"), F.first("seq").alias("seq"))
    return twins.where("n = 1").select(F.col("payload").cast("bigint").alias("event_id"), "seq")


@query("A06_deprecate_nodes", f"WITH {_NODES} SELECT id, label = 3 AS gone, CASE WHEN label = 3 THEN 'wrong' END AS reason FROM nodes")
def _(spark, d):
    at = Store(spark, scratch(spark, "gone")).create()
    at.upsert("nodes", _nodes(spark, d))
    at.deprecate("nodes", nodes(spark, d).where("label = 3").select("id"), "wrong", F.expr(_AT))
    return at.latest("nodes").select("id", F.col("deprecated").isNotNull().alias("gone"), "reason")


@query("A08_active_nodes", f"WITH {_NODES} SELECT id, label FROM nodes WHERE id % 10 <> 0 AND label = 4 ORDER BY id DESC LIMIT 20")
def _(spark, d):
    return filled(spark, d).active_nodes({"label": "4"}, 20).select("id", F.col("scope")["label"].cast("int").alias("label"))


@query("A09_active_edges", f"WITH {_EDGES} SELECT src, dst, edge_type, round(weight, 6) AS weight FROM edges")
def _(spark, d):
    return filled(spark, d).active_edges().select("src", "dst", "edge_type", r6("weight").alias("weight"))


@query("A12_file_ingest", "SELECT count(*)::BIGINT AS files, sum(length(body) + 1)::BIGINT AS chars FROM (SELECT string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)")
def _(spark, d):
    files = ingest.whole_files(spark, _written(spark, d))
    return files.agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


def _written(spark: SparkSession, d: str) -> str:
    """A folder with a text file for each conversation."""
    at = scratch(spark, "files")
    lines = F.sort_array(F.collect_list(F.struct("turn", "text")))
    body = F.array_join(F.transform(lines, lambda x: x.text), "\n")
    table(spark, d, "conversations").groupBy("conv_id").agg(body.alias("value")).select("value", "conv_id").write.partitionBy("conv_id").text(at)
    return at


@query("A15_bulk_observe", "SELECT DISTINCT sha256(text) AS h FROM conversations WHERE turn % 2 = 0")
def _(spark, d):
    at = Store(spark, scratch(spark, "bulk")).create()
    rows = table(spark, d, "conversations").where("turn % 2 = 0").select("text")
    return ingest.bulk(at, rows, source="document", at=F.expr(_AT)).select(F.sha2("text", 256).alias("h"))


@query("A16_chunk_context", """WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, trim(text, ' \t\n\r') AS t FROM conversations WHERE length(trim(text, ' \t\n\r')) > 30 AND NOT contains(text, chr(10) || chr(10))),
c AS (SELECT conv_id, k, length(t) AS n, 1 AS chunk FROM p WHERE k = 1 UNION ALL SELECT p.conv_id, p.k, CASE WHEN n > 800 THEN length(t) ELSE n + length(t) END, CASE WHEN n > 800 THEN chunk + 1 ELSE chunk END FROM c JOIN p ON p.conv_id = c.conv_id AND p.k = c.k + 1)
SELECT conv_id, chunk, string_agg(t, chr(10) || chr(10) ORDER BY k) AS text FROM c JOIN p USING (conv_id, k) GROUP BY 1, 2""")
def _(spark, d):
    lines = F.sort_array(F.collect_list(F.struct("turn", "text")))
    body = F.array_join(F.transform(lines, lambda x: x.text), "\n\n")
    files = table(spark, d, "conversations").where("NOT contains(text, '\n\n')").groupBy("conv_id").agg(body.alias("body"))
    return files.select("conv_id", F.posexplode(text.chunks(F.col("body"))).alias("chunk", "text")).withColumn("chunk", F.col("chunk") + 1)


@query("B01_drawer_id", "SELECT conv_id, turn, sha256('default' || chr(31) || '{\"conv\":\"' || conv_id || '\",\"role\":\"' || role || '\"}' || chr(31) || 'conversation' || chr(31) || text) AS id FROM conversations")
def _(spark, d):
    scope = F.create_map(F.lit("role"), F.col("role"), F.lit("conv"), F.col("conv_id").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", store.drawer_id(F.col("text"), scope, F.lit("conversation"), F.lit("default")).alias("id"))


@query("B03_stored_text_hash", "SELECT DISTINCT sha256(text) AS h FROM conversations UNION SELECT sha256('drawer ' || k) FROM range(40) t(k) WHERE false")
def _(spark, d):
    return filled(spark, d).table("drawers").where("text_hash IS NOT NULL").select(F.col("text_hash").alias("h")).distinct()


@query("B04_scope_json", "SELECT doc_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS scope FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    return docs.select("doc_id", text.canonical_map(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")).alias("scope"))


@query("D02_active", f"WITH {_LIVE} SELECT (SELECT count(*) FROM live) AS nodes, (SELECT count(*) FROM edges) AS edges")
def _(spark, d):
    at = filled(spark, d)
    return at.latest("nodes").where(store.active("nodes")).agg(F.count("*").alias("nodes")).crossJoin(at.latest("edges").where(store.active("edges")).agg(F.count("*").alias("edges")))  # one row each


@query("D03_tenant", "SELECT conv_id % 3 AS tenant, count(DISTINCT text) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "tenants")
    rows = table(spark, d, "conversations").select("conv_id", "text", F.lit("conversation").alias("source"), F.expr("map('a', 'b')").alias("scope"), F.expr(_AT).alias("created"))
    held = [Store(spark, path, str(k)) for k in range(3)]
    held[0].create()
    for k, at in enumerate(held):
        at.insert_drawers(rows.where(F.col("conv_id") % 3 == k))
    out = [at.table("drawers").agg(F.count("*").alias("n")).select(F.lit(k).cast("bigint").alias("tenant"), "n") for k, at in enumerate(held)]
    return out[0].union(out[1]).union(out[2])


@query("D06_bulk_source", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN false ELSE role = 'system' END AS fast FROM conversations")
def _(spark, d):
    source = F.when(F.col("role") == "system", "document").otherwise("conversation")
    return table(spark, d, "conversations").select("conv_id", "turn", ingest.is_fast(source, F.when(F.col("turn") % 5 == 0, False)).alias("fast"))


@query("D07_quality_threshold", "SELECT event_id, CASE WHEN value % 1 < 0.4 THEN 'rejected' ELSE 'pending' END AS status FROM events WHERE value >= 0")
def _(spark, d):
    return table(spark, d, "events").where("value >= 0").select("event_id", text.quality_status(F.col("value") % 1).alias("status"))


@query("D11_edges_of", f"WITH {_EDGES} SELECT src, dst FROM edges WHERE edge_type = 'pivots' AND (src % 100 = 0 OR dst % 100 = 0)")
def _(spark, d):
    return filled(spark, d).edges_of(nodes(spark, d).where("id % 100 = 0"), "pivots").select("src", "dst")


@query("D13_result_projection", f"WITH {_LIVE} SELECT id, text, CASE WHEN id % 3 = 0 THEN 'fact' ELSE 'outcome' END AS role, (id % 10) / 10.0::DOUBLE AS quality FROM live")
def _(spark, d):
    return filled(spark, d).active_nodes().select("id", "text", "role", F.col("quality_score").alias("quality"))


@query("D14_index_projection", f"WITH {_LIVE}, a AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1) SELECT live.id, coalesce(n, 0) AS n_out FROM live LEFT JOIN a USING (id)")
def _(spark, d):
    at = filled(spark, d)
    out = at.active_edges().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return at.active_nodes().select("id").join(out, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_out"))


@query("E03_drawers_of_nodes", f"WITH {_NODES} SELECT id, CASE WHEN id % 50 < 40 THEN 'drawer ' || (id % 50) END AS text FROM nodes WHERE id % 100 = 0 OR id % 50 = 45")
def _(spark, d):
    return filled(spark, d).drawers_of(nodes(spark, d).where("id % 100 = 0 OR id % 50 = 45")).select("id", "text")


_NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY ts, user_id::VARCHAR, upper(event_type)) AS seq FROM events)"


@query("E11_audit_of_results", "SELECT user_id::VARCHAR AS target_id, event_id FROM events WHERE user_id % 100 = 0")
def _(spark, d):
    at = filled(spark, d)
    return at.audit_for(at.table("audit").where("target_id % 100 = 0")).select("target_id", F.col("payload").cast("bigint").alias("event_id"))


@query("G07_last_rows", f"WITH {_LIVE} SELECT id FROM live ORDER BY id DESC LIMIT 20")
def _(spark, d):
    return filled(spark, d).active_nodes(limit=20).select("id")


@query("G13_audit_order", "SELECT max(ts) - min(ts) AS span, count(*) AS n FROM (SELECT ts FROM events ORDER BY ts DESC LIMIT 50)")
def _(spark, d):
    last = filled(spark, d).audit_since(limit=50)
    return last.agg((F.max("ts") - F.min("ts")).alias("span"), F.count("*").alias("n"))


@query("K13_trace", f"WITH {_EDGES}, r AS (SELECT id FROM nodes WHERE id % 100 = 0) SELECT 'drawer' AS kind, id::VARCHAR AS target, CASE WHEN id % 50 < 40 THEN 'drawer ' || (id % 50) END AS what FROM r UNION ALL SELECT 'audit', user_id::VARCHAR, event_id::VARCHAR FROM events WHERE user_id IN (SELECT id FROM r)")
def _(spark, d):
    at = filled(spark, d)
    some = nodes(spark, d).where("id % 100 = 0")
    drawers, entries = at.trace(some, at.edges_of(some))
    return drawers.select(F.lit("drawer").alias("kind"), F.col("id").cast("string").alias("target"), F.col("text").alias("what")).union(entries.select(F.lit("audit"), "target_id", "payload"))


@query("K14_forget", f"WITH {_EDGES}, asked AS (SELECT id FROM nodes WHERE id % 100 = 0 UNION ALL SELECT -1), hit AS (SELECT src, dst FROM edges WHERE src % 100 = 0 OR dst % 100 = 0) SELECT asked.id, CASE WHEN asked.id < 0 THEN 'not_found' ELSE 'forgotten' END AS status, (SELECT count(*) FROM hit WHERE src = asked.id OR dst = asked.id) AS n_edges, (SELECT count(*) FROM edges) - (SELECT count(*) FROM hit) AS left_over FROM asked")
def _(spark, d):
    at = Store(spark, scratch(spark, "forget")).create()
    at.upsert("nodes", _nodes(spark, d))
    at.upsert("edges", edges(spark, d))
    out = at.forget(nodes(spark, d).where("id % 100 = 0").select("id").union(spark.range(-1, 0)), "asked to", F.expr(_AT))
    return out.crossJoin(at.active_edges().agg(F.count("*").alias("left_over")))  # one row


@query("P01_audit_log", "SELECT upper(event_type) AS operation, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1")
def _(spark, d):
    at = filled(spark, d)
    since = table(spark, d, "events").agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("t")).first().t
    return at.audit_since(since).groupBy("operation").agg(F.count("*").alias("n"))


@query("P02_audit_vocabulary", "SELECT unnest([" + ", ".join(f"'{x}'" for x in store.OPERATIONS) + "]) AS operation")
def _(spark, d):
    return spark.createDataFrame([(x,) for x in store.OPERATIONS], "operation string")


@query("F09_mean_clustering", f"WITH {_ADJ}, deg AS (SELECT u, count(*) AS d FROM adj GROUP BY 1), t AS (SELECT x.u, count(*) AS c FROM adj x JOIN adj y ON y.u = x.u JOIN adj z ON z.u = x.v AND z.v = y.v GROUP BY 1) SELECT round(avg(CASE WHEN coalesce(d, 0) < 2 THEN 0 ELSE coalesce(t.c, 0)::DOUBLE / (d * (d - 1)) END), 6) AS clustering FROM nodes LEFT JOIN deg ON deg.u = id LEFT JOIN t ON t.u = id")
def _(spark, d):
    return graph.clustering(nodes(spark, d), edges(spark, d)).agg(r6(F.avg("coefficient")).alias("clustering"))


@query("F14_graph_density", f"WITH {_EDGES} SELECT round((SELECT count(*) FROM edges)::DOUBLE / greatest(1, (SELECT count(*) FROM nodes)), 6) AS density")
def _(spark, d):
    n, e = nodes(spark, d).agg(F.count("*").alias("v")), edges(spark, d).agg(F.count("*").alias("e"))
    return n.crossJoin(e).select(r6(F.col("e") / F.greatest(F.lit(1), F.col("v"))).alias("density"))  # one row each


@query("F06_pattern_instances", f"WITH {_EDGES} SELECT x.edge_type || ' → ' || y.edge_type AS pattern, x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src WHERE x.weight > 0 AND y.weight > 0 AND x.src <> y.dst AND (x.edge_type || y.edge_type) IN (SELECT x.edge_type || y.edge_type FROM edges x JOIN edges y ON x.dst = y.src WHERE x.weight > 0 AND y.weight > 0 AND x.src <> y.dst GROUP BY 1 HAVING count(*) >= 2)")
def _(spark, d):
    return graph.motif_instances(edges(spark, d))


@query("F07_forman_summary", f"WITH {_ADJ}, deg AS (SELECT u, count(*) AS d FROM adj GROUP BY 1), common AS (SELECT x.u, x.v, count(z.v) AS c FROM adj x JOIN adj y ON y.u = x.u LEFT JOIN adj z ON z.u = x.v AND z.v = y.v GROUP BY 1, 2), k AS (SELECT 4 - x.d - y.d + 2 * c AS kappa FROM edges e JOIN deg x ON x.u = e.src JOIN deg y ON y.u = e.dst JOIN common k ON k.u = e.src AND k.v = e.dst) SELECT round(avg(kappa), 6) AS mean, median(kappa)::DOUBLE AS median, min(kappa)::DOUBLE AS least, max(kappa)::DOUBLE AS most, count_if(kappa < 0)::BIGINT AS n_negative, count_if(kappa > 0)::BIGINT AS n_positive FROM k")
def _(spark, d):
    return ranks.summary(cut(graph.forman(edges(spark, d)), "forman"), "kappa")


# P, Q: streams, measures and the whole engine.
@query("P03_metrics_snapshot", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY k) AS c FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'click' ELSE 'other' END AS k FROM events)),
s AS (SELECT k, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM e WHERE c <= 4000 OR r <= 3000 GROUP BY 1)
SELECT k, n, round(m, 6) AS mean, v[least(n, floor(n * 0.5::DOUBLE)::BIGINT + 1)] AS p50, v[least(n, floor(n * 0.95::DOUBLE)::BIGINT + 1)] AS p95, v[least(n, floor(n * 0.99::DOUBLE)::BIGINT + 1)] AS p99 FROM s""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(F.col("event_type") == "click", "click").otherwise("other"))
    return jobs.snapshot(e, "k", "value", ["ts", "event_id"], most=4_000, kept=3_000).withColumn("mean", r6("mean"))


def _edge_files(spark, d) -> str:
    at = scratch(spark, "edge-files")
    edges(spark, d).withColumn("created", F.expr(_AT)).repartition(4).write.parquet(at)
    return at


@query("P06_incremental_adjacency", f"WITH {_ADJ} SELECT u, v FROM adj")
def _(spark, d):
    at, files = Store(spark, scratch(spark, "kept")).create(), _edge_files(spark, d)
    jobs.keep_up(spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 2).parquet(files), at, "edges")
    return graph.adjacency(at.active_edges())


@query("P07_periodic_consolidation", "SELECT 'CONSOLIDATE' AS operation, 2::BIGINT AS n")
def _(spark, d):
    at, files = Store(spark, scratch(spark, "kept")).create(), _edge_files(spark, d)
    at.upsert("nodes", _nodes(spark, d))
    run = lambda store: Memory(store, Config(regions=2)).consolidate(F.expr(_AT))
    jobs.keep_up(spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 2).parquet(files), at, "edges", run)
    return at.table("audit").where("operation = 'CONSOLIDATE'").groupBy("operation").agg(F.count("*").alias("n"))


@query("Q01_memory_round_trip")
def _(spark, d):
    c = table(spark, d, "conversations")
    turns = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text", F.lit("conversation").alias("source"), F.create_map(F.lit("conv"), (F.col("conv_id") % 5).cast("string")).alias("scope"))
    memory = Memory(Store(spark, scratch(spark, "memory")).create(), Config(dim=64, depth=2))
    memory.observe(turns, F.expr(_AT))
    asks = turns.where("seq % 100 = 0").select(F.col("seq").alias("qid"), "text")
    return memory.search(asks, mode="hybrid", k=3)
