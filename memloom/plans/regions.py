"""More queries over the test tables: conversations, hash vectors, regions, streams. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions import text, vec
from memloom.operators import embed, graph, regions
from memloom.plans.fixtures import edges, nodes, table
from memloom.plans.queries import _ANCHORS, _ATTRIBUTES, _BUFFER, _EDGES, _NODES, _SENT, _TOK, _WORDS, buffered, query, r6
from memloom.streaming import dedup


@query("I02_pack_sentences", f"""WITH RECURSIVE w AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS t FROM (SELECT doc_id, {_SENT.format('text', 3)} AS l FROM documents)),
s AS (SELECT *, len({_WORDS.format('t')}) AS n FROM w),
p AS (SELECT doc_id, k, n AS total, 1 AS chunk FROM s WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.k, CASE WHEN total >= 80 AND total + n > 250 THEN n ELSE total + n END, CASE WHEN total >= 80 AND total + n > 250 THEN chunk + 1 ELSE chunk END FROM p JOIN s ON s.doc_id = p.doc_id AND s.k = p.k + 1)
SELECT doc_id, chunk, string_agg(t, ' ' ORDER BY k) AS text FROM p JOIN s USING (doc_id, k) GROUP BY 1, 2""")
def _(spark, d):
    chunks = text.pack(text.sentences(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "text")).withColumn("chunk", F.col("chunk") + 1)


@query("I07_attribute_types", f"SELECT conv_id, turn, ({_ATTRIBUTES})::INT AS attributes FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.bio_attributes(F.col("text")).alias("attributes"))


@query("I08_conversation_anchors", f"SELECT conv_id, turn, ({_ANCHORS})::INT AS anchors FROM (SELECT *, {_BUFFER} AS buffer FROM conversations)")
def _(spark, d):
    return buffered(spark, d).select("conv_id", "turn", text.anchors(F.col("text"), F.col("buffer")).alias("anchors"))


@query("I09_fabricated_bio", f"SELECT conv_id, turn, {_ATTRIBUTES} >= 3 AND {_ANCHORS} < 2 AS fabricated FROM (SELECT *, {_BUFFER} AS buffer FROM conversations)")
def _(spark, d):
    return buffered(spark, d).select("conv_id", "turn", text.is_fabricated_bio(F.col("text"), F.col("buffer")).alias("fabricated"))


@query("I11_support_tag", """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'so [Supported], no: [NOT supported]' WHEN 1 THEN '[irrelevant]' WHEN 2 THEN '[Not Supported] then [Supported].' ELSE event_type END AS a FROM events)
SELECT event_id, CASE WHEN a LIKE '%[NOT supported]' THEN 0.10 WHEN a LIKE '%[irrelevant]' THEN 0.05 WHEN a LIKE '%[Supported].' THEN 0.85 END::DOUBLE AS score FROM t""")
def _(spark, d):
    k = F.col("event_id") % 4
    answer = F.when(k == 0, "so [Supported], no: [NOT supported]").when(k == 1, "[irrelevant]").when(k == 2, "[Not Supported] then [Supported].").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.support_tag(answer).alias("score"))


_CLAIMS = f"""c AS (SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS claim FROM (SELECT conv_id, turn, list_filter({_SENT.format('text', 4)}, lambda s: NOT suffix(s, '?')) AS l FROM conversations)),
h AS (SELECT *, {_TOK.format('claim')} AS h FROM c), t AS (SELECT conv_id, turn, {_TOK.format('text')} AS p FROM conversations),
m AS (SELECT h.conv_id, h.turn, pos, any_value(h) AS h, max(coalesce(len(list_intersect(p, h))::DOUBLE / nullif(len(h), 0), 0)) AS best, list_distinct(flatten(list(p))) AS u FROM h JOIN t ON t.conv_id = h.conv_id AND t.turn < h.turn GROUP BY 1, 2, 3)"""


def _claims(spark, d):
    c = table(spark, d, "conversations")
    claims = c.select("conv_id", "turn", F.posexplode(text.claims(F.col("text"))).alias("pos", "claim")).withColumn("h", text.tokens(F.col("claim")))
    earlier = c.select("conv_id", F.col("turn").alias("before"), text.tokens(F.col("text")).alias("p"))
    covered = F.coalesce(F.try_divide(F.size(F.array_intersect("p", "h")), F.size("h")), F.lit(0.0))
    rows = claims.join(earlier, "conv_id").where("before < turn").withColumn("covered", covered)
    # Only the claim's own tokens are gathered, so a group holds no more than the claim for each earlier turn.
    return rows.groupBy("conv_id", "turn", "pos").agg(F.first("h").alias("h"), F.max("covered").alias("best"), F.array_distinct(F.flatten(F.collect_set(F.array_intersect("p", "h")))).alias("u"))


@query("I17_structural_support", f"WITH {_CLAIMS} SELECT conv_id, turn, pos::INT AS pos, best >= 0.6 OR coalesce(len(list_intersect(u, h))::DOUBLE / nullif(len(h), 0) >= 0.6, false) AS supported FROM m")
def _(spark, d):
    union = F.coalesce(F.try_divide(F.size("u"), F.size("h")) >= 0.6, F.lit(False))
    return _claims(spark, d).select("conv_id", "turn", "pos", ((F.col("best") >= 0.6) | union).alias("supported"))


@query("I18_support_score", f"WITH {_CLAIMS} SELECT conv_id, turn, pos::INT AS pos, round(best, 6) AS score FROM m")
def _(spark, d):
    return _claims(spark, d).select("conv_id", "turn", "pos", r6("best").alias("score"))


def _hash_sql(prompt: str, seed: int) -> str:
    pair = lambda k: " || ".join(f"substr(h{seed}, 8 * {k} + {2 * b + 1}, 2)" for b in (3, 2, 1, 0))
    return "[" + ", ".join(f"('0x' || {pair(k)})::BIGINT / 4294967295.0::DOUBLE * 2 - 1" for k in range(8)) + "]"


@query("I22_hash_embedder", f"""WITH h AS (SELECT conv_id, turn, sha256('text::' || text || '::0') AS h0, sha256('{vec.FORWARD_PROMPT}::' || text || '::1') AS h1, sha256('{vec.BACKWARD_PROMPT}::' || text || '::2') AS h2 FROM conversations),
v AS (SELECT conv_id, turn, {_hash_sql('', 0)} AS t, {_hash_sql('', 1)} AS f, {_hash_sql('', 2)} AS b FROM h),
x AS (SELECT conv_id, turn, list_transform(range(1, 9), lambda i: 0.7 * t[i] + 0.3 * f[i]) AS f, list_transform(range(1, 9), lambda i: 0.7 * t[i] + 0.3 * b[i]) AS b FROM v)
SELECT conv_id, turn, round(f[1] / sqrt(32 * list_inner_product(f, f)), 6) AS f1, round(b[8] / sqrt(32 * list_inner_product(b, b)), 6) AS b8, round(list_cosine_similarity(f, b), 6) AS cos FROM x""")
def _(spark, d):
    rows = embed.hash_vectors(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", r6(F.col("f")[0]).alias("f1"), r6(F.col("b")[7]).alias("b8"), r6(vec.dot(F.col("f"), F.col("b"))).alias("cos"))


@query("I29_expanded_vectors", f"""WITH s AS (SELECT conv_id, turn, 'then: ' || text AS x, 'before: ' || text AS y FROM conversations),
h AS (SELECT conv_id, turn, sha256('text::' || x || '::0') AS h0, sha256('{vec.FORWARD_PROMPT}::' || x || '::1') AS h1, sha256('text::' || y || '::0') AS h3, sha256('{vec.BACKWARD_PROMPT}::' || y || '::2') AS h2 FROM s),
v AS (SELECT conv_id, turn, {_hash_sql('', 0)} AS t, {_hash_sql('', 1)} AS f, {_hash_sql('', 3)} AS u, {_hash_sql('', 2)} AS b FROM h),
x AS (SELECT conv_id, turn, list_transform(range(1, 9), lambda i: 0.7 * t[i] + 0.3 * f[i]) AS f, list_transform(range(1, 9), lambda i: 0.7 * u[i] + 0.3 * b[i]) AS b FROM v)
SELECT conv_id, turn, round(list_cosine_similarity(f, b), 6) AS cos FROM x""")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = embed.expanded(rows, forward=lambda t: F.concat(F.lit("then: "), t), backward=lambda t: F.concat(F.lit("before: "), t))
    return out.select("conv_id", "turn", r6(vec.dot(F.col("f"), F.col("b"))).alias("cos"))


# Regions are the labels of the nodes; role and quality are made from the id.
_REGIONS = _EDGES + """, r AS (SELECT id, label AS region, s, CASE WHEN id % 3 = 0 THEN 'fact' ELSE 'outcome' END AS role, (id % 10) / 10.0::DOUBLE AS quality FROM nodes),
inside AS (SELECT e.*, x.region, x.role, x.s AS sx, y.s AS sy FROM edges e JOIN r x ON x.id = src JOIN r y ON y.id = dst WHERE x.region = y.region),
st AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY id) - 1 AS place, 1 - list_cosine_similarity(s, lead(s) OVER (PARTITION BY region ORDER BY id)) AS d FROM r),
ps AS (SELECT region, coalesce(avg(d), 0) AS divergence, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce((count(*) - min(CASE WHEN d < 0.05 THEN place END))::DOUBLE / count(*), 0) END AS collapse FROM st GROUP BY 1),
sy AS (SELECT region, coalesce((SELECT avg(CASE WHEN list_cosine_similarity(sx, sy) > 0.85 AND role = 'fact' THEN 1.0 ELSE 0.0 END) FROM inside i WHERE i.region = r.region AND edge_type = 'agrees'), 0)::DOUBLE AS sycophancy FROM r GROUP BY 1),
co AS (SELECT region, CASE WHEN a.id = b.id THEN 0 ELSE CASE WHEN region IN (SELECT region FROM inside WHERE edge_type IN ('pivots', 'corrects')) THEN 1.5 ELSE 1.0 END * (1 - list_cosine_similarity(a.s, b.s)) * (0.5 + b.quality - a.quality) END::DOUBLE AS correction
  FROM (SELECT region, arg_min(r, id) AS a, arg_max(r, id) AS b FROM r GROUP BY 1)),
de AS (SELECT region, count(*) AS v, (SELECT count(*) FROM inside i WHERE i.region = r.region) AS e FROM r GROUP BY 1),
up AS (SELECT region, e::DOUBLE / v - 0.05 * ln(1 + v) AS uplift, 1 / (1 + v / sqrt((SELECT count(*) FROM r))) AS rarity FROM de)"""


def _regions(spark, d):
    k = F.col("id")
    return nodes(spark, d).select("id", F.col("label").alias("region"), "s", F.when(k % 3 == 0, "fact").otherwise("outcome").alias("role"), (k % 10 / 10).alias("quality"), F.concat(F.lit("node "), k).alias("text"))


@query("N10_disagreement_collapse", f"WITH {_REGIONS} SELECT region, round(divergence, 6) AS divergence, round(collapse::DOUBLE, 6) AS collapse FROM ps")
def _(spark, d):
    return regions.path_scores(_regions(spark, d)).select("region", r6("divergence").alias("divergence"), r6("collapse").alias("collapse"))


@query("N11_sycophancy", f"WITH {_REGIONS} SELECT region, round(sycophancy, 6) AS sycophancy FROM sy")
def _(spark, d):
    return regions.sycophancy(_regions(spark, d), edges(spark, d)).select("region", r6("sycophancy").alias("sycophancy"))


@query("N12_correction_depth", f"WITH {_REGIONS} SELECT region, round(correction, 6) AS correction FROM co")
def _(spark, d):
    return regions.correction(_regions(spark, d), edges(spark, d)).select("region", r6("correction").alias("correction"))


@query("N14_region_priority", f"WITH {_REGIONS} SELECT region, round(divergence - collapse - sycophancy + correction + 0.5 * uplift + 0.5 * rarity, 6) AS priority FROM ps JOIN sy USING (region) JOIN co USING (region) JOIN up USING (region)")
def _(spark, d):
    return regions.priority(_regions(spark, d), edges(spark, d)).select("region", r6("priority").alias("priority"))


@query("L23_density_gap", f"WITH {_REGIONS} SELECT region, round(abs(e::DOUBLE / v - (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM r)), 6) AS gap FROM de")
def _(spark, d):
    return regions.density_gaps(_regions(spark, d), edges(spark, d)).select("region", r6("gap").alias("gap"))


@query("L18_harmonic_dimension")
def _(spark, d):
    return graph.harmonic_dimension(nodes(spark, d).select("id"), edges(spark, d))


# The extracted subgraphs of I20: each node with the targets of its edges.
@query("I20_linearize", f"""WITH {_EDGES}, m AS (SELECT src AS region, dst AS id FROM edges UNION SELECT id, id FROM nodes),
n AS (SELECT region, id, '[N' || row_number() OVER (PARTITION BY region ORDER BY id) || ']' AS name, '(' || CASE WHEN id % 3 = 0 THEN 'fact' ELSE 'outcome' END || ') node ' || id || CASE WHEN id % 4 = 0 THEN '  (verbatim: "' || substr('said ' || id || ' | ' || repeat('so ', 80), 1, 200) || '")' ELSE '' END AS body FROM m),
l AS (SELECT region, id, -1 AS dst, '' AS kind, name || ' ' || body AS line FROM n UNION ALL
  SELECT x.region, x.id, y.id, edge_type, printf('    --(%s, w=%+.3f)--> %s', edge_type, weight, y.name) FROM edges JOIN n x ON x.id = src JOIN n y ON y.region = x.region AND y.id = dst)
SELECT region, string_agg(line, chr(10) ORDER BY id, dst, kind) AS text FROM l GROUP BY 1""")
def _(spark, d):
    said = F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("said "), "id"), F.lit("so " * 80))).otherwise(F.array().cast("array<string>"))
    e, n = edges(spark, d), _regions(spark, d).select("id", "role", "text", said.alias("drawers"))
    members = e.select(F.col("src").alias("region"), F.col("dst").alias("id")).union(n.select(F.col("id").alias("region"), "id")).distinct()
    return regions.linearize(members.join(n, "id"), e)


@query("P04_stream_dedup", "SELECT DISTINCT sha256(lower(trim(text))) AS h FROM conversations WHERE text IS NOT NULL")
def _(spark, d):
    schema = table(spark, d, "conversations").schema
    return dedup.drain(dedup.distinct_texts(spark.readStream.schema(schema).parquet(f"{d}/conversations[.]parquet")), "stream-dedup")
