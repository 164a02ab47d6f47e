"""Queries over the test tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import bounds, text, vec
from memloom.operators import graph, ranks, retrieve
from memloom.operators.vectors import top_k
from memloom.sources.scratch import cut
from memloom.plans.fixtures import SAYINGS, edges, knn, nodes, table, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _unicode(pattern: str) -> str:
    """A pattern of ASCII borders as one whose borders are those of all letters and digits."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_]){body}($|[^\p{{L}}\p{{N}}_])"


def _sql_hit(kind: str, column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{_unicode(p).replace(chr(39), chr(39) * 2)}')" for p in text.EDGE_PATTERNS[kind]) + ")"


# The engine's tables in SQL.
_TYPE = f"""CASE WHEN {_sql_hit('corrects', 'd')} THEN 'corrects' WHEN {_sql_hit('superseded', 'b')} AND g < 0 THEN 'superseded' WHEN {_sql_hit('contradicts', 'b')} AND g < 0.05 THEN 'contradicts'
  WHEN {_sql_hit('pivots', 'b')} THEN 'pivots' WHEN {_sql_hit('temporal_next', 'b')} THEN 'temporal_next' WHEN abs(a) > 0.1 AND g > 0 THEN 'supports' WHEN abs(a) > 0.1 THEN 'contradicts'
  WHEN {_sql_hit('agrees', 'b')} AND g > 0 THEN 'agrees' WHEN {_sql_hit('supports', 'b')} AND g > 0 THEN 'supports' WHEN g > 0.1 THEN 'agrees' WHEN g < -0.05 THEN 'contradicts' ELSE 'pending' END"""
_SAYINGS = ", ".join(f"'{t}'" for t in SAYINGS)
_NODES = """nodes AS (SELECT *, list_transform(range(1, 33), lambda i: (f[i] + b[i]) / 2) AS s, list_transform(range(1, 33), lambda i: (f[i] - b[i]) / 2) AS c, [""" + _SAYINGS + """][id % 8 + 1] AS text
  FROM (SELECT vec_id AS id, label, embedding[1:32]::DOUBLE[] AS f, embedding[33:64]::DOUBLE[] AS b FROM embeddings))"""
_KNN = _NODES + """, knn AS (SELECT * FROM (SELECT q.id AS i, n.id AS j, list_cosine_similarity(q.s, n.s) AS cos, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.s, n.s) DESC, n.id) AS rank
  FROM nodes q JOIN nodes n ON q.id <> n.id) WHERE rank <= 6)"""
_EDGES = _KNN + """, pairs AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(cos) AS cos FROM knn WHERE cos >= 0 GROUP BY 1, 2),
scored AS (SELECT p.*, list_inner_product(x.c, y.s) - list_inner_product(y.c, x.s) AS ga, -list_inner_product(x.c, y.c) AS sym, x.text AS ti, y.text AS tj, sqrt(list_inner_product(x.c, x.c)) * sqrt(list_inner_product(y.c, y.c)) AS cc
  FROM pairs p JOIN nodes x ON x.id = p.i JOIN nodes y ON y.id = p.j),
ways AS (SELECT i AS src, j AS dst, sym + ga AS g, ga AS a, cos, tj AS d, ti || ' ' || tj AS b FROM scored WHERE (CASE WHEN cc > 1e-9 THEN abs(ga) / (cc + 1e-9) ELSE 0 END) < 0.2 OR ga > 0
  UNION ALL SELECT j, i, sym - ga, -ga, cos, ti, tj || ' ' || ti FROM scored WHERE (CASE WHEN cc > 1e-9 THEN abs(ga) / (cc + 1e-9) ELSE 0 END) < 0.2 OR ga <= 0),
typed AS (SELECT *, """ + _TYPE + """ AS edge_type FROM ways),
edges AS (SELECT src, dst, edge_type, CASE WHEN edge_type IN ('contradicts', 'superseded') THEN -abs(cos) WHEN cos > 0 THEN cos ELSE abs(cos) * 0.5 END AS weight, g AS gamma_score, a AS gamma_anti FROM typed)"""
_ADJ = _EDGES + ", adj AS (SELECT DISTINCT src AS u, dst AS v FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst)"
_PAIR = _NODES + ", pair AS (SELECT x.id AS i, y.id AS j, x.f AS fi, x.b AS bi, x.s AS si, x.c AS ci, y.f AS fj, y.b AS bj, y.s AS sj, y.c AS cj FROM nodes x JOIN nodes y ON y.id = x.id + 1)"


def _pair(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    one = n.select(F.col("id").alias("i"), F.col("f").alias("fi"), F.col("b").alias("bi"), F.col("s").alias("si"), F.col("c").alias("ci"))
    two = n.select(F.col("id").alias("j"), F.col("f").alias("fj"), F.col("b").alias("bj"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    return one.join(two, F.col("j") == F.col("i") + 1)


# A, D: storage.
@query("A05_append_audit", "SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events")
def _(spark, d):
    return ranks.numbered(table(spark, d, "events").select("event_id", "event_type", "user_id", "ts"), ["ts", "event_id"], group=["event_type"]).select("event_id", "event_type", "user_id", "seq")


@query("A07_point_lookup", "SELECT doc_id, text FROM documents WHERE doc_id = 17")
def _(spark, d):
    return table(spark, d, "documents").where("doc_id = 17").select("doc_id", "text")


@query("A10_index_load", f"WITH {_NODES} SELECT id, round(s[1] / sqrt(list_inner_product(s, s)), 6) AS s1, round(sqrt(list_inner_product(s, s)), 6) AS size FROM nodes")
def _(spark, d):
    return nodes(spark, d).select("id", r6(vec.l2_normalize(F.col("s"))[0]).alias("s1"), r6(vec.norm(F.col("s"))).alias("size"))


@query("A13_paragraph_ingest", "SELECT conv_id, unnest(list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: trim(p, ' \t\n\r')), lambda p: length(p) >= 20)) AS paragraph FROM (SELECT conv_id, string_agg(CASE WHEN turn % 3 = 0 THEN chr(10) ELSE chr(10) || chr(10) END || text, '' ORDER BY turn) AS body FROM conversations GROUP BY 1)")
def _(spark, d):
    # a file of paragraphs for each conversation; some paragraphs have two lines
    lines = F.sort_array(F.collect_list(F.struct("turn", "text")))
    body = F.aggregate(lines, F.lit(""), lambda acc, x: F.when(acc == "", x.text).otherwise(F.concat(acc, F.when(x.turn % 3 == 0, "\n").otherwise("\n\n"), x.text)))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(body.alias("body"))
    return files.select("conv_id", F.explode(text.paragraphs(F.col("body"))).alias("paragraph"))


@query("A14_export_jsonl", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))


@query("A17_render_session", "SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def _(spark, d):
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("t"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.t), "\n").alias("body"))


@query("D01_scope_match", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src3'")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("src"), "source").alias("scope"))
    wanted = {"lang": "de", "src": "src3"}
    held = F.lit(True)
    for k, v in wanted.items():
        held = held & (F.col("scope")[k] == v)
    return docs.where(held).select("doc_id")


@query("D04_exact_scope_hash", "SELECT doc_id FROM documents x WHERE EXISTS (SELECT 1 FROM documents y WHERE y.doc_id % 100 = 0 AND y.lang = x.lang AND sha256(lower(trim(y.text))) = sha256(lower(trim(x.text))))")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", text.text_hash(F.col("text")).alias("h"))
    return docs.join(docs.where("doc_id % 100 = 0").select("lang", "h"), ["lang", "h"], "left_semi").select("doc_id")


@query("D05_provenance_firewall", "SELECT role = 'system' AS rejected, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    return turns(spark, d).groupBy(F.col("source").isin(*text.ARTIFACT_SOURCES).alias("rejected")).agg(F.count("*").alias("n"))


@query("D10_audit_since", "SELECT event_id, user_id FROM events WHERE user_id % 100 = 0 AND ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def _(spark, d):
    e = table(spark, d, "events")
    since = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return e.join(F.broadcast(since), e.ts >= since.since).where("user_id % 100 = 0").select("event_id", "user_id")


# B, I: text.
@query("B02_text_hash", "SELECT conv_id, turn, sha256(lower(trim(text))) AS h FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.text_hash(F.col("text")).alias("h"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains([" + _STOP + "], t)))"


@query("B07_tokens", f"SELECT conv_id, turn, len({_TOK.format('text')})::BIGINT AS n, array_to_string(list_sort({_TOK.format('text')}), ' ') AS t FROM conversations")
def _(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(t).cast("bigint").alias("n"), F.array_join(F.array_sort(t), " ").alias("t"))


@query("B09_normalize", "SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS t FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.squash(F.col("text")).alias("t"))


_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query("B10_unique_ratio", f"SELECT doc_id, len({_WORDS.format('text')})::BIGINT AS n, round(len(list_distinct({_WORDS.format('text')}))::DOUBLE / len({_WORDS.format('text')}), 6) AS ratio FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("bigint").alias("n"), r6(text.unique_ratio(F.col("text"))).alias("ratio"))


_SENT = "list_filter(list_transform(string_split_regex(regexp_replace({0}, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: trim(s)), lambda s: len(" + _WORDS.format("s") + ") >= {1})"


@query("I01_sentence_split", f"SELECT conv_id, turn, unnest({_SENT.format('text', 3)}) AS sentence FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.sentences(F.col("text"))).alias("sentence"))


@query("I14_extract_claims", f"SELECT conv_id, turn, len(list_filter({_SENT.format('text', 4)}, lambda s: NOT suffix(s, '?')))::BIGINT AS n FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(text.claims(F.col("text"))).cast("bigint").alias("n"))


def _cues(column: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + ")"


_SPLIT = "list_transform(string_split_regex(regexp_replace(trim({0}, ' \t\n\r'), '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: trim(s, ' \t\n\r'))"


@query("I04_role", f"""WITH s AS (SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (SELECT conv_id, turn, list_filter({_SPLIT.format('text')}, lambda x: length(x) >= 5) AS l FROM conversations))
SELECT conv_id, turn, pos::INT AS pos, sentence, CASE """ + " ".join(f"WHEN {_cues('sentence', c)} THEN '{n}'" for n, c in text.ROLE_CUES) + " ELSE 'fact' END AS role FROM s")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.thoughts(F.col("text"))).alias("pos", "t")).select("conv_id", "turn", "pos", "t.sentence", "t.role")


_BUFFER = "coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), chr(10)), '')"
_ATTRIBUTES = " + ".join(f"regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}')::INT" for p in text.BIO_PATTERNS)
_ANCHORS = "len(list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]{2,})(?:$|[^\\p{L}\\p{N}_])', 1)), lambda w: contains(buffer, w)))"


def _gate(bio: str) -> str:
    """The gate's cascade in SQL over text (and buffer)."""
    words = _WORDS.format("lower(text)")
    return f"""CASE WHEN trim(text) = '' THEN 0.0 WHEN length(trim(text)) < 10 THEN 0.05 WHEN {_cues('trim(text)', [x.lower() for x in text.TEMPLATES])} THEN 0.1 {bio} WHEN len({words}) < 3 THEN 0.15
  WHEN len(list_distinct({words}))::DOUBLE / len({words}) < 0.4 THEN 0.2 ELSE greatest(0.5, least(1.0, 0.4 + 0.5 * least(1.0, len({words}) / 30.0::DOUBLE) + 0.2 * len(list_distinct({words}))::DOUBLE / len({words}))) END::DOUBLE"""


def buffered(spark, d):
    """Turns with the texts of the twenty before them."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-20, -1)
    return table(spark, d, "conversations").withColumn("buffer", F.array_join(F.collect_list("text").over(before), "\n"))


@query("I05_quality_score", f"SELECT conv_id, turn, round({_gate(f'WHEN length(buffer) > 0 AND {_ATTRIBUTES} >= 3 AND {_ANCHORS} < 2 THEN 0.05')}, 6) AS score FROM (SELECT *, {_BUFFER} AS buffer FROM conversations)")
def _(spark, d):
    return buffered(spark, d).select("conv_id", "turn", r6(text.quality_score(F.col("text"), F.col("buffer"))).alias("score"))


@query("I06_quality_gate", f"WITH s AS (SELECT doc_id, {_gate('')} AS score FROM documents) SELECT quality, CASE WHEN score < 0.4 THEN 'rejected' ELSE 'pending' END AS status, count(*) AS n FROM s JOIN labels USING (doc_id) GROUP BY 1, 2")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.quality_status(text.quality_score(F.col("text"))).alias("status"))
    return docs.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "status").agg(F.count("*").alias("n"))


@query("I12_edge_type", f"""WITH t AS (SELECT x.conv_id, x.turn, y.text AS d, x.text || ' ' || y.text AS b, ((x.conv_id + x.turn) % 7 - 3) / 20.0::DOUBLE AS g, ((x.conv_id + x.turn) % 5 - 2) / 15.0::DOUBLE AS a
  FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, turn, {_TYPE} AS edge_type FROM t""")
def _(spark, d):
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    g, a = ((F.col("conv_id") + F.col("turn")) % 7 - 3) / 20, ((F.col("conv_id") + F.col("turn")) % 5 - 2) / 15
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", text.edge_type(F.col("text"), F.col("next"), g, a).alias("edge_type"))


@query("I13_extract_entities")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.entities(F.col("text")), "|").alias("entities"))


@query("I15_lexical_entails", f"""WITH t AS (SELECT x.conv_id, x.turn, {_TOK.format('x.text')} AS p, {_TOK.format('y.text')} AS h FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, turn, coalesce(len(list_intersect(p, h))::DOUBLE / nullif(len(h), 0) >= 0.6, false) AS entails FROM t""")
def _(spark, d):
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.coalesce(text.coverage(F.col("text"), F.col("next")) >= 0.6, F.lit(False)).alias("entails"))


@query("I19_intent", f"""SELECT conv_id, turn, CASE WHEN {_cues('text', text.INTENT_DIRECTIONAL)} AND NOT {_cues('text', text.INTENT_SYMMETRIC)} THEN 'directional'
  WHEN {_cues('text', text.INTENT_SYMMETRIC)} AND NOT {_cues('text', text.INTENT_DIRECTIONAL)} THEN 'symmetric' ELSE 'hybrid' END AS intent FROM conversations""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


_TERMS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1)"


def _bm25(spark, d, wanted):
    """The five best documents of each wanted benchmark item."""
    docs = table(spark, d, "documents").select("doc_id", text.terms(F.col("text")).alias("ts"))
    total = docs.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    tf = docs.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    idf = tf.groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(total)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("m"))
    q = table(spark, d, "benchmark").where(wanted).select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(text.terms(F.col("text")))).alias("t"))
    rows = tf.join(q, "t").join(idf.select("t", "idf", "avgdl"), "t").join(F.broadcast(mean))
    part = F.when(F.col("idf") < 0, 0.25 * F.col("m")).otherwise(F.col("idf")) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return rows.groupBy("qid", "doc_id").agg(F.sum(part).alias("score")).withColumn("r", F.row_number().over(best)).where("r <= 5").select("qid", "doc_id", r6("score").alias("score"))


@query("I21_bm25", f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
q AS (SELECT item_id AS qid, t FROM (SELECT item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark WHERE item_id % 100 = 0)),
tf AS (SELECT doc_id, t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(ts) AS t, len(ts) AS dl FROM d) GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n), mean AS (SELECT avg(idf) AS m FROM raw),
s AS (SELECT qid, doc_id, sum((CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (t) JOIN raw USING (t), n, mean GROUP BY 1, 2)
SELECT qid, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) <= 5""")
def _(spark, d):
    return _bm25(spark, d, "item_id % 100 = 0")


# C: vectors.
@query("C02_cosine", f"WITH {_PAIR} SELECT i, j, round(list_cosine_similarity(si, sj), 6) AS cos, round(list_inner_product(fi, bj), 6) AS fb FROM pair")
def _(spark, d):
    return _pair(spark, d).select("i", "j", r6(vec.cosine(F.col("si"), F.col("sj"))).alias("cos"), r6(vec.dot(F.col("fi"), F.col("bj"))).alias("fb"))


_G = "list_inner_product(fi, bj) - list_inner_product(si, sj)"


@query("C06_gamma_score", f"WITH {_PAIR} SELECT i, j, round({_G}, 6) AS g, round(list_inner_product(fj, bi) - list_inner_product(sj, si), 6) AS back FROM pair")
def _(spark, d):
    a = [F.col(c) for c in ("fi", "bi", "fj", "bj")]
    return _pair(spark, d).select("i", "j", r6(vec.gamma(*a)).alias("g"), r6(vec.gamma(a[2], a[3], a[0], a[1])).alias("back"))


@query("C07_gamma_split", f"WITH {_PAIR} SELECT i, j, round(-list_inner_product(ci, cj), 6) AS sym, round(list_inner_product(ci, sj) - list_inner_product(cj, si), 6) AS anti FROM pair")
def _(spark, d):
    a = [F.col(c) for c in ("fi", "bi", "fj", "bj")]
    return _pair(spark, d).select("i", "j", r6(vec.gamma_sym(*a)).alias("sym"), r6(vec.gamma_anti(*a)).alias("anti"))


@query("C08_asymmetry", f"WITH {_PAIR} SELECT i, j, round(2 * (list_inner_product(ci, sj) - list_inner_product(cj, si)), 6) AS diff FROM pair")
def _(spark, d):
    a = [F.col(c) for c in ("fi", "bi", "fj", "bj")]
    return _pair(spark, d).select("i", "j", r6(vec.gamma(*a) - vec.gamma(a[2], a[3], a[0], a[1])).alias("diff"))


@query("C09_squared_distance", f"WITH {_PAIR} SELECT i, j, round(list_distance(si, sj) * list_distance(si, sj), 6) AS d2 FROM pair")
def _(spark, d):
    return _pair(spark, d).select("i", "j", r6(vec.squared_distance(F.col("si"), F.col("sj"))).alias("d2"))


@query("C11_direction_strength", f"WITH {_PAIR} SELECT i, j, round(abs(list_inner_product(ci, sj) - list_inner_product(cj, si)) / (sqrt(list_inner_product(ci, ci)) * sqrt(list_inner_product(cj, cj)) + 1e-9), 6) AS strength FROM pair")
def _(spark, d):
    a = [F.col(c) for c in ("fi", "bi", "fj", "bj")]
    return _pair(spark, d).select("i", "j", r6(vec.direction_strength(vec.gamma_anti(*a), F.col("ci"), F.col("cj"))).alias("strength"))


# E, G, K: search.
def _nearest(spark, d, wanted):
    """The ten nearest nodes of each wanted node within its label."""
    n = nodes(spark, d)
    got = top_k(n.where(wanted).select(F.col("id").alias("qid"), F.col("s").alias("v"), "label"), n.select("id", F.col("s").alias("v"), "label"), 10, scope="label")
    return got.select("qid", "id", r6("score").alias("score"))


@query("K01_symmetric_search", f"WITH {_NODES} SELECT q.id AS qid, n.id AS id, round(list_cosine_similarity(q.s, n.s), 6) AS score FROM nodes q JOIN nodes n ON q.label = n.label WHERE q.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.s, n.s) DESC, n.id) <= 10")
def k01(spark, d):
    return _nearest(spark, d, "id % 100 = 0")


@query("E05_knn_self_join", f"WITH {_KNN} SELECT i, j, round(cos, 6) AS cos, rank FROM knn")
def _(spark, d):
    return knn(spark, d).select("i", "j", r6("cos").alias("cos"), F.col("rank").cast("bigint").alias("rank"))


@query("J01_earlier_neighbours", f"WITH {_NODES} SELECT q.id AS i, n.id AS j, round(list_cosine_similarity(q.s, n.s), 6) AS cos FROM nodes q JOIN nodes n ON n.id < q.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.s, n.s) DESC, n.id) <= 10")
def _(spark, d):
    n = nodes(spark, d)
    got = top_k(n.select(F.col("id").alias("qid"), F.col("s").alias("v")), n.select("id", F.col("s").alias("v")), 10, earlier=True)
    return got.select(F.col("qid").alias("i"), F.col("id").alias("j"), r6("score").alias("cos"))


_E = "round(weight, 6) AS weight, round(gamma_score, 6) AS gamma_score, round(gamma_anti, 6) AS gamma_anti"


@query("J05_induced_edges", f"WITH {_EDGES} SELECT src, dst, edge_type, {_E} FROM edges")
def _(spark, d):
    return edges(spark, d).select("src", "dst", "edge_type", *(r6(c).alias(c) for c in ("weight", "gamma_score", "gamma_anti")))


def _chains(spark, d, wanted):
    """Two-chains that start at wanted edges."""
    e = edges(spark, d)
    return e.where(wanted).select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a <> c").select("a", "b", "c")


@query("E06_two_chains", f"WITH {_EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src <> y.dst")
def _(spark, d):
    return _chains(spark, d, "true")


@query("E09_forget_cascade", f"WITH {_EDGES} SELECT src, dst FROM edges WHERE src % 100 = 0 OR dst % 100 = 0")
def _(spark, d):
    e, gone = edges(spark, d).select("src", "dst"), nodes(spark, d).where("id % 100 = 0").select("id")
    return e.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").union(e.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")).distinct()


@query("E10_isolated_nodes", f"WITH {_EDGES} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE edge_type = 'pivots' UNION SELECT dst FROM edges WHERE edge_type = 'pivots')")
def _(spark, d):
    return graph.isolated(nodes(spark, d), edges(spark, d).where("edge_type = 'pivots'"))


@query("E14_induced_subgraph", f"WITH {_EDGES} SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT id FROM nodes WHERE label = 3) AND dst IN (SELECT id FROM nodes WHERE label = 3)")
def _(spark, d):
    return retrieve.induced(edges(spark, d), nodes(spark, d).where("label = 3").select("id")).select("src", "dst", "edge_type")


@query("G04_rank_fusion", "SELECT qid, item, round(sum(w / (60 + pos + 1)), 6) AS score FROM (SELECT user_id % 5 AS qid, event_id AS item, 1.0::DOUBLE AS w, row_number() OVER (PARTITION BY user_id % 5 ORDER BY value DESC, event_id) - 1 AS pos FROM events UNION ALL SELECT user_id % 5, event_id, 2.0, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) - 1 FROM events) WHERE pos < 20 GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("qid", F.col("user_id") % 5)
    one, two = Window.partitionBy("qid").orderBy(F.desc("value"), "event_id"), Window.partitionBy("qid").orderBy("ts", "event_id")
    lists = e.select("qid", F.col("event_id").alias("item"), F.lit(1.0).alias("w"), (F.row_number().over(one) - 1).alias("pos")).where("pos < 20").union(e.select("qid", "event_id", F.lit(2.0), (F.row_number().over(two) - 1).alias("pos")).where("pos < 20"))
    return retrieve.fuse(lists).select("qid", "item", r6("score").alias("score"))


@query("G08_conversation_buffer", "SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), chr(10)), '') AS buffer FROM conversations")
def _(spark, d):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-20, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(before), "\n").alias("buffer"))


def _beam(spark, d, wanted):
    """Walks of two steps from each wanted node."""
    seeds = nodes(spark, d).where(wanted).select(F.col("id").alias("qid"), F.col("id").alias("seed"))
    return retrieve.walk(seeds, edges(spark, d), depth=2).select("qid", "seed", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), r6("cum").alias("cum"))


@query("K02_beam_walk", f"""WITH {_EDGES}, w AS (SELECT src, dst, weight FROM edges WHERE weight >= -0.1), p0 AS (SELECT id AS seed, [id] AS nodes, 0.0::DOUBLE AS cum FROM nodes WHERE id % 100 = 0),
m1 AS (SELECT seed, list_append(nodes, dst) AS nodes, cum + weight AS cum, nodes AS old FROM p0 JOIN w ON src = nodes[-1] WHERE NOT list_contains(nodes, dst)),
p1 AS (SELECT seed, nodes, cum FROM (SELECT seed, nodes, cum FROM m1 UNION ALL SELECT seed, nodes, cum FROM p0 WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.old = p0.nodes)) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(cum, 9) DESC, nodes) <= 8),
m2 AS (SELECT seed, list_append(nodes, dst) AS nodes, cum + weight AS cum, nodes AS old FROM p1 JOIN w ON src = nodes[-1] WHERE NOT list_contains(nodes, dst)),
p2 AS (SELECT seed, nodes, cum FROM (SELECT seed, nodes, cum FROM m2 UNION ALL SELECT seed, nodes, cum FROM p1 WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.old = p1.nodes)) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(cum, 9) DESC, nodes) <= 8)
SELECT seed AS qid, seed, array_to_string(nodes, '>') AS path, round(cum, 6) AS cum FROM p2""")
def _(spark, d):
    return _beam(spark, d, "id % 100 = 0")


# F: aggregates.
@query("F01_stats", f"WITH {_EDGES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM events) AS n_audit")
def _(spark, d):
    count = lambda df, c: df.agg(F.count("*").alias(c))
    return count(nodes(spark, d), "n_nodes").crossJoin(count(edges(spark, d), "n_edges")).crossJoin(count(table(spark, d, "events"), "n_audit"))


@query("F03_node_prize", f"WITH {_EDGES} SELECT id, round(sum(greatest(weight, 0)), 6) AS prize FROM (SELECT src AS id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY 1")
def _(spark, d):
    return retrieve.prizes(edges(spark, d)).select("id", r6("prize").alias("prize"))


@query("F04_edge_cost", f"WITH {_EDGES} SELECT src, dst, round(greatest(0, -weight), 6) AS tree_cost, round(CASE WHEN weight < 0 THEN 1.5 * abs(weight) ELSE greatest(0.01, 0.1 * (1 - weight)) END, 6) AS forest_cost FROM edges")
def _(spark, d):
    return retrieve.costs(edges(spark, d)).select("src", "dst", r6("tree_cost").alias("tree_cost"), r6("forest_cost").alias("forest_cost"))


@query("F08_frustration", f"WITH {_EDGES} SELECT round(avg(CASE WHEN edge_type IN ('contradicts', 'superseded') THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS frustration FROM edges")
def _(spark, d):
    return edges(spark, d).agg(r6(F.avg(F.col("edge_type").isin("contradicts", "superseded").cast("double"))).alias("frustration"))


@query("F10_percentiles", """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)
SELECT event_type, n, round(m, 6) AS mean, v[least(n, floor(n * 0.5::DOUBLE)::BIGINT + 1)] AS p50, v[least(n, floor(n * 0.95::DOUBLE)::BIGINT + 1)] AS p95, v[least(n, floor(n * 0.99::DOUBLE)::BIGINT + 1)] AS p99 FROM s""")
def _(spark, d):
    at = lambda q: F.least(F.col("n"), F.floor(F.col("n") * F.lit(q)) + 1)
    return ranks.order_statistics(table(spark, d, "events"), "value", {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99)}, group=["event_type"]).withColumn("mean", r6("mean"))


@query("F11_operation_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("F18_causal_ratio", f"WITH {_NODES} SELECT round(avg(sqrt(list_inner_product(c, c)) / sqrt(list_inner_product(s, s))), 6) AS rho FROM nodes")
def _(spark, d):
    return nodes(spark, d).agg(r6(F.avg(vec.norm(F.col("c")) / vec.norm(F.col("s")))).alias("rho"))


@query("H05_undirected_closure", f"WITH {_ADJ} SELECT u, v FROM adj")
def _(spark, d):
    return graph.adjacency(edges(spark, d))


# L: graph analytics.
@query("L01_weighted_adjacency", f"WITH {_EDGES} SELECT u, v, round(sum(a), 6) AS a FROM (SELECT src AS u, dst AS v, abs(weight) AS a FROM edges UNION ALL SELECT dst, src, abs(weight) FROM edges) GROUP BY 1, 2")
def _(spark, d):
    return graph.weighted_adjacency(edges(spark, d)).select("u", "v", r6("a").alias("a"))


@query("L02_laplacian", f"""WITH {_EDGES}, a AS (SELECT u, v, sum(a) AS a FROM (SELECT src AS u, dst AS v, abs(weight) AS a FROM edges UNION ALL SELECT dst, src, abs(weight) FROM edges) GROUP BY 1, 2), deg AS (SELECT u, sum(a) AS d FROM a GROUP BY 1)
SELECT id AS u, id AS v, 1.0::DOUBLE AS value FROM nodes UNION ALL SELECT a.u, a.v, round(-a.a / sqrt(x.d * y.d), 6) FROM a JOIN deg x ON x.u = a.u JOIN deg y ON y.u = a.v""")
def _(spark, d):
    return graph.laplacian(nodes(spark, d), edges(spark, d)).select("u", "v", r6("value").alias("value"))


@query("L09_connected_components", f"WITH RECURSIVE {_ADJ}, reach AS (SELECT id AS node, id AS root FROM nodes UNION SELECT v, root FROM reach JOIN adj ON u = node) SELECT node AS id, min(root) AS component FROM reach GROUP BY 1")
def _(spark, d):
    return graph.components(nodes(spark, d), edges(spark, d))


_DEG = _ADJ + ", deg AS (SELECT u, count(*) AS d FROM adj GROUP BY 1), common AS (SELECT x.u, x.v, count(z.v) AS c FROM adj x JOIN adj y ON y.u = x.u LEFT JOIN adj z ON z.u = x.v AND z.v = y.v GROUP BY 1, 2)"


@query("L10_clustering", f"WITH {_DEG} SELECT id, coalesce(d, 0)::BIGINT AS degree, round(CASE WHEN coalesce(d, 0) < 2 THEN 0 ELSE (SELECT sum(c) FROM common WHERE common.u = id)::DOUBLE / (d * (d - 1)) END, 6)::DOUBLE AS coefficient FROM nodes LEFT JOIN deg ON deg.u = id")
def _(spark, d):
    return graph.clustering(nodes(spark, d), edges(spark, d)).select("id", "degree", r6("coefficient").alias("coefficient"))


def _hops(spark, d, wanted):
    """Hops up to three from each wanted node."""
    return graph.hops(edges(spark, d), nodes(spark, d).where(wanted).select("id"), 3)


@query("L11_hops", f"WITH RECURSIVE {_ADJ}, h AS (SELECT id AS source, id, 0 AS hops FROM nodes WHERE id % 100 = 0 UNION SELECT source, v, hops + 1 FROM h JOIN adj ON u = id WHERE hops < 3) SELECT source, id, min(hops) AS hops FROM h GROUP BY 1, 2 HAVING min(hops) > 0")
def _(spark, d):
    return _hops(spark, d, "id % 100 = 0")


_FORMAN = _DEG + ", forman AS (SELECT e.*, (4 - x.d - y.d + 2 * c)::DOUBLE AS kappa FROM edges e JOIN deg x ON x.u = e.src JOIN deg y ON y.u = e.dst JOIN common k ON k.u = e.src AND k.v = e.dst)"


@query("L12_forman_curvature", f"WITH {_FORMAN} SELECT src, dst, kappa FROM forman")
def _(spark, d):
    return graph.forman(edges(spark, d)).select("src", "dst", "kappa")


_OLL = _EDGES + """, w AS (SELECT u, v, max(a) AS a FROM (SELECT src AS u, dst AS v, abs(weight) AS a FROM edges UNION ALL SELECT dst, src, abs(weight) FROM edges) GROUP BY 1, 2), tot AS (SELECT u, sum(a) AS t FROM w GROUP BY 1),
mass AS (SELECT w.u, w.v AS k, 0.5 * a / t AS m FROM w JOIN tot ON tot.u = w.u UNION ALL SELECT u, u, 0.5 FROM tot),
oll AS (SELECT p.u, p.v, 1 - (1 - sum(least(x.m, y.m))) / greatest(1 / greatest(any_value(p.a), 0.01), 1) AS kappa FROM w p JOIN mass x ON x.u = p.u JOIN mass y ON y.u = p.v AND y.k = x.k WHERE p.u < p.v GROUP BY 1, 2)"""


@query("L13_ollivier_curvature", f"WITH {_OLL} SELECT u, v, round(kappa, 6) AS kappa FROM oll")
def _(spark, d):
    return graph.ollivier(edges(spark, d)).select("u", "v", r6("kappa").alias("kappa"))


@query("L14_pruning_signal", f"WITH {_FORMAN} SELECT src, dst FROM forman WHERE kappa < -4")
def _(spark, d):
    return graph.forman(edges(spark, d)).where("kappa < -4").select("src", "dst")


@query("L15_curvature_summary", f"WITH {_OLL} SELECT round(avg(kappa), 6) AS mean, round(median(kappa), 6) AS median, round(min(kappa), 6) AS least, round(max(kappa), 6) AS most, count_if(kappa < 0)::BIGINT AS n_negative, count_if(kappa > 0)::BIGINT AS n_positive FROM oll")
def _(spark, d):
    return ranks.summary(cut(graph.ollivier(edges(spark, d)), "curvatures"), "kappa")


def _pagerank_sql(rounds: int = 5) -> str:
    parts = ["w AS (SELECT src, dst, max(weight) AS w FROM edges GROUP BY 1, 2)", "t AS (SELECT src, sum(abs(w)) AS t FROM w GROUP BY 1)", "p AS (SELECT w.src, dst, w / t AS p FROM w JOIN t ON t.src = w.src WHERE t > 0)", "q AS (SELECT id, CASE WHEN id % 100 = 0 THEN 1.0 / (SELECT count(*) FROM nodes WHERE id % 100 = 0) ELSE 0.0 END::DOUBLE AS q FROM nodes)", "r0 AS (SELECT id, q AS s FROM q)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS (SELECT q.id, 0.15 * any_value(q) + 0.85 * coalesce(sum(p.p * r{k}.s), 0) AS s FROM q LEFT JOIN p ON p.dst = q.id LEFT JOIN r{k} ON r{k}.id = p.src GROUP BY 1)")
    return f"WITH {_EDGES}, {', '.join(parts)} SELECT id, round(s, 6) AS score FROM r{rounds}"


@query("L08_personalized_pagerank", _pagerank_sql())
def _(spark, d):
    return graph.pagerank(nodes(spark, d), edges(spark, d), nodes(spark, d).where("id % 100 = 0").select("id"), rounds=5).select("id", r6("score").alias("score"))


_SIGN = "CASE WHEN edge_type IN ('contradicts', 'superseded') THEN -1.0 WHEN edge_type IN ('supports', 'agrees', 'temporal_next', 'pivots') THEN 1.0 WHEN edge_type = 'corrects' THEN -0.5 ELSE 0.5 END::DOUBLE"


@query("L16_signed_incidence", f"WITH {_EDGES} SELECT src, dst, src AS node, -1.0::DOUBLE AS value FROM edges UNION ALL SELECT src, dst, dst, {_SIGN} FROM edges")
def _(spark, d):
    return graph.signed_incidence(edges(spark, d)).select("src", "dst", "node", "value")


@query("L17_sheaf_laplacian", f"WITH {_EDGES}, x AS (SELECT src, dst, src AS node, -1.0::DOUBLE AS value FROM edges UNION ALL SELECT src, dst, dst, {_SIGN} FROM edges) SELECT a.node AS u, b.node AS v, round(sum(a.value * b.value), 6) AS value FROM x a JOIN x b ON a.src = b.src AND a.dst = b.dst GROUP BY 1, 2")
def _(spark, d):
    return graph.sheaf_laplacian(edges(spark, d)).select("u", "v", r6("value").alias("value"))


# M: bounds, over edges and nodes as inputs.
@query("M01_conformal_bounds", """WITH g AS (SELECT source, avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS r, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), z AS (SELECT *, 2 * ln(exp(1.0::DOUBLE) / 0.05) AS z2 FROM g)
SELECT source, n, round(r, 6) AS risk, round(least(1.0, r + sqrt(ln(1 / 0.05::DOUBLE) / (2 * n))), 6) AS hoeffding, round(least(1.0, (r + z2 / (2 * n) + sqrt(z2) * sqrt(r * (1 - r) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS wilson FROM z""")
def _(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.avg((F.col("toxic") == 1).cast("double")).alias("r"), F.count("*").alias("n"))
    return rows.select("source", "n", r6("r").alias("risk"), r6(bounds.crc_hoeffding(F.col("r"), F.col("n"))).alias("hoeffding"), r6(bounds.crc_wilson(F.col("r"), F.col("n"))).alias("wilson"))


@query("M04_split_conformal", "SELECT event_type, value AS threshold FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = least(n, greatest(1, ceil((n + 1) * 0.95::DOUBLE)::BIGINT))")
def _(spark, d):
    at = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * F.lit(0.95))))
    return ranks.order_statistics(table(spark, d, "events"), "value", {"threshold": at}, group=["event_type"]).select("event_type", "threshold")


@query("M05_pac_bayes", """WITH x AS (SELECT p_partkey AS id, (p_partkey % 10) / 20.0::DOUBLE AS l, (p_partkey % 7) / 40.0::DOUBLE AS t, (p_partkey % 3) / 2.0::DOUBLE AS kl, p_partkey * 50 AS n FROM part WHERE p_partkey > 0),
y AS (SELECT *, 2 * (l - t) AS m, sqrt(2 * (kl + ln(2 * sqrt(n) / 0.05)) / n) AS r FROM x)
SELECT id, round(CASE WHEN m > 0 AND m - r > 0 AND 1 - m + r > 0 THEN least(1.0, greatest(0.0, pow((m + r) / (1 - m + r), 2))) END, 6) AS chebyshev, round(least(1.0, 4 * (t + (kl + ln(2 * sqrt(n) / 0.05)) / n)), 6) AS first_order FROM y""")
def _(spark, d):
    x = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 10) / 20).alias("l"), ((F.col("p_partkey") % 7) / 40).alias("t"), ((F.col("p_partkey") % 3) / 2).alias("kl"), (F.col("p_partkey") * 50).alias("n"))
    return x.select("id", r6(bounds.chebyshev_cantelli(*(F.col(c) for c in ("l", "t", "kl", "n")))).alias("chebyshev"), r6(bounds.pac_bayes(F.col("t"), F.col("kl"), F.col("n"))).alias("first_order"))


@query("M09_hallucination_bound", """WITH x AS (SELECT s_suppkey AS id, (s_suppkey % 9) / 30.0::DOUBLE AS loss, s_suppkey % 12 AS n, (s_suppkey % 5) / 20.0::DOUBLE AS dist, s_suppkey % 40 AS e, s_suppkey % 15 AS v FROM supplier),
y AS (SELECT *, CASE WHEN n > 0 THEN least(1.0, greatest(0.0, loss + (1 - exp(-1 / n::DOUBLE)) + dist + sqrt(ln(2 / 0.05::DOUBLE) / (2 * n)))) END AS rag, CASE WHEN v <= 1 THEN 0.5 ELSE least(1.0, greatest(2.0 / greatest(1, v - 1), e::DOUBLE / greatest(1, v) / 2)) END AS h FROM x),
z AS (SELECT *, CASE WHEN e > 0 AND h > 0 THEN least(1.0, 0.1 + (1 / h) / sqrt(e)) END AS spec FROM y)
SELECT id, round(rag, 6) AS rag, round(h, 6)::DOUBLE AS cheeger, round(spec, 6) AS spectral, round(CASE WHEN rag IS NOT NULL AND spec IS NOT NULL THEN least(1.0, rag + 0.5 * spec) ELSE coalesce(rag, spec) END, 6) AS composite FROM z""")
def _(spark, d):
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(k.alias("id"), ((k % 9) / 30).alias("loss"), (k % 12).alias("n"), ((k % 5) / 20).alias("dist"), (k % 40).alias("e"), (k % 15).alias("v"))
    x = x.withColumns({"rag": bounds.rag_bound(F.col("loss"), F.when(F.col("n") > 0, F.col("n")), F.col("dist")), "h": bounds.estimate_cheeger(F.col("e"), F.col("v"))})
    x = x.withColumn("spec", F.when(F.col("e") > 0, bounds.spectral_bound(F.col("e"), F.col("h"))))
    return x.select("id", r6("rag").alias("rag"), r6("h").alias("cheeger"), r6("spec").alias("spectral"), r6(bounds.composite_bound(F.col("rag"), F.col("spec"))).alias("composite"))


# N: maintenance.
_S2 = "CASE WHEN abs(weight) <= 1e-6 THEN 0.0016 ELSE greatest(1e-6, 0.0016 / greatest(0.1, 0.5 + 0.5 * least(1.0, abs(gamma_anti) / (abs(weight) + 1e-6)))) END"


@query("N03_bmrs_log_ratio", f"WITH {_EDGES}, v AS (SELECT *, {_S2} AS s2 FROM edges) SELECT src, dst, round(s2, 9) AS s2, round(0.5 * ln(1 / s2) - 0.5 * weight * weight * (1 - s2) / s2, 6) AS log_ratio FROM v")
def _(spark, d):
    s2 = bounds.cosine_edge_variance(F.col("weight"), F.col("gamma_anti"))
    return edges(spark, d).select("src", "dst", F.round(s2, 9).alias("s2"), r6(bounds.bmrs_log_ratio(F.col("weight"), s2)).alias("log_ratio"))


@query("N07_prune", f"WITH {_FORMAN}, v AS (SELECT *, {_S2} AS s2 FROM forman) SELECT src, dst, kappa >= -0.7 AND 0.5 * ln(1 / s2) - 0.5 * weight * weight * (1 - s2) / s2 > 0 AS pruned FROM v")
def _(spark, d):
    return graph.prune(edges(spark, d)).select("src", "dst", "pruned")


def _mean_field_sql(rounds: int = 3) -> str:
    parts, last = [], "(SELECT *, weight AS r FROM edges)"
    for k in range(rounds):
        parts.append(f"e{k} AS (SELECT * FROM {last}), s{k} AS (SELECT n, edge_type, sum(r) AS s, count(*) AS c FROM (SELECT src AS n, edge_type, r FROM e{k} UNION ALL SELECT dst, edge_type, r FROM e{k}) GROUP BY 1, 2), f{k} AS (SELECT e.src, e.dst, e.edge_type, e.weight, (0.7 * r + 0.3 * CASE WHEN x.c + y.c > 2 THEN (x.s + y.s - 2 * r) / (x.c + y.c - 2) ELSE 0 END + weight) / 2 AS r FROM e{k} e JOIN s{k} x ON x.n = e.src AND x.edge_type = e.edge_type JOIN s{k} y ON y.n = e.dst AND y.edge_type = e.edge_type)")
        last = f"f{k}"
    return f"WITH {_EDGES}, {', '.join(parts)} SELECT src, dst, edge_type, round(r, 6) AS refined FROM {last}"


@query("N08_mean_field", _mean_field_sql())
def _(spark, d):
    return graph.mean_field(edges(spark, d), rounds=3).select("src", "dst", "edge_type", r6("refined").alias("refined"))


@query("N09_motifs", f"WITH {_EDGES} SELECT x.edge_type || ' → ' || y.edge_type AS pattern, count(*) AS cnt FROM edges x JOIN edges y ON x.dst = y.src WHERE x.weight > 0 AND y.weight > 0 AND x.src <> y.dst GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return graph.motifs(edges(spark, d))


@query("N10_reasoning_divergence", f"WITH {_NODES}, o AS (SELECT label, id, s, lead(s) OVER (PARTITION BY label ORDER BY id) AS nxt FROM nodes) SELECT label, round(avg(1 - list_cosine_similarity(s, nxt)), 6) AS divergence FROM o WHERE nxt IS NOT NULL GROUP BY 1")
def _(spark, d):
    after = F.lead("s").over(Window.partitionBy("label").orderBy("id"))
    return nodes(spark, d).withColumn("next", after).where("next IS NOT NULL").groupBy("label").agg(r6(F.avg(1 - vec.cosine(F.col("s"), F.col("next")))).alias("divergence"))


@query("N13_uplift_rarity", f"WITH {_EDGES}, t AS (SELECT count(*) AS total FROM nodes), v AS (SELECT label, count(*) AS v FROM nodes GROUP BY 1), e AS (SELECT x.label, count(*) AS e FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst WHERE x.label = y.label GROUP BY 1) SELECT v.label, round(coalesce(e, 0)::DOUBLE / v - 0.05 * ln(1 + v), 6) AS uplift, round(1 / (1 + v / sqrt(total)), 6) AS rarity FROM v LEFT JOIN e ON e.label = v.label, t")
def _(spark, d):
    n = nodes(spark, d).select("id", "label")
    inner = edges(spark, d).join(n.select(F.col("id").alias("src"), "label"), "src").join(n.select(F.col("id").alias("dst"), F.col("label").alias("l2")), "dst").where("label = l2").groupBy("label").agg(F.count("*").alias("e"))
    rows = n.groupBy("label").agg(F.count("*").alias("v")).join(inner, "label", "left").join(F.broadcast(n.agg(F.count("*").alias("total"))))
    return rows.select("label", r6(F.coalesce("e", F.lit(0)) / F.col("v") - 0.05 * F.log(1 + F.col("v"))).alias("uplift"), r6(1 / (1 + F.col("v") / F.sqrt("total"))).alias("rarity"))


# P: event windows.
@query("P08_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
