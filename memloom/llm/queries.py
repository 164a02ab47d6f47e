"""The queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import bpe, decontam, html, jaccard, langid, licences, secrets, substrings, tiff, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def vocabulary() -> dict[str, str]:
    """Path and pattern of the public vocabulary."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


QUERIES = {
    "op1_license_scan": lambda spark, d: licences.report(_documents(spark, d)),
    "op2_html_extraction": lambda spark, d: html.main_text(_pages(spark, d)),
    "op3_warc_round_trip": lambda spark, d: warc.round_trip(_pages(spark, d)),
    "op4_language_id": lambda spark, d: langid.report(_documents(spark, d)),
    "op5_decontamination": lambda spark, d: decontam.report(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op6_tiff_media": lambda spark, d: tiff.stored(_documents(spark, d)),
    "op7_secret_scan": lambda spark, d: secrets.report(_documents(spark, d)),
    "op8_substring_dedup": lambda spark, d: substrings.report(_documents(spark, d)),
    "op9_byte_bpe": lambda spark, d: bpe.report(_documents(spark, d), **vocabulary()),
    "op10_jaccard_join": lambda spark, d: jaccard.report(_documents(spark, d)),
}

_FORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FORM_WORDS = rf"regexp_extract_all({_FORM}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), s AS (
  SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha1(body)) AS top FROM p
), digits AS (
  SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(h, i, 1)) - 1) AS v FROM s
), groups AS (
  SELECT *, list_transform(range(0, 8), lambda g: v[5*g+1] * 65536 + v[5*g+2] * 4096 + v[5*g+3] * 256 + v[5*g+4] * 16 + v[5*g+5]) AS w FROM digits
)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(w, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM groups
"""

_OP5 = f"""
WITH item AS (
  SELECT item_id, {_FORM_WORDS} AS w FROM benchmark
), window_ AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[k:k+7], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, {_FORM_WORDS} AS w FROM documents
), size_ AS (
  SELECT DISTINCT n FROM window_
), place AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, size_ WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.k, p.n, x.item_id FROM (SELECT doc_id, n, k, array_to_string(w[k:k+n-1], ' ') AS g FROM place) p JOIN window_ x ON x.n = p.n AND x.g = p.g
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP8 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), place AS (
  SELECT doc_id, k, md5(array_to_string(w[k:k+19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM doc WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM place) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(k, k + 20)) AS j FROM later)
), word AS (
  SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM doc
), kept AS (
  SELECT word.doc_id, count(gone.j) AS n_removed, string_agg(CASE WHEN gone.j IS NULL THEN t END, ' ' ORDER BY word.j) AS s
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j GROUP BY 1
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

_OP10 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, {_FORM_WORDS} AS w FROM documents
), gram AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[k:k+4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM doc WHERE len(w) > 0)
), size_ AS (
  SELECT doc_id, count(*) AS n FROM gram GROUP BY 1
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM both_ JOIN size_ x ON x.doc_id = a JOIN size_ y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT b, root FROM reach JOIN link ON a = node
)
SELECT d.doc_id, d.class_id, coalesce(n, 0)::BIGINT AS n_links
FROM (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY 1) d LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY 1) l USING (doc_id)
"""

ORACLE_SQL = {"op3_warc_round_trip": _OP3, "op5_decontamination": _OP5, "op8_substring_dedup": _OP8, "op10_jaccard_join": _OP10}
