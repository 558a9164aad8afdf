"""Queries of the near-duplicate and repeated-passage operators."""

from pyspark.sql import functions as F

from . import lines, neardup, passages, repeats
from .registry import query, table

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hit FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hit >= 80 * (x.n + y.n - hit)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


@query("op6_minhash_near_dedup", OP6)
def op6(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) AS a, md5(substr(x, 2 * i + 1, 200)) AS b
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) > 1),
edges AS (
  SELECT doc_id, i, i + 100 AS e, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM later),
marked AS (
  SELECT *, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM edges),
spans AS (SELECT doc_id, span, min(i) AS lo, max(e) AS hi FROM marked GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS start FROM spans),
cut AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, max(hi) AS tail,
         string_agg(substr(x, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query("op9_repeated_bytes", OP9)
def op9(spark, folder):
    return repeats.without_repeats(table(spark, folder, "documents"))


@query("op1_line_dedup")
def op1(spark, folder):
    docs = lines.without_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.char_length("text").cast("long").alias("kept_chars"),
                       F.sha2("text", 256).alias("kept_sha256"))


@query("op5_paragraph_dedup")
def op5(spark, folder):
    return passages.without_passages(table(spark, folder, "documents")).drop("kept_text")
