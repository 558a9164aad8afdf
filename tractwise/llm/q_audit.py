"""Queries of the filter audit, subword tokens and importance resampling."""

from . import interaction, resampling, subwords
from .registry import query, table

_WORDS = r"[^\x20\x09-\x0D]+"

OP11 = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
bits AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN base.doc_id > min(base.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM base LEFT JOIN said ON base.doc_id = said.doc_id),
per AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM bits GROUP BY part, mask),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || l FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(l) WHERE length(o) < 5 AND position(l IN o) = 0),
steps AS (
  SELECT o, CAST(k AS INTEGER) AS step, o[k] AS letter, CAST(1 << (ascii(o[k]) - 65) AS INTEGER) AS bit,
         list_sum([CAST(1 << (ascii(o[j]) - 65) AS INTEGER) FOR j IN range(1, k)]) AS before
  FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
counted AS (
  SELECT part, o AS filter_order, step, letter,
         sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & coalesce(before, 0) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS toxic_lost
  FROM per, steps GROUP BY part, o, step, letter, bit, before)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""


@query("op11_filter_audit", OP11)
def op11(spark, folder):
    return interaction.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_subword_tokens")
def op12(spark, folder):
    import public_tokenizers
    return subwords.digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _crc_table():
    """The 256 values of the reflected polynomial, by its rule."""
    out = []
    for v in range(256):
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


_SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = rf"""
WITH crc AS (SELECT {_crc_table()}::BIGINT[] AS c),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPLIT}') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPLIT}')) AS f FROM benchmark),
g AS (SELECT r, unnest(w) AS f FROM d),
spelled AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM (SELECT f FROM g UNION ALL SELECT f FROM b))),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, length(h) // 2)]),
                lambda a, x: xor(a >> 8, c[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS k FROM spelled, crc),
sk AS (SELECT k, count(*) AS s FROM g JOIN hashed USING (f) GROUP BY k),
tk AS (SELECT k, count(*) AS t FROM b JOIN hashed USING (f) GROUP BY k),
tot AS (SELECT (SELECT count(*) FROM g)::DOUBLE + 10000 AS ss, (SELECT count(*) FROM b)::DOUBLE + 10000 AS tt),
gain AS (SELECT k, CAST(floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * ss) / ((coalesce(s, 0)::DOUBLE + 1) * tt))) AS BIGINT) AS v
         FROM sk FULL JOIN tk USING (k), tot),
weighed AS (SELECT r, count(*) AS n_features, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS weight
            FROM g JOIN hashed USING (f) JOIN gain USING (k) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS FIRST, n_features DESC, weight DESC) AS place, count(*) FILTER (may) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


@query("op13_importance_resampling", OP13)
def op13(spark, folder):
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), n=1)
