"""Query of the WARC sink and source."""

from . import warc
from .registry import query, table

_LETTERS = " || ".join(
    f"substr('{warc.ALPHABET}', CAST((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31 AS BIGINT) + 1, 1)"
    for g in range(8) for s in (15, 10, 5, 0))

OP2 = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""


@query("op2_warc", OP2)
def op2(spark, folder):
    return warc.round_trip(table(spark, folder, "pages")).drop("target_uri")
