"""op4: writes every page as a WARC record and reads the archives back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import table
from meridian.llm.warc import archive_root, read_archives, write_archives

NAME = "op4_warc"

SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM m
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), archive_root(spark))
    # a gap in an archive written a moment ago is an error, not a row less
    found = read_archives(manifest, payloads=False).where("assert_true(gap_start IS NULL, 'an archive is damaged') IS NULL")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
