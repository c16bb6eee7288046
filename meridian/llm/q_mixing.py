"""op7: mixes all documents to target words per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import table
from meridian.llm.mixing import mix

NAME = "op7_mixing"

SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(source_size * 2.0::DOUBLE) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target FROM l
), r AS (
  SELECT source, source_size, target, floor(least(target / source_size, 2.0::DOUBLE)) AS whole, least(target / source_size, 2.0::DOUBLE) - floor(least(target / source_size, 2.0::DOUBLE)) AS p
  FROM t WHERE source_size > 0 UNION ALL SELECT source, source_size, target, 0, 0 FROM t WHERE source_size = 0
), q AS (
  SELECT d.doc_id, d.size, r.*, (('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), k AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS rank FROM q
), h AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS half FROM k
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN p > 0 AND half <= p * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM h
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
