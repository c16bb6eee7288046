"""op5: components of documents whose 5-word shingle sets are alike by 0.8 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import table
from meridian.llm.jaccard import near_copies

NAME = "op5_ngram_jaccard_join"

SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS ss FROM d
), x AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM d
  UNION
  SELECT e.b, r.reach FROM r JOIN e ON r.node = e.a
)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
