"""op2: near-duplicate components of all embeddings at a cosine of 0.95."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import table
from meridian.llm.pq import near_vectors

NAME = "op2_embedding_near_dedup"

SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT e.b, r.reach FROM r JOIN e ON r.node = e.a
), c AS (
  SELECT node, min(reach) AS component_id FROM r GROUP BY node
)
SELECT c.node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = c.node AS kept
FROM c LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = c.node
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
