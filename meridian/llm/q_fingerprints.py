"""op8: fingerprints every document and its edited text, and how alike they and the next document's are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import table
from meridian.llm.fingerprints import WIDTH, fingerprint_edits

NAME = "op8_fingerprints"

_ENTRY = "k * 65536 + ((k % 65521) * (k % 32749)) % 65536"


def _set(text: str) -> str:
    """The distinct digest entries of a text, as a DuckDB list."""
    units = rf"list_filter(string_split(regexp_replace({text}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda u: u <> '')"
    return f"list_distinct(list_transform(list_transform({units}, lambda u: ('0x' || substr(md5(u), 1, 11))::BIGINT), lambda k: {_ENTRY}))"


def _sketch(units: str) -> str:
    at = f"(e >> (16 + 10 * (c // {WIDTH})::INT)) % 1024 % {WIDTH} = c % {WIDTH}"
    return f"array_to_string(list_transform(range({3 * WIDTH}), lambda c: format('{{:06X}}', len(list_filter({units}, lambda e: {at}))) || format('{{:015X}}', coalesce(list_reduce(list_filter({units}, lambda e: {at}), lambda a, e: xor(a, e), 0::BIGINT), 0))), '')"


def _near(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), x AS (
  SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx FROM d
), y AS (
  SELECT doc_id, n, t, nx, substr(t, 1, n - n // 2) || substr(nx, 1, n // 2) AS edited FROM x
), u AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, {_set('t')} AS ut, {_set('edited')} AS ue, {_set('nx')} AS un FROM y
)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, {_sketch('ut')} AS fingerprint, {_sketch('ue')} AS edited_fingerprint, {_near('ut', 'ue')} AS near_edited, {_near('ut', 'un')} AS near_next
FROM u
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
