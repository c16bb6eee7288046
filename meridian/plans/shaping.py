"""Spine checks, enrichment joins, derived columns and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import encode
from meridian.plans.registry import register, table


@register("spine_integrity", """
SELECT (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS orders_unique,
  (SELECT count(*) FROM orders WHERE o_orderkey IS NULL OR o_orderdate IS NULL) AS null_keys,
  (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)) AS orphan_customers,
  (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)) AS orphan_lines,
  (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) AS repeated_lines
""")
def spine_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customer = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    spine = orders.agg((F.count(F.lit(1)) == F.countDistinct("o_orderkey")).alias("orders_unique"), F.count_if(F.col("o_orderkey").isNull() | F.col("o_orderdate").isNull()).alias("null_keys"))
    lost = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphan_customers"))
    stray = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphan_lines"))
    repeated = lines.groupBy("l_orderkey", "l_linenumber").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_lines"))
    # four tables of one row
    return spine.crossJoin(lost).crossJoin(stray).crossJoin(repeated)


@register("dim_enrichment_broadcast", """
SELECT c_custkey, n_name AS nation, r_name AS region, c_mktsegment AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def dim_enrichment_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    # Spark sends the two dimensions round as long as their size is below its threshold
    out = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))


@register("left_enrich_with_defaults", """
SELECT doc_id, lang, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, 0)::BIGINT AS toxic, l.doc_id IS NOT NULL AS labelled, CASE WHEN l.doc_id IS NULL THEN 'none' ELSE 'high' END AS confidence
FROM documents LEFT JOIN labels l USING (doc_id)
""")
def left_enrich_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    out = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return out.select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("long").alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"), F.when(F.col("labelled"), "high").otherwise("none").alias("confidence"))


@register("left_label_join", """
SELECT o_orderkey, l.quality::BIGINT AS label, coalesce(CASE WHEN l.toxic = 1 THEN 'Toxic' WHEN l.toxic = 0 THEN 'Clean' END, 'Unknown') AS stage FROM orders LEFT JOIN labels l ON o_orderkey = l.doc_id
""")
def left_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    out = table(spark, sf_dir, "orders").select("o_orderkey").join(labels, F.col("o_orderkey") == F.col("doc_id"), "left")
    return out.select("o_orderkey", F.col("quality").cast("long").alias("label"), F.when(F.col("toxic") == 1, "Toxic").when(F.col("toxic") == 0, "Clean").otherwise("Unknown").alias("stage"))


@register("derived_flags", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate,
  (coalesce((l_returnflag = 'R')::INT, 0) + coalesce((l_linestatus = 'O')::INT, 0) + coalesce((l_discount > 0.05)::INT, 0))::BIGINT AS n_flags,
  (lower(p_type) <> 'none')::INT::BIGINT AS chronic, len(string_split(p_name, ' '))::BIGINT AS n_tokens,
  coalesce(l_quantity * (l_returnflag = 'R')::INT, 0) AS interaction,
  (l_returnflag = 'R')::INT::VARCHAR || (l_linestatus = 'O')::INT::VARCHAR || (l_discount > 0.05)::INT::VARCHAR AS pattern,
  TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS brand_number, TRY_CAST(p_name AS DOUBLE) AS not_a_number, TRY_CAST(p_name AS DATE) AS not_a_date
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def derived_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    flags = [encode.flag(F.col("l_returnflag"), "R"), encode.flag(F.col("l_linestatus"), "O"), F.coalesce((F.col("l_discount") > 0.05).cast("int"), F.lit(0))]
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", sum(flags[1:], flags[0]).cast("long").alias("n_flags"), (F.lower("p_type") != "none").cast("long").alias("chronic"), F.size(F.split("p_name", " ")).cast("long").alias("n_tokens"), F.coalesce(F.col("l_quantity") * flags[0], F.lit(0.0)).alias("interaction"), F.concat(*[f.cast("string") for f in flags]).alias("pattern"), encode.number(F.substring("p_brand", 7, 99)).alias("brand_number"), encode.number(F.col("p_name")).alias("not_a_number"), encode.day(F.col("p_name")).alias("not_a_date"))


@register("one_hot_align", """
WITH lv AS (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT o_orderkey, v AS level, CASE WHEN o_orderpriority = v THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM orders, lv WHERE o_orderdate >= TIMESTAMP '2001-01-01'
""")
def one_hot_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    levels = encode.levels(orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01'"), "o_orderpriority")
    coded = encode.one_hot(orders.where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'").select("o_orderkey", "o_orderpriority"), "o_orderpriority", levels)
    names = [f"o_orderpriority_{v}" for v in levels]
    return coded.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"`{n}`").alias("value")) for v, n in zip(levels, names, strict=True)])).alias("s")).select("o_orderkey", "s.level", "s.value")


@register("median_impute_standardise", """
WITH t AS (SELECT d.doc_id, l.quality::DOUBLE AS q, n_chars::DOUBLE AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT median(q) AS mq, median(n) AS mn FROM t),
i AS (SELECT doc_id, coalesce(q, mq) AS q, coalesce(n, mn) AS n FROM t, s)
SELECT doc_id, round((q - avg(q) OVER ()) / stddev_pop(q) OVER (), 6) AS quality, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS n_chars FROM i
""")
def median_impute_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    out = encode.standardise(encode.impute_median(rows, ["quality", "n_chars"]), ["quality", "n_chars"])
    return out.select("doc_id", F.round("quality", 6).alias("quality"), F.round("n_chars", 6).alias("n_chars"))


_LABELS = {("orders", "o_orderstatus"): ("label", "known only after the order ends")}
_NEVER = {("lineitem", "l_returnflag"): "outcome after the order", ("lineitem", "l_linestatus"): "outcome after the order"}
_AT_T = {("orders", "o_totalprice"), ("orders", "o_orderpriority"), ("lineitem", "l_quantity")}
_HISTORICAL, _STATIC, _ENCOUNTER = {"l_shipdate", "value", "c_acctbal"}, {"nation", "region"}, {"orders"}
_TABLES = ("customer", "events", "lineitem", "nation", "orders", "region")


def _text(*values: str) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


@register("column_verdicts", f"""
WITH c AS (SELECT DISTINCT table_name, column_name FROM information_schema.columns WHERE table_name IN ({_text(*_TABLES)})),
rules AS (
  SELECT * FROM (VALUES {", ".join(f"('{t}', '{c}', 1, '{v}', '{why}')" for (t, c), (v, why) in sorted(_LABELS.items()))}, {", ".join(f"('{t}', '{c}', 2, 'history only', '{why}')" for (t, c), why in sorted(_NEVER.items()))}, {", ".join(f"('{t}', '{c}', 3, 'available', 'recorded during the encounter')" for t, c in sorted(_AT_T))}) v(table_name, column_name, place, verdict, reason)
  UNION ALL SELECT table_name, column_name, 4, 'history only', 'dated on or before the predicted instant' FROM c WHERE column_name IN ({_text(*_HISTORICAL)})
  UNION ALL SELECT table_name, column_name, 5, 'available', 'static reference' FROM c WHERE table_name IN ({_text(*_STATIC)})
  UNION ALL SELECT table_name, column_name, 6, 'available', 'recorded at or before the instant' FROM c WHERE table_name IN ({_text(*_ENCOUNTER)})
  UNION ALL SELECT table_name, column_name, 7, 'conditional', 'only if strictly before the instant' FROM c
)
SELECT table_name, column_name, arg_min(verdict, place) AS verdict, arg_min(reason, place) AS reason FROM c JOIN rules USING (table_name, column_name) GROUP BY ALL
""")
def column_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(t, c) for t in _TABLES for c in table(spark, sf_dir, t).columns]
    return encode.verdicts(spark.createDataFrame(found, "table_name string, column_name string"), _LABELS, _NEVER, _AT_T, _HISTORICAL, _STATIC, _ENCOUNTER)


@register("condition_counts", """
WITH s AS (SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'None' WHEN p_partkey % 7 > 0 THEN replace(p_name, ' ', '+') END AS status FROM part)
SELECT p_partkey, CASE WHEN lower(status) = 'none' THEN 0 ELSE coalesce(len(string_split(status, '+')), 1) END::BIGINT AS conditions FROM s
""")
def condition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("p_retailprice") < 1000, "None").when(F.col("p_partkey") % 7 > 0, F.replace("p_name", F.lit(" "), F.lit("+")))
    return table(spark, sf_dir, "part").select("p_partkey", encode.condition_count(status).alias("conditions"))
