"""Profiles, cross tables, bins, extensions (grouping sets, set operations, sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import profile
from meridian.plans.registry import register, table


@register("profile_numeric", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS distinct, min({c})::DOUBLE AS least, max({c})::DOUBLE AS largest, round(avg({c}), 6) AS mean FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_profile(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"]).withColumn("mean", F.round("mean", 6))


@register("profile_top_values", "SELECT * FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM orders GROUP BY ALL" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")) + ")) WHERE rank <= 12")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@register("value_share", "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM orders GROUP BY o_orderpriority")
def value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shares(table(spark, sf_dir, "orders"), ["o_orderpriority"]).withColumn("share", F.round("share", 6))


@register("crosstab_priority_status", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{v}') AS {v}" for v in "FOP") + " FROM orders GROUP BY o_orderpriority")
def crosstab_priority_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.crosstab(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@register("crosstab_four_way", "SELECT l_returnflag, l_linestatus, l_discount > 0.05 AS discounted, " + ", ".join(f"count(*) FILTER (l_linenumber = {v}) AS n_{v}" for v in range(1, 8)) + " FROM lineitem GROUP BY ALL")
def crosstab_four_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"discounted": F.col("l_discount") > 0.05, "line": F.concat(F.lit("n_"), F.col("l_linenumber"))})
    return profile.crosstab(rows, ["l_returnflag", "l_linestatus", "discounted"], "line", [f"n_{v}" for v in range(1, 8)])


@register("weekly_counts_by_cohort", """
SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) FILTER (o_orderdate < TIMESTAMP '1999-01-01') AS development, count(*) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS evaluation
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1
""")
def weekly_counts_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    rows = rows.withColumns({"week": F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd"), "cohort": F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "development").otherwise("evaluation")})
    return profile.crosstab(rows, ["week"], "cohort", ["development", "evaluation"])


@register("binned_rate_ci", """
WITH b AS (SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '(0, 10]' WHEN l_quantity > 10 AND l_quantity <= 20 THEN '(10, 20]' WHEN l_quantity > 20 AND l_quantity <= 35 THEN '(20, 35]' WHEN l_quantity > 35 AND l_quantity <= 45 THEN '(35, 45]' END AS bin, (l_returnflag = 'R')::INT AS y FROM lineitem)
SELECT bin, round(avg(y), 6) AS rate, count(*) AS n, round(1.96 * sqrt(avg(y) * (1 - avg(y)) / count(*)), 6) AS half_width FROM b WHERE bin IS NOT NULL GROUP BY bin
""")
def binned_rate_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("bin", profile.interval(F.col("l_quantity"), [0, 10, 20, 35, 45])).where("bin IS NOT NULL")
    out = profile.rate_with_interval(rows, "bin", F.col("l_returnflag") == "R")
    return out.select("bin", F.round("rate", 6).alias("rate"), "n", F.round("half_width", 6).alias("half_width"))


@register("grouped_multi_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS price, min(l_quantity) AS least, max(l_quantity) AS largest, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY ALL")
def grouped_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate BETWEEN TIMESTAMP_NTZ '1996-01-01' AND TIMESTAMP_NTZ '1999-12-31'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("largest"), F.round(F.avg("l_discount"), 6).alias("discount"))


@register("ext_cube_orders", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def ext_cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("ext_intersect_except", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def ext_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, buyers = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey")
    both, only = customers.intersect(buyers), customers.subtract(buyers)
    return both.agg(F.lit("both").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(only.agg(F.lit("customers only").alias("kind"), F.count(F.lit(1)).alias("n")))


@register("ext_session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k
""")
def ext_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = rows.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@register("ext_streaming_replay", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def ext_streaming_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.streaming.replay import replay_counts

    return replay_counts(spark, f"{sf_dir}/events.parquet")
