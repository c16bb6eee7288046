"""Metrics over deterministic scores: discounts against returns, priorities against status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import metrics
from meridian.plans.registry import register, table

_POINTS = """
c AS (SELECT l_discount AS score, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1),
k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_tax", "l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.05).cast("int").alias("p"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("metric_auc_ap_brier", f"""
WITH {_POINTS} SELECT round(sum(neg * (tp - pos) + neg * pos / 2.0::DOUBLE) / (sum(pos) * sum(neg)), 6)::DOUBLE AS auc, round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 6) AS average_precision,
  (SELECT round(avg(pow(l_discount - (l_returnflag = 'R')::INT, 2)), 6) FROM lineitem) AS brier FROM k
""")
def metric_auc_ap_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    # two tables of one row
    out = metrics.ranking(rows, F.col("score"), F.col("y")).crossJoin(metrics.brier(rows, F.col("score"), F.col("y")))
    return _rounded(out, "auc", "average_precision", "brier")


@register("metric_pr_f1_at_threshold", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag = 'R' AND l_discount >= 0.05) AS tp, count(*) FILTER (l_returnflag <> 'R' AND l_discount >= 0.05) AS fp FROM lineitem)
SELECT n, round(pos / n, 6) AS prevalence, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (tp + fp + pos), 6) AS f1, round(1 - tp / pos, 6) AS miss_rate FROM c
""")
def metric_pr_f1_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.at_threshold(_lines(spark, sf_dir), F.col("p"), F.col("y")), "prevalence", "precision", "recall", "f1", "miss_rate")


@register("metric_topk", """
WITH r AS (SELECT (o_orderstatus = 'F')::INT AS y, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n, sum((o_orderstatus = 'F')::INT) OVER () AS pos FROM orders)
SELECT share::DOUBLE AS share, count(*) AS k, round(avg(y), 6) AS precision, round(sum(y) / any_value(pos)::DOUBLE, 6) AS recall FROM r, (VALUES (0.1), (0.2)) v(share) WHERE rank <= greatest(floor(n * share), 1) GROUP BY share
""")
def metric_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.at_top(table(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_orderstatus") == "F", "o_orderkey", [0.1, 0.2])
    return _rounded(out, "precision", "recall")


@register("roc_pr_points", f"WITH {_POINTS} SELECT score, round(tp / sum(pos) OVER ()::DOUBLE, 6) AS recall, round(fp / sum(neg) OVER ()::DOUBLE, 6) AS fall_out, round(tp / (tp + fp)::DOUBLE, 6) AS precision FROM k")
def roc_pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.curve(_lines(spark, sf_dir), F.col("score"), F.col("y")), "recall", "fall_out", "precision")


@register("calibration_bins", "SELECT least(floor(l_discount * 10 * 8), 7)::BIGINT AS bin, count(*) AS n, round(avg(l_discount * 10), 6) AS mean_score, round(avg((l_returnflag = 'R')::INT), 6) AS observed FROM lineitem GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration(_lines(spark, sf_dir), F.col("score") * 10, F.col("y")), "mean_score", "observed")


_CLASS = "CASE WHEN l_quantity > 33 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END"


@register("confusion_matrix", f"SELECT l_returnflag AS actual, " + ", ".join(f"count(*) FILTER (p = '{c}') AS {c}" for c in "ANR") + f" FROM (SELECT l_returnflag, {_CLASS} AS p FROM lineitem) GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_lines(spark, sf_dir).withColumn("guess", F.expr(_CLASS)), "l_returnflag", "guess", ["A", "N", "R"])


@register("macro_f1", f"""
WITH r AS (SELECT l_returnflag AS a, {_CLASS} AS p FROM lineitem), k AS (SELECT a AS c FROM r UNION SELECT p FROM r),
f AS (SELECT c, 2 * count(*) FILTER (a = c AND p = c) / (count(*) FILTER (a = c) + count(*) FILTER (p = c)) AS f1 FROM k, r GROUP BY c)
SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1 FROM f
""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.macro_f1(_lines(spark, sf_dir).withColumn("guess", F.expr(_CLASS)), "l_returnflag", "guess"), "macro_f1")


@register("subgroup_fairness", """
WITH r AS (SELECT o.*, c.c_mktsegment, n.n_name, (o_orderstatus = 'F')::INT AS y, (o_totalprice > 150000)::INT AS p FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey),
g AS (
  SELECT CASE WHEN GROUPING(c_mktsegment) = 0 THEN 'c_mktsegment' WHEN GROUPING(n_name) = 0 THEN 'n_name' ELSE 'o_orderpriority' END AS attribute, coalesce(c_mktsegment, n_name, o_orderpriority) AS value,
    count(*) AS n, sum(y) AS pos, sum(y * p) AS tp, sum((1 - y) * p) AS fp
  FROM r GROUP BY GROUPING SETS ((c_mktsegment), (n_name), (o_orderpriority)) HAVING count(*) >= 30 AND count(DISTINCT y) = 2
)
SELECT attribute, value, n, round(pos / n::DOUBLE, 6) AS prevalence, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(tp / pos::DOUBLE, 6) AS recall, round(2 * tp / (tp + fp + pos)::DOUBLE, 6) AS f1, round(1 - tp / pos::DOUBLE, 6) AS miss_rate FROM g
""")
def subgroup_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = metrics.subgroups(rows, ["c_mktsegment", "n_name", "o_orderpriority"], F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F")
    return _rounded(out, "prevalence", "precision", "recall", "f1", "miss_rate")
