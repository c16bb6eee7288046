"""Stages, gates, priorities, tiers, reasons and per-site queues over orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import queue
from meridian.operators.ranks import quantile
from meridian.plans.registry import register, table

_STAGE = "CASE o_orderstatus WHEN 'F' THEN 'Medicine' WHEN 'O' THEN 'Test' ELSE 'Review' END"
_RISK = "o_totalprice / 600000"
_DIM = [("Medicine", 1.0, 0.9, "Deliver"), ("Test", 0.8, 0.7, "Arrange test"), ("Review", 0.5, 0.8, "Call")]
_PRI = f"""
p AS (
  SELECT o.*, {_RISK} AS risk, {_STAGE} AS stage, d.action, 0.60::DOUBLE * ({_RISK}) + 0.25::DOUBLE * urgency + 0.10::DOUBLE * urgency + 0.05::DOUBLE * feasibility AS priority
  FROM orders o LEFT JOIN (VALUES {', '.join(f"('{s}', {u}::DOUBLE, {f}::DOUBLE, '{a}')" for s, u, f, a in _DIM)}) d(stage, urgency, feasibility, action) ON d.stage = {_STAGE}
), r AS (
  SELECT priority AS s, row_number() OVER (ORDER BY priority DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM p WHERE o_orderdate < TIMESTAMP '1999-01-01'
), cut AS (
  SELECT max(s) FILTER (rank = greatest(floor(n * 0.15), 1)) AS c1, max(s) FILTER (rank = greatest(floor(n * 0.30), 1)) AS c2, max(s) FILTER (rank = greatest(floor(n * 0.50), 1)) AS c3 FROM r
), t AS (
  SELECT p.*, CASE WHEN priority >= c1 THEN 'P1' WHEN priority >= c2 THEN 'P2' WHEN priority >= c3 THEN 'P3' ELSE 'P4' END AS tier FROM p, cut WHERE o_orderdate >= TIMESTAMP '1999-01-01'
)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with risk, stage, its action and its tier; cut-offs come from orders before 1999."""
    stages = spark.createDataFrame(_DIM, "stage string, urgency double, feasibility double, action string")
    rows = table(spark, sf_dir, "orders").withColumns({"risk": F.expr(_RISK), "stage": F.expr(_STAGE)}).join(stages, "stage", "left")
    rows = rows.withColumn("priority", queue.priority(F.col("risk"), F.col("urgency"), F.col("feasibility")))
    early = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    return queue.tiers(rows.where(~early), "priority", queue.cut_offs(rows.where(early), "priority"))


@register("priority_score_tiers", f"WITH {_PRI} SELECT o_orderkey, stage, action, round(priority, 6) AS priority, tier FROM t")
def priority_score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("o_orderkey", "stage", "action", F.round("priority", 6).alias("priority"), "tier")


@register("masked_argmax_stage", """
WITH x AS (SELECT l_linestatus, l_returnflag, l_quantity / 50 AS a, l_tax * 10 AS b, l_discount * 10 AS c, l_linestatus = 'O' AS ma, l_returnflag = 'R' AS mb, l_returnflag = 'A' AS mc FROM lineitem),
y AS (SELECT *, greatest(CASE WHEN ma THEN a ELSE -1 END, CASE WHEN mb THEN b ELSE -1 END, CASE WHEN mc THEN c ELSE -1 END) AS best FROM x)
SELECT l_linestatus, l_returnflag, CASE WHEN best < 0 THEN 'Completed' WHEN ma AND a = best THEN 'Medicine' WHEN mb AND b = best THEN 'Test' ELSE 'Review' END AS stage, count(*) AS n FROM y GROUP BY ALL
""")
def masked_argmax_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    probabilities = F.array(F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_discount") * 10)
    allowed = F.array(F.col("l_linestatus") == "O", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")
    stage = queue.masked_argmax(probabilities, allowed, ["Medicine", "Test", "Review"], "Completed")
    return rows.groupBy("l_linestatus", "l_returnflag", stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@register("median_gate", f"SELECT o_orderkey, CASE WHEN o_totalprice >= (SELECT median(o_totalprice) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') THEN {_STAGE} ELSE 'Completed' END AS stage FROM orders")
def median_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    early = orders.where("o_orderdate < TIMESTAMP_NTZ '1999-01-01'")
    return queue.median_gate(orders, "o_totalprice", early, F.expr(_STAGE), "Completed").select("o_orderkey", "stage")


@register("reasons_first3", """
WITH r AS (
  SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.75) FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') THEN 'large order' END, CASE WHEN c_acctbal < 0 THEN 'in debt' END,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'priority ' || o_orderpriority END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END], lambda x: x IS NOT NULL) AS f
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)
SELECT o_orderkey, CASE WHEN len(f) = 0 THEN 'General follow-up' ELSE array_to_string(f[1:3], '; ') END AS reason FROM r
""")
def reasons_first3(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    large = quantile(orders.where("o_orderdate < TIMESTAMP_NTZ '1999-01-01'"), "o_totalprice", 0.75, "large")
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").crossJoin(F.broadcast(large))
    rules = [(F.col("o_totalprice") > F.col("large"), F.lit("large order")), (F.col("c_acctbal") < 0, F.lit("in debt")), (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("priority "), "o_orderpriority")), (F.col("c_mktsegment") == "BUILDING", F.lit("building")), (F.col("o_orderstatus") == "P", F.lit("partial"))]
    return rows.select("o_orderkey", queue.reasons(rules).alias("reason"))


_SITE = "site AS (SELECT l_orderkey, min(l_suppkey) AS site FROM lineitem GROUP BY l_orderkey)"
_QUEUE = f"""
WITH {_PRI}, {_SITE}, q AS (
  SELECT t.*, site, row_number() OVER (PARTITION BY site ORDER BY priority DESC, o_orderkey) AS rank FROM t LEFT JOIN site ON o_orderkey = l_orderkey WHERE tier <> 'P4'
)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("site"))
    rows = _scored(spark, sf_dir).where("tier <> 'P4'").join(sites, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return queue.with_capacity(rows, "site", "priority", "o_orderkey")


@register("capacity_overflow_queue", _QUEUE + " SELECT o_orderkey, site, rank, CASE WHEN rank > 10 THEN 'P4_OVERFLOW' ELSE tier END AS priority_label, CASE WHEN rank > 10 THEN 'TELECALL_OVERFLOW' WHEN stage = 'Medicine' THEN 'ASHA' ELSE 'CHO' END AS assigned, '/feedback?order=' || o_orderkey || '&site=' || coalesce(site::VARCHAR, '') AS link FROM q")
def capacity_overflow_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _queue(spark, sf_dir)
    return rows.select("o_orderkey", "site", "rank", F.when(F.col("overflow"), "P4_OVERFLOW").otherwise(F.col("tier")).alias("priority_label"), F.when(F.col("overflow"), "TELECALL_OVERFLOW").when(F.col("stage") == "Medicine", "ASHA").otherwise("CHO").alias("assigned"), F.concat(F.lit("/feedback?order="), F.col("o_orderkey").cast("string"), F.lit("&site="), F.coalesce(F.col("site").cast("string"), F.lit(""))).alias("link"))


@register("queue_validation_report", _QUEUE + " SELECT count(*) AS n, count(*) = count(DISTINCT o_orderkey) AS unique_ids, bool_and(risk BETWEEN 0 AND 1) AS risk_in_range, bool_and(stage IN ('Medicine', 'Test', 'Review')) AS stages_known, round(avg((tier = 'P1')::INT), 3) AS p1, round(avg((tier = 'P2')::INT), 3) AS p2, round(avg((tier = 'P3')::INT), 3) AS p3, max(rank) FILTER (rank <= 10) <= 10 AS within_capacity FROM q")
def queue_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = {f"p{i}": F.round(F.avg((F.col("tier") == f"P{i}").cast("double")), 3).alias(f"p{i}") for i in (1, 2, 3)}
    return _queue(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.countDistinct("o_orderkey")).alias("unique_ids"), F.bool_and(F.col("risk").between(0, 1)).alias("risk_in_range"), F.bool_and(F.col("stage").isin("Medicine", "Test", "Review")).alias("stages_known"), *share.values(), (F.max(F.when(~F.col("overflow"), F.col("rank"))) <= 10).alias("within_capacity"))


@register("system_barrier_flag", f"WITH {_SITE}, s AS (SELECT l_suppkey, avg((l_returnflag = 'R')::INT) AS rate FROM lineitem GROUP BY 1) SELECT o_orderkey, ({_STAGE} = 'Medicine' AND coalesce(rate, 0) >= 0.33)::INT::BIGINT AS barrier FROM orders LEFT JOIN site ON o_orderkey = l_orderkey LEFT JOIN s ON site = l_suppkey")
def system_barrier_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sites = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("site"))
    rates = lines.groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("rate"))
    rows = table(spark, sf_dir, "orders").join(sites, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(rates, F.col("site") == F.col("l_suppkey"), "left")
    return rows.select("o_orderkey", ((F.expr(_STAGE) == "Medicine") & (F.coalesce("rate", F.lit(0.0)) >= 0.33)).cast("long").alias("barrier"))


@register("top_contributions", """
WITH c AS (SELECT o_orderkey, unnest([{'name': 'price', 'v': o_totalprice / 100000 - 1.5}, {'name': 'customer', 'v': (o_custkey % 7) - 3.0::DOUBLE}, {'name': 'month', 'v': month(o_orderdate) / 6.0::DOUBLE - 1}, {'name': 'key', 'v': (o_orderkey % 5) - 2.0::DOUBLE}, {'name': 'weekday', 'v': isodow(o_orderdate) / 4.0::DOUBLE - 1}]) AS s FROM orders),
r AS (SELECT o_orderkey, s.name AS name, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(s.v) DESC, s.name) AS rn FROM c)
SELECT o_orderkey, string_agg(name, ',' ORDER BY rn) AS top FROM r WHERE rn <= 4 GROUP BY o_orderkey
""")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"price": F.col("o_totalprice") / 100000 - 1.5, "customer": (F.col("o_custkey") % 7).cast("double") - 3, "month": F.month("o_orderdate") / 6.0 - 1, "key": (F.col("o_orderkey") % 5).cast("double") - 2, "weekday": (F.weekday("o_orderdate") + 1) / 4.0 - 1}
    given = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in parts.items()])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(queue.top_contributions(given), ",").alias("top"))


@register("first_per_key", "WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_orderpriority || '/' || o_orderstatus AS key FROM orders) SELECT key, o_orderkey, o_totalprice FROM b WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("key"), "o_orderkey", "o_totalprice")
    return queue.first_per_key(rows, "key", "o_totalprice", "o_orderkey")
