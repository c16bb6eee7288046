"""Point-in-time queries over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import asof
from meridian.plans.registry import register, table


@register("history_count_asof", """
SELECT a.o_orderkey, count(b.o_orderkey) AS n_prior, round(coalesce(sum(b.o_totalprice), 0), 2) AS total_prior,
  date_diff('day', max(b.o_orderdate)::DATE, any_value(a.o_orderdate)::DATE) AS days_since_last,
  (isodow(any_value(a.o_orderdate)) - 1)::BIGINT AS weekday, month(any_value(a.o_orderdate))::BIGINT AS month
FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY a.o_orderkey
""")
def history_count_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = asof.history(rows, "o_custkey", "o_orderdate", {"n_prior": F.count("o_orderkey"), "total": F.sum("o_totalprice"), "last": F.max("o_orderdate")})
    return rows.select("o_orderkey", "n_prior", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total_prior"), asof.days_between(F.col("o_orderdate"), F.col("last")).alias("days_since_last"), F.weekday("o_orderdate").cast("long").alias("weekday"), F.month("o_orderdate").cast("long").alias("month"))


@register("asof_latest_order", """
SELECT o_orderkey, prev_orderkey, prev_total, days_since FROM (
  SELECT a.o_orderkey, b.o_orderkey AS prev_orderkey, b.o_totalprice AS prev_total, date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE) AS days_since,
    row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC NULLS LAST, b.o_orderkey DESC) AS rn
  FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate
) WHERE rn = 1
""")
def asof_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    events = rows.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("prev_orderkey"), F.col("o_totalprice").alias("prev_total"))
    found = asof.latest(rows.drop("o_totalprice"), events, "o_custkey", "o_orderdate", ["prev_orderkey", "prev_total"])
    return found.select("o_orderkey", "latest.prev_orderkey", "latest.prev_total", asof.days_between(F.col("o_orderdate"), F.col("latest._at")).alias("days_since"))


_LEDGER = """
SELECT l_suppkey, l_partkey % 6 AS item, date_trunc('month', l_shipdate) AS month, sum(l_quantity) < 40 AS low, max(l_returnflag) = 'R' AS stockout FROM lineitem GROUP BY ALL
"""


def _latest_stock_sql(before: str) -> str:
    return f"""
WITH ledger AS ({_LEDGER}), spine AS (SELECT DISTINCT l_suppkey, month FROM ledger),
ranked AS (
  SELECT s.l_suppkey, s.month, g.low, g.stockout, row_number() OVER (PARTITION BY s.l_suppkey, s.month ORDER BY g.month DESC, g.item DESC) AS rn
  FROM spine s JOIN ledger g ON s.l_suppkey = g.l_suppkey AND g.month {before} s.month
)
SELECT l_suppkey, strftime(month, '%Y-%m') AS month, count(*) AS n, round(avg(low::INT), 6) AS low_share, round(avg(stockout::INT), 6) AS stockout_rate FROM ranked WHERE rn <= 6 GROUP BY l_suppkey, ranked.month
"""


def _latest_stock(spark: SparkSession, sf_dir: str, inclusive: bool) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    ledger = lines.groupBy("l_suppkey", (F.col("l_partkey") % 6).alias("item"), F.date_trunc("month", "l_shipdate").alias("month")).agg((F.sum("l_quantity") < 40).alias("low"), (F.max("l_returnflag") == "R").alias("stockout"))
    spine = ledger.select("l_suppkey", "month").distinct()
    last = asof.latest_k(spine, ledger, "l_suppkey", "month", ["item"], ["low", "stockout"], 6, inclusive)
    rates = last.groupBy("l_suppkey", "month").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(name) for c, name in (("low", "low_share"), ("stockout", "stockout_rate"))])
    return rates.withColumn("month", F.date_format("month", "yyyy-MM"))


@register("asof_latest_k_stock", _latest_stock_sql("<"))
def asof_latest_k_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_stock(spark, sf_dir, inclusive=False)


@register("asof_latest_k_stock_inclusive", _latest_stock_sql("<="))
def asof_latest_k_stock_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the instant's own month counts too."""
    return _latest_stock(spark, sf_dir, inclusive=True)


_BANDS = """
WITH ep AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
pr AS (SELECT e.event_id, e.ts AS t, p.event_id AS prior_id, p.ts AS d0, e.user_id FROM ep e JOIN ep p ON e.user_id = p.user_id AND p.ts < e.ts)
"""


def _priors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of a purchase and each earlier one of the same user, and all other events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    episodes = events.where("event_type = 'purchase'").drop("event_type")
    earlier = episodes.select(F.col("event_id").alias("prior_id"), F.col("user_id").alias("_user"), F.col("ts").alias("d0"))
    priors = episodes.withColumnRenamed("ts", "t").join(earlier, (F.col("user_id") == F.col("_user")) & (F.col("d0") < F.col("t"))).drop("_user")
    return priors, events.where("event_type <> 'purchase'").select("user_id", "ts", "event_type")


@register("band_followup_rate", _BANDS + """
, m AS (
  SELECT pr.event_id, prior_id, avg((v.event_type = 'click')::INT) AS share FROM pr
  JOIN events v ON v.user_id = pr.user_id AND v.event_type <> 'purchase' AND v.ts >= d0 - INTERVAL 1 DAY AND v.ts <= d0 + INTERVAL 3 DAY AND v.ts < t GROUP BY ALL
)
SELECT event_id, count(*) AS n_priors, round(avg(share), 6) AS rate FROM m GROUP BY event_id
""")
def band_followup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors, events = _priors(spark, sf_dir)
    near = asof.band(priors, events, "user_id", "d0", "ts", -1, 3).where("ts < t")
    per_prior = near.groupBy("event_id", "prior_id").agg(F.avg((F.col("event_type") == "click").cast("double")).alias("share"))
    return per_prior.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_priors"), F.round(F.avg("share"), 6).alias("rate"))


@register("band_followup_rate_zero", _BANDS + """
, m AS (
  SELECT pr.event_id, prior_id, max((v.user_id IS NOT NULL)::INT) AS hit FROM pr
  LEFT JOIN events v ON v.user_id = pr.user_id AND v.event_type = 'view' AND v.ts > d0 AND v.ts <= d0 + INTERVAL 1 DAY AND v.ts < t GROUP BY ALL
)
SELECT event_id, count(*) AS n_priors, round(avg(hit), 6) AS rate FROM m GROUP BY event_id
""")
def band_followup_rate_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    priors, events = _priors(spark, sf_dir)
    views = events.where("event_type = 'view'").drop("event_type")
    hits = asof.band(priors, views, "user_id", "d0", "ts", 0, 1, open_lower=True).where("ts < t").select("event_id", "prior_id").distinct().withColumn("hit", F.lit(1.0))
    joined = priors.select("event_id", "prior_id").join(hits, ["event_id", "prior_id"], "left")
    return joined.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_priors"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("rate"))


@register("history_conditional_counts", """
SELECT a.event_id, count(b.event_id) AS n_prior, count(b.event_id) FILTER (b.event_type = 'error') AS n_errors, count(b.event_id) FILTER (b.event_type ILIKE '%sign%') AS n_sign
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts GROUP BY a.event_id
""")
def history_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    wanted = {"n_prior": F.count("event_id"), "n_errors": F.count_if(F.col("event_type") == "error"), "n_sign": F.count_if(F.coalesce(F.lower("event_type").contains("sign"), F.lit(False)))}
    return asof.history(rows, "user_id", "ts", wanted).select("event_id", *wanted)


@register("last_event_recency_default", """
WITH r AS (
  SELECT a.event_id, a.ts, b.ts AS bts, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC NULLS LAST, b.event_id DESC) AS rn
  FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND b.ts < a.ts
)
SELECT event_id, date_diff('day', bts::DATE, ts::DATE) AS days_since_error, coalesce(value, 0) AS last_value, CASE WHEN bts IS NULL THEN 'No event' ELSE 'error' END AS status FROM r WHERE rn = 1
""")
def last_event_recency_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    spine = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"), "value")
    found = asof.latest(spine, errors, "user_id", "ts", ["error_id", "value"])
    return found.select("event_id", asof.days_between(F.col("ts"), F.col("latest._at")).alias("days_since_error"), F.coalesce("latest.value", F.lit(0.0)).alias("last_value"), F.when(F.col("latest").isNull(), "No event").otherwise("error").alias("status"))


@register("no_future_violation_count", "SELECT count(*) AS checked, count(*) FILTER (l_shipdate < o_orderdate) AS violations FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def no_future_violation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return asof.future_rows(orders, lines, F.col("o_orderkey") == F.col("l_orderkey"), "o_orderdate", "l_shipdate")


@register("monotone_history_probe", """
WITH h AS (
  SELECT a.o_orderkey, count(*) FILTER (b.o_orderdate < a.o_orderdate) AS now, count(*) FILTER (b.o_orderdate < a.o_orderdate + INTERVAL 45 DAY) AS later
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey GROUP BY a.o_orderkey
)
SELECT count(*) AS n, min(later - now) AS least_gain, sum(later - now)::BIGINT AS total_gain, min(later - now) >= 0 AS monotone FROM h
""")
def monotone_history_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("o_custkey").orderBy(asof.micros(F.col("o_orderdate")))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    gained = rows.select((F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, 45 * 86_400_000_000 - 1)) - F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, -1))).alias("gain"))
    return gained.agg(F.count(F.lit(1)).alias("n"), F.min("gain").alias("least_gain"), F.sum("gain").alias("total_gain"), (F.min("gain") >= 0).alias("monotone"))
