"""Model queries: fitted on whole tables, so checked for rows and quality only."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.operators import metrics, models, queue
from meridian.plans.registry import register, table

FEATURES = ["price", "urgent", "month", "weekday", "balance"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with features known at the order's date and whether they were filled.

    Customers never pass through the driver, which a broadcast would need anew for every pass. Rows of a partition are in
    the order of their keys, so that what a tree samples doesn't depend on how they arrived."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey"), "left").sortWithinPartitions("o_orderkey")
    return rows.select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("double").alias("label"), (F.col("o_totalprice") / 100000).alias("price"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double").alias("urgent"), F.month("o_orderdate").cast("double").alias("month"), F.weekday("o_orderdate").cast("double").alias("weekday"), F.coalesce(F.col("c_acctbal") / 1000, F.lit(0.0)).alias("balance"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("toxic"), F.log1p(F.char_length(text).cast("double")).alias("chars"), F.size(F.split(text, "\n")).cast("double").alias("lines"), (F.size(F.array_distinct(F.split(text, " "))) / F.size(F.split(text, " "))).alias("variety"))


DOC_FEATURES = ["chars", "lines", "variety"]


def _metrics(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    train, valid = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0), rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    return models.evaluate(models.score(models.fit(train, DOC_FEATURES, kind), valid)).withColumn("model", F.lit(kind))


@register("ml_logistic_metrics")
def ml_logistic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "logistic")


@register("ml_forest_metrics")
def ml_forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "forest")


@register("ml_boosted_metrics")
def ml_boosted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, "boosted")


@register("ml_multiclass_masked")
def ml_multiclass_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 of a balanced three-class forest whose classes are masked by what a document allows."""
    rows = _documents(spark, sf_dir).withColumn("label", F.when(F.col("toxic") == 1, 2.0).otherwise(F.col("label")))
    weighted = models.balanced_weights(rows, "label")
    scored = models.score(models.fit(weighted, DOC_FEATURES, "forest", weightCol="weight", numTrees=20), rows)
    allowed = F.array(F.lit(True), F.col("lines") > 1, F.col("chars") > 3)
    stage = queue.masked_argmax(F.col("probabilities"), allowed, ["0.0", "1.0", "2.0"], "none")
    return metrics.macro_f1(scored.select(F.col("label").cast("string").alias("actual"), stage.alias("predicted")), "actual", "predicted")


@register("ml_temporal_tune_ablate")
def ml_temporal_tune_ablate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of nested feature sets with settings tuned on an inner temporal split."""
    rows = _orders(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    train, valid = models.temporal_split(rows, "o_orderdate", "1999-06-30", "1999-07-01")
    inner, outer = models.temporal_split(train, "o_orderdate", "1998-06-30", "1998-07-01")
    settings, _ = models.tune(inner, outer, FEATURES, "logistic", [{"regParam": r} for r in (0.001, 0.1)])
    sets = {"A": FEATURES[:2], "B": FEATURES[:4], "C": FEATURES}
    found = [(name, len(columns), models.average_precision(models.score(models.fit(train, columns, "logistic", **settings), valid))) for name, columns in sets.items()]
    rows.unpersist()
    return spark.createDataFrame(found, "feature_set string, features int, average_precision double")


_CANDIDATES = {
    "logistic": [{"C": 0.5, "maxIter": 2000}],
    "forest": [{"minInstancesPerNode": v, "numTrees": 500, "maxDepth": None} for v in (5, 10, 20)],
    "boosted": [{"maxIter": 300, "stepSize": 0.05, "maxDepth": 3}],
    "depthwise": [{"max_depth": v, "maxIter": 400} for v in (3, 4, 5)],
    "leafwise": [{"num_leaves": a, "min_child_samples": b, "maxIter": 400} for a in (15, 31) for b in (20, 40)],
}


@register("ml_model_comparison")
def ml_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalence and tuned models on a temporal split; the best by average precision is refitted on all development
    orders and judged on the orders after these (row ``refit``)."""
    orders = _orders(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    development, later = models.temporal_split(orders, "o_orderdate", "1999-12-31", "2000-01-01")
    train, valid = models.temporal_split(development, "o_orderdate", "1999-06-30", "1999-07-01")
    inner = models.temporal_split(train, "o_orderdate", "1998-12-31", "1999-01-01")
    rows = [(name, settings, m.first()) for name, settings, m in models.compare(train, valid, FEATURES, _CANDIDATES, inner)]
    name, settings, _ = max(rows[1:], key=lambda r: r[2]["average_precision"] or 0.0)
    last = models.judge(models.predict(development, later, FEATURES, name, settings)).first()
    orders.unpersist()
    shown = [(n, json.dumps(s, sort_keys=True), m["n"], m["prevalence"], m["auc"], m["average_precision"], m["brier"], m["f1"]) for n, s, m in [*rows, ("refit", {"kind": name} | settings, last)]]
    return spark.createDataFrame(shown, "model string, settings string, n long, prevalence double, auc double, average_precision double, brier double, f1 double")


@register("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    train, valid = models.temporal_split(rows, "o_orderdate", "1999-06-30", "1999-07-01")
    model = models.fit(train, FEATURES, "logistic", regParam=0.01)
    found = models.permutation_importance(model, valid, FEATURES, "o_orderkey", repeats=1)
    return spark.createDataFrame(found, "feature string, loss double")


@register("tree_attributions")
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute attribution of each feature over all validation orders."""
    from meridian.operators.treeshap import explain

    train, valid = models.temporal_split(_orders(spark, sf_dir), "o_orderdate", "1999-06-30", "1999-07-01")
    model = models.fit(train, FEATURES, "boosted", maxIter=5)
    values = explain(model.stages[-1], valid, "o_orderkey", FEATURES)
    means = values.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in FEATURES])
    return means.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs")) for f in FEATURES])).alias("s")).select("s.*")
