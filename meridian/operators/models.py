"""Classifiers over MLlib or ``celltrees``, tuned and compared under temporal splits, judged by the exact metrics."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators import celltrees, metrics


def temporal_split(rows: DataFrame, at: str, train_end: str, valid_start: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to the end of the training dates, and from the start of validation on."""
    day = F.col(at).cast("date")
    return rows.where(day <= F.lit(train_end).cast("date")), rows.where(day >= F.lit(valid_start).cast("date"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over classes times rows of the class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    # a row per class, and one row
    weights = counts.crossJoin(F.broadcast(totals)).select(F.col(label), (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return rows.join(weights, label)


def estimator(kind: str, label: str = "label", seed: int = 42, **settings):
    """A pipeline stage by name: ``logistic``, ``forest``, ``boosted``, or a stand-in for libraries that Spark hasn't.

    ``depthwise`` (``max_depth``) and ``leafwise`` (``num_leaves``, ``min_child_samples``) are boosted trees whose rows
    and columns are sampled; Spark grows trees by level, so leaves bound the depth of a ``leafwise`` tree."""
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "logistic":
        return LogisticRegression(**common, **({"maxIter": 100, "elasticNetParam": 0.0, "standardization": False} | settings))
    if kind == "forest":
        return RandomForestClassifier(**common, seed=seed, **({"numTrees": 50, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 10, "maxDepth": 10} | settings))
    if kind == "boosted":
        return GBTClassifier(**common, seed=seed, **({"maxIter": 20, "stepSize": 0.1, "maxDepth": 3, "subsamplingRate": 0.9} | settings))
    sampled = {"maxIter": 400, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"}
    if kind == "depthwise":
        return GBTClassifier(**common, seed=seed, **(sampled | {"maxDepth": settings.pop("max_depth", 4)} | settings))
    if kind == "leafwise":
        leaves, least = settings.pop("num_leaves", 31), settings.pop("min_child_samples", 30)
        return GBTClassifier(**common, seed=seed, **(sampled | {"maxDepth": math.ceil(math.log2(leaves)), "minInstancesPerNode": least} | settings))
    raise ValueError(f"unknown kind of model {kind!r}")


def fit(rows: DataFrame, features: list[str], kind: str, **settings) -> PipelineModel:
    """``C`` of a logistic model is the inverse strength of its penalty on scaled features: ``regParam`` is 1 / (C n)."""
    if (c := settings.pop("C", None)) is not None:
        settings |= {"regParam": 1 / (c * max(1, rows.count())), "standardization": True}
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), estimator(kind, **settings)]).fit(rows)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``p``: the probability of class 1, and ``probabilities``."""
    out = model.transform(rows).withColumn("probabilities", vector_to_array("probability"))
    return out.withColumn("p", F.element_at("probabilities", 2)).drop("features", "rawPrediction", "probability")


def evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row of ranking and threshold metrics; scores are rounded to bound the distinct ones."""
    p, y = F.round("p", 6), F.col(label)
    # three tables of one row
    return metrics.ranking(scored, p, y).crossJoin(metrics.brier(scored, F.col("p"), y)).crossJoin(metrics.at_threshold(scored, F.col("p") >= 0.5, y))


def judge(scored: DataFrame, label: str = "label") -> DataFrame:
    """``evaluate``, computed now: the model scores each row once, and scores and labels are kept meanwhile."""
    kept = scored.select("p", label).persist(StorageLevel.MEMORY_AND_DISK)
    found = evaluate(kept, label)
    out = scored.sparkSession.createDataFrame(found.collect(), found.schema)
    kept.unpersist()
    return out


def average_precision(scored: DataFrame, label: str = "label") -> float:
    return metrics.ranking(scored, F.round("p", 6), F.col(label)).first()["average_precision"] or 0.0


def tune(train: DataFrame, valid: DataFrame, features: list[str], kind: str, grid: list[dict]) -> tuple[dict, float]:
    """The settings with the best average precision on ``valid``; the first of equals."""
    best = None
    for settings in grid:
        ap = average_precision(score(fit(train, features, kind, **settings), valid))
        if best is None or ap > best[1]:
            best = settings, ap
    return best


def _through(grid: list[dict], kind: str) -> list[dict]:
    """Settings for MLlib, with what ``celltrees`` takes for granted; it grows trees to 30 levels at most."""
    full = [celltrees.DEFAULTS.get(kind, {}) | s for s in grid]
    return [s | {"maxDepth": 30} if s.get("maxDepth", 30) is None else s for s in full]


def predict(train: DataFrame, rows: DataFrame, features: list[str], kind: str, settings: dict) -> DataFrame:
    """Adds ``p``, the probability of class 1 by a model of ``train``; trees are grown over cells where bins bound these."""
    if kind in celltrees.KINDS and (found := celltrees.cells(train, rows, features)) is not None:
        return celltrees.score(rows, found[0], celltrees.fits(rows.sparkSession, [(found[0], kind, settings)])[0])
    return score(fit(train, features, kind, **_through([settings], kind)[0]), rows)


def _compare_trees(train: DataFrame, valid: DataFrame, features: list[str], candidates: dict[str, list[dict]], inner: tuple[DataFrame, DataFrame]) -> dict[str, tuple[dict, DataFrame]]:
    """Of each kind of trees: the settings taken and ``valid`` with ``p``. Nothing where bins make too many cells.

    All models whose settings are known are fitted at once."""
    spark, tuned = train.sparkSession, {k: g for k, g in candidates.items() if len(g) > 1}
    outer = celltrees.cells(train, valid, features) if candidates else None
    within = celltrees.cells(*inner, features) if outer and tuned else None
    if outer is None or tuned and within is None:
        return {}
    settled = {k: g[0] for k, g in candidates.items() if len(g) == 1}
    asked = [(k, s) for k, g in tuned.items() for s in g]
    found = celltrees.fits(spark, [(within[0], k, s) for k, s in asked] + [(outer[0], k, s) for k, s in settled.items()])
    p, best = dict(zip(settled, found[len(asked) :])), {}
    for (kind, settings), one in zip(asked, found):
        ap = celltrees.average_precision(one, *within[1:])
        if kind not in best or ap > best[kind]:
            best[kind], settled[kind] = ap, settings
    p |= dict(zip(tuned, celltrees.fits(spark, [(outer[0], k, settled[k]) for k in tuned])))
    return {k: (settled[k], celltrees.score(valid, outer[0], p[k])) for k in candidates}


def compare(train: DataFrame, valid: DataFrame, features: list[str], candidates: dict[str, list[dict]], inner: tuple[DataFrame, DataFrame]) -> list[tuple[str, dict, DataFrame]]:
    """Of the prevalence in ``train`` and of each kind of model: its name, its settings, and its metrics on ``valid``.

    Where a kind has several settings, those with the best average precision on ``inner`` (train, valid) are taken."""
    rate = train.agg(F.avg("label").alias("p"))
    found = [("prevalence", {}, judge(valid.crossJoin(F.broadcast(rate))))]
    trees = _compare_trees(train, valid, features, {k: g for k, g in candidates.items() if k in celltrees.KINDS}, inner)
    for kind, grid in candidates.items():
        if kind in trees:
            settings, scored = trees[kind]
        else:
            through = _through(grid, kind)
            best = through[0] if len(grid) == 1 else tune(*inner, features, kind, through)[0]
            settings, scored = grid[through.index(best)], score(fit(train, features, kind, **best), valid)
        found.append((kind, settings, judge(scored)))
    return found


def refit(development: DataFrame, features: list[str], kind: str, settings: dict) -> PipelineModel:
    """The chosen kind, fitted anew on all development rows, its training and validation rows together."""
    return fit(development, features, kind, **settings)


def permuted(rows: DataFrame, feature: str, key: str, seed: int) -> DataFrame:
    """``rows`` with one feature's values dealt out anew: the values in order of one hash meet the rows in order of another.

    Ranks are found by range partitioning and counts per partition, so no single task sees all rows."""
    return ranked(rows.drop(feature), F.xxhash64(F.col(key)), "_rank").join(ranked(rows.select(feature, key), F.xxhash64(F.col(key), F.lit(seed)), "_rank").select(feature, "_rank"), "_rank").drop("_rank")


def ranked(rows: DataFrame, order, name: str) -> DataFrame:
    """Adds the rank of each row in an order, from counts of buckets of the order's value."""
    from pyspark.sql.window import Window

    rows = rows.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 48))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_o"))
    return rows.join(before, "_b").withColumn(name, F.col("_before") + within).drop("_o", "_b", "_before")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], key: str, repeats: int = 2, seed: int = 42) -> list[tuple[str, float]]:
    """Mean loss of average precision when a feature is dealt out anew, largest first."""
    base = average_precision(score(model, rows))
    losses = [(f, sum(base - average_precision(score(model, permuted(rows, f, key, seed + r))) for r in range(repeats)) / repeats) for f in features]
    return sorted(losses, key=lambda x: (-x[1], x[0]))
