"""Exact evaluation metrics as plans: ranking, thresholds, calibration, confusion, subgroups.

Rows are reduced to counts per distinct score first; running totals over these are taken in buckets of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.ranks import running


def by_score(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """Per distinct score: positives, negatives, and both at this score or above."""
    counts = rows.select(score.cast("double").alias("score"), label.cast("int").alias("y")).where("score IS NOT NULL AND y IS NOT NULL").groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return running(counts, "score", ["pos", "neg"], descending=True).withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"})


def ranking(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row: area under the ROC curve (ties count half) and average precision (steps at distinct scores)."""
    points = by_score(rows, score, label)
    sums = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0).alias("won"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"), F.when(F.col("p") > 0, F.col("steps") / F.col("p")).alias("average_precision"))


def brier(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    return rows.agg(F.avg(F.pow(score - label.cast("double"), 2.0)).alias("brier"))


def curve(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """ROC and precision-recall points, one per distinct score."""
    points = by_score(rows, score, label)
    sums = points.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return points.crossJoin(F.broadcast(sums)).select("score", (F.col("tp") / F.col("_p")).alias("recall"), (F.col("fp") / F.col("_n")).alias("fall_out"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def at_threshold(rows: DataFrame, predicted: Column, label: Column, by: list[str] | None = None) -> DataFrame:
    """n, prevalence, precision, recall, F1 and false negative rate, overall or per group."""
    y, p = label.cast("int") == 1, predicted.cast("int") == 1
    counts = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(y).alias("pos"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"))
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("pos")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, pos)
    return counts.select(*(by or []), "n", (pos / F.col("n")).alias("prevalence"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * tp, tp + fp + pos).alias("f1"), F.when(pos > 0, 1 - recall).otherwise(F.lit(0.0)).alias("miss_rate"))


def at_top(rows: DataFrame, score: Column, label: Column, key: str, shares: list[float]) -> DataFrame:
    """Precision and recall among the best-scored share of rows (at least one row; ties by ``key``, a number).

    A missing score is the lowest. Of rows with equal scores and keys those of label 0 count first. No rows, no shares."""
    base = rows.select(F.coalesce(score.cast("double"), F.lit(float("-inf"))).alias("s"), F.col(key).alias("key"), F.coalesce(label.cast("int"), F.lit(0)).alias("y"))
    tally = (F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    counts = base.groupBy("s").agg(*tally)
    totals = base.agg(F.count(F.lit(1)).alias("all"), F.sum("y").alias("all_pos"))
    asked = running(counts, "s", ["n", "pos"], descending=True).crossJoin(F.broadcast(totals)).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    asked = asked.withColumn("k", F.greatest(F.floor(F.col("all") * F.col("share")), F.lit(1)))
    # a row for each share: the score at which it ends
    cuts = asked.where("run_n >= k AND run_n - n < k").select("s", "share", "k", "all_pos", (F.col("k") - F.col("run_n") + F.col("n")).alias("room"), (F.col("run_pos") - F.col("pos")).alias("above"))
    ties = running(base.join(F.broadcast(cuts.select("s", "share", "room")), "s").groupBy("share", "room", "key").agg(*tally), "key", ["n", "pos"], within=("share", "room"))
    left = F.col("room") - (F.col("run_n") - F.col("n"))
    taken = ties.where("run_n - n < room").groupBy("share").agg(F.sum(F.when(left >= F.col("n"), F.col("pos")).otherwise(F.greatest(F.lit(0), left - (F.col("n") - F.col("pos"))))).alias("taken"))
    hits = F.col("above") + F.col("taken")
    return cuts.join(taken, "share").select("share", "k", (hits / F.col("k")).alias("precision"), F.when(F.col("all_pos") > 0, hits / F.col("all_pos")).alias("recall"))


def calibration(rows: DataFrame, score: Column, label: Column, bins: int = 8) -> DataFrame:
    """Mean score and observed rate of uniform bins; empty bins have no row."""
    return rows.groupBy(F.least(F.floor(score * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label.cast("double")).alias("observed"))


def confusion(rows: DataFrame, actual: str, predicted: str, classes: list[str]) -> DataFrame:
    """A row per class in fixed order, a column per predicted class; a class that doesn't occur has zeros."""
    counts = rows.groupBy(F.col(actual).alias("actual")).agg(*[F.count_if(F.col(predicted) == c).alias(c) for c in classes])
    all_classes = rows.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in classes])).alias("_at", "actual"))
    return all_classes.join(counts, "actual", "left").orderBy("_at").select("actual", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in classes])


def macro_f1(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Unweighted mean of F1 over the classes that occur as actual or predicted."""
    pairs = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    f1 = sides.groupBy("c").agg((2 * F.sum("hit") / (F.sum("actual") + F.sum("predicted"))).alias("f1"))
    return f1.agg(F.count(F.lit(1)).alias("classes"), F.avg("f1").alias("macro_f1"))


def subgroups(rows: DataFrame, groups: list[str], predicted: Column, label: Column, least: int = 30) -> DataFrame:
    """``at_threshold`` for every value of several attributes, in one pass; small or one-class groups are left out."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(g).alias("attribute"), F.col(g).cast("string").alias("value")) for g in groups])).alias("s"), predicted.cast("int").alias("p"), label.cast("int").alias("y")).select("s.*", "p", "y")
    out = at_threshold(long, F.col("p"), F.col("y"), ["attribute", "value"])
    return out.where((F.col("n") >= least) & (F.col("prevalence") > 0) & (F.col("prevalence") < 1))
