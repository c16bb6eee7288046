"""From scores to a work queue: masked stages, gates, priorities, tiers, reasons, capacities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridian.config import DEFAULT
from meridian.operators.ranks import quantile, running


def masked_argmax(probabilities: Column, allowed: Column, names: list[str], none: str) -> Column:
    """Name of the largest allowed probability, the first of equals; ``none`` where nothing is allowed."""
    masked = F.zip_with(probabilities, allowed, lambda p, ok: F.when(ok, p).otherwise(F.lit(-1.0)))
    best = F.array_max(masked)
    return F.when(best < 0, F.lit(none)).otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(masked, best).cast("int")))


def median_gate(rows: DataFrame, score: str, calibration: DataFrame, stage: Column, below: str) -> DataFrame:
    """Adds ``gate`` (median calibration score) and ``stage``: as given at or above the gate, else ``below``."""
    gate = quantile(calibration, score, 0.5, "gate")
    return rows.crossJoin(F.broadcast(gate)).withColumn("stage", F.when(F.col(score) >= F.col("gate"), stage).otherwise(F.lit(below)))


def priority(risk: Column, urgency: Column, feasibility: Column, weights: tuple[float, ...] = DEFAULT.priority) -> Column:
    """Weighted sum; the consequence of a stage is its urgency."""
    return weights[0] * risk + weights[1] * urgency + weights[2] * urgency + weights[3] * feasibility


def cut_offs(calibration: DataFrame, score: str, shares: tuple[float, ...] = DEFAULT.tier_shares) -> DataFrame:
    """One row: for each share c the score of rank floor(c * n), at least 1, in descending order; missing scores come last."""
    counts = calibration.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    total = calibration.agg(F.count(F.lit(1)).alias("all"))
    ranked = running(counts.where("s IS NOT NULL"), "s", ["n"], descending=True).crossJoin(F.broadcast(total))
    return ranked.agg(*[F.max(F.when(F.col("run_n") >= F.greatest(F.floor(F.col("all") * c), F.lit(1)), F.col("s"))).alias(f"cut_{i + 1}") for i, c in enumerate(shares)])


def tiers(rows: DataFrame, score: str, cuts: DataFrame) -> DataFrame:
    """Adds ``tier`` P1 to P4 by the cut-offs."""
    s = F.col(score)
    out = rows.crossJoin(F.broadcast(cuts))
    return out.withColumn("tier", F.when(s >= F.col("cut_1"), "P1").when(s >= F.col("cut_2"), "P2").when(s >= F.col("cut_3"), "P3").otherwise("P4")).drop("cut_1", "cut_2", "cut_3")


def reasons(rules: list[tuple[Column, Column]], most: int = 3, default: str = "General follow-up") -> Column:
    """The first reasons whose condition holds (null: it doesn't), joined; the default where none does."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for test, text in rules]))
    return F.when(F.size(found) == 0, F.lit(default)).otherwise(F.array_join(F.slice(found, 1, most), "; "))


def with_capacity(rows: DataFrame, site: str, score: str, key: str, capacity: int = DEFAULT.capacity) -> DataFrame:
    """Adds the rank within a site (a null site is a site) and whether it is over the site's capacity."""
    rank = F.row_number().over(Window.partitionBy(site).orderBy(F.desc(score), key))
    return rows.withColumn("rank", rank.cast("long")).withColumn("overflow", F.col("rank") > capacity)


def top_contributions(contributions: Column, most: int = 4) -> Column:
    """Names of the largest absolute contributions (array of struct name, value); ties by name."""
    ordered = F.array_sort(contributions, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return F.transform(F.slice(ordered, 1, most), lambda x: x["name"])


def first_per_key(rows: DataFrame, key: str, score: str, tie: str, most: int = 6) -> DataFrame:
    """The best row of each key, of the keys with the best rows."""
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where("_n = 1").drop("_n")
    return best.orderBy(F.desc(score), tie).limit(most)
