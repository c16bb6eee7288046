"""Profiles: per-column statistics, frequent values, cross tables, bins and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numeric_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column from a single pass: missing, distinct, least, largest, mean."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("missing", lambda x: F.count_if(F.col(x).isNull())), ("distinct", F.countDistinct), ("least", lambda x: F.min(F.col(x).cast("double"))), ("largest", lambda x: F.max(F.col(x).cast("double"))), ("mean", lambda x: F.avg(F.col(x).cast("double"))))]
    names = ("missing", "distinct", "least", "largest", "mean")
    one = rows.agg(*stats)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}_{n}").alias(n) for n in names]) for c in columns])).alias("s")).select("s.*")


def top_values(rows: DataFrame, columns: list[str], n: int = 12) -> DataFrame:
    """The most frequent values of each column; ties by value."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count and share of each value."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def crosstab(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Dense counts: a row per group, a column per value, 0 where there are none."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins between the least and the largest value, which belongs to the last bin."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    value = F.floor((F.col(column) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))
    return rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(value, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def interval(value: Column, edges: list[float]) -> Column:
    """Label of the right-closed interval that holds the value; null outside."""
    rule = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        rule = F.when((value > low) & (value <= high), f"({low:g}, {high:g}]").otherwise(rule)
    return rule


def rate_with_interval(rows: DataFrame, by: str, outcome: Column) -> DataFrame:
    """Rate, size and half-width of the 95 % Wald interval of each group."""
    out = rows.groupBy(by).agg(F.avg(outcome.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("half_width", F.lit(1.96) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))
