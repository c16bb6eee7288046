"""Running totals, quantiles and cut-offs in the order of a number, without sorting a whole table in one task.

Values are dealt into buckets by a fixed function that keeps their order, so a bucket's totals say what lies before it.
The table of buckets is bounded by the range of a double (a few thousand rows for scores, millions at worst); values that
agree in their first twelve bits or so share a bucket, which is sorted with spilling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets for a factor of e in a value's size, and the place of values beyond all others.
STEPS, FAR = 4096, 1 << 40


def _place(value: Column) -> Column:
    place = F.floor(F.signum(value) * F.log1p(F.abs(value)) * STEPS).cast("long")
    return F.when(F.isnan(value), F.lit(FAR)).otherwise(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), place)))


def running(rows: DataFrame, by: str, sums: list[str], descending: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``run_<c>`` for each of ``sums``: its total over the rows up to this one in the order of the number ``by``.

    Values of ``by`` are distinct (per ``within``) and not null, as after a ``groupBy``."""
    place = _place(F.col(by).cast("double"))
    rows = rows.withColumn("_b", -place if descending else place)
    totals = rows.groupBy(*within, "_b").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*within, "_b", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = Window.partitionBy(*within, "_b").orderBy(F.desc(by) if descending else F.asc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, [*within, "_b"]).withColumns({f"run_{c}": F.col(f"_before_{c}") + F.sum(c).over(inside) for c in sums})
    return out.drop("_b", *[f"_before_{c}" for c in sums])


def quantile(rows: DataFrame, column: str, share: float, name: str) -> DataFrame:
    """One row, ``name``: the exact quantile, interpolated between neighbours; null where the column has no value."""
    counts = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    place = counts.agg(((F.sum("n") - 1) * F.lit(float(share))).alias("at"))
    low, high = F.floor("at"), F.ceil("at")
    found = running(counts, "v", ["n"]).crossJoin(F.broadcast(place)).agg(F.min(F.when(F.col("run_n") > low, F.col("v"))).alias("low"), F.min(F.when(F.col("run_n") > high, F.col("v"))).alias("high"), F.max("at").alias("at"))
    return found.select(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((high - F.col("at")) * F.col("low") + (F.col("at") - low) * F.col("high")).alias(name))
