"""Point-in-time operators: what was known of an entity strictly before an instant.

All take a spine (one row per id, with an entity key and an instant) and an event table (key, instant,
payload). None compares every spine row with every event of its key unless the result needs it: running
aggregates and latest rows come from one sorted timeline per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(instant: Column) -> Column:
    """Microseconds of a timestamp with or without a zone, for range frames."""
    return F.unix_micros(instant.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later.cast("date"), earlier.cast("date")).cast("long")


def strictly_before(key: str, instant: str) -> Window:
    """The frame of rows of the same key with an earlier instant (ties excluded)."""
    return Window.partitionBy(key).orderBy(micros(F.col(instant))).rangeBetween(Window.unboundedPreceding, -1)


def up_to(key: str, instant: str) -> Window:
    """The frame of rows of the same key with an earlier or equal instant."""
    return Window.partitionBy(key).orderBy(micros(F.col(instant))).rangeBetween(Window.unboundedPreceding, 0)


def history(rows: DataFrame, key: str, instant: str, aggregates: dict[str, Column]) -> DataFrame:
    """Adds aggregates over the rows of the same table and key that are strictly earlier."""
    frame = strictly_before(key, instant)
    return rows.withColumns({name: a.over(frame) for name, a in aggregates.items()})


def _timeline(spine: DataFrame, events: DataFrame, key: str, instant: str, payload: list[str]) -> DataFrame:
    here = spine.withColumn("_event", F.lit(None).cast("boolean"))
    there = events.select(F.col(key), F.col(instant), F.lit(True).alias("_event"), F.struct(F.col(instant).alias("_at"), *payload).alias("_payload"))
    return here.unionByName(there, allowMissingColumns=True)


def latest(spine: DataFrame, events: DataFrame, key: str, instant: str, payload: list[str]) -> DataFrame:
    """Adds ``latest``: the last event before each spine row (struct of ``_at`` and ``payload``; ties: largest payload)."""
    frame = strictly_before(key, instant)
    return _timeline(spine, events, key, instant, payload).withColumn("latest", F.max("_payload").over(frame)).where("_event IS NULL").drop("_event", "_payload")


def latest_k(spine: DataFrame, events: DataFrame, key: str, instant: str, order: list[str], payload: list[str], k: int, inclusive: bool = False) -> DataFrame:
    """One row per spine row and each of its last ``k`` events before it: the spine's columns and ``payload``.

    ``inclusive``: events at the very instant of the spine row count too, as for a ledger that is closed by then.

    Events are numbered within their key; a spine row knows from its timeline how many came before it and
    asks for the last k numbers, an equi-join whose size is k rows a spine row."""
    timeline = _timeline(spine, events, key, instant, payload)
    before = timeline.withColumn("_n", F.count("_event").over((up_to if inclusive else strictly_before)(key, instant))).where("_event IS NULL").drop("_event", "_payload")
    asked = before.where("_n > 0").withColumn("_seq", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_n") - (k - 1)), F.col("_n"))))
    numbered = events.select(F.col(key).alias("_key"), F.row_number().over(Window.partitionBy(key).orderBy(instant, *order)).cast("long").alias("_seq_event"), *payload)
    return asked.join(numbered, (F.col(key) == F.col("_key")) & (F.col("_seq") == F.col("_seq_event"))).drop("_key", "_seq_event", "_n", "_seq")


def band(left: DataFrame, right: DataFrame, key: str, at: str, event_at: str, lower_days: int, upper_days: int, open_lower: bool = False, how: str = "inner") -> DataFrame:
    """Joins events of the same key whose instant lies within days around ``at``.

    Rows meet by key and a time bucket as wide as the band (a row asks two or three buckets), so a key with a
    long history isn't compared with all of it. The right side's key is renamed ``_key``."""
    width = max(1, upper_days - lower_days) * 86_400_000_000
    low, high = micros(F.col(at)) + lower_days * 86_400_000_000, micros(F.col(at)) + upper_days * 86_400_000_000
    asks = left.withColumns({"_low": low, "_high": high}).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    events = right.withColumnRenamed(key, "_key").withColumn("_when", micros(F.col(event_at))).withColumn("_slot", F.floor(F.col("_when") / width))
    above = F.col("_when") > F.col("_low") if open_lower else F.col("_when") >= F.col("_low")
    return asks.join(events, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_slot")) & above & (F.col("_when") <= F.col("_high")), how).drop("_low", "_high", "_bucket", "_slot", "_when", "_key")


def future_rows(left: DataFrame, right: DataFrame, on: Column, at: str, event_at: str) -> DataFrame:
    """One row: how many joined events lie before the instant they should follow (``violations``) of how many (``checked``)."""
    return left.join(right, on).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col(event_at) < F.col(at)).alias("violations"))
