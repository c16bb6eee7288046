"""Casts, flags, imputation, scaling, one-hot encoding and the column contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.ranks import quantile


def number(c: Column) -> Column:
    """A double, null where it can't be read or isn't a number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def day(c: Column) -> Column:
    return c.cast("string").try_cast("date")


def flag(c: Column, yes: str) -> Column:
    """1 where the value is ``yes``, else (null too) 0."""
    return F.coalesce((c == yes).cast("int"), F.lit(0))


def strict_number(c: Column) -> Column:
    """A double; a value that isn't null and can't be read fails the query and is named."""
    value = c.try_cast("double")
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), c.cast("string"))).cast("double")).otherwise(value)


def condition_count(c: Column) -> Column:
    """How many conditions a text such as ``A+B`` names: none for ``none`` in any case; a missing text counts as one."""
    plus = F.char_length(c) - F.char_length(F.replace(c, F.lit("+"), F.lit("")))
    return F.when(F.lower(c) == "none", F.lit(0)).otherwise(F.coalesce(plus + 1, F.lit(1))).cast("long")


def levels(rows: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The sorted categories of a training column (missing is one); more than ``most`` is an error, not a cut."""
    found = [r[0] for r in rows.select(F.coalesce(F.col(column).cast("string"), F.lit("__missing__")).alias("v")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return sorted(found)


def one_hot(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """A column of 0.0 or 1.0 for each known category; a category not seen in training is all zeros."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("__missing__"))
    return rows.withColumns({f"{column}_{v}": (value == v).cast("double") for v in known}).drop(column)


def impute_median(rows: DataFrame, columns: list[str], training: DataFrame | None = None) -> DataFrame:
    """Nulls become the training median (exact, interpolated); a column without any value becomes 0."""
    out = rows
    for c in columns:
        out = out.crossJoin(F.broadcast(quantile(training or rows, c, 0.5, f"_{c}")))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def standardise(rows: DataFrame, columns: list[str], training: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    moments = (training or rows).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return rows.crossJoin(F.broadcast(moments)).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def verdicts(columns: DataFrame, labels: dict[tuple[str, str], tuple[str, str]], never: dict[tuple[str, str], str], at_t: set[tuple[str, str]], historical: set[str], static: set[str], encounter: set[str]) -> DataFrame:
    """Adds ``verdict`` and ``reason``: how each column (``table_name, column_name``) may be used in prediction.

    The first rule that fits decides: a label, an outcome, what is known at the instant (each by table and column), a
    historical measurement (by column, whatever its table), a static table, a table of the encounter itself; else conditional."""
    of, name = F.col("table_name"), F.col("column_name")

    def rule(test: Column, verdict: str, reason: str) -> Column:
        return F.when(test, F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason")))

    def at(key: tuple[str, str]) -> Column:
        return (of == key[0]) & (name == key[1])

    rules = [rule(at(k), *v) for k, v in sorted(labels.items())]
    rules += [rule(at(k), "history only", why) for k, why in sorted(never.items())]
    rules += [rule(at(k), "available", "recorded during the encounter") for k in sorted(at_t)]
    rules += [rule(name.isin(*sorted(historical)), "history only", "dated on or before the predicted instant"), rule(of.isin(*sorted(static)), "available", "static reference"), rule(of.isin(*sorted(encounter)), "available", "recorded at or before the instant")]
    found = F.coalesce(*rules, F.struct(F.lit("conditional").alias("verdict"), F.lit("only if strictly before the instant").alias("reason")))
    return columns.withColumn("_found", found).select(*columns.columns, "_found.verdict", "_found.reason")


def assert_usable(wanted: list[str], labels: list[str], never: list[str]) -> None:
    """Fails while a plan is built if it refers to a label or a forbidden column."""
    if wrong := sorted(set(wanted) & (set(labels) | set(never))):
        raise ValueError(f"columns that prediction may not use: {', '.join(wrong)}")
