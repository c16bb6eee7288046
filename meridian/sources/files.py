"""Tables from and to files, with explicit schemas; reports as CSV, JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_names(rows: DataFrame) -> DataFrame:
    """Column names without surrounding white space or a byte order mark."""
    return rows.toDF(*[c.strip().lstrip("﻿").strip() for c in rows.columns])


def nan_to_null(rows: DataFrame) -> DataFrame:
    """Not-a-number is missing: comparisons and means then treat it so."""
    real = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else rows


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, null_value: str = "") -> DataFrame:
    """A CSV with a header, read by a given schema; what doesn't parse is null. Identities should be strings."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("nullValue", null_value).option("mode", "PERMISSIVE").csv(path))


def read_tables(spark: SparkSession, folder: str, names: list[str], views: bool = False) -> dict[str, DataFrame]:
    """Several Parquet tables of a folder by name, as temporary views too if asked."""
    found = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    if views:
        for n, rows in found.items():
            rows.createOrReplaceTempView(n)
    return found


def project(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there."""
    return rows.select(*[c for c in wanted if c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def document(one_row: DataFrame) -> str:
    """A table of one row as a JSON document."""
    found = one_row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a document is made of exactly one row")
    return json.dumps(found[0].asDict(recursive=True), default=str, sort_keys=True)


def markdown(rows: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table (column ``value``), without its heading."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_heading(columns: list[str]) -> list[str]:
    return [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]


def save_model(model: PipelineModel, path: str, about: dict) -> None:
    """A model and, beside it, what it was fitted on."""
    model.write().overwrite().save(path)
    session = SparkSession.getActiveSession()
    session.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(path), json.loads(spark.read.text(f"{path}-about").first()[0])
