"""op3: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import table
from meridian.llm.htmltext import extract_pages

NAME = "op3_html_extraction"
SQL = None  # parsing HTML is beyond SQL; tests hold it against pages of known text


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
