"""Queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_toxicity", "q_pq", "q_html", "q_warc", "q_jaccard", "q_substrings", "q_mixing", "q_fingerprints", "q_packing", "q_chat")


def _modules():
    return [importlib.import_module(f"meridian.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
