"""op9: packs every document by power-of-two decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.common import table
from meridian.llm.packing import pack

NAME = "op9_packing"
SQL = None  # token ids come from a tokenizer


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
