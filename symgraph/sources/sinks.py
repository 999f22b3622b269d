"""Results as JSON or as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.schema import SYMBOL_COLS


def symbols_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*SYMBOL_COLS)).alias("value"))


def symbols_text(df: DataFrame) -> DataFrame:
    """Two lines per symbol: kind and name, then place and signature."""
    place = F.format_string("    %s:%d-%d  %s", "file_path", "start_line", "end_line", "signature")
    return df.select(F.concat(F.concat_ws(" ", "kind", "qualified_name"), F.lit("\n"), place).alias("value"))


def hits_json(df: DataFrame) -> DataFrame:
    """{symbol, score}"""
    return df.select(F.to_json(F.struct(F.struct(*SYMBOL_COLS).alias("symbol"), "score")).alias("value"))


def hits_text(df: DataFrame) -> DataFrame:
    return df.select(F.format_string("%.3f %s", F.col("score"), F.col("qualified_name")).alias("value"))
