"""SQL of the user's own over the tables of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def raw_query(spark: SparkSession, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """text names the tables as `{symbols}` and its values as `:name`; values are bound, never pasted."""
    return spark.sql(text, args or {}, **tables)
