"""Working columns that can't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aside(df: DataFrame, text: str = "text") -> DataFrame:
    """``_row``, all columns as one, and ``text``."""
    return df.select(F.struct("*").alias("_row"), F.col(text).alias("text"))


def restored(worked: DataFrame, df: DataFrame, made: list[str]) -> DataFrame:
    """The columns of ``df`` out of ``_row``, then those of ``made``, which replace any of the same names."""
    return worked.select(*[F.col("_row")[c].alias(c) for c in df.columns if c not in made], *made)
