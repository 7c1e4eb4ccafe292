"""Readers of typed tables: JSON lines with their bad lines, Parquet by declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of bad lines."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", f"{schema}, _bad string", options).alias("r")).select("r.*")
    return rows.filter("_bad is null").drop("_bad"), rows.filter("_bad is not null").select("_bad")


def last_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Of JSON lines with the same key, the last one in order of path and place.  Blocks of a file may be read in any order, so a line's
    place is its block's start and then its number within the block."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    parsed = spark.read.text(path).select(F.from_json("value", schema).alias("r"), at.alias("_at")).filter(F.col("r")[key].isNotNull())
    return parsed.groupBy(F.col("r")[key].alias("_k")).agg(F.max_by("r", "_at").alias("r")).select("r.*")


def with_schema(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet whose names and types are as declared; anything else fails before a row is read."""
    df = spark.read.parquet(path)
    want = spark.createDataFrame([], schema).dtypes
    if (have := [d for d in df.dtypes if d[0] in dict(want)]) != want:
        raise ValueError(f"schema drift: expected {want}, found {have}")
    return df.select([n for n, _ in want])
