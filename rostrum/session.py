"""The session that the library's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "rostrum", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, zstd Parquet.  Masters, memory and partition counts are the deployer's."""
    builder = SparkSession.builder.appName(app)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
