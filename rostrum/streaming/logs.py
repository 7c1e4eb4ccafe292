"""Append-only logs as streams: the latest row per key and sums over its rows, kept up to date by micro-batches.

An extension: the logs of the batch operators, read as they grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """Files that weren't read before, as a stream; run it with trigger(availableNow=True) to take what is there and stop."""
    return spark.readStream.schema(schema).format(form).load(path)


def reduced(rows: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """The last row of each key, with ``sums`` added up over all its rows."""
    rest = [c for c in rows.columns if c != key and c not in sums]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"), *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums])
    return top.select(*[F.col("_top")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])


def parts(number: int, fanout: int) -> list[str]:
    """The folders that together hold what batches 0 to ``number`` left: the largest merged ones first."""
    out, upto, level = [], 0, 0
    while fanout ** (level + 1) <= number + 1:
        level += 1
    for k in range(level, -1, -1):
        while upto + fanout**k <= number + 1:
            upto += fanout**k
            out.append(f"level={k}/upto={upto - 1}")
    return out


def keep_latest(stream: DataFrame, key: str, order: list[str], state: str, checkpoint: str, sums: list[str] | None = None, fanout: int = 8) -> StreamingQuery:
    """Keeps the latest row of each key, and sums over all its rows, as deltas that are merged by levels.

    A batch writes what it has itself; every ``fanout``th one merges the last ``fanout`` folders of a level into one of the next, so a row is
    written again once a level and what a batch writes doesn't grow with the state.  Folders are named by level and last batch, so a batch that
    is run again overwrites its own and nothing is added twice.  Read with ``standing``; folders that were merged can be deleted by their owner.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, adds, level = batch.sparkSession, sums or [], 0
        reduced(batch, key, order, adds).write.mode("overwrite").parquet(f"{state}/level=0/upto={number}")
        while (number + 1) % fanout ** (level + 1) == 0:
            last = [f"{state}/level={level}/upto={number - k * fanout**level}" for k in range(fanout)]
            rows = spark.read.schema(batch.schema).parquet(*last)
            level += 1
            reduced(rows, key, order, adds).write.mode("overwrite").parquet(f"{state}/level={level}/upto={number}")
        spark.range(number, number + 1).write.mode("overwrite").parquet(f"{state}/done/upto={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(spark: SparkSession, state: str, schema: str | StructType, key: str, order: list[str], sums: list[str] | None = None, fanout: int = 8) -> DataFrame:
    """What ``keep_latest`` has kept, up to the last batch that was finished."""
    number = spark.read.schema("id bigint").option("recursiveFileLookup", True).parquet(f"{state}/done").agg(F.max("id")).first()[0]
    rows = spark.read.schema(schema).parquet(*[f"{state}/{p}" for p in parts(number, fanout)])
    return reduced(rows, key, order, sums or [])


def remaining(planned: DataFrame, kept: DataFrame, key: str, status: str, done: tuple[str, ...], attempt: str, most: int) -> DataFrame:
    """Records that a run which starts again still has to ask for: never asked, or without an outcome that ends them and with attempts left."""
    ended = kept.filter(F.col(status).isin(*done) | (F.col(attempt) >= most))
    return planned.join(ended.select(key), key, "left_anti")
