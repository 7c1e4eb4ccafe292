"""Hashes of ordered lists of any length, and artifacts of chunks merged in planned order.

A hash of a list goes through it in order, so one task has to.  All else is done before: rows are sorted and joined into long pieces of
text by many tasks, and that one task reads the pieces in order, with one piece and the hash's state in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import keys

#: Characters of a piece, at least.
PIECE = 1 << 20


def streamed_hash(df: DataFrame, order: list[Column | str], text: Column, between: str = "", start: str = "", end: str = "") -> DataFrame:
    """One row: n, and the SHA-256 of all texts in order with ``between`` between them.  Null texts are left out of the hash."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, k, part = [], 0, 0, 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int64()), pa.array([between.join(waiting)]), pa.array([len(waiting)], pa.int64())], ["part", "k", "text", "n"])

        for batch in batches:
            for part, t in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                waiting.append(t)
                n += len(t)
                if n >= PIECE:
                    yield piece()
                    waiting, n, k = [], 0, k + 1
        if waiting:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = hashlib.sha256(start.encode()), 0
        for batch in batches:
            for t, more in zip(batch.column("text").to_pylist(), batch.column("n").to_pylist()):
                if t is not None:
                    state.update(((between if n else "") + t).encode())
                    n += more
        state.update(end.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([state.hexdigest()])], ["n", "sha256"])

    rows = df.select(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{k}") for k, o in enumerate(order)], text.alias("text")).filter("text is not null")
    # partitions follow each other in the order, and their numbers are those of the sort
    sorted_rows = rows.orderBy(*[f"o{k}" for k in range(len(order))]).select(F.spark_partition_id().alias("part"), "text")
    made = sorted_rows.mapInArrow(pieces, "part int, k bigint, text string, n bigint")
    none = df.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("k"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    one = made.union(none).repartition(1).sortWithinPartitions("part", "k")  # never without a row, so that an empty list has its hash too
    return one.mapInArrow(hashed, "n bigint, sha256 string")


def list_hash(df: DataFrame, order: list[Column | str], key: Column) -> DataFrame:
    """One row: n, and the SHA-256 of the JSON list of string ids: that of ``keys.list_hash`` without a list in memory."""
    return streamed_hash(df, order, keys.json_text(key.cast("string")), ",", "[", "]")


# What a row of a chunk's artifact can be.
STATES = ("original_valid", "structurally_repaired", "provider_refused", "unresolved_invalid", "provider_failed", "missing")


def merged(plan: DataFrame, artifacts: DataFrame, key: str, chunk: str, order: str, state: str) -> DataFrame:
    """A row per planned record, with its ``order``, the state and columns of its row in its own chunk's artifact (``missing`` without one), and
    ``n_rows``, how many it has there; of several the first by all columns counts.  Rows of records that are not planned in their chunk have a
    null order.  One join on the key and chunk; write it sorted by order to have the artifact of the whole campaign.
    """
    more = [c for c in artifacts.columns if c not in (key, chunk)]
    rows = artifacts.groupBy(key, chunk).agg(F.count("*").alias("n_rows"), F.min(F.struct(*more)).alias("_row"))
    both = plan.select(key, chunk, order).join(rows, [key, chunk], "full")
    both = both.select(key, chunk, order, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), *[F.col("_row")[c].alias(c) for c in more])
    return both.withColumn(state, F.when(F.col("n_rows") == 0, "missing").otherwise(F.col(state)))


def accounts(rows: DataFrame, key: str, order: str, state: str, planned_sha256: str | None = None) -> DataFrame:
    """One row of a merged campaign: planned records by state, ``duplicate`` rows (second ones and those outside the plan), the hash of the
    planned ids in order, and whether the main pass may be closed: every record in one known state, nothing twice, the hash as planned."""
    there = F.col(order).isNotNull()
    n = rows.agg(
        F.count_if(there).alias("planned"), *[F.count_if(there & (F.col(state) == s)).alias(s) for s in STATES],
        F.coalesce(F.sum(F.when(there, F.greatest(F.col("n_rows") - 1, F.lit(0))).otherwise(F.col("n_rows"))), F.lit(0)).alias("duplicate"),
    )
    ids = list_hash(rows.filter(there), [order], F.col(key)).select(F.col("sha256").alias("record_set_sha256"))
    row = n.crossJoin(ids)  # one row and one row
    whole = (F.col("planned") == sum((F.col(s) for s in STATES), F.lit(0))) & (F.col("duplicate") == 0)
    same = F.lit(True) if planned_sha256 is None else F.col("record_set_sha256") == planned_sha256
    return row.withColumns({"accounted": whole, "complete": whole & same & (F.col("missing") == 0) & (F.col("provider_failed") == 0) & (F.col("unresolved_invalid") == 0)})
