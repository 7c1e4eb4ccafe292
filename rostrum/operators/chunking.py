"""Greedy chunks of ordered records, many tasks to a campaign.

A chunk takes records in order until one would pass a limit, so where a chunk starts depends on all before it.  But from a given start the
next one follows from prefix sums, by binary search, and it is at most ``most_records`` further.  So records are cut into blocks longer than a
chunk can be; each block finds for every entry (a start among its first records) where the chain leaves it and after how many chunks, by
doubling its pointers.  Entries near each other soon meet, so a block says this in a few runs.  The chain of the blocks themselves is
walked on the driver, a few numbers a block, and then every block numbers its own records.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.storage import settled

BLOCK = 50_000


def _placed(df: DataFrame, campaign: str, order: str, tokens: str, most_tokens: int) -> DataFrame:
    """Rows with ``_i``, their place in their campaign from 0, and ``_s``, the tokens before them.

    Sorted over many partitions; of each only what its first and its last campaign have there reaches the driver.
    """
    parts = settled(df.orderBy(campaign, order).withColumn("_part", F.spark_partition_id()))
    each = parts.groupBy("_part", campaign).agg(F.count("*").alias("n"), F.sum(tokens).alias("s"), F.max(tokens).alias("most"))
    said = F.struct(F.col(campaign).isNotNull(), F.col(campaign).alias("c"), "n", "s")
    ends = each.groupBy("_part").agg(F.min(said).alias("first"), F.max(said).alias("last"), F.max("most").alias("most")).orderBy("_part").collect()
    if any(r.most > most_tokens for r in ends):
        raise ValueError(f"a record needs more than the {most_tokens} tokens of a chunk")
    before, of, n, s = {}, None, 0, 0
    for r in ends:
        before[r._part] = (n, s) if of is not None and of[0] == r.first.c else (0, 0)
        whole = r.first.c == r.last.c  # the partition has one campaign, which may go on
        n, s = (before[r._part][0] + r.last.n, before[r._part][1] + r.last.s) if whole else (r.last.n, r.last.s)
        of = (r.last.c,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, i, used = object(), 0, 0
        first = True
        for batch in batches:
            places, sums = [], []
            for key, part, need in zip(batch.column(campaign).to_pylist(), batch.column("_part").to_pylist(), batch.column(tokens).to_pylist()):
                if first or key != of:
                    i, used = before[part] if first else (0, 0)
                    of, first = key, False
                places.append(i)
                sums.append(used)
                i, used = i + 1, used + need
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(sums, pa.int64())], [*batch.schema.names, "_i", "_s"])

    schema = T.StructType([*parts.schema.fields, T.StructField("_i", T.LongType()), T.StructField("_s", T.LongType())])
    return parts.mapInArrow(run, schema).drop("_part")


def next_starts(before: np.ndarray, after: np.ndarray, n: int, most_records: int, most_tokens: int) -> np.ndarray:
    """Of the first ``n`` records: where the chunk after the one that starts there starts.  ``before``, ``after``: tokens up to each record."""
    fits = np.searchsorted(after, before[:n] + most_tokens, "right")
    return np.minimum(fits, np.arange(n) + most_records)


def exits(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chains of starts leave a block, and after how many chunks, by doubling."""
    n = len(following)
    at, count = following.copy(), np.ones(n, np.int64)
    while (inside := at < n).any():
        count[inside] += count[at[inside]]
        at[inside] = at[at[inside]]
    return at, count


def greedy_chunks(df: DataFrame, campaign: str, order: str, tokens: str, most_records: int, most_tokens: int, block: int = BLOCK) -> DataFrame:
    """Rows with ``chunk_number``, from 1: in order, a chunk takes rows until one would pass either limit.

    A row over the token limit by itself fails the job.  Ties in the order are broken in any way.
    """
    block = max(block, most_records)
    rows = _placed(df, campaign, order, tokens, most_tokens).withColumn("_b", F.floor(F.col("_i") / block))  # twice read, from the settled sort
    ahead = (F.col("_b") > 0) & (F.col("_i") % block < most_records)  # what the block before looks ahead to
    light = rows.select(F.col(campaign).alias("c"), F.explode(F.when(ahead, F.array("_b", F.col("_b") - 1)).otherwise(F.array("_b"))).alias("b"), F.col("_i").alias("i"), F.col("_s").alias("s"), (F.col("_s") + F.col(tokens)).alias("e"))

    def leave(group: pa.Table) -> pa.Table:
        i = group.column("i").to_numpy()
        ranked = np.argsort(i)
        first = int(group.column("b")[0].as_py()) * block
        n = int((i < first + block).sum())
        following = next_starts(group.column("s").to_numpy()[ranked], group.column("e").to_numpy()[ranked], n, most_records, most_tokens)
        at, count = (a[:most_records] for a in exits(following))
        runs = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (count[1:] != count[:-1]))))
        return pa.table({"c": group.column("c").take(pa.array(np.zeros(len(runs), np.int64))), "b": group.column("b").take(pa.array(np.zeros(len(runs), np.int64))), "entry": runs.astype(np.int64), "exit": at[runs] - n, "chunks": count[runs], "n": np.full(len(runs), n)})

    kind = df.schema[campaign].dataType
    runs = light.groupBy("c", "b").applyInArrow(leave, T.StructType([T.StructField("c", kind)] + [T.StructField(c, T.LongType()) for c in ("b", "entry", "exit", "chunks", "n")]))
    starts, of, entry, number, mine = [], None, 0, 0, []

    def walk() -> None:
        """One block more of the chain."""
        nonlocal entry, number
        starts.append((mine[0].c, mine[0].b, entry, number))
        if entry < mine[0].n:
            run = mine[bisect_right([r.entry for r in mine], entry) - 1]
            entry, number = run.exit, number + run.chunks

    for r in runs.orderBy("c", "b", "entry").toLocalIterator():
        if mine and (r.c, r.b) != (mine[0].c, mine[0].b):
            walk()
            mine = []
        if of is None or of[0] != r.c:
            of, entry, number = (r.c,), 0, 0
        mine.append(r)
    if mine:
        walk()
    entries = df.sparkSession.createDataFrame(starts, T.StructType([T.StructField("_c", kind)] + [T.StructField(c, T.LongType()) for c in ("_block", "_entry", "_number")]))
    joined = rows.join(entries, F.col(campaign).eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_block")))
    joined, names = joined.withColumn("_need", F.col(tokens).cast("long")), df.columns

    def number_rows(group: pa.Table) -> pa.Table:
        i = group.column("_i").to_numpy()
        ranked = np.argsort(i)
        s, need = group.column("_s").to_numpy()[ranked], group.column("_need").to_numpy()[ranked]
        entry, number = int(group.column("_entry")[0].as_py()), int(group.column("_number")[0].as_py())
        following = next_starts(s, s + need, len(i), most_records, most_tokens)
        begins = np.zeros(len(i), np.int64)
        at = entry
        while at < len(i):
            begins[at] = 1
            at = int(following[at])
        chunk = np.empty(len(i), np.int64)
        chunk[ranked] = number + np.cumsum(begins)
        return group.select(names).append_column("chunk_number", pa.array(chunk))

    return joined.groupBy(campaign, "_b").applyInArrow(number_rows, T.StructType([*df.schema.fields, T.StructField("chunk_number", T.LongType())]))


def chunk_report(chunks: DataFrame, campaign: str, tokens: str) -> DataFrame:
    """A row per chunk: its records and tokens."""
    return chunks.groupBy(campaign, "chunk_number").agg(F.count("*").alias("records"), F.sum(tokens).alias("tokens"))
