"""What a campaign would take before it is started: what is left to do, in how many chunks, and at what cost."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import keys
from rostrum.operators import chunking, events, streams


def preflight(eligible: DataFrame, completed: DataFrame, terminal: DataFrame, active: DataFrame, key: str, tokens: str, *, seed: str, most_records: int, ceiling: int, active_tokens: int, unknown_jobs: int, pilot: tuple[int, int], prices: tuple[float, float]) -> DataFrame:
    """One row.

    ``eligible``: key and tokens; the others: keys that are labelled, ended otherwise, or in an active campaign of the same configuration.
    What remains is put in seeded order (SHA-256 of ``key:seed``, ties by key) and cut into greedy chunks.  ``pilot``: output tokens and
    records of a measured run; without records there is no estimate.  ``prices``: of a million tokens in and out.  ``quota_fits``: the
    largest chunk fits beside what is active, and no active job's size is unknown.
    """
    counts = events.reconcile(eligible, completed, terminal, active, key)
    left = eligible
    for done in (completed, terminal, active):
        left = left.join(done.select(key).distinct(), key, "left_anti")
    left = left.select(key, tokens, F.concat(keys.seeded(F.col(key), seed, "sha256"), F.lit(":"), F.col(key).cast("string")).alias("_order"), F.lit("all").alias("_campaign"))
    chunks = chunking.chunk_report(chunking.greedy_chunks(left, "_campaign", "_order", tokens, most_records, ceiling), "_campaign", tokens)
    sums = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.max("tokens"), F.lit(0)).alias("most_chunk_tokens"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("records"), F.lit(0)).alias("n_left"))
    ids = streams.list_hash(left, ["_order"], F.col(key)).select(F.col("sha256").alias("remaining_sha256"))
    row = counts.crossJoin(sums).crossJoin(ids)  # one row each
    output = F.floor(F.col("n_left") * F.lit(pilot[0]) / F.lit(pilot[1])) if pilot[1] else F.lit(None).cast("long")
    money = [F.lit(Decimal(str(p))) for p in prices]
    cost = ((F.col("input_tokens") * money[0] + F.col("output_tokens") * money[1]) / 1_000_000).cast("decimal(18,6)")
    fits = (F.lit(active_tokens) + F.col("most_chunk_tokens") <= ceiling) & F.lit(unknown_jobs == 0)
    return row.withColumn("output_tokens", output).withColumns({"estimated_cost": cost, "quota_fits": fits}).drop("n_left")
