"""What must hold before work on a selection begins: records eligible by their latest policy label, frozen samples as batches; and how it failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.operators.events import latest

UNCLASSIFIED = "UNCLASSIFIED"


def eligibility(records: DataFrame, turns: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per campaign: records, those whose turn has no latest policy prediction that says it is policy, and the smallest key of these.

    Latest is by import, then run, then prediction.  A record without a turn isn't counted.
    """
    last = latest(predictions.filter("task = 'policy'").select("turn_id", "imported_at", "run_id", "prediction_id", "is_non_policy"), "turn_id", "imported_at", "run_id", "prediction_id")
    rows = records.select("campaign", "turn_id").join(turns.select("turn_id", "turn_key"), "turn_id").join(last.select("turn_id", "is_non_policy"), "turn_id", "left")
    bad = ~F.col("is_non_policy").eqNullSafe(F.lit(False))
    return rows.groupBy("campaign").agg(F.count("*").alias("n_records"), F.count_if(bad).alias("invalid_count"), F.min(F.when(bad, F.col("turn_key"))).alias("example_turn_key"))


def sample_batch(sample: DataFrame, turns: DataFrame, taken: DataFrame) -> DataFrame:
    """Tasks of a frozen sample (sample_order, turn_key): turn_id and priority, which falls with the order; ``error`` says why a row makes none:
    TWICE in the sample, MISSING, AMBIGUOUS (several turns of one key), TAKEN by another batch."""
    ids = turns.groupBy("turn_key").agg(F.count("*").alias("_n"), F.min("turn_id").alias("turn_id"))
    times = sample.groupBy("turn_key").agg(F.count("*").alias("_times"))
    rows = sample.select("sample_order", "turn_key").join(times, "turn_key", "left").join(ids, "turn_key", "left").join(taken.select("turn_key").distinct().withColumn("_taken", F.lit(True)), "turn_key", "left")
    error = F.when(F.col("_times") > 1, "TWICE").when(F.col("_n").isNull(), "MISSING").when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("_taken"), "TAKEN")
    return rows.withColumns({"error": error, "priority": -F.col("sample_order")}).withColumn("turn_id", F.when(F.col("error").isNull(), F.col("turn_id"))).drop("_times", "_n", "_taken")


def batch_accounts(batch: DataFrame, size: int, shown: int = 5) -> DataFrame:
    """One row: rows, errors by kind, the first missing keys in order, and ``usable``: as many rows as the sample has, numbered from 1 without gaps, no error."""
    kinds = ("TWICE", "MISSING", "AMBIGUOUS", "TAKEN")
    order = F.col("sample_order")
    row = batch.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("error") == k).alias(f"n_{k.lower()}") for k in kinds],
        (F.coalesce(F.min(order) == 1, F.lit(False)) & (F.max(order) == F.count("*")) & (F.count_distinct(order) == F.count("*"))).alias("_gapless"),
    )
    missing = batch.filter("error = 'MISSING'").orderBy("sample_order", "turn_key").limit(shown)
    first = missing.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_order", "turn_key"))), lambda s: s["turn_key"]), ",").alias("first_missing"))
    good = (F.col("n") == size) & F.col("_gapless") & (sum(F.col(f"n_{k.lower()}") for k in kinds) == 0)
    return row.crossJoin(first).withColumn("usable", good).drop("_gapless")  # one row and one row


def same_batch(batch: DataFrame, stored: DataFrame) -> bool:
    """Whether the tasks that are stored (sample_order, turn_key) are those of the sample, each in its place."""
    mine, theirs = (d.groupBy("sample_order", "turn_key").agg(F.count("*").alias("n")) for d in (batch, stored))
    return mine.select("sample_order", "turn_key", "n").exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()


def failure_counts(rows: DataFrame, by: str, categories: list[str]) -> DataFrame:
    """Per group every category with its failures, zero included; rows that are no success and of no known category are UNCLASSIFIED."""
    known = F.when(F.col("failure_category").isin(*categories), F.col("failure_category")).otherwise(UNCLASSIFIED)
    failed = rows.select(by, F.when(~F.col("status").eqNullSafe(F.lit("success")), known).alias("_c"))
    all_ = [*categories, UNCLASSIFIED]
    wide = failed.groupBy(by).agg(*[F.count_if(F.col("_c") == c).alias(c) for c in all_])
    return wide.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("failure_category"), F.col(c).alias("n")) for c in all_])).alias("_e")).select(by, "_e.*")
