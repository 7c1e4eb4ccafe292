"""Append-only logs: the state they leave, counts, existence, unions and reconciliation of sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: str, only: Column | None = None) -> DataFrame:
    """The last row of each key by ``order``, of those that hold ``only``.

    An aggregate, so rows of a hot key are reduced before the shuffle.
    """
    if only is not None:
        df = df.filter(only)
    rest = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(key, *[F.col("_top")[c].alias(c) for c in rest])


def latest_by_priority(df: DataFrame, key: str, kind: str, priorities: list[str], *order: str) -> DataFrame:
    """The row of each key whose kind comes first in ``priorities``, then the last by ``order``."""
    rank = reduce(lambda c, p: c.when(F.col(kind) == p[1], p[0]), enumerate(priorities), F.when(F.lit(False), 0)).otherwise(len(priorities))
    return latest(df.withColumn("_rank", -rank), key, "_rank", *order).drop("_rank")


def counts(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """All conditional counts in one pass."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def with_exists(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """Whether a row has a match, as a column."""
    return df.join(other.select(*on).distinct().withColumn("_there", F.lit(True)), on, "left").withColumn(name, F.col("_there").isNotNull()).drop("_there")


def outcomes(predictions: DataFrame, failures: DataFrame, kinds: tuple[str, str] = ("PREDICTION", "FAILURE")) -> DataFrame:
    """Two kinds of rows in one table; columns that one lacks are null."""
    return predictions.withColumn("outcome", F.lit(kinds[0])).unionByName(failures.withColumn("outcome", F.lit(kinds[1])), allowMissingColumns=True)


def reconcile(eligible: DataFrame, completed: DataFrame, terminal: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are eligible, done in each way, in several at once, outside, and remaining."""
    flags = [("eligible", eligible), ("completed", completed), ("terminal", terminal), ("active", active)]
    rows = reduce(DataFrame.unionByName, [d.select(key, F.lit(name).alias("_in")) for name, d in flags])
    per = rows.groupBy(key).agg(*[F.count_if(F.col("_in") == name).alias(name) for name, _ in flags])
    done = (F.col("completed") > 0).cast("int") + (F.col("terminal") > 0).cast("int") + (F.col("active") > 0).cast("int")
    there = F.col("eligible") > 0
    return per.agg(
        *[F.count_if(F.col(n) > 0).alias(f"n_{n}") for n, _ in flags],
        F.count_if(done > 1).alias("n_overlapping"), F.count_if(~there & (done > 0)).alias("n_outside"),
        F.count_if((F.col("completed") > 1) | (F.col("terminal") > 1)).alias("n_repeated"), F.count_if(there & (done == 0)).alias("n_remaining"),
    )


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, in the left only, in the right only."""
    sides = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full")
    return sides.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"),
        F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"),
    )


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def transitions(df: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Changes of state with whether the pair is allowed.  ``allowed`` is a fixed, small list."""
    w = W.partitionBy(key).orderBy(*order)
    moves = df.withColumn("from_state", F.lag(state).over(w)).filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
    pairs = df.sparkSession.createDataFrame(allowed, f"from_state string, {state} string").withColumn("_ok", F.lit(True))
    return moves.join(F.broadcast(pairs), ["from_state", state], "left").withColumn("allowed", F.col("_ok").isNotNull()).drop("_ok")


def overlay(original: DataFrame, attempts: DataFrame, key: str, attempt: str, status: str, columns: list[str]) -> DataFrame:
    """The latest successful attempt takes the place of the original result; all others keep theirs.  Of attempts of one number the one
    of the largest values counts."""
    best = attempts.filter(F.col(status) == "success").groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(attempt, *columns)).alias("_new"))
    df = original.join(best, key, "left").withColumn("recovered", F.col("_new").isNotNull())
    return df.withColumns({c: F.when(F.col("recovered"), F.col("_new")[c]).otherwise(F.col(c)) for c in columns}).drop("_new")


def revisions(saves: DataFrame, key: str, order: list[str], digest: str, status: str) -> DataFrame:
    """Saves of a record as numbered revisions; a draft equal to the save before it makes none."""
    w = W.partitionBy(key).orderBy(*order)
    same = F.col(digest).eqNullSafe(F.lag(digest).over(w)) & (F.col(status) == "draft") & (F.row_number().over(w) > 1)
    kept = saves.withColumn("_same", same).filter(~F.col("_same")).drop("_same")
    return kept.withColumn("revision", F.row_number().over(w))


def responses(plan: DataFrame, responses: DataFrame, key: str, index: str, ok: Column, failed: Column) -> DataFrame:
    """A status for every planned record and every response: success, provider_failure, invalid, missing, duplicate, unknown_key."""
    n = F.row_number().over(W.partitionBy(key).orderBy(index))
    said = responses.withColumns({"_n": n, "_ok": ok, "_failed": failed}).withColumn("_said", F.lit(True))
    both = plan.select(key).withColumn("_planned", F.lit(True)).join(said, key, "full")
    status = (
        F.when(F.col("_planned").isNull(), "unknown_key").when(F.col("_said").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
        .when(F.col("_failed"), "provider_failure").when(F.col("_ok"), "success").otherwise("invalid")
    )
    return both.withColumn("status", status).drop("_planned", "_n", "_ok", "_failed", "_said")


def conflicts(loaded: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that are there with another content."""
    return loaded.select(key, F.col(digest).alias("_old")).join(incoming.select(key, digest), key).filter(~F.col("_old").eqNullSafe(F.col(digest))).select(key)
