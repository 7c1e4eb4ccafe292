"""Reviews, adjudication, attempts and campaigns: what append-only tables of human and model labels say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.operators import metrics
from rostrum.operators.events import latest


def current_reviews(predictions: DataFrame, reviews: DataFrame, key: str, *order: str) -> DataFrame:
    """Predictions with three views of their log: the last review, the last that made a revision, the last flag."""
    views = {"last": None, "revised": F.col("revision_id").isNotNull(), "flagged": F.col("status") == "flagged"}
    for name, only in views.items():
        top = latest(reviews, key, *order, only=only).select(key, F.col("status").alias(f"{name}_status"), F.col("review_id").alias(f"{name}_review"))
        predictions = predictions.join(top, key, "left")
    return predictions


def review_totals(current: DataFrame, by: list[str]) -> DataFrame:
    status = F.col("last_status")
    return current.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(status.isNotNull() & (status != "skipped")).alias("reviewed"), F.count_if(status == "accepted").alias("accepted"), F.count_if(status == "edited").alias("edited"),
        F.count_if(F.col("flagged_status").isNotNull()).alias("flagged"), F.count_if(status.isNull()).alias("unreviewed"),
    )


def inconsistent(edits: DataFrame, status: str, before: list[str], after: list[str]) -> DataFrame:
    """Reviews that say edited and changed nothing, or accepted and changed something."""
    same = F.lit(True)
    for b, a in zip(before, after, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(a))
    return edits.filter(((F.col(status) == "edited") & same) | ((F.col(status) == "accepted") & ~same))


def changed_fields(pairs: dict[str, tuple[str, str]]) -> Column:
    """Sorted names of the fields that differ."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.col(b).eqNullSafe(F.col(a)), n) for n, (b, a) in pairs.items()])))


def adjudicated(df: DataFrame, model: str, other: str, ruling: str) -> DataFrame:
    """Adds ``reference``: the ruling, or what both models said; rows without either drop out."""
    agreed = F.when(F.col(model).eqNullSafe(F.col(other)), F.col(model))
    return df.withColumn("reference", F.coalesce(F.col(ruling), agreed)).filter("reference is not null")


def attempts(history: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Per key: attempts in order, joined; their number; whether every one was refused; and the last status."""
    ordered = F.array_sort(F.collect_list(F.struct(order, status)))
    return history.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda x: x[status]), ">").alias("history"), F.count("*").alias("attempts"),
        F.bool_and(F.col(status) == "refused").alias("all_refused"), F.max_by(status, order).alias("last_status"),
    )


def recovery_bucket(status: Column, tries: Column, most: int) -> Column:
    return (
        F.when(status == "success", "DONE").when(status == "refused", "TERMINAL_REFUSAL").when(tries >= most, "ATTEMPTS_EXHAUSTED")
        .when(status.isin("invalid", "failed", "missing"), "ELIGIBLE").otherwise("UNKNOWN")
    )


def workflow(status: Column, submitted: Column, skipped: Column) -> Column:
    return F.when(skipped, "skipped").when(submitted, "completed").when(status == "draft", "in_progress").otherwise("to_annotate")


def quota_left(used: Column, ceiling: int, safety: float, unknown: Column) -> Column:
    """Tokens that may still be submitted: none while a job of unknown size is active."""
    return F.when(unknown > 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(F.lit(ceiling) * F.lit(safety)) - used)).cast("long")


def compared(a: DataFrame, b: DataFrame, key: str, truth: str, said: str) -> DataFrame:
    """One row: of two runs over the same records, accuracy of each, the difference, disagreements, and a verdict."""
    both = a.select(key, truth, F.col(said).alias("_a")).join(b.select(key, F.col(said).alias("_b")), key)
    ok = lambda c: F.count_if(F.col(c).eqNullSafe(F.col(truth)))
    t = both.agg(F.count("*").alias("n"), ok("_a").alias("a_correct"), ok("_b").alias("b_correct"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("disagreements"))
    delta = metrics.ratio(F.col("b_correct") - F.col("a_correct"), F.col("n"))
    return t.withColumns({"delta": delta, "verdict": F.when(delta > 0, "IMPROVED").when(delta < 0, "REGRESSED").otherwise("UNCHANGED")})


def named(df: DataFrame, codes: str, names: DataFrame, code: str, name: str, out: str) -> DataFrame:
    """Codes of a list as readable names, in the list's order; codes without a name stay.  ``names`` is a code book."""
    book = F.broadcast(names.agg(F.map_from_entries(F.collect_list(F.struct(code, name))).alias("_book")))
    return df.crossJoin(book).withColumn(out, F.transform(codes, lambda c: F.coalesce(F.element_at("_book", c), c))).drop("_book")


def unknown_values(df: DataFrame, value: str, known: DataFrame, at: str) -> DataFrame:
    """Values that a table of known ones lacks: count and first place."""
    return df.join(known.select(value), value, "left_anti").groupBy(value).agg(F.count("*").alias("n"), F.min(at).alias("first"))


def gapless(df: DataFrame, partition: str, order: str) -> DataFrame:
    """Per partition: is the numbering gapless from its least value."""
    return df.groupBy(partition).agg(((F.max(order) - F.min(order) + 1 == F.count("*")) & (F.countDistinct(order) == F.count("*"))).alias("gapless"))


def zipped(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two lists side by side as rows with their place, from 0."""
    return df.select("*", F.posexplode(F.arrays_zip(first, second)).alias("place", "_z")).select("*", F.col("_z")[first].alias("a"), F.col("_z")[second].alias("b")).drop("_z", first, second)


def with_first_fragment(turns: DataFrame, fragments: DataFrame, columns: list[str]) -> DataFrame:
    """Turns with what they inherit from their first fragment; both keyed by file and sequence."""
    own = fragments.select("source_file", F.col("sequence_number").alias("first_fragment_sequence"), *columns)
    return turns.join(own, ["source_file", "first_fragment_sequence"])


def top_per(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
