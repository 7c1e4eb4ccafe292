"""Reconciliation and invariants: every check is a table of violations, and a report counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) of each."""
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check"), "violations") for n, d in checks.items()])


def turn_checks(fragments: DataFrame, folded: DataFrame, turns: DataFrame) -> dict[str, DataFrame]:
    """What must hold between fragments, their fold and the turns; each should be empty."""
    key = ["source_file", "sequence_number"]
    own = folded.filter("relation <> 'interjection'")
    first = own.filter("sequence_number = turn").select("source_file", F.col("turn").alias("first_fragment_sequence"))
    counted = own.groupBy("source_file", F.col("turn").alias("first_fragment_sequence")).agg(F.count("*").alias("n"))
    return {
        "fragment_not_folded": fragments.select(*key).join(folded.select(*key), key, "left_anti"),
        "fragment_folded_twice": folded.groupBy(*key).count().filter("count > 1"),
        "turn_without_first_fragment": turns.join(first, ["source_file", "first_fragment_sequence"], "left_anti"),
        "fragment_count_differs": turns.join(counted, ["source_file", "first_fragment_sequence"]).filter("n <> fragment_count"),
        "interjection_in_turn_text": own.filter("kind = 'I'"),
        "continuation_without_reason": folded.filter("kind = 'C' and reason is null"),
    }


def against_baseline(actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(check, expected, actual, same) for rows (check, violations) or any (check, number)."""
    name, value = actual.columns[:2]
    want = actual.sparkSession.createDataFrame(list(expected.items()), f"{name} string, expected bigint")
    both = want.join(actual, name, "full")
    return both.select(name, "expected", F.col(value).alias("actual"), F.col("expected").eqNullSafe(F.col(value)).alias("same"))


def year_summary(years: DataFrame, *parts: tuple[DataFrame, str, str]) -> DataFrame:
    """Years with a count column of each (table with a year, key, name); zero where a year has none."""
    for df, key, name in parts:
        years = years.join(df.groupBy("year").agg(F.count(key).alias(name)), "year", "left").fillna(0, [name])
    return years


def unpivoted(row: DataFrame) -> DataFrame:
    """A one-row summary as (measure, value)."""
    return row.unpivot([], row.columns, "measure", "value")
