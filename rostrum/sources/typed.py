"""Loads of string tables into types, with a ledger of every cell that doesn't fit and of keys that resolve to nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of a fragment's columns that aren't strings (a fixed value).
FRAGMENT = {
    "sequence_number": "int", "date": "date", "calculated_word_count": "int",
    **dict.fromkeys((
        "is_presiding_officer", "is_collective_speaker", "is_procedural", "is_ceremonial", "is_division_related", "is_question_time", "is_question", "is_answer", "is_interjection", "is_continuation_merged",
        "is_orphan_continuation", "has_known_speaker", "eligible_50_words", "eligible_100_words", "eligible_main_analysis",
    ), "boolean"),
}


def typed(df: DataFrame, kinds: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``kinds`` cast, all in one pass, and ``bad_cells``: column, value and reason (``NOT_<TYPE>`` or ``REQUIRED``) of those that
    don't fit.  An empty cell is null."""
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    cell = lambda c, reason, bad: F.when(bad, F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(reason).alias("reason")))
    bad = [cell(c, f"NOT_{kind.upper()}", given(c).isNotNull() & given(c).try_cast(kind).isNull()) for c, kind in kinds.items()]
    bad += [cell(c, "REQUIRED", given(c).isNull()) for c in required]
    cells = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<struct<column:string,value:string,reason:string>>")
    return df.withColumns({"bad_cells": cells} | {c: given(c).try_cast(kind) for c, kind in kinds.items()})


def ledger(rows: DataFrame, key: str) -> DataFrame:
    """A row per cell that didn't fit: key, column, value, reason."""
    return rows.filter(F.size("bad_cells") > 0).select(key, F.explode("bad_cells").alias("c")).select(key, "c.column", "c.value", "c.reason")


def resolved(rows: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each column a parent's key, whether it is there, as ``<column>_found``; null where the column is null.  Keys of parents count once."""
    for column, (parent, key) in parents.items():
        there = parent.select(F.col(key).alias(column)).distinct().withColumn(f"{column}_found", F.lit(True))
        rows = rows.join(there, column, "left").withColumn(f"{column}_found", F.when(F.col(column).isNotNull(), F.coalesce(f"{column}_found", F.lit(False))))
    return rows


def accounts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: what was read, what can be loaded, cells and rows that don't fit, and of each key how many are resolved, unresolved or absent."""
    fits: Column = reduce(Column.__and__, [F.coalesce(F.col(f"{k}_found"), F.lit(True)) for k in keys], F.size("bad_cells") == 0)
    out = [F.count("*").alias("n_read"), F.count_if(fits).alias("n_loaded"), F.count_if(F.size("bad_cells") > 0).alias("n_bad_rows"), F.coalesce(F.sum(F.size("bad_cells")), F.lit(0)).alias("n_bad_cells")]
    for k in keys:
        found = F.col(f"{k}_found")
        out += [F.count_if(found).alias(f"{k}_resolved"), F.count_if(~found).alias(f"{k}_unresolved"), F.count_if(found.isNull()).alias(f"{k}_absent")]
    return rows.agg(*out)
