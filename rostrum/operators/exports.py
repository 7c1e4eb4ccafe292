"""Sinks: partitioned Parquet, CSV, JSON lines, and a manifest written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions.text import csv_cell, yes_no_unknown
from rostrum.operators.ordered import numbered


def write_by_year(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Parquet by year.  Rows of a year are spread by a hash of all columns, so that a large year is not one task's."""
    spread = df.repartition("year", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    spread.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("year").mode("errorifexists").parquet(path)


def plain(df: DataFrame) -> DataFrame:
    return df.select(*[csv_cell(F.col(n), kind).alias(n) for n, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, line_end: str = "\n") -> None:
    plain(df).write.option("header", True).option("escape", '"').option("lineSep", line_end).option("emptyValue", "").mode("errorifexists").csv(path)


def write_excel(df: DataFrame, path: str) -> None:
    """CSV as spreadsheets want it: parts that, joined in the order of their names, begin with a byte order mark and the names, once; lines
    end in CR LF, line ends in cells stay as they are, and an unknown truth value is ``unknown``.

    Lines are written as text: Spark's CSV writer puts its own line end into cells.
    """
    told = plain(df.select(*[yes_no_unknown(F.col(n)).alias(n) if kind == "boolean" else F.col(n) for n, kind in df.dtypes]))
    cells = lambda of: F.concat_ws(",", *[F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in of])
    head = df.sparkSession.range(0, 1, 1, 1).select(F.concat(F.lit("\ufeff"), cells([F.lit(n) for n in df.columns])).alias("value"))
    lines = head.union(told.select(cells([F.col(n) for n in told.columns]).alias("value")))
    lines.select(F.concat("value", F.lit("\r")).alias("value")).write.option("lineSep", "\n").mode("errorifexists").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).mode("errorifexists").json(path)


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """One line of JSON in a folder of its own; its presence says that what it describes is complete."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of every file below a folder, hashed where it is read; files are parts of a table, so each fits a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_gated(df: DataFrame, path: str, rows: int) -> None:
    """Parquet and CSV of a table, then checksums of both, and the manifest last; nothing after the first two if either, read back,
    hasn't the number of rows that was expected."""
    spark, forms = df.sparkSession, ("parquet", "csv")
    df.write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/parquet")
    write_csv(spark.read.schema(df.schema).parquet(f"{path}/parquet"), f"{path}/csv")
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/csv")
    for form, back in zip(forms, (spark.read.parquet(f"{path}/parquet"), csv)):
        if (n := back.count()) != rows:
            raise ValueError(f"{form} has {n} rows, not {rows}")
    both = [checksums(spark, f"{path}/{form}").withColumn("form", F.lit(form)) for form in forms]
    write_jsonl(both[0].unionByName(both[1]), f"{path}/checksums")
    write_manifest(spark, f"{path}/manifest", {"rows": rows, "columns": df.columns})


def canonical(turns: DataFrame, first_fragments: DataFrame, predictions: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per turn with its first fragment, its prediction and that one's latest review, whether or not there are any.

    Several predictions of a turn: the first by (run_id, prediction_id) is exported and the number is told.
    """
    w = W.partitionBy("turn_key")
    first = predictions.withColumns({"n_predictions": F.count("*").over(w), "_n": F.row_number().over(w.orderBy("run_id", "prediction_id"))}).filter("_n = 1").drop("_n")
    last = reviews.groupBy("prediction_id").agg(F.max_by("review_status", F.struct("reviewed_at", "review_id")).alias("review_status"))
    return (
        turns.join(first_fragments, "turn_key", "left").join(first, "turn_key", "left").join(last, "prediction_id", "left")
        .withColumn("n_predictions", F.coalesce("n_predictions", F.lit(0)))
    )


def catalogue(runs: DataFrame, predictions: DataFrame, reviews: DataFrame, refusals: DataFrame, terminal: tuple[str, ...] = ("accepted", "edited", "skipped")) -> DataFrame:
    """A row per run: predictions, those with a review that ended it and those without, and refusals; zero where there are none."""
    ended = reviews.filter(F.col("review_status").isin(*terminal)).select("prediction_id").distinct().withColumn("_ended", F.lit(True))
    own = predictions.join(ended, "prediction_id", "left").groupBy("run_id").agg(F.count("*").alias("prediction_count"), F.count_if(F.col("_ended").isNotNull()).alias("reviewed_count"))
    refused = refusals.groupBy("run_id").agg(F.count("*").alias("provider_refusal_count"))
    rows = runs.join(own, "run_id", "left").join(refused, "run_id", "left").fillna(0, ["prediction_count", "reviewed_count", "provider_refusal_count"])
    return rows.withColumn("unreviewed_count", F.col("prediction_count") - F.col("reviewed_count"))


def canonical_order(df: DataFrame, date: str, path: str, sequence: str, key: str) -> DataFrame:
    """Rows with ``corpus_order``, from 1: by date, path, sequence and key, strings by their bytes."""
    return numbered(df, [date, path, sequence, key], "corpus_order")
