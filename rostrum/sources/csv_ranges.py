"""CSV with line ends inside quotes, read by many tasks to a file.

Whether a place stands inside quotes depends on all quotes before it, but only on whether their number is odd: a doubled quote changes
nothing.  So ranges of bytes are counted first, the parities of a file's ranges are added up in order, and then each range, knowing its state,
finds the first record that starts in it and reads on until the last one ends.  Bytes are read twice and nothing is shuffled but one row a range.

Quotes stand around cells and doubled within them (RFC 4180); lines end in LF or CRLF; texts are UTF-8, a byte order mark is skipped.  Cells
that are empty without quotes are null.  A row with fewer cells has nulls, of one with more the rest is dropped.  Every file has a header.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.storage import settled

#: Bytes of a range, of a read, and rows of an output batch.
SPLIT, READ, BATCH = 64 << 20, 1 << 20, 4096


def opened(path: str) -> pa.NativeFile:
    system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(place)


def next_record(file: pa.NativeFile, at: int, quoted: bool, size: int) -> int:
    """The place after the first line end outside quotes from ``at`` on, or the file's end.  ``quoted``: the state before ``at``."""
    while at < size:
        data, k = file.read_at(min(READ, size - at), at), 0
        while True:
            quote = data.find(b'"', k)
            if not quoted and (end := data.find(b"\n", k, quote if quote >= 0 else len(data))) >= 0:
                return at + end + 1
            if quote < 0:
                break
            quoted, k = not quoted, quote + 1
        at += len(data)
    return size


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            with opened(path) as file:
                counts.append(sum(file.read_at(min(READ, end - at), at).count(b'"') for at in range(start, end, READ)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "quotes"])


def ranges(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, start, end, size, and whether the range starts and ends inside quotes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    cut = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"), F.col("length").alias("size"))
    cut = cut.withColumn("end", F.least(F.col("start") + split, "size")).repartition(F.col("path"), F.col("start"))
    counted = settled(cut.mapInArrow(_quotes, "path string, start bigint, size bigint, end bigint, quotes bigint"))
    upto = F.sum("quotes").over(W.partitionBy("path").orderBy("start"))
    return counted.select("path", "start", "end", "size", ((upto - F.col("quotes")) % 2 == 1).alias("quoted"), (upto % 2 == 1).alias("quoted_end"))


def csv_frame(spark: SparkSession, path: str, columns: list[str], required: list[str], split: int = SPLIT) -> DataFrame:
    """The required columns of the CSV files of a path, as strings."""
    if missing := set(required) - set(columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    wanted = [columns.index(c) for c in required]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    # a record starts at the range's start if a line end outside quotes stands before it
                    first = 0 if r["start"] == 0 else next_record(file, r["start"] - 1, r["quoted"], r["size"]) if file.read_at(1, r["start"] - 1) == b"\n" else next_record(file, r["start"], r["quoted"], r["size"])
                    last = r["size"] if r["end"] == r["size"] else next_record(file, r["end"] - 1, r["quoted_end"], r["size"]) if file.read_at(1, r["end"] - 1) == b"\n" else next_record(file, r["end"], r["quoted_end"], r["size"])
                    text = file.read_at(max(last - first, 0), first).decode("utf-8-sig" if first == 0 else "utf-8")
                reader = csv.reader(io.StringIO(text, newline=""), quoting=csv.QUOTE_NOTNULL)
                if first == 0 and (header := next(reader, None)) is not None and header != columns:
                    raise ValueError(f"{r['path']} has the columns {header}")
                waiting: list[list[str | None]] = []
                for cells in reader:
                    if cells:
                        waiting.append([cells[k] if k < len(cells) else None for k in wanted])
                    if len(waiting) >= BATCH:
                        yield made(waiting)
                        waiting = []
                if waiting:
                    yield made(waiting)

    def made(cells: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*cells)], required)

    return ranges(spark, path, split).repartition(F.col("path"), F.col("start")).mapInArrow(rows, ", ".join(f"`{c}` string" for c in required))
