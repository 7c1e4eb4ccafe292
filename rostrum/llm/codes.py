"""Vectors as short codes: each part of a vector by the nearest entry of that part's codebook.

Codebooks come of a few rounds of Lloyd's method on integers, so results are exact and don't depend on order.  They are maintained by
deltas: the table of the round before keeps each row's assignments, and the sums and counts of all entries go on from round to round; a
round adds and subtracts only the parts whose assignment changed.  Each task adds its own deltas up first, so a round sends one number for
each component of each entry and task, and what reaches the driver is as large as the codebooks.

Rows whose vector is null, or has a null or non-finite component, are dropped; so are those with a component of over 2^20, whose squared
distances would leave 64 bits, and those whose length isn't that of the first row (by id) with a length that the parts divide.  Rows that repeat
count each.  Of rows with the same id, the first entries take those with smaller components first; null ids come last.  With fewer rows
than entries, codebooks are shorter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.storage import written

PARTS, ENTRIES, ROUNDS, SCALE, MOST = 16, 64, 2, 256, float(1 << 20)
#: Rows whose distances are in memory at once.
ROWS = 2048


class Codes(NamedTuple):
    """rows: vec_id, label, code (a byte for each part), error.  book: (parts, entries, components).  moved: parts that each round reassigned."""

    rows: DataFrame
    book: np.ndarray
    moved: list[int]


def _binary(rows: np.ndarray) -> pa.Array:
    """An array of as many byte strings as there are rows."""
    n, width = len(rows), rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer vectors: the code of each part and the squared distances summed over parts.  Ties go to the lower index."""
    parts, _, width = book.shape
    code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for p in range(parts):
        d = ((x[:, None, p * width : (p + 1) * width] - book[None, p]) ** 2).sum(axis=2)
        code[:, p] = best = d.argmin(axis=1)
        error += d[np.arange(len(x)), best]
    return code, error


def usable(embeddings: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label and x, the integer components."""
    fine = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) <= MOST, F.lit(False)))
    rows = embeddings.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & fine)
    return rows.select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    spark = embeddings.sparkSession
    rows = usable(embeddings, parts, scale)
    firsts = lambda r: [x.x for x in r.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    first = firsts(rows)
    if any(len(v) != len(first[0]) for v in first):
        first = firsts(rows.filter(F.size("x") == len(first[0])))
    dims = len(first[0]) if first else parts
    width = dims // parts
    book = np.array(first, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    named = ", ".join(f"{c} {embeddings.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    state = rows.filter(F.size("x") == dims).withColumn("code", F.lit(None).cast("binary"))

    def assigned(state: DataFrame, book: np.ndarray) -> DataFrame:
        """The state with the code before as ``was``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                    x = batch.column("x")
                    listed = not pa.types.is_binary(x.type)
                    ints = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if listed else _matrix(x, "<i4", dims).astype(np.int64)
                    code, error = nearest(ints, book)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("vec_id"), batch.column("label"), _binary(ints.astype("<i4")) if listed else x, batch.column("code"), _binary(code), pa.array(error),
                    ], ["vec_id", "label", "x", "was", "code", "error"])

        return state.select("vec_id", "label", "x", "code").mapInArrow(run, f"{named}, x binary, was binary, code binary, error bigint")

    def deltas(state: DataFrame) -> DataFrame:
        """What parts with another code than before add to entries and take from them: part, entry, place (0: the count), change.  Part -1 has
        how many such parts there are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            change = np.zeros((parts, entries, width + 1), np.int64)
            moved = 0
            for batch in batches:
                x, code = _matrix(batch.column("x"), "<i4", dims), _matrix(batch.column("code"), "u1", parts)
                x = np.concatenate((np.ones((len(x), parts, 1), np.int64), x.reshape(-1, parts, width)), axis=2)
                old = batch.column("was").is_valid().to_numpy(zero_copy_only=False)
                was = np.zeros_like(code)
                was[old] = _matrix(batch.column("was").drop_null(), "u1", parts)
                for p in range(parts):
                    other = ~old | (was[:, p] != code[:, p])
                    moved += int(other.sum())
                    np.add.at(change[p], code[other, p], x[other, p])
                    np.subtract.at(change[p], was[other & old, p], x[other & old, p])
            at = np.argwhere(change)
            made = [*at.T, change[tuple(at.T)]]
            made = [np.append(c, v) for c, v in zip(made, (-1, 0, 0, moved))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in made], ["part", "entry", "place", "change"])

        changed = state.select("x", "was", "code").filter(~F.col("was").eqNullSafe(F.col("code")))
        return changed.mapInArrow(run, "part bigint, entry bigint, place bigint, change bigint")

    running, moved = None, [0]
    for _ in range(rounds if first else 0):
        state = written(assigned(state, book), "assigned")
        new = deltas(state) if running is None else running.unionByName(deltas(state))
        running = written(new.groupBy("part", "entry", "place").agg(F.sum("change").alias("change")), "sums")
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for part, entry, place, value in running.collect():  # as many rows as the codebooks have numbers
            if part < 0:
                moved.append(value)
            else:
                sums[part, entry, place] = value
        used = sums[:, : book.shape[1], :1]
        book = np.where(used > 0, sums[:, : book.shape[1], 1:] // np.maximum(used, 1), book)
    moved = np.diff(moved).tolist()
    if not first:
        return Codes(spark.createDataFrame([], f"{named}, code binary, error bigint"), book, moved)
    return Codes(assigned(state, book).select("vec_id", "label", "code", "error"), book, moved)


def digest(book: np.ndarray) -> str:
    """Of all entries' components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """label_error, the errors of a label's rows summed; null is a label.  The sums are written first, so that Spark knows their size: few
    labels are broadcast and no row is shuffled by its label."""
    rows = written(rows, "codes")
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
