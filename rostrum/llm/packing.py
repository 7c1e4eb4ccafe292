"""Token ids packed into rows of a fixed length, written as binary matrices.

Texts are encoded, those over the row length cut into pieces, and the pieces of a block placed by best-fit decreasing: the
longest first, each into the row with the least room that takes it, found with a segment tree over room sizes.  A block is what
one task reads until it has ``block`` tokens, so memory is bounded and no text is shuffled.  A row holds ``length`` ids
(little-endian, unused places 0), the cumulative lengths of its segments and the places where positions start at 0 again.
A null text is empty; an empty text has one segment of length 0.  Repeated rows each have their segments.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import tokens
from rostrum.llm.worker import held

LENGTH, BLOCK, BATCH, PART = 2048, 4_000_000, 512, 65_536


class RoomTree:
    """Rows by room left.  A node tells whether any room size below it has a row."""

    def __init__(self, most: int):
        self.size = 1 << (most + 1).bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row of the least room of at least ``need``, removed; and its room."""
        i = need + self.size
        while not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i == 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while i and not (i < self.size and (self.tree[2 * i] or self.tree[2 * i + 1])):
                self.tree[i] = 0
                i >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes into lengths, each in the order of placing; ties in length go by index."""
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, room = found
        rows[row].append(k)
        tree.put(row, room - lengths[k])
    return rows


class Encoder:
    """Ids of a text, as bytes, by byte-level BPE.  Special strings in a text are ordinary text.

    Texts of over ``part`` characters are encoded in parts, cut only where a pre-token starts whatever surrounds it (see tokens.py), so
    ids are those of the whole text.  A part goes on to the next such place, however far that is.
    """

    def __init__(self, ranks: str, part: int = PART):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(str.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=tokens.PRETOKEN.pattern, mergeable_ranks=table, special_tokens={})
        self.kind, self.part = np.dtype("<u2" if len(table) <= 1 << 16 else "<u4"), part

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.part:
            cut = tokens.BOUNDARY.search(text, at + self.part)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def __call__(self, text: str) -> bytes:
        return b"".join(np.array(self.bpe.encode_ordinary(p), self.kind).tobytes() for p in self.parts(text))

    def decode(self, ids: bytes) -> str:
        return self.bpe.decode_bytes(np.frombuffer(ids, self.kind).tolist()).decode()


def ranks_file(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Path(path).read_text()


ROW = "row string, ids binary, id_bytes int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{id}>, pieces array<int>"


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Packed rows: row (its name), ids, id_bytes (bytes of an id), cu_seqlens, position_resets, and doc_ids and pieces by segment."""
    sent = documents.sparkSession.sparkContext.broadcast(ranks_file(path))
    kind = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held("encoder", sent.value, lambda: Encoder(sent.value))
        width, task, blocks = encode.kind.itemsize, TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = best_fit_decreasing([len(x[2]) // width for x in waiting], length)
            for i in range(0, len(rows), BATCH):
                part = [[waiting[k] for k in row] for row in rows[i : i + BATCH]]
                ends = [np.cumsum([0, *(len(x[2]) // width for x in row)]).tolist() for row in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{task}-{blocks}-{i + k}" for k in range(len(part))]),
                    pa.array([b"".join(x[2] for x in row).ljust(length * width, b"\0") for row in part], pa.binary()),
                    pa.array([width] * len(part), pa.int32()),
                    pa.array(ends, pa.list_(pa.int32())), pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                    pa.array([[x[0] for x in row] for row in part], pa.list_(id_type)), pa.array([[x[1] for x in row] for row in part], pa.list_(pa.int32())),
                ], ["row", "ids", "id_bytes", "cu_seqlens", "position_resets", "doc_ids", "pieces"])

        n = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "")
                for p, at in enumerate(range(0, max(len(ids), 1), length * width)):
                    waiting.append((doc_id, p, ids[at : at + length * width]))
                    n += len(waiting[-1][2]) // width
                    if n >= block:
                        yield from done()
                        waiting, n, blocks = [], 0, blocks + 1
        if waiting:
            yield from done()

    return documents.select("doc_id", "text").mapInArrow(run, ROW.format(id=kind.simpleString()))


def segments(packed: DataFrame) -> DataFrame:
    """A row per segment, read from the matrices: doc_id, piece, row, start, length, ids (bytes)."""
    each = packed.select("row", "ids", "id_bytes", "cu_seqlens", F.posexplode_outer(F.arrays_zip("doc_ids", "pieces", "position_resets")).alias("k", "s"))
    start, length = F.col("s.position_resets"), F.get("cu_seqlens", F.col("k") + 1) - F.get("cu_seqlens", "k")
    return each.select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), "row", start.alias("start"), length.alias("length"),
        F.substring("ids", start * F.col("id_bytes") + 1, length * F.col("id_bytes")).alias("ids"),
    )
