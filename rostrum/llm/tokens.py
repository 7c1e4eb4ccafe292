"""Token counts of whole texts, however long.

A text is cut into chunks that overlap; each is encoded with offsets.  Two chunks are spliced at a place in their overlap where
both have a token boundary and the boundary is stable: a character that is no white space, then one that is.  The pre-token
rule of byte-level BPE takes white space only at the start of a pre-token or by itself, so a new pre-token starts there whatever
surrounds it.  If an overlap has no such place, it is widened, in the end to the rest of the text.

Short texts are counted by pre-token, each distinct one encoded by the library once and remembered, if all their characters are
of blocks where this rule and the library's agree on every code point; others go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.worker import held

#: Characters of a chunk and of an overlap at first; pre-tokens that a worker remembers.
CHUNK, OVERLAP, REMEMBERED = 65_536, 256, 1_000_000
#: The pre-token rule of the public byte-level BPE vocabulary (a fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
OTHER = regex.compile(r"[^\u0000-\u052F\u2000-\u206F\u20A0-\u20BF\u3000-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3]")
BOUNDARY = regex.compile(r"(?<=\S)\s")


def load(definition: str):
    os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def specials(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def spliced(encode: Callable[[str], list[tuple[int, int]]], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the text.  encode: the spans of a string's tokens."""
    total, start = 0, 0
    while True:
        end, wide = start + chunk, overlap
        while True:
            if end + wide >= len(text):
                return total + len(encode(text[start:]))
            spans = encode(text[start : end + wide])
            after = encode(text[end - wide : end + wide]) if end - wide > start else []
            mine, others = {a + start for a, _ in spans}, {a + end - wide for a, _ in after}
            at = next((m.start() for m in BOUNDARY.finditer(text, max(start + 1, end - wide + 1), end + wide - 1) if m.start() in mine and m.start() in others), None)
            if at is not None:
                break
            wide *= 2
        total += sum(a + start < at for a, _ in spans)
        start = at


class Counter:
    """Tokens of texts by a tokenizer's definition."""

    def __init__(self, definition: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = load(definition), chunk, overlap
        self.special = specials(self.tokenizer)
        self.memory: dict[str, int] = {}

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def new(self, pretoken: str) -> int:
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        n = self.memory[pretoken] = len(self.tokenizer.encode(pretoken, add_special_tokens=False))
        return n

    def __call__(self, text: str) -> int:
        if len(text) > self.chunk:
            return spliced(self.spans, text, self.chunk, self.overlap)
        if OTHER.search(text) or any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        get = self.memory.get
        parts = PRETOKEN.findall(text)
        return sum(n if n is not None else self.new(p) for p, n in zip(parts, map(get, parts)))


def definition(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text()


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit.  A null text is empty.  The tokenizer's file is read on the
    driver and sent to the executors (some MB, whatever the corpus)."""
    sent = documents.sparkSession.sparkContext.broadcast(definition(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held("counter", sent.value, lambda: Counter(sent.value))
        for batch in batches:
            n = [count(text) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
