"""Documents packed into as few sequences as can be, with a certificate.

A task reads documents until it has ``block`` tokens and packs them by best-fit decreasing.  Dual-feasible functions give each length a weight
such that the weights of whatever fits into one sequence are at most 1, so the sum of all weights, rounded up, bounds how many sequences
any packing needs.  A block whose sequences meet the unrounded bound is certified and closed.  One with a gap opens its emptiest sequences,
among those whose weights are less than 1; open documents of all blocks are exchanged, packed anew in blocks, and so on, until nothing is open
or all that is open met in one block.  Only open documents move, a few hundredths of a block.

Rows of each round are written once to the shared folder, so a lost executor repeats its own tasks, with the same names of sequences.

A null text is empty; an empty text has the end mark alone.  Rows that repeat, with null ids too, are packed each by itself.  Texts of any
length are read whole, by stretches; only documents longer than a sequence are cut.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from pathlib import Path
from struct import pack as pack_numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.packing import best_fit_decreasing
from rostrum.llm.storage import shared_path
from rostrum.llm.tokens import load
from rostrum.llm.worker import give_back, held

#: Tokens of a sequence and of a block; most sequences that a block opens; the id behind each document.
LENGTH, BLOCK, OPEN, END = 2048, 4_000_000, 64, 0
#: Characters of a stretch; words that a worker remembers, and the longest of them; rows of an output batch; stages of the rounding functions.
#: TOGETHER: bytes of texts whose words are found at once.
PART, REMEMBERED, LONGEST, BATCH, STAGES = 1 << 20, 1_000_000, 64, 512, 24
TOGETHER = 1 << 22
#: White space of the vocabulary's rules (a fixed value): Unicode's, without the four separators U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
UNUSUAL = re.compile("[\x1c-\x1f]")
#: The rule that splits words (a fixed value), and the words for whose characters it and lower-casing agree with the library's at every code point.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile("[!-~\u00c0-\u024f]+")
#: The same in Arrow: the rule, whose matches end at the added space, and a character that isn't plain, or that Arrow lower-cases differently (U+0130).
CUT, NOT_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\pL\pN]+", "[^!-~\u00c0-\u012f\u0131-\u024f]"


class Encoder(dict):
    """Ids of texts, as little-endian unsigned 32-bit numbers.

    The vocabulary's rules drop white space and never look across it, so a text's ids are those of its words, and words that repeat are
    encoded once.  Special strings are found inside words, as in whole texts: they hold no white space.

    Many texts together are split by Arrow, their distinct plain words cut into pre-tokens, and only distinct pre-tokens and other words looked up.
    A lower-case pre-token has the same ids as pre-token and as word, so both are remembered in one place.
    """

    def __init__(self, definition: str, part: int = PART):
        super().__init__()
        self.tokenizer, self.part = load(definition), part
        self.model, self.special = self.tokenizer.model, tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        printable = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]  # bytes that stand for themselves; others follow 255
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printable)}

    def ids(self, word: str) -> list[int]:
        """A word of plain characters goes to the library's model as pre-tokens, others to the library whole."""
        if word.isascii() and word.isalpha():  # the usual word, sooner
            return [t.id for t in self.model.tokenize(word.lower())]
        if PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            parts = PRETOKEN.findall(word.lower())
            if not word.isascii():
                parts = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
            return [t.id for p in parts for t in self.model.tokenize(p)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        ids = pack_numbers(f"<{len(found := self.ids(word))}I", *found)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = SPACE.search(text, at + self.part)
            part = text[at : cut.start() if cut else None]
            out.append(b"".join(map(self.__getitem__, SPACE.split(part) if UNUSUAL.search(part) else part.split())))
            at = cut.start() if cut else len(text)
        return b"".join(out)

    def all(self, texts: pa.Array, together: int = TOGETHER) -> Iterator[bytes]:
        """The ids of each text, in order.  Long texts, and those with separators that are no white space here, go by themselves."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        alone = (sizes > self.part) | pc.match_substring_regex(texts, UNUSUAL.pattern).to_numpy(zero_copy_only=False)
        stops, ends, at = np.append(np.flatnonzero(alone), len(texts)), np.cumsum(sizes), 0
        while at < len(texts):
            if alone[at]:
                yield self(texts[at].as_py())
                at += 1
                continue
            full = np.searchsorted(ends, ends[at] - sizes[at] + together, "right")
            to = int(min(max(full, at + 1), stops[np.searchsorted(stops, at)]))
            lists = pc.utf8_split_whitespace(texts[at:to])
            words = lists.flatten().dictionary_encode()
            data, starts = _laid_out(self._words(words.dictionary).take(words.indices))
            marks = starts[lists.offsets.to_numpy()].tolist()
            yield from (bytes(data[a:b]) for a, b in zip(marks, marks[1:]))
            at = to

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of words, looked up by distinct pre-token, or by word where one isn't plain."""
        whole = pc.match_substring_regex(words, NOT_PLAIN)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(words, s))
        cut = pc.if_else(whole, words, pc.replace_substring_regex(pc.utf8_lower(words), CUT, r"\0 "))
        lists = pc.split_pattern(cut, " ")
        parts = lists.flatten().dictionary_encode()
        ids = pa.array(list(map(self.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary())
        data, starts = _laid_out(ids.take(parts.indices))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(starts[lists.offsets.to_numpy()]), pa.py_buffer(data)])


def _laid_out(ids: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """All bytes, one after the other, and where each value starts, the end added."""
    _, starts, data = ids.buffers()
    return memoryview(data or b""), np.frombuffer(starts, np.int64)[ids.offset : ids.offset + len(ids) + 1]


def definition(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text()


def _weights(k: int, capacity: int) -> tuple[np.ndarray, int]:
    """A dual-feasible function by length, times a number; that number.  0: the length itself.  k: lengths rounded down to (k+1)ths, kept where they are such."""
    x = np.arange(capacity + 1, dtype=np.int64)
    if k == 0:
        return x, capacity
    return np.where(x * (k + 1) % capacity == 0, x * k, x * (k + 1) // capacity * capacity), k * capacity


def bound(counts: np.ndarray, stages: int = STAGES) -> tuple[Fraction, np.ndarray, int]:
    """The best bound on sequences for so many documents of each length, and its weights by length with their unit.

    Functions: those of ``_weights``, each also with lengths under a threshold left out and those that fit with no longer ones counted whole.
    """
    capacity = len(counts) - 1
    low = np.arange(capacity // 2 + 1)
    best = Fraction(0), np.zeros(capacity + 1, np.int64), 1
    for k in range(stages + 1):
        w, unit = _weights(k, capacity)
        weighed, n = np.concatenate(([0], np.cumsum(w * counts))), np.concatenate(([0], np.cumsum(counts)))
        totals = weighed[capacity - low + 1] - weighed[low] + unit * (n[-1] - n[capacity - low + 1])
        e = int(totals.argmax())
        if (found := Fraction(int(totals[e]), unit)) > best[0]:
            x = np.arange(capacity + 1)
            best = found, np.where(x > capacity - e, unit, np.where(x < e, 0, w)), unit
    return best


def opened(lengths: np.ndarray, rows: list[list[int]], capacity: int, most: int) -> set[int]:
    """Sequences that a block opens: the emptiest of those under weight 1, if its number isn't the unrounded bound."""
    least, w, unit = bound(np.bincount(lengths, minlength=capacity + 1))
    if len(rows) == least:
        return set()
    light = [(int(lengths[row].sum()), k) for k, row in enumerate(rows) if w[lengths[row]].sum() < unit]
    return {k for _, k in sorted(light)[: min(most, len(rows) // 4 + 1)]}


ROW = "doc_id {id}, piece int, start bigint, length bigint, ids binary, home bigint, sequence_id bigint, offset bigint, open int"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _blocks(pieces: Iterator[tuple], kind: pa.DataType, turn: int, capacity: int, block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces (doc_id, piece, start, length, ids) packed block by block."""
    first = turn << 58 | TaskContext.get().partitionId() << 32
    waiting, n, used, home = [], 0, 0, 0

    def packed() -> Iterator[pa.RecordBatch]:
        lengths = np.array([x[3] for x in waiting], np.int64)
        rows = best_fit_decreasing(lengths.tolist(), capacity)
        loose = opened(lengths, rows, capacity, most)
        for k in range(0, len(rows), BATCH):
            part = [(s, i) for s in range(k, min(k + BATCH, len(rows))) for i in rows[s]]
            offsets = [int(o) for s in range(k, min(k + BATCH, len(rows))) for o in np.cumsum([0, *lengths[rows[s]][:-1]])]
            cols = [[waiting[i][c] for _, i in part] for c in range(5)]
            cols += [[first + home] * len(part), [first + used + s for s, _ in part], offsets, [int(s in loose) for s, _ in part]]
            kinds = kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], NAMES)
        return len(rows)

    for piece in pieces:
        waiting.append(piece)
        n += piece[3]
        if n >= block:
            used += yield from packed()
            waiting, n, home = [], 0, home + 1
    if waiting:
        yield from packed()


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH, block: int = BLOCK, most: int = OPEN) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids, home (its block), sequence_id, offset."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(definition(path))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode, end = held("words", sent.value, lambda: Encoder(sent.value)), np.array([END], "<u4").tobytes()
        batches = iter(batches)
        if (ahead := next(batches, None)) is None:
            return

        def pieces() -> Iterator[tuple]:
            for batch in (b for some in ([ahead], batches) for b in some):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.all(batch.column("text"))):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        yield doc_id, p, at // 4, len(part) // 4, part

        yield from _blocks(pieces(), ahead.schema.field("doc_id").type, 0, length, block, most)

    def again(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = iter(batches)
            if (ahead := next(batches, None)) is None:
                return
            rows = (r for some in ([ahead], batches) for b in some for r in zip(*(b.column(c).to_pylist() for c in NAMES[:5])))
            yield from _blocks(rows, ahead.schema.field("doc_id").type, turn, length, block, most)

        return run

    def kept(rows: DataFrame) -> DataFrame:
        rows.write.partitionBy("open").parquet(at := shared_path(spark, "packed"))
        return spark.read.schema(rows.schema).parquet(at)

    table, turn, parts = kept(documents.select("doc_id", "text").mapInArrow(encoded, ROW.format(id=kind))), 0, []
    while True:
        n, homes = table.filter("open = 1").agg(F.coalesce(F.sum("length"), F.lit(0)), F.countDistinct("home")).first()
        tasks = math.ceil(n / block)
        if tasks >= homes or turn == 31:  # nothing is open, or no block would meet another one
            parts.append(table)
            break
        parts.append(table.filter("open = 0"))
        turn += 1
        table = kept(table.filter("open = 1").repartition(tasks).mapInArrow(again(turn), ROW.format(id=kind)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop("open")


def certificate(packed: DataFrame, length: int = LENGTH) -> tuple[int, int]:
    """How many sequences there are, and how many there must be: the bound for all lengths together, of which there are ``length`` at most."""
    counts = np.zeros(length + 1, np.int64)
    for size, n in packed.groupBy("length").count().collect():
        counts[size] = n
    return packed.select("sequence_id").distinct().count(), math.ceil(bound(counts)[0])
