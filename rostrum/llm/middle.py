"""Fill-in-the-middle: prefix, middle and suffix of a text, reordered behind marks, so that a model learns to fill gaps.

Cuts fall between units, a run of letters A-Z or any other single character.  The offsets of units come from the Split pre-tokenizer of the
tokenizers library with each match by itself; nothing is trained.  How many offsets there are gives n, and the offset at a drawn rank gives
a cut.  A space is always a unit, so a text is asked for word by word, and words that repeat are asked for once.

A document's draws depend on its id and the seed only, so any executor gives the same rows again.  A text that holds a mark stays plain, so
every output can be undone.  A null text is empty, a null id draws as an empty one; rows that repeat have rows that repeat; texts of any
length are read whole, by stretches of ``PART`` characters.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.worker import held

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those that are transformed, and of a hundred of these, those with the suffix first.
CHANGED, SUFFIX_FIRST, SEED = 90, 20, 1
#: Characters of a stretch; words that a worker remembers, and the longest of them; rows of an output batch.
PART, REMEMBERED, LONGEST, BATCH = 1 << 20, 1_000_000, 64, 512


class Starts(dict):
    """Where the units of a word start, in code points, by word."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        super().__init__()
        self.split = Split(Regex(UNIT), "isolated")

    def __missing__(self, word: str) -> tuple[int, ...]:
        starts = tuple(a for _, (a, _) in self.split.pre_tokenize_str(word))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = starts
        return starts


class Units:
    """The units of a text: ``n``, and the code point where the unit of a rank starts."""

    def __init__(self, text: str, starts: Starts, part: int = PART):
        self.text, self.starts, self.at, self.before, self.n = text, starts, [0], [0], 0
        while True:
            cut = text.find(" ", self.at[-1] + part)
            self.n += sum(map(len, map(starts.__getitem__, words := self._words(self.at[-1], cut)))) + len(words) - 1
            if cut < 0:
                break
            self.at.append(cut)
            self.before.append(self.n)

    def _words(self, start: int, end: int) -> list[str]:
        return self.text[start : end if end >= 0 else None].split(" ")

    def start(self, rank: int) -> int:
        if rank == self.n:
            return len(self.text)
        k = bisect_right(self.before, rank) - 1
        words = self._words(self.at[k], self.at[k + 1] if k + 1 < len(self.at) else -1)
        ends = list(accumulate((len(self.starts[w]) + 1 for w in words), initial=self.before[k]))  # a space goes with the word before it
        w = bisect_right(ends, rank) - 1
        at = self.at[k] + sum(map(len, words[:w])) + w
        mine = self.starts[words[w]]
        return at + (mine[rank - ends[w]] if rank - ends[w] < len(mine) else len(words[w]))


def rearranged(text: str, key: str, starts: Starts, part: int = PART) -> tuple[int, str, int | None, int | None, str]:
    """n, form, characters of prefix and middle, output."""
    units = Units(text, starts, part) if text else None
    n = units.n if units else 0
    drawn = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= CHANGED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (units.start(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = held("units", UNIT, Starts)
        for whole in batches:
            for batch in (whole.slice(k, BATCH) for k in range(0, whole.num_rows, BATCH)):
                ids = batch.column("doc_id")
                keys = [f"{seed}:{'' if i is None else i}" for i in ids.to_pylist()]
                made = [rearranged(t or "", k, starts) for t, k in zip(batch.column("text").to_pylist(), keys)]
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*made), kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return documents.select("doc_id", "text").mapInArrow(run, made)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of."""
    between = lambda start, end: F.substring_index(F.substring_index(output, start, -1), end, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
