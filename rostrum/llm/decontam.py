"""Benchmark decontamination: passages of benchmark items within an edit distance, found by CGK embedding and LSH.

Words are runs of letters and digits, in lower case; those of no benchmark item are one symbol.  The CGK walk writes the symbol at
its place, then moves on by one or stays, as a random function of step and symbol says; it is the same for all texts, so strings
at a small edit distance get embeddings at a small Hamming distance.  LSH samples places of the embedding.

Hamming distances of embeddings grow with the square of the edits, so long items are looked up by parts: an item of over
``LONGEST`` words is cut into parts of nearly equal length that cover it, none of more words than that.  Of a passage within
(1 - ``SIMILARITY``) times the item's words, some part has no more than its own share of the edits.  Windows are of the part's size
class; a part's windows start at its first words, and those of documents at every ``stride``-th word, so that one lines up.  Where
keys meet, the edit distance of the whole item to the passage is computed exactly, and up to its share of edits is a hit.

Items share passages, such as instructions, and then keys.  Of the items of such a key only those are looked at that can be there: an item
with more rare words than it may have edits has one of them in any passage within the distance, so it is looked up by those.

Null and empty texts, and items without words, have no hit.  Repeated rows each give theirs.  A window that runs over its text's end
reads a symbol of its own there, so what is found in a text depends on that text alone.  Long texts are read as a whole by one
task; the work in them is in proportion to their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.simhash import mixed

WORD = re.compile(r"[^\W_]+")
SIMILARITY, STRIDE = 0.8, 4
#: Walks, LSH keys of each and sampled places of a key.  Recall of passages with a fifth of their words edited is measured in tests.
WALKS, KEYS, SAMPLED = 4, 9, 4
#: Words of a part at most.
LONGEST = 32
#: Items whose windows share a key, from which on only those are looked at that have a rare word nearby, and words between such looks.
SHARED, NEARBY = 8, 64
#: Size classes: a part's windows have the largest that leaves room for all its starts.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Words of the benchmark that are searched for at a time, which bounds what is sent to the executors; words of documents looked at
#: at once.
AT_A_TIME, AT_ONCE = 200_000, 400_000
LOW = np.uint64((1 << 20) - 1)
#: The symbol past a text's end; words are numbered from 1, and 0 is a word of no item.
PAST = np.uint64(1 << 63)


class Items:
    """Benchmark items as symbols, with the sorted LSH keys of their parts' windows.  rows: (item_id, text)."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float = SIMILARITY):
        self.symbol: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            if words := WORD.findall((text or "").lower()):
                self.ids.append(item_id)
                self.words.append([self.symbol.setdefault(w, len(self.symbol) + 1) for w in words])
        share = lambda n: int((1 - similarity) * n + 1e-9)
        self.most = [share(len(w)) for w in self.words]
        self.masks = [{} for _ in self.words]
        for m, words in zip(self.masks, self.words):
            for i, s in enumerate(words):
                m[s] = m.get(s, 0) | 1 << i
        in_items = np.bincount([s for w in self.words for s in set(w)], minlength=len(self.symbol) + 1)
        #: words of few items; of these, a window that matches has as many as the part's window, but for one an edit
        self.rare = (in_items > 0) & (in_items <= max(2, len(self.words) // 50))
        #: items by their rare words; an item with more rare words than it may have edits is only found where one of them is
        self.having: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            for s in {s for s in words if self.rare[s]}:
                self.having.setdefault(s, []).append(k)
        self.marked = [sum(bool(self.rare[s]) for s in w) > most for w, most in zip(self.words, self.most)]
        #: words before and after a window's start that a passage of any item can reach
        self.reach = max((len(w) + 2 * m for w, m in zip(self.words, self.most)), default=0)
        parts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for k, words in enumerate(self.words):
            n = -(-len(words) // LONGEST)
            for a, b in ((len(words) * i // n, len(words) * (i + 1) // n) for i in range(n)):
                stride = max(1, min(STRIDE, b - a - 1))
                size = max(s for s in SIZES if s <= b - a - stride + 1)
                parts.setdefault((size, stride), []).append((k, a, b, share(b - a)))
        self.tables = {at: self.table(*at, parts[at]) for at in sorted(parts)}

    def table(self, size: int, stride: int, parts: list[tuple[int, int, int, int]]) -> tuple:
        """The fewest rare words and words of items of a match; which low bits of keys occur; sorted keys, and the item and word at which
        each key's window starts.  parts: (item, its first word and its last's next, most edits)."""
        keys, item, start, least = [], [], [], size
        for k, a, b, most in parts:
            code, at = np.array(self.words[k], np.int64), a + np.arange(stride)
            least = min(least, *(int(self.rare[code[i : i + size]].sum()) - most for i in at))
            for key in lsh_keys(code, at, at + size, size):
                keys.append(key)
                item.append(np.full(len(at), k))
                start.append(at)
        key, item, start = (np.concatenate(x) for x in (keys, item, start))
        order = np.argsort(key, kind="stable")
        there = np.zeros(LOW + 1, bool)
        there[key & LOW] = True
        key, item, start = key[order], item[order], start[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(first[1:], len(key))
        shared = {}
        for a, b in zip(first.tolist(), ends.tolist()):
            if b - a > SHARED:
                of: dict[int, list[int]] = {}
                for k, s in zip(item[a:b].tolist(), start[a:b].tolist()):
                    of.setdefault(k, []).append(s)
                if len(of) > SHARED:
                    shared[a] = {k: s for k, s in of.items() if self.marked[k]}, [(k, x) for k, s in of.items() if not self.marked[k] for x in s]
        return least, size - max(p[3] for p in parts), there, key, item, start, shared


@cache
def sampled_places(size: int, walk: int) -> np.ndarray:
    """KEYS x SAMPLED steps of a walk over ``size`` words, in increasing order."""
    steps = max(1, size * 2 - size // 2)
    return np.sort(np.random.default_rng([size, walk]).integers(0, steps, (KEYS, SAMPLED)), axis=1)


def lsh_keys(words: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The LSH keys of the CGK embeddings of the windows from ``at`` to ``end``, of ``size`` words or, at a text's end, fewer: an array
    for each key, a number for each window."""
    padded = np.append(words, 0)
    symbols = np.arange(int(words.max(initial=0)) + 1, dtype=np.uint64)
    for walk in range(WALKS):
        places = sampled_places(size, walk)
        moves = [mixed(symbols, 100 + walk + 1000 * k) for k in range(int(places.max()) // 64 + 1)]  # bit j: the move after step j
        key = [np.full(len(at), k * 1000 + walk * 10, np.uint64) for k in range(KEYS)]
        i = at.copy()
        for j in range(int(places.max()) + 1):
            symbol = padded[i]
            for k in range(KEYS):
                for _ in range(int((places[k] == j).sum())):
                    key[k] = mixed(key[k] ^ np.where(i < end, symbol.astype(np.uint64), PAST), j + 1)
            i = np.minimum(i + ((moves[j // 64][symbol] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), end)
        yield from key


def best_match(mask: dict[int, int], n: int, words: list[int]) -> tuple[int, int]:
    """Least edit distance of an item of n words to any passage of ``words``, and where that passage ends (Myers' bit vectors)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(words):
        eq = mask.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def hits(items: Items, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
    """For each text the items found in it: index of the item -> (edit distance, the word at which the passage ends)."""
    codes = [np.fromiter(map(items.symbol.get, words := WORD.findall((t or "").lower()), repeat(0)), np.int64, len(words)) for t in texts]
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    start = n = 0
    for k, code in enumerate(codes):
        n += len(code)
        if n >= AT_ONCE or k == len(codes) - 1:
            _search(items, codes[start : k + 1], found[start : k + 1])
            start, n = k + 1, 0
    return found


def _search(items: Items, codes: list[np.ndarray], found: list[dict[int, tuple[int, int]]]) -> None:
    size = np.array([len(c) for c in codes], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    code = np.concatenate(codes)
    rare = np.concatenate([[0], np.cumsum(items.rare[code])])
    text_of = np.repeat(np.arange(len(codes)), size)
    place, stop = np.arange(len(code)) - first[:-1][text_of], first[1:][text_of]
    tried: dict[tuple[int, int], list[int]] = {}
    near_by: dict[tuple[int, int], list[int]] = {}
    known = np.concatenate([[0], np.cumsum(code > 0)])

    def look(text: int, k: int, from_: int) -> None:
        """Is item k in the text where it would start at about ``from_``."""
        n, most = len(items.words[k]), items.most[k]
        near = most // 2  # a passage looked at is so much longer at both ends that starts this near need no other look
        before = tried.setdefault((text, k), [])
        if found[text].get(k, (1, 0))[0] == 0 or any(abs(x - from_) <= near for x in before):
            return
        before.append(from_)
        a = max(0, from_ - most - near)
        passage = codes[text][a : max(0, from_ + n + most + near)].tolist()
        if sum(map(items.masks[k].__contains__, passage)) < n - most:
            return
        d, end = best_match(items.masks[k], n, passage)
        if d <= most and (k not in found[text] or (d, a + end) < found[text][k]):
            found[text][k] = d, a + end

    def around(text: int, mine: int) -> list[int]:
        """Items with a rare word within reach of a place in the text, and of the places next to it."""
        at = text, mine // NEARBY
        if at not in near_by:
            region = codes[text][max(0, at[1] * NEARBY - items.reach) : (at[1] + 1) * NEARBY + items.reach]
            near_by[at] = sorted({k for s in set(region[items.rare[region]].tolist()) for k in items.having[s]})
        return near_by[at]

    for (width, stride), (least, least_known, there, keys, item, begin, shared) in items.tables.items():
        every = np.flatnonzero(place % stride == 0)
        after = np.minimum(every + width, stop[every])
        some = (rare[after] - rare[every] >= least) & (known[after] - known[every] >= least_known)
        at, after = every[some], after[some]
        if not len(at):
            continue
        for key in lsh_keys(code, at, after, width):
            met = np.flatnonzero(there[key & LOW])
            for w, e in zip(met.tolist(), np.searchsorted(keys, key[met]).tolist()):
                text, mine = int(text_of[at[w]]), int(place[at[w]])
                if e in shared and keys[e] == key[w]:
                    marked, others = shared[e]
                    for k in around(text, mine):
                        for s in marked.get(k, ()):
                            look(text, k, mine - s)
                    for k, s in others:
                        look(text, k, mine - s)
                    continue
                while e < len(keys) and keys[e] == key[w]:
                    look(text, int(item[e]), mine - int(begin[e]))
                    e += 1


def blocks(benchmark: DataFrame, at_a_time: int = AT_A_TIME) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's rows in blocks of about so many words; an item is never split."""
    held, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        n += len(r.text or "") // 5 + 1
        if n >= at_a_time:
            yield held
            held, n = [], 0
    if held:
        yield held


def leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, end_word, edit_distance, item_words, similarity."""
    rows = documents.select("doc_id", "text")
    ids = (rows.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, end_word int, edit_distance int, item_words int"
    out = documents.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(Items(block, similarity))  # of AT_A_TIME words and one item

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                said = hits(items, batch.column("text").to_pylist())
                found = [(i, items.ids[k], end, d, len(items.words[k])) for i, h in zip(batch.column("doc_id").to_pylist(), said) for k, (d, end) in sorted(h.items())]
                kinds = [batch.schema.field("doc_id").type, pa.from_numpy_dtype(np.int64), pa.int32(), pa.int32(), pa.int32()]
                kinds[1] = {"int": pa.int32(), "string": pa.string()}.get(ids[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "end_word", "edit_distance", "item_words"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumn("similarity", 1 - F.col("edit_distance") / F.col("item_words"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` in which no item is found."""
    for block in blocks(benchmark):
        sent = documents.sparkSession.sparkContext.broadcast(Items(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not h for h in hits(sent.value, batch.column("text").to_pylist())], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
