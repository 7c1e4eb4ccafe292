"""SentencePiece segmentations sampled by forward filtering and backward sampling over the piece lattice, and decoding.

A piece weighs (1 + rank) ** -alpha, its rank being its place in the vocabulary's scores.  A segmentation is drawn with
probability in proportion to the product of its pieces' weights: sums over all ways to a place are filtered forward, then pieces
are drawn backward from the end.  The draw at a place of a text depends only on the seed, the row's key and the place.

The lattice falls apart wherever no piece holds the two characters beside each other, so it is filtered unit by unit, and equal
units share their sums.  Characters that are no piece become their UTF-8 bytes; so does U+2581 in a text, which stands for a
space in pieces.  Decoding is lossless.  A null text has no pieces, as has an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rostrum.llm.simhash import mixed
from rostrum.llm.worker import give_back

ALPHA, SEED = 1.0, 7
#: Characters sampled at once, ends of pieces that a worker's tables hold, and the longest unit that is remembered.
AT_ONCE, PLACES, LONG = 1_000_000, 1_000_000, 64
#: Log weight of spelling out a character that is no piece.
FALLBACK = -20.0
SPACE, OWN_MARK = "▁", "\udc81"  # what stands for a space, and for U+2581 itself while a text is cut up


class Vocabulary:
    """Pieces with their weights, a trie of them over kinds of characters, and which kinds stand beside each other in a piece."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.raw = [b""] * self.size
        self.byte_ids = [0] * 256
        weight: dict[str, tuple[int, float]] = {}
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.raw[i], self.byte_ids[value] = bytes([value]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = piece.replace(SPACE, " ").encode()
                weight[piece] = i, -alpha * math.log(1.0 + max(0.0, -sp.get_score(i)))
        chars = sorted({c for p in weight if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.single, self.single_weight = np.full(0x110000, -1, np.int32), np.full(0x110000, FALLBACK, np.float64)
        kids: list[dict[int, int]] = [{}]
        ends: list[tuple[int, float]] = [(-1, 0.0)]
        for p, (i, w) in weight.items():
            if len(p) == 1:
                self.single[ord(p)], self.single_weight[ord(p)] = i, w
                continue
            kinds = self.kind[[ord(c) for c in p]].tolist()
            self.joined[kinds[:-1], kinds[1:]] = True
            node = 0
            for k in kinds:
                if k not in kids[node]:
                    kids[node][k] = len(kids)
                    kids.append({})
                    ends.append((-1, 0.0))
                node = kids[node][k]
            ends[node] = i, w
        inner = [n for n, k in enumerate(kids) if k]
        self.row = np.zeros(len(kids), np.int32)  # row 0 has no child
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.child = np.zeros((len(inner) + 1, len(chars) + 1), np.int32)
        for r, n in enumerate(inner, 1):
            self.child[r, list(kids[n])] = list(kids[n].values())
        self.piece = np.array([e[0] for e in ends], np.int32)
        self.weight = np.array([e[1] for e in ends])

    def byte_fallback(self, code: int) -> list[int]:
        return [self.byte_ids[b] for b in (SPACE if code == ord(OWN_MARK) else chr(code)).encode()]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


class Grown:
    """An array that rows are added to."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1 << 16, kind), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held) // 2, len(rows)), self.held.dtype)])
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Sampler:
    """Sampled segmentations of texts.  Tables: for each place in a unit, the pieces that end there, with cumulative shares."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.forget()

    def forget(self) -> None:
        self.base: dict[str, int] = {}
        self.extra, self.extra_of = [], {}
        self.first, self.upto, self.long, self.piece = Grown(np.int32), Grown(np.float32), Grown(np.int16), Grown(np.int32)

    def _edges(self, code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces within units: (place of the last character, length, piece, log weight)."""
        kind, piece = self.v.kind[code], self.v.single[code]
        none = np.flatnonzero(piece < 0)
        for c in np.unique(code[none]).tolist():
            if c not in self.extra_of:
                self.extra_of[c] = len(self.extra)
                self.extra.append(self.v.byte_fallback(c))
        piece[none] = [self.v.size + self.extra_of[c] for c in code[none].tolist()]
        found = [(np.arange(len(code)), np.ones(len(code), np.int64), piece, self.v.single_weight[code])]
        at, node = np.arange(len(code)), self.v.child[self.v.row[0], kind]
        n = 1
        while True:
            live = (node > 0) & (at + n < end[at])
            at, node = at[live], node[live]
            if not len(at):
                return tuple(np.concatenate(x) for x in zip(*found))
            node = self.v.child[self.v.row[node], kind[at + n]]
            n += 1
            done = np.flatnonzero(self.v.piece[node] >= 0)
            found.append((at[done] + n - 1, np.full(len(done), n), self.v.piece[node[done]], self.v.weight[node[done]]))

    def filtered(self, units: list[str]) -> list[int]:
        """Adds the units to the tables: sums over all ways to each place, forward.  The first place of each."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(size)
        begin, end = np.repeat(stop - size, size), np.repeat(stop, size)
        place, long, piece, weight = self._edges(code, end)
        order = np.lexsort((-long, place))  # by place, the longest piece first
        place, long, piece, weight = place[order], long[order], piece[order], weight[order]
        depth = place - begin[place]
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
        ways, upto = np.zeros(len(code)), np.empty(len(place), np.float32)
        for e in np.split(by_depth, cuts):
            p, before = place[e], place[e] - long[e]
            w = weight[e] + np.where(before < begin[p], 0.0, ways[before])
            new = np.concatenate([[True], p[1:] != p[:-1]])
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            most = np.maximum.reduceat(w, start)
            share = np.exp(w - most[group])
            total = np.add.reduceat(share, start)
            ways[p[start]] = most + np.log(total)
            sums = np.cumsum(share / total[group])
            upto[e] = sums - np.concatenate([[0.0], sums[start[1:] - 1]])[group]
            upto[e[np.append(start[1:], len(e)) - 1]] = 1.0
        at = self.first.n
        self.first.add(np.searchsorted(place, np.arange(len(code))) + self.upto.n)
        self.upto.add(upto)
        self.long.add(long)
        self.piece.add(piece)
        return (at + stop - size).tolist()

    def units(self, text: str) -> tuple[list[str], np.ndarray]:
        """The text's units and their ends."""
        marked = SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)
        kind = self.v.kind[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.append(np.flatnonzero(~self.v.joined[kind[:-1], kind[1:]]) + 1, len(kind))
        at = ends.tolist()
        return [marked[a:b] for a, b in zip([0, *at[:-1]], at)], ends

    def __call__(self, keys: list, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts, and where each text's start, with the end of the last; keys: the rows' keys."""
        if self.first.n > PLACES:
            self.forget()
        cut = [self.units(t) if t else ([], np.zeros(0, np.int64)) for t in texts]
        units = [u for us, _ in cut for u in us]
        if not units:
            return np.zeros(0, np.int32), [0] * (len(texts) + 1)
        base = [*map(self.base.get, units)]
        new = [*dict.fromkeys(u for u, at in zip(units, base) if at is None)]
        if new:
            found = dict(zip(new, self.filtered(new)))
            base = [found[u] if at is None else at for u, at in zip(units, base)]
            self.base.update((u, at) for u, at in found.items() if len(u) <= LONG)
        per_text = [len(us) for us, _ in cut]
        end = np.concatenate([ends for _, ends in cut])
        left = np.concatenate([np.diff(ends, prepend=0) for _, ends in cut])
        place = np.array(base, np.int64) + left - 1
        row = np.repeat(np.array([xxhash.xxh64_intdigest(str(k).encode(), self.seed) for k in keys], np.uint64), per_text)
        first, upto, long, piece = (x.held for x in (self.first, self.upto, self.long, self.piece))
        who, steps, count = np.arange(len(units)), [], np.zeros(len(units), np.int64)
        while len(who):
            u = (mixed(row ^ (end.astype(np.uint64) << np.uint64(20)), 3) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = first[place]
            missed = np.flatnonzero(upto[e] <= u)
            while len(missed):
                e[missed] += 1
                missed = missed[upto[e[missed]] <= u[missed]]
            steps.append((who, piece[e]))
            count[who] += 1
            size = long[e]
            left = left - size
            more = np.flatnonzero(left > 0)
            who, left, row = who[more], left[more], row[more]
            place, end = place[more] - size[more], end[more] - size[more]
        last = np.cumsum(count)
        out = np.empty(last[-1], np.int32)
        for k, (w, p) in enumerate(steps):
            out[last[w] - 1 - k] = p
        at = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.spelt(out, at)

    def spelt(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Bytes in the place of characters that are no piece."""
        odd = np.flatnonzero(ids >= self.v.size)
        if len(odd):
            bytes_ = [self.extra[i - self.v.size] for i in ids[odd].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [*map(len, bytes_)]
            starts = np.cumsum(times) - times
            ids = np.repeat(ids, times)
            for i, b in zip(starts[odd].tolist(), bytes_):
                ids[i : i + len(b)] = b
            at = np.append(starts, len(ids))[at]
        return ids, at.tolist()


def model_file(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def in_parts(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE or i == len(texts) - 1:
            yield keys[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0


def encode(documents: DataFrame, path: str | None = None, alpha: float = ALPHA, seed: int = SEED, check: bool = True) -> DataFrame:
    """``documents`` with ``pieces``, an array of ids, and with ``check`` ``lossless``, whether they decode to the text."""
    sent = documents.sparkSession.sparkContext.broadcast(model_file(path))  # the vocabulary: half a MB
    rest = documents.drop("pieces", "lossless")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        sample = Sampler(Vocabulary(sent.value, alpha), seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                done = [sample(*part) for part in in_parts(batch.column("doc_id").to_pylist(), texts)]
                ids = np.concatenate([x[0] for x in done])
                sizes = np.concatenate([np.diff(x[1]) for x in done])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                more = {"pieces": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}
                if check:
                    flat = ids.tolist()
                    more["lossless"] = pa.array([sample.v.decode(flat[a:b]) == t for a, b, t in zip(offsets.tolist(), offsets[1:].tolist(), texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    fields = [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())]
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *fields[: 1 + check]]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its pieces."""
    sent = encoded.sparkSession.sparkContext.broadcast(model_file(path))
    rest = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(sent.value)
        for batch in batches:
            texts = [v.decode(i or []) for i in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())]))
