"""SimHash near-dedup with BK-trees.

Each text gets a fingerprint: bit k is set if it is set in over half of the hashes of its word shingles.  Equal fingerprints
become one node.  Nodes are dealt to shards so that linked ones meet in one: by blocks of the fingerprint (radius + 1 blocks, of
which two fingerprints within the radius share one), or, for wide radii, by bands of min-hashes of the shingles.  A task builds
the BK-trees of its shards - children keyed by their Hamming distance to the parent - and follows only edges within the radius.
It sends on one edge a node at most, to the least node it reaches in the shard; the components of these edges are found on Spark.
Trees are built where a shard's rows meet rather than broadcast, as they grow with the corpus.

Null texts are empty; a text without words has fingerprint zero.  A null doc_id is nobody's smallest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.storage import settled, written
from rostrum.llm.worker import give_back

SEED = 42
#: Rows of whole shards that a task gathers before it builds their trees, and pairs it looks at at once.
GATHER, FRONTIER = 100_000, 1_000_000
#: A shard of more nodes is cut into blocks of about so many; each pair of blocks is then a shard.
LARGEST = 50_000
MASK = (1 << 64) - 1


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, A-Z lower-cased, repeats included; of all words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    parts = [joined[a:b] for a, b in zip(starts[: 1 - size].tolist() if size > 1 else starts.tolist(), ends[size - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of a hash (the splitmix64 finalizer)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & MASK)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """``words`` times 64 bits, the most significant first; past the first 64 they are of mixed hashes."""
    out = b""
    for k in range(words):
        h = mixed(hashes, k) if k else hashes
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * counts > len(h)).tobytes()
    return out


def block_keys(print_: bytes, blocks: int) -> list[int]:
    """The shard of each of ``blocks`` blocks of bits, with the block's number in it."""
    n, size = int.from_bytes(print_, "big"), len(print_) * 8
    cuts = [size * k // blocks for k in range(blocks + 1)]
    return [((n >> a & ((1 << b - a) - 1)) * blocks + k) & (MASK >> 1) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for each band of ``rows`` min-hashes."""
    if not len(hashes):
        return [0]
    least = np.array([mixed(hashes, 1000 + k).min() for k in range(bands * rows)], np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key ^ least[:, r], 1)
    return key.astype(np.int64).tolist()


def signatures(documents: DataFrame, shingle: int, radius: int, words: int = 1, bands: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fingerprint, keys of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, shingle)
                prints.append(fingerprint(h, words))
                keys.append(band_keys(h, *bands) if bands else block_keys(prints[-1], radius + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fingerprint", "keys"])

    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, fingerprint binary, keys array<bigint>")


def distance(words: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the items a and b, word by word, so that no copy of whole fingerprints is made."""
    return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the components of each a and b; a label is its component's least index."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label = label[label]


class Forest:
    """The BK-trees of many shards at once.  prints: n x words of 64 bits; root: each item's shard's first item."""

    def __init__(self, prints: np.ndarray, root: np.ndarray):
        self.words, self.root = [np.ascontiguousarray(w) for w in prints.T], root
        at, left = root.copy(), np.flatnonzero(root != np.arange(len(root)))
        parents, kids = [], []
        while len(left):
            key = at[left] * 1024 + distance(self.words, left, at[left])
            found, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            parents.append(found)
            kids.append(left[first])
            at[left] = left[first][inverse]
            left = left[at[left] != left]
        key = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.kid = key[order], np.concatenate(kids)[order] if kids else key

    def links(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asked item, other item of its shard) within the radius."""
        q, node, left, right = asked, self.root[asked], [], []
        while len(q):
            d = distance(self.words, q, node)
            near = (d <= radius) & (q != node)
            left.append(q[near])
            right.append(node[near])
            lo = np.searchsorted(self.key, node * 1024 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 1024 + d + radius, side="right") - lo
            q = np.repeat(q, n)
            node = self.kid[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(q))]
        return np.concatenate(left), np.concatenate(right)


def roots_of(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items sorted by shard: the first item of each one's shard, and how many are in it."""
    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    size = np.diff(np.append(start, len(shard)))
    return np.repeat(start, size), np.repeat(size, size)


def asked_parts(size: np.ndarray) -> list[np.ndarray]:
    """The items that are not alone in their shard, in parts that look at about FRONTIER pairs each."""
    some = np.flatnonzero(size > 1)
    part = np.cumsum(size[some]) // FRONTIER
    return np.split(some, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(some) else []


def shard_labels(prints: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """Of items sorted by shard: the least item that each reaches in its shard, itself included."""
    root, size = roots_of(shard)
    label, parts = np.arange(len(shard)), asked_parts(size)
    if parts:
        forest = Forest(prints, root)
    for asked in parts:
        label = merge(label, *forest.links(asked, radius))
    return label


def shard_edges(prints: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of items sorted by shard: those linked to an earlier one, and the least item each reaches in its shard."""
    label = shard_labels(prints, shard, radius)
    moved = np.flatnonzero(label != np.arange(len(shard)))
    return moved, label[moved]


def sharded(nodes: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(shard, fingerprint) and what else the rows hold, for rows (fingerprint, keys).  Shards of over ``largest`` nodes are dealt out by pairs of blocks, so that
    any two of their nodes still meet and no task gets all of them."""
    rest = [c for c in nodes.columns if c != "keys"]
    rows = nodes.select(F.explode("keys").alias("shard"), *rest)
    large = rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > largest)
    large = settled(large.select("shard", F.ceil(F.col("n") / largest).alias("blocks")))
    if large.isEmpty():
        return rows
    mine = F.pmod(F.xxhash64("node" if "node" in rest else "fingerprint"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("shard", F.least(mine, k), F.greatest(mine, k)))
    cut = rows.join(large, "shard", "left")
    return cut.select(F.explode(F.when(F.col("blocks").isNull(), F.array("shard")).otherwise(pairs)).alias("shard"), *rest)


def whole_shards(done: Callable[[pa.Table], pa.RecordBatch], weight: Callable[[pa.RecordBatch], int] = lambda b: b.num_rows, most: int = GATHER) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by shard: ``done`` of about GATHER rows at once, or of ``most`` by another weight, no shard of them cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(weight, held)) >= most:
                table = pa.Table.from_batches(held)
                shard = table.column("shard").to_numpy()
                cut = int(np.searchsorted(shard, shard[-1]))
                if cut:
                    yield done(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield done(table)

    return run


def bits_of(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).reshape(len(prints), -1)


def edges(nodes: DataFrame, radius: int) -> DataFrame:
    """Of rows (fingerprint, keys): edges (u, v), u > v, whose components are those of all links."""

    def done(table: pa.Table) -> pa.RecordBatch:
        raw = table.column("fingerprint").to_pylist()
        a, b = shard_edges(bits_of(raw), table.column("shard").to_numpy(), radius)
        pairs = [(max(raw[i], raw[j]), min(raw[i], raw[j])) for i, j in zip(a.tolist(), b.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["u", "v"])

    rows = sharded(nodes).repartition("shard").sortWithinPartitions("shard", "fingerprint")
    return rows.mapInArrow(whole_shards(done), "u binary, v binary").filter("u > v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), u > v; root is the least node of the component.

    Large-star and small-star steps in turn, each round settled in the shared folder, until nothing changes.
    """
    pairs, before = settled(pairs), None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v")).distinct()
        before = now
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        # the least neighbour by an aggregate and a join, which reduce and split the many edges of a hub
        large = both.join(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        rest = large.join(least.withColumnRenamed("v", "m"), "u").filter("v > m").select("v", "m")
        small = least.union(rest)
        pairs = settled(small.filter("u > v").distinct())


def near_duplicates(documents: DataFrame, shingle: int = 5, radius: int = 2, words: int = 1, bands: tuple[int, int] | None = None) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex), component_id, the smallest doc_id of all that links reach from it."""
    signed = settled(signatures(documents, shingle, radius, words, bands))
    nodes = signed.groupBy("fingerprint", "keys").agg(F.min("doc_id").alias("id"))
    roots = components(edges(nodes, radius))
    least = signed.groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    placed = settled(least.join(roots, least.fingerprint == roots.node, "left").select("fingerprint", "id", F.coalesce("root", "fingerprint").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    found = placed.join(smallest, "root").select("fingerprint", "component_id")
    return signed.select("doc_id", "fingerprint").join(found, "fingerprint", "left").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


#: For texts of which at least 0.8 of the distinct five-word shingles are shared: such pairs share a band with a probability over
#: 0.999, and their 512-bit fingerprints differ in 78 bits on average, with a deviation of 8; in 96 with five shingles and four of them.
#: The fingerprints only find candidates; the decision is the shingles' own similarity.
NEAR = {"shingle": 5, "radius": 120, "words": 8, "bands": (16, 4)}
#: Least similarity of near copies, in tenths, so that it is compared in whole numbers.
TENTHS = 8
#: A node's candidates are looked at so many times more in each round.
MORE = 4
#: Bytes of sets that a task gathers before it compares them, codes that it looks up at once, and nodes of a block of a large shard.
SETS, LOOKED_UP, BLOCK = 32_000_000, 1_000_000, 20_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def set_signatures(documents: DataFrame, shingle: int, words: int, bands: tuple[int, int]) -> DataFrame:
    """doc_id, hash (of the text), node (128 bits of the text's set of shingles), fingerprint and keys of that set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, keys = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_set(text, shingle)
                nodes.append(xxhash.xxh3_128_digest(h.tobytes(), SEED))
                prints.append(fingerprint(h, words))
                keys.append(band_keys(h, *bands))
            made = [pa.array(nodes, pa.binary()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *made], ["doc_id", "hash", "node", "fingerprint", "keys"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, hash bigint, node binary, fingerprint binary, keys array<bigint>")


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """node, shingles: each text's set of shingles."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(text, shingle) for text in batch.column("text").to_pylist()]
            nodes = [xxhash.xxh3_128_digest(h.tobytes(), SEED) for h in made]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([h.astype(np.int64) for h in made], pa.list_(pa.int64()))], ["node", "shingles"])

    return documents.select("text").mapInArrow(sets, "node binary, shingles array<bigint>")


def groups(nodes: DataFrame, radius: int, largest: int = BLOCK) -> DataFrame:
    """(shard, node, fingerprint): the nodes (node, fingerprint, keys) that links within the radius join in a shard, under a number of the
    group.  Groups of the same nodes, as near copies have in most of their shards, are one."""

    def done(table: pa.Table) -> pa.RecordBatch:
        ids, raw = (table.column(c).to_pylist() for c in ("node", "fingerprint"))
        label = shard_labels(bits_of(raw), table.column("shard").to_numpy(), radius)
        more = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        # a number of the group's nodes in any order; groups that it doesn't tell apart would be compared as one
        number = np.zeros(len(label), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(number, label, mixed(np.frombuffer(b"".join(i[:8] for i in ids), np.uint64), 3))
        made = [pa.array(number[label[more]].astype(np.int64)), *[pa.array([x[i] for i in more.tolist()], pa.binary()) for x in (ids, raw)]]
        return pa.RecordBatch.from_arrays(made, ["shard", "node", "fingerprint"])

    rows = sharded(nodes, largest).repartition("shard").sortWithinPartitions("shard", "fingerprint")
    return rows.mapInArrow(whole_shards(done), "shard bigint, node binary, fingerprint binary").distinct()


class Sets:
    """Sets of shingles one behind the other, by small codes."""

    def __init__(self, sets: pa.ListArray):
        first = sets.offsets.to_numpy().astype(np.int64)
        found, code = np.unique(sets.values.to_numpy()[first[0] : first[-1]], return_inverse=True)
        self.code, self.start, self.size, self.mark = code.astype(np.int32), first[:-1] - first[0], np.diff(first), np.zeros(len(found), bool)

    def alike(self, a: np.ndarray, b: np.ndarray, tenths: int) -> np.ndarray:
        """Have the sets a and b, pairs sorted by a, a Jaccard similarity of at least so many tenths."""
        out = np.zeros(len(a), bool)
        # one of the sizes is too small, whatever the sets hold; with that, none is empty
        n, m = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        left = np.flatnonzero((10 * n >= tenths * m) & (n > 0))
        part = np.cumsum(self.size[b[left]]) // LOOKED_UP
        cuts = np.flatnonzero((a[left][1:] != a[left][:-1]) | (part[1:] != part[:-1])) + 1
        for k in np.split(left, cuts) if len(left) else []:
            mine = self.code[self.start[a[k[0]]] : self.start[a[k[0]]] + self.size[a[k[0]]]]
            self.mark[mine] = True
            size = self.size[b[k]]
            ahead = np.cumsum(size) - size
            hit = self.mark[self.code[np.repeat(self.start[b[k]] - ahead, size) + np.arange(size.sum())]]
            both = np.add.reduceat(hit.astype(np.int64), ahead)
            out[k] = 10 * both >= tenths * (len(mine) + size - both)
            self.mark[mine] = False
        return out


def similar_labels(prints: np.ndarray, shard: np.ndarray, sets: pa.ListArray, radius: int, tenths: int = TENTHS) -> np.ndarray:
    """Of items sorted by shard: the least item that each reaches by pairs within the radius whose sets have a Jaccard similarity of at
    least so many tenths.

    An item looks at its nearest candidates of another label first, at four times as many in each further round, until every candidate is
    looked at or has the same label.
    """
    root, size = roots_of(shard)
    label, parts = np.arange(len(shard)), asked_parts(size)
    if parts:
        forest, held = Forest(prints, root), Sets(sets)
    for asked in parts:
        a, b = forest.links(asked, radius)
        once = a > b  # the other way round, the pair comes with b
        a, b = a[once], b[once]
        order = np.lexsort((distance(forest.words, a, b), a))
        a, b, most = a[order], b[order], 1
        while len(a := a[new := label[a] != label[b]]):
            b = b[new]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            few = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < most
            yes = held.alike(a[few], b[few], tenths)
            label = merge(label, a[few][yes], b[few][yes])
            a, b, most = a[~few], b[~few], most * MORE
    return label


def similar_edges(grouped: DataFrame, radius: int) -> DataFrame:
    """Of rows (shard, node, fingerprint, shingles): edges (u, v), u > v, whose components are those of all similar candidates.

    A pair is compared where its group's rows meet, and a node sends on one edge at most, so pairs of a large group are never rows.
    """

    def done(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("node").to_pylist()
        sets = table.column("shingles").combine_chunks()
        label = similar_labels(bits_of(table.column("fingerprint").to_pylist()), table.column("shard").to_numpy(), sets, radius)
        pairs = [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in enumerate(label.tolist()) if i != j]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["u", "v"])

    rows = grouped.select("shard", "node", "fingerprint", "shingles").repartition("shard").sortWithinPartitions("shard", "node")
    return rows.mapInArrow(whole_shards(done, lambda b: b.nbytes, SETS), "u binary, v binary").distinct()


def near_copies(documents: DataFrame, shingle: int, radius: int, words: int, bands: tuple[int, int]) -> DataFrame:
    """doc_id, hash (of the text), root and component_id of every row: the component, and the smallest doc_id of all that pairs of a
    similarity of at least 0.8 reach from it.

    Texts of the same shingles are one node.  Nodes that are candidates of one another in a shard are a group; their sets are compared where
    the group meets, until every candidate is either checked or already in the same component.
    """
    signed = settled(set_signatures(documents, shingle, words, bands))
    nodes = signed.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"), F.min("doc_id").alias("id"))
    found, roots = settled(groups(nodes.drop("id"), radius)), None
    if not found.isEmpty():
        mine = found.select("node").distinct()
        ids = nodes.join(mine, "node", "left_semi").select(F.col("id").alias("doc_id"))
        sets = written(shingle_sets(documents.join(ids, "doc_id", "left_semi"), shingle).join(mine, "node", "left_semi").dropDuplicates(["node"]), "shingles")
        roots = components(similar_edges(found.join(sets, "node"), radius))
    placed = signed.select("doc_id", "hash", "node").withColumn("root", F.col("node"))
    if roots is not None:
        placed = placed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root").select("doc_id", "hash", "root", "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row, of the smallest doc_id, for each group of near duplicates; of texts that share that id, the one of the
    smallest hash.  Rows without a doc_id stay."""
    found = near_copies(documents.filter("doc_id is not null"), **NEAR).filter("doc_id = component_id")
    mine = settled(found.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n")).groupBy("root", "doc_id").agg(F.min(F.struct("hash", "n")).alias("_m")))
    only = mine.select(F.col("doc_id").alias("_id"), F.col("_m.hash").alias("_hash"))
    kept = documents.join(only, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")
    if not mine.filter("_m.n > 1").isEmpty():  # repeated rows
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(documents.filter("doc_id is null"))
