"""Language id, tokens, pieces, packing, decontamination and SimHash against brute force, exact round trips or held-out rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rostrum.llm import decontam, langid, packing, pieces, queries, simhash, tokens

ODD = [(1, None), (2, ""), (3, " "), (4, "ok"), (4, "ok"), (None, "no id"), (5, "a▁b  c\n\td 😀 \U0010ffff 梦 <|endoftext|> x"), (6, "word " * 30_000), (7, "é" * 5000), (8, "=" * 3000 + " \n" * 200), (9, "12 ² ½ 34 !!")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, "k") for i, t in ODD], "doc_id long, text string, score double, pieces string")


@pytest.fixture(scope="module")
def documents(spark, pytestconfig):
    return spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet")


def test_language_held_out(spark, pytestconfig, documents):
    got = queries.op4_language_id(spark, pytestconfig.DATA)
    right = got.join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and got.count() == documents.count()


def test_language_odd(spark, odd, documents):
    model = langid.learn(documents)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {got[i].lang_pred for i in (1, 2, 3, 9)} - {"und"} == set() and got[1].score == 0
    assert got[4].lang_pred in model["langs"] and 0 <= got[4].score <= 1
    empty = langid.learn(documents.limit(0))
    assert langid.predict(odd, empty).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.confident(odd, model, 0.5).columns == odd.columns


def test_language_backs_off():
    logs = lambda **p: ([*p], np.log(np.array([*p.values()]).reshape(-1, 2)))
    model = {"langs": ["x", "y"], "words": logs(known=(0.9, 0.1)), "grams": [logs(a=(0.2, 0.8)), (["^q"], np.log([[0.7, 0.3]])), logs(), logs()]}
    s = langid.Scorer(model)
    assert s.text("known")[0] == "x" and s.text("zaz")[0] == "y" and s.text("qzz")[0] == "x"
    assert np.allclose(s.unseen("qa"), np.log([0.7, 0.3])) and np.allclose(s.unseen("zzz"), 0)


def plain_language(texts, learned, words, grams):
    """The same by plain counts: languages and scores of texts after learning from (lang, text)."""
    langs = sorted({x for x, _ in learned})
    split = lambda t: ["".join(c for c in w if c.isalpha()) for w in "".join(c if c.isalpha() or c.isnumeric() and not c.isdigit() and not c.isdecimal() else " " for c in t.lower()).split()]
    grams_in = lambda w, k: [w] if k == 0 else [*w] if k == 1 else [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
    tables = []
    for k in range(5):
        count = {}
        for lang, t in learned:
            for w in filter(None, split(t)):
                for g in grams_in(w, k):
                    count.setdefault(g, dict.fromkeys(langs, 0))[lang] += 1
        most = (words if k == 0 else grams) // len(langs)
        known = {g for x in langs for g in sorted((g for g in count if count[g][x]), key=lambda g: (-count[g][x], g))[:most]}
        tables.append({g: [np.log((count[g][x] + 0.5) / (sum(count[h][x] for h in known) + 0.5 * len(known))) for x in langs] for g in known})
    out = []
    for t in texts:
        said, total = [w for w in split(t) if w], np.zeros(len(langs))
        for w in said:
            for k in (0, 4, 3, 2, 1):
                if found := [tables[k][g] for g in grams_in(w, k) if g in tables[k]]:
                    total += np.mean(found, axis=0)
                    break
        z = np.exp((total - total.max()) / max(1, len(said)) ** 0.5)
        out.append((langs[int(total.argmax())], 1 / z.sum()) if said else ("und", 0.0))
    return out


def test_language_against_plain_counts(spark):
    pool = {"x": ["the", "house", "a" * 60, "über", "day"], "y": ["le", "maison", "été", "jour", "the"], "rare": ["dom", "dzień"]}
    rng = random.Random(6)
    rows = [(k, lang, " ".join(rng.choices(pool[lang], k=12))) for k, lang in enumerate(["x"] * 40 + ["y"] * 40 + ["rare"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.learn(docs, words=9, grams=60)
    assert model["langs"] == ["rare", "x", "y"]
    ids = {r.doc_id for r in docs.filter(~langid.held_out()).collect()}
    texts = ["the house", "maisons d'été", "dom dzień domy", "a" * 59, "12 ½", "", "the the le le", "zzz qqq", "Ünter"]
    want = plain_language(texts, [(lang, t) for k, lang, t in rows if k in ids], 9, 60)
    got = [(r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1), model).collect()]
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-4


def test_language_sample_does_not_vanish(spark):
    docs = spark.range(200_000).selectExpr("id as doc_id", "'t' as text", "case when id < 5 then 'rare' else 'common' end as lang")
    n = {r.lang: r["count"] for r in langid.sample(docs, 40).groupBy("lang").count().collect()}
    assert 15 < n["common"] < 80 and n["rare"] >= 2


def test_token_counts(spark, odd, documents):
    tokenizer = tokens.load(tokens.definition())
    rows = tokens.count_tokens(odd).collect() + tokens.count_tokens(documents).collect()
    texts = [t for _, t in ODD] + [r.text for r in documents.select("text").collect()]
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 1024)


def test_token_splices():
    count = tokens.Counter(tokens.definition(), chunk=50, overlap=4)
    rng = random.Random(1)
    parts = ["word", " ", "  ", "\n", "é", "12", "'s", "!", "<|endoftext|>", "梦", "x" * 70, "\t", "ab cd"]
    for _ in range(60):
        text = "".join(rng.choices(parts, k=120))
        assert count(text) == len(count.tokenizer.encode(text, add_special_tokens=False))


def test_pretoken_rule_agrees_with_the_library():
    pre = tokens.load(tokens.definition()).pre_tokenizer
    for c in [*range(0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0), *range(0x3000, 0x3100), *range(0x4E00, 0xA000, 97), *range(0xAC00, 0xD7A4, 97)]:
        s = "a" + chr(c) + "1" + chr(c) + " "
        assert not tokens.OTHER.search(chr(c)) and [o for _, o in pre.pre_tokenize_str(s)] == [m.span() for m in tokens.PRETOKEN.finditer(s)]


def test_pieces_are_lossless_and_reproducible(spark, odd, documents):
    a = pieces.encode(odd).cache()
    assert a.filter(~F.col("lossless")).count() == 0 and a.columns == ["doc_id", "text", "score", "pieces", "lossless"]
    back = pieces.decode(a).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
    one = {r.doc_id: r.pieces for r in pieces.encode(documents.repartition(1)).collect()}
    many = {r.doc_id: r.pieces for r in pieces.encode(documents.repartition(7)).collect()}
    assert one == many
    other = {r.doc_id: r.pieces for r in pieces.encode(documents, seed=8).collect()}
    assert sum(one[k] != other[k] for k in one) > 0.9 * len(one)


def test_pieces_follow_the_lattice():
    v = pieces.Vocabulary(pieces.model_file())
    s = pieces.Sampler(v, seed=1)
    n = 4000
    ids, at = s([*range(n)], ["then"] * n)
    seen = {}
    for a, b in zip(at, at[1:]):
        k = tuple(ids[a:b].tolist())
        seen[k] = seen.get(k, 0) + 1
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=pieces.model_file())
    ids_of = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_byte(i) and not sp.is_control(i)}

    def ways(rest):
        if not rest:
            return {(): 1.0}
        out = {}
        for k in range(1, len(rest) + 1):
            if (i := ids_of.get(rest[:k])) is not None:
                for tail, w in ways(rest[k:]).items():
                    out[(i, *tail)] = w / (1.0 + max(0.0, -sp.get_score(i)))
        return out

    want = ways("▁then")
    total = sum(want.values())
    assert set(seen) <= set(want)
    for k, w in want.items():
        p = w / total
        assert abs(seen.get(k, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_packing(spark, odd, documents):
    encode = packing.Encoder(packing.ranks_file())
    small = packing.Encoder(packing.ranks_file(), part=40)
    assert all(encode.decode(small(t or "")) == (t or "") for _, t in ODD)
    rows = packing.pack(documents.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text")), length=256, block=20_000).cache()
    for r in rows.collect():
        assert len(r.ids) == 256 * r.id_bytes and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= 256 and r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.pieces) == len(r.position_resets)
    found = {}
    for r in packing.segments(rows).collect():
        found.setdefault(r.doc_id, []).append((r.piece, bytes(r.ids)))
    texts = {}
    for i, t in [(r.doc_id, r.text) for r in documents.collect()] + [(i and i + 1000, t) for i, t in ODD]:
        texts.setdefault(i, []).append(t or "")
    for i, ts in texts.items():
        joined = b"".join(x for _, x in sorted(found[i]))
        assert encode.decode(joined) == (ts[0] if len(ts) == 1 else "".join(ts)), i


def test_ids_of_long_texts_are_those_of_the_whole():
    small, whole = packing.Encoder(packing.ranks_file(), part=40), packing.Encoder(packing.ranks_file(), part=1 << 30)
    rng = random.Random(4)
    parts = ["word", " ", "  ", "\n", "é", "12", "'s", "!", "<|endoftext|>", "梦", "x" * 70, "=" * 90, "\t", "ab cd"]
    texts = ["".join(rng.choices(parts, k=120)) for _ in range(60)] + ["梦é" * 200, "a" * 500, "-" * 500 + " b"]
    assert all(small(t) == whole(t) for t in texts) and max(len([*small.parts(t)]) for t in texts) > 5


def test_best_fit_decreasing():
    rng = random.Random(5)
    for cap in (1, 7, 64):
        lengths = [rng.randrange(cap + 1) for _ in range(200)]
        rows = packing.best_fit_decreasing(lengths, cap)
        assert sorted(k for r in rows for k in r) == [*range(200)] and all(sum(lengths[k] for k in r) <= cap for r in rows)
        room, want = [], 0
        for n in sorted(lengths, reverse=True):
            fits = [x for x in room if x >= n]
            if fits:
                room[room.index(min(fits))] -= n
            else:
                room.append(cap - n)
        assert len(rows) == len(room)


def edit_distance(a, b):
    d = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_best_match():
    rng = random.Random(2)
    for _ in range(200):
        item, text = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))], [rng.randrange(0, 6) for _ in range(rng.randrange(12))]
        mask = {}
        for i, s in enumerate(item):
            mask[s] = mask.get(s, 0) | 1 << i
        d, end = decontam.best_match(mask, len(item), text)
        assert d == min([len(item), *(edit_distance(item, text[a:b]) for a in range(len(text)) for b in range(a, len(text) + 1))])


def edited(words, n, pool, rng):
    w = list(words)
    for _ in range(n):
        i, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.5:
            w[i] = rng.choice(pool)
        elif kind < 0.75:
            del w[i]
        else:
            w.insert(i, rng.choice(pool))
    return w


@pytest.mark.parametrize("rate", [0, 0.1, 0.2])
def test_leaks_recall(spark, pytestconfig, documents, rate):
    rng = random.Random(7)
    items = spark.read.parquet(f"{pytestconfig.DATA}/benchmark.parquet")
    pool = [w for r in documents.limit(50).collect() for w in r.text.lower().split()]
    rows, want = [], set()
    for k, r in enumerate(items.collect()):
        for j in range(4):
            words = decontam.WORD.findall(r.text.lower())
            inner = edited(words, int(rate * len(words) + 1e-9), pool, rng)
            rows.append((k * 10 + j, " ".join([*rng.choices(pool, k=rng.randrange(80)), *inner, *rng.choices(pool, k=20)])))
            want.add((k * 10 + j, r.item_id))
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert len(want & set(got)) >= (0.9 if rate == 0.2 else 0.97) * len(want)
    assert all(r.similarity >= 0.8 for r in got.values())


def test_leaks_odd(spark, odd):
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "!!")], "item_id long, text string")
    assert decontam.leaks(odd, empty).count() == 0 and decontam.leaks(odd, empty.limit(0)).count() == 0
    assert decontam.without_leaks(odd, empty).count() == len(ODD)
    short = spark.createDataFrame([(1, "no id"), (1, "no id"), (2, "ok")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(odd, short).collect()} == {(None, 1), (4, 2)}


def plain_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and find(i) != find(j):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_components(spark, documents, odd):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + [(10_000 + (i or 0), t) for i, t in ODD]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, radius=2).collect()}
    prints = [plain_fingerprint(t, 3) for _, t in rows]
    comps = plain_components(prints, 2)
    least = {}
    for (i, _), c in zip(rows, comps, strict=True):
        least[c] = min(i, least.get(c, i))
    for (i, _), p, c in zip(rows, prints, comps, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", least[c])


def test_forest_finds_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(20)]]))
    shard = np.sort(rng.integers(0, 3, len(prints)))
    for radius in (0, 2, 5, 30):
        moved, root = simhash.shard_edges(prints.reshape(-1, 1), shard, radius)
        label = np.arange(len(prints))
        label[moved] = root
        want = np.empty(len(prints), int)
        for s in range(3):
            at = np.flatnonzero(shard == s)
            want[at] = at[np.array(plain_components([int(prints[i]) for i in at], radius))]
        groups = lambda x: {frozenset(np.flatnonzero(x == v).tolist()) for v in x}
        assert groups(label) == groups(want)


def test_components_of_a_path(spark):
    pairs = spark.createDataFrame([(bytes([i + 1]), bytes([i])) for i in range(60)], "u binary, v binary")
    rows = simhash.components(pairs).collect()
    assert len(rows) == 61 and {bytes(r.root) for r in rows} == {b"\0"}


def test_large_shards_are_cut(spark):
    rng = random.Random(11)
    prints = sorted({rng.randrange(1 << 12) << 50 | rng.choice([0, 1 << 3]) for _ in range(300)})
    nodes = spark.createDataFrame([(n.to_bytes(8, "big"), [1, 2]) for n in prints], "fingerprint binary, keys array<long>")
    cut = simhash.sharded(nodes, largest=40).groupBy("shard").agg(F.collect_set("fingerprint").alias("f")).collect()
    assert len(cut) > 20
    met = {(a, b) for r in cut for a in map(bytes, r.f) for b in map(bytes, r.f)}
    assert len(met) == len(prints) ** 2


def test_near_copies_stay_once(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows, n = [], 0
    for g in range(40):
        words = rng.choices(pool, k=300)
        rows.append((n, " ".join(words)))
        for _ in range(5):
            n += 1
            w = list(words)
            for _ in range(4):
                w[rng.randrange(300)] = rng.choice(pool)
            rows.append((n, " ".join(w)))
        n += 1
    rows += [(n, None), (n + 1, ""), (None, "no id"), (0, rows[0][1])]
    kept = simhash.one_of_each(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fingerprint string")).collect()
    assert len([r for r in kept if r.doc_id is not None and r.doc_id < n]) == 40 and sum(r.doc_id is None for r in kept) == 1


def jaccard(a, b):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_are_exact(spark):
    """Pairs on both sides of 0.8, families of a hub and chains, against all pairs."""
    rng = random.Random(24)
    pool = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    texts = []
    for g in range(80):
        length = 24 if g % 2 else 204
        words = rng.choices(pool, k=length)
        texts.append(" ".join(words))
        for _ in range(1 + 5 * (g % 8 < 2)):  # a changed tail: similarities from 0.6 to 0.95
            n = rng.randrange(1, length // 4)
            texts.append(" ".join([*words[:-n], *rng.choices(pool, k=n)]))
    root = [*range(len(texts))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i in range(len(texts)):
        for j in range(i):
            s = jaccard(texts[i], texts[j])
            near += 0.65 < s < 0.8
            if s >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert near > 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, **simhash.NEAR).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_copies_with_repeated_ids(spark):
    """An id with two texts: the one that copies a smaller id's goes, the other stays; of its two near copies one stays."""
    rng = random.Random(11)
    text = lambda: [str(rng.random()) for _ in range(60)]
    a, b, c = text(), text(), text()
    near = [*c[:-1], "changed"]
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, near), (9, c)]
    kept = [(r.doc_id, r.text.split()) for r in simhash.one_of_each(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")).collect()]
    assert sorted(k for k, _ in kept) == [3, 5, 9] and (3, a) in kept and (5, b) in kept


def test_sets_of_a_shard_against_all_pairs():
    rng = np.random.default_rng(8)
    sets, shard = [], np.sort(rng.integers(0, 6, 150))
    for s in shard:
        base = np.arange(s * 100, s * 100 + 40)
        sets.append(np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.integers(1000, 1020, rng.integers(0, 4))])).astype(np.int64))
    sets[3] = sets[3][:0]
    prints = rng.integers(0, 1 << 20, (150, 1), dtype=np.uint64)
    for radius in (8, 64):
        label, want = simhash.similar_labels(prints, shard, pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), radius), [*range(150)]
        for i in range(150):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if shard[i] == shard[j] and int(prints[i, 0] ^ prints[j, 0]).bit_count() <= radius and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((want[i], want[j]))
                    want = [a if w == b else w for w in want]
        assert label.tolist() == want and 6 < len(set(want)) < 150


def test_pairs_of_a_large_group_are_not_rows(spark, tmp_path):
    """Texts that are candidates of one another but not near copies: what is written grows with the texts, not with their pairs."""
    rng, shared = random.Random(5), spark.sparkContext.getCheckpointDir()
    words, texts = rng.choices(range(10**6), k=200), []
    for n, places in enumerate(rng.sample([*itertools.combinations(range(1, 39), 4)], 600)):
        w = list(words)
        for k in places:  # similarities of at most 0.78
            w[5 * k] = f"n{n}"
        texts.append(" ".join(map(str, w)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = []
    try:
        for n in (150, 600):
            spark.sparkContext.setCheckpointDir(str(tmp_path / str(n)))
            found = simhash.near_copies(docs.filter(f"doc_id < {n}"), **simhash.NEAR)
            assert found.filter("doc_id = component_id").count() == n
            written.append(sum(f.stat().st_size for f in (tmp_path / str(n)).rglob("*") if f.is_file()))
    finally:
        spark.sparkContext.setCheckpointDir(shared.removeprefix("file:").rpartition("/")[0])
    assert written[1] < 8 * written[0], written
