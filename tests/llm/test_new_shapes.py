"""Fill-in-the-middle, best-fit packing and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rostrum.llm import bestfit, codes, middle, queries
from rostrum.llm.tokens import load

ODD = [
    (1, None), (2, ""), (3, " "), (4, "ok then"), (4, "ok then"), (None, "no id, two"), (5, "a▁b  c\n\td 😀 \U0010ffff 梦 <|endoftext|>x <|startoftext|>"), (6, "word " * 30_000), (7, "é" * 5000),
    (8, "=" * 3000 + " \n" * 200), (9, "has <P> inside"), (10, "tail < <P <S"), (11, "a\x1cb\x1f c d\x85e　f"), (12, "x" * 9000), (13, "ǅ İ ﬁ é Σ ΑΣ ½"), (14, "<|endoftext|>"), (15, "'s 'S don't I'LL 12 ²"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "mine", 3) for i, t in ODD], "doc_id long, text string, form string, n int").repartition(3)


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def test_middle(spark, odd, pytestconfig):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet").select("doc_id", "text"))
    more = spark.createDataFrame([(k, t) for k in range(100, 160) for _, t in ODD[2:6] + ODD[9:10]], "doc_id long, text string")
    docs = docs.unionByName(more)
    got = middle.fill_in_middle(docs.withColumns({"n": F.lit("mine"), "output": F.lit(0)})).withColumn("back", middle.restored(F.col("form"), F.col("output"))).collect()
    want = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got])) == sorted(map(repr, [(i, *plain_middle(i, t), t or "") for i, t in want]))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("part", [1, 3, 17, 1 << 20])
def test_units_by_stretches(part):
    rng, starts = random.Random(4), middle.Starts()
    for _ in range(60):
        text = "".join(rng.choices(["a", "Zq", " ", "  ", "\n", "é", "😀", "12", "-", "x" * 70], k=rng.randrange(1, 30)))
        units = middle.Units(text, starts, part)
        places = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
        assert units.n == len(places) - 1 and [units.start(k) for k in range(units.n + 1)] == places


def test_middle_and_codes_sql(spark, pytestconfig):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{pytestconfig.DATA}/{t}.parquet'")
    for name in ("op11_fill_in_middle", "op13_vector_codes"):
        got = queries.QUERIES[name](spark, pytestconfig.DATA)
        want = c.execute(queries.ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_word_ids_are_the_librarys(spark, pytestconfig):
    library = load(bestfit.definition())
    texts = [t or "" for _, t in ODD] + [r.text or "" for r in spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choices(["a", "É", " ", "́", " ", "'s", "12", "<|endoftext|>", "<|end", "\x1d", "Σ", " ", "!?", "梦", "\xa0"], k=25)) for _ in range(200)]
    for part in (20, 1 << 20):
        encode = bestfit.Encoder(bestfit.definition(), part)
        for text in texts:
            assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    # every plain character, also beside others
    for c in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]):
        word = f"a{c}1{c}B{c}{c}'ll-{c}'s"
        assert bestfit.PLAIN.fullmatch(word) and encode.ids(word) == library.encode(word, add_special_tokens=False).ids, hex(ord(c))
    # every separator separates, and nothing else that Python splits at is left out
    for c in filter(lambda c: not 0xD800 <= c < 0xE000 and chr(c).isspace(), range(0x3100)):
        assert encode(f"ab{chr(c)}cd") == np.array(library.encode(f"ab{chr(c)}cd", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize(("part", "together"), [(20, 1), (1 << 20, 1), (1 << 20, 500), (1 << 20, 1 << 22)])
def test_texts_together_have_the_ids_of_each(spark, pytestconfig, part, together):
    encode, library = bestfit.Encoder(bestfit.definition(), part), load(bestfit.definition())
    texts = [t for _, t in ODD] + [r.text for r in spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet").select("text").limit(60).collect()]
    rng = random.Random(5)
    texts += ["".join(rng.choices(["a", "É", "İ", "Ⱥ", "×", "K", " ", "́", "'s", "'LL", "''t", "12", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "\x1d", "\0", "ΑΣ", "!?", "…", "梦", "\xa0", "\n"], k=25)) for _ in range(300)]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert list(encode.all(pa.array(["left out", *texts], kind)[1:], together)) == want
        assert list(encode.all(pa.array([], kind), together)) == [] and list(encode.all(pa.array([None, ""], kind), together)) == [b"", b""]


def test_every_character_together():
    encode, library = bestfit.Encoder(bestfit.definition()), load(bestfit.definition())
    texts = [f"ab{c}cd a{c}1{c}B{c}{c}'ll-{c}'s" for c in map(chr, range(0x3100))]
    assert list(encode.all(pa.array(texts))) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_of_the_same_pretokens_are_encoded_once(monkeypatch):
    asked, ids = [], bestfit.Encoder.ids
    monkeypatch.setattr(bestfit.Encoder, "ids", lambda self, word: asked.append(word) or ids(self, word))
    encode = bestfit.Encoder(bestfit.definition())
    texts = pa.array(["Über über. ÜBER, (über) über's", None, "ber über über! Über-ber"] * 50)
    assert len(list(encode.all(texts))) == 150
    assert len(asked) == len(set(asked)) and {"über", "ber", "'s"} <= set(asked) and not any("über" in w and w != "über" for w in map(str.lower, asked))


def whole_packing(rows, texts, library, length):
    """Each document's pieces follow each other, each sequence is gapless and no longer than it may be; how many sequences there are."""
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) // 4
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    for doc_id, own in docs.items():
        ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts[doc_id]]
        pieces = sorted((k, 4 * at, i[4 * at : 4 * (at + length)]) for i in ids for k, at in enumerate(range(0, len(i) // 4, length)))
        assert sorted((r.piece, 4 * r.start, bytes(r.ids)) for r in own) == pieces
    assert set(docs) == set(texts)
    return len(seqs)


@pytest.mark.parametrize(("length", "block", "most"), [(64, 300, 2), (256, 4000, 8), (2048, 4_000_000, 64)])
def test_packing(spark, odd, pytestconfig, length, block, most):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet").select("doc_id", "text"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    packed = bestfit.pack(docs.repartition(5).withColumns({"ids": F.lit(1), "open": F.lit("x")}), length=length, block=block, most=most)
    n = whole_packing(packed.collect(), texts, load(bestfit.definition()), length)
    have, least = bestfit.certificate(packed, length)
    assert have == n and (n <= 1.02 * least + 1)


def test_blocks_exchange(spark):
    """Each block alone leaves most of a sequence over; all together leave one."""
    docs = spark.createDataFrame([(k, "ok " * 40) for k in range(60)], "doc_id long, text string").repartition(30)
    packed = bestfit.pack(docs)
    assert bestfit.certificate(packed) == (2, 2)
    halves = spark.createDataFrame([(k, "ok " * 1100) for k in range(20)], "doc_id long, text string").repartition(4)
    assert bestfit.certificate(bestfit.pack(halves)) == (20, 20)  # no two fit, and the bound says so


@pytest.mark.parametrize("capacity", [7, 12, 30])
def test_weights_are_dual_feasible(capacity):
    """No set that fits weighs more than one unit, and the bound is never over what a packing needs."""
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 40))]
        least, w, unit = bestfit.bound(np.bincount(lengths, minlength=capacity + 1))
        most = [0] * (capacity + 1)
        for room in range(1, capacity + 1):
            most[room] = max([most[room - 1], *(most[room - x] + int(w[x]) for x in range(1, room + 1))])
        assert most[capacity] <= unit and least * unit == sum(int(w[x]) for x in lengths)
        assert math.ceil(least) <= len(bestfit.best_fit_decreasing(lengths, capacity)) and least >= sum(lengths) / capacity - 1e-9


def test_query_of_packing(spark, pytestconfig):
    rows = queries.op12_best_fit_packing(spark, pytestconfig.DATA).collect()
    library, texts = load(bestfit.definition()), {r.doc_id: r.text or "" for r in spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet").collect()}
    for r in rows:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.start == 2048 * r.piece


def plain_codes(rows, parts, entries, rounds):
    """rows: (vec_id, vector) without any to drop.  Codes, errors, codebook."""
    rows = sorted((i, [math.floor(256 * x) for x in v]) for i, v in rows)
    width = len(rows[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    book = [[part(v, p) for _, v in rows[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), c)), k) for k, c in enumerate(book[p]))
    for _ in range(rounds):
        at = [[near(v, p)[1] for p in range(parts)] for _, v in rows]
        for p in range(parts):
            for k in range(len(book[p])):
                if own := [part(v, p) for (_, v), a in zip(rows, at) if a[p] == k]:
                    book[p][k] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((i, bytes(near(v, p)[1] for p in range(parts)), sum(near(v, p)[0] for p in range(parts))) for i, v in rows), book


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(2, 3, 2), (4, 8, 3), (16, 64, 2), (4, 5, 0)])
def test_codes(spark, parts, entries, rounds):
    rng = random.Random(parts)
    rows = [(k, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(16)]) for k in range(90)]
    rows += [rows[3], (95, rows[3][1]), (None, rows[8][1]), *((200 + k, [0.125] * 16) for k in range(40))]
    bad = [(-1, None), (-2, [None] * 16), (-3, [float("nan")] + [0.0] * 15), (-4, [0.0] * 15 + [float("-inf")]), (-5, []), (500, [1.0] * 15), (501, [1.0] * 32), (-6, [1e30] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, None if i in (1, 2) else 7, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(4)
    made = codes.compress(df, parts, entries, rounds)
    fill = 10**6  # null ids come last
    want, book = plain_codes([(fill if i is None else i, v) for i, v in rows], parts, entries, rounds)
    got = [(fill if r.vec_id is None else r.vec_id, bytes(r.code), r.error) for r in made.rows.collect()]
    assert sorted(got) == want and made.book.tolist() == book
    assert len(made.moved) == rounds and (not rounds or made.moved[0] == parts * len(rows)) and all(m < made.moved[0] for m in made.moved[1:])
    by = {r.vec_id: r.label_error for r in codes.with_label_error(made.rows).collect()}
    nulls = sum(e for i, _, e in want if i in (1, 2))
    assert by[1] == by[2] == nulls and by[0] == sum(e for _, _, e in want) - nulls
