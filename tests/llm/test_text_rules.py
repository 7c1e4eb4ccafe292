"""License scan, chat formatting and quality rules against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rostrum.llm import chat, licenses, quality

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "mit license"), (5, "MIT  License, mit-license; x mit license"), (6, "Licensed under the Apache License, Version 2.0."),
    (6, "Licensed under the Apache License, Version 2.0."), (7, "CC BY-NC 4.0 cc by cc by"), (8, "the gnu general public license gnu general public license"), (9, "émit license mit licenseé"),
    (10, "a b c d e a b c d e a b"), (11, "x " * 40), (12, "one two\none two\n\n \nthree\none two"), (13, "# * $ % & | < > a#b " * 3), (14, "All rights reserved. Copyright 2020 Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (None, "w " * 12), (15, " ".join(f"w{i % 9}" for i in range(3000))), (16, "mit license " * 800), (17, "SPDX-License-Identifier: BSD-3-Clause"), (18, "a\x0bb\x0cc d e f g h i j k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "z", "y") for i, t in ODD], "doc_id long, text string, _text string, labels string")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_license_base(spark, odd):
    got = licenses.scan(odd)
    assert got.columns[:3] == ["doc_id", "text", "_text"] and "labels" in got.columns
    for r in got.collect():
        w, at, names = words_of(r.text), [], set()
        for phrase, name in licenses.BASE.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            names |= {name} if hits else set()
        assert (r.n_words, r.n_base) == (len(w), len(at)), r
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted(names)) and names <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
        assert all(0 <= d.start < d.end <= len(w) for d in r.detections)


def test_license_rules(odd):
    by = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert by[6].labels == "apache" and [(d.start, d.end, d.rank) for d in by[6].detections] == [(0, 8, 1)]
    assert by[7].labels == "cc-by,cc-by-nc" and by[17].labels == "bsd" and by[17].score == 1.0
    assert by[14].labels.split(",") == ["all-rights-reserved", "copyright", "mit"]
    assert len(by[16].detections) == 800 and by[1].detections == []
    assert len(licenses.rules()) > 400 and len({r[2] for r in licenses.rules()}) == len(licenses.rules())


def example(parsed):
    """The shortest text of a regex, of its first branches."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, what = arg[0]
            out += chr(what) if str(kind) == "LITERAL" else "1" if str(what) == "CATEGORY_DIGIT" else "w"
        elif op == "BRANCH":
            out += example(arg[1][0])
        elif op == "SUBPATTERN":
            out += example(arg[3])
        else:
            assert op == "MAX_REPEAT", op
            out += arg[0] * example(arg[2])
    return out


def test_every_rule_passes_the_gate(spark):
    rows = [(label, rank, example(re._parser.parse(regex))) for label, _, regex, rank in licenses.rules()]
    assert all(re.fullmatch(r[2], x[2]) and licenses._key(r[1]) in f" {x[2]} " for r, x in zip(licenses.rules(), rows))
    rows += [("public-domain", 1, "placed in the public domain"), ("all-rights-reserved", 3, "All rights reserved"), ("cc0", 2, "released under CC0 1.0"), ("cc0", 2, "CCZero"), ("ncsa", 2, "University of Illinois Open Source License")]
    rows += [("mit", 0, "permission is hereby granted free of charge to any person obtaining a copy of this software")]
    texts = [(label, rank, x.replace(" ", by)) for label, rank, x in rows for by in (" ", "\n", "  ", "\n# ", "\n * ")]
    for r in licenses.scan(spark.createDataFrame(texts, "label string, rank int, text string").withColumnRenamed("label", "want")).collect():
        assert r.score >= (4 - r.rank) / 4 and r.want in r.labels.split(","), r
    assert "ncsa" not in licenses.scan(spark.createDataFrame([("an open source license",)], "text string")).first().labels


def variants(parsed):
    """Strings that take every branch and every optional part of a regex at least once."""
    each = []
    for op, arg in parsed:
        op = str(op)
        if op == "BRANCH":
            each.append([x for b in arg[1] for x in variants(b)])
        elif op == "SUBPATTERN":
            each.append(variants(arg[3]))
        elif op == "MAX_REPEAT":
            inner = variants(arg[2])
            each.append([inner[0] * max(arg[0], 1), *inner[1:], *[""] * (arg[0] == 0)])
        elif op == "IN" and len(arg) > 1 and all(str(k) == "LITERAL" for k, _ in arg):
            each.append([chr(c) for _, c in arg])
        else:
            each.append([example([(op, arg)])])
    base = [e[0] for e in each]
    return list(dict.fromkeys(["".join(base)] + ["".join([*base[:k], x, *base[k + 1 :]]) for k, e in enumerate(each) for x in e[1:]]))


def test_every_branch_passes_the_gate(spark):
    cases = [(label, rank, key, x) for label, key, regex, rank in licenses.rules() for x in variants(re._parser.parse(regex)) if re.fullmatch(regex, x)]
    assert len(cases) > 2 * len(licenses.rules())
    cc = re.compile(r"(?<![0-9a-z])cc ?(?:by|zero|0)")
    assert [c for c in cases if not (any(g in c[3] for g in licenses.GATES) or cc.search(c[3])) or licenses._key(c[2]) not in f" {c[3]} "] == []
    text = "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the X Consortium"
    row = licenses.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.labels, row.score) == ("x11", 1.0)


def test_suppression_is_containment(spark):
    rng = random.Random(3)
    for _ in range(5):
        hits = [(s, -(s + rng.randrange(1, 6)), rng.randrange(4), k, "x") for k, s in enumerate(rng.choices(range(25), k=30))]
        df = spark.createDataFrame([(hits,)], "h array<struct<start:int,minus_end:int,rank:int,rule:int,label:string>>")
        kept = {tuple(x) for x in df.select(licenses._suppressed(F.array_sort("h")).alias("k")).first().k}
        order = sorted(hits)
        want = {h for i, h in enumerate(order) if not any(e[0] <= h[0] and e[1] <= h[1] and e[2] <= h[2] for e in order[:i])}
        assert kept == want


def test_many_detections_in_linear_time(spark):
    """40,000 detections of one text; the time of the growing array would be minutes."""
    df = spark.createDataFrame([(1, "mit license " * 40_000), (2, "copyright 2020 mit license and " * 10_000)], "doc_id long, text string").coalesce(1)
    licenses.scan(df.limit(0)).collect()
    start = time.perf_counter()
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert time.perf_counter() - start < 60
    assert len(got[1].detections) == 40_000 and got[1].n_base == 40_000 and len(got[2].detections) == 20_000 and got[2].labels == "copyright,mit"


def base_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark, odd):
    labels = spark.createDataFrame([(15, 1, 0), (4, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for r in quality.quality_rules(odd, labels).collect():
        want = base_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_separates(spark):
    """Kept rates of labelled documents whose labels the operator never saw."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs.select("doc_id", "text"), labels.filter(~unseen)).select("doc_id", "kept", "base_failed").collect() if not r.base_failed}
    rates = {}
    for r in labels.filter(unseen).collect():
        rates.setdefault((r.quality, r.toxic), []).append(kept.get(r.doc_id))
    rates = {k: sum(filter(None, rates[k])) / sum(x is not None for x in rates[k]) for k in ((1, 0), (0, 0))}
    assert rates[1, 0] > 0.98 and rates[0, 0] < 0.1


def test_quality_ratio_against_plain_counts(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", "d", "e"] if k % 3 else ["x!", "y!", "a"], k=15))) for k in range(40)] + [(7, "a b"), (None, "a z"), (50, None), (51, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k == 4)) for k in range(30)] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    good = {r._id for r in quality.trusted(labels).filter("not _out").collect()}
    out = {r._id for r in quality.trusted(labels).filter("_out").collect()}
    assert good | out == {k for k in range(30) if k % 3 and k != 4} and out and good
    size = 1 << 18  # no two of these n-grams share a bucket
    grams_of = lambda t: (w := (t or "").split()) + [*zip(w, w[1:])]
    raw, target = Counter(), Counter()
    for k, t in rows:
        raw.update(grams_of(t))
        target.update(grams_of(t) if k in good else [])
    shift = math.log((raw.total() + size) / (target.total() + size))
    ratio = {g: math.log((target[g] + 1) / (raw[g] + 1)) + shift for g in raw}
    mean = lambda t: sum(map(ratio.__getitem__, grams_of(t))) / len(grams_of(t)) if grams_of(t) else None
    scores = sorted(mean(t) for k, t in rows if k in out and not base_of(t)[0] < 10 and not 100 * base_of(t)[4] > 20 * base_of(t)[0])
    least = scores[0] - 0.5 * (scores[-(-len(scores) // 2) - 1] - scores[0]) if scores else quality.THRESHOLD
    for r in quality.quality_rules(docs, labels, buckets=size).collect():
        want = mean(r.text)
        assert (r.llr is None) == (want is None) and (want is None or abs(r.llr - want) < 1e-4)
        assert r.kept == (not r.base_failed and want is not None and want >= least - 1e-5)
    assert quality.fit(docs, quality.trusted_documents(docs, labels.limit(0)), buckets=16) == [0.0] * 16
    assert quality.passing(docs.limit(0), labels).count() == 0


def test_buckets_grow(spark):
    sizes = [quality.buckets_for(spark.createDataFrame([("x" * n,)], "text string")) for n in (0, 1000, 100_000, 10_000_000)]
    assert sizes == sorted(set(sizes))


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<|end|>\\ \\\\ <|turn|>x<|text|>"), (1, 3, "user", None), (1, 4, "assistant", "a\nb"),
    (2, 0, "user", "hi"), (3, 0, "assistant", None), (4, 1, "assistant", "<<SYS>> <s> <</SYS>> <\\|end|> \\<|end|>"), (4, 0, None, "😀<|"), (4, 1, "assistant", "z"), (None, 5, "assistant", "q"), (5, None, "user", "n"), (5, 0, "assistant", "m"),
]


def in_order(turns):
    by = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def test_chat_round_trip(spark):
    many = [(9, k, ("user", "assistant", "tool")[k % 3], f"say {k} <|end|>\\") for k in range(200)]
    made = chat.examples(spark.createDataFrame(TURNS + many, "conv_id long, turn long, role string, text string"), whole=True)
    for r in made.collect():
        for control in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<s>"):
            assert control not in r.text
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = in_order(TURNS + many)
    assert set(got) == set(want)
    for conv, rows in want.items():
        said, loss = "".join(f"{r}\n{t}\n" for r, t in rows), "".join(t for r, t in rows if r == "assistant")
        assert got[conv].n_turns == len(rows) and got[conv].n_examples == sum(r == "assistant" for r, _ in rows)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples(spark):
    """Each example read back by plain Python: all turns before as context, only the reply trained on."""
    rows = chat.examples(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")).collect()
    plain = lambda s: re.sub(r"\\(\\)?", lambda m: m[1] or "", s)
    want = in_order(TURNS)
    assert sorted((str(r.conv_id), r.target) for r in rows) == sorted((str(c), k + 1) for c, ts in want.items() for k, t in enumerate(ts) if t[0] == "assistant")
    for r in rows:
        read = [(plain(a), plain(b)) for a, b in re.findall(r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", r.text)]
        assert read == want[r.conv_id][: r.target]
        assert plain(r.text[r.loss_start : r.loss_start + r.loss_chars]) == want[r.conv_id][r.target - 1][1] and r.text[r.loss_start + r.loss_chars :] == "<|end|>\n"


@pytest.mark.parametrize("seed", range(3))
def test_escape_is_reversible(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["\\", "<", "|", "s>", "/s>", "[INST]", "[/INST]", "<|turn|>", "<<SYS>>", "a", "\n", "é"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"))
    assert all(r.t == r.u for r in df.collect())


def test_quality_learns_from_all_trusted_documents(spark, pytestconfig):
    docs, labels = (spark.read.parquet(f"{pytestconfig.DATA}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(r.doc_id for r in docs.join(labels.filter("quality = 1 and coalesce(toxic, 0) <> 1"), "doc_id").select("doc_id").collect())
    for most in (3, 1000):  # with and without a broadcast
        assert len(want) > 20 and sorted(r.doc_id for r in quality.trusted_documents(docs, labels, most).collect()) == want
