"""Recall of benchmark passages by length and place of edits, and op3's rows against all pairs."""

import random
import time

import pytest

from rostrum.llm import decontam, queries

VOCABULARY = [f"w{i}" for i in range(3000)]


def edited(words, n, where, rng, kinds="sid"):
    """n edits at different words: anywhere, or among the first or last fifth.  kinds: substitutions, insertions, deletions."""
    size, out = len(words), list(words)
    among = {"spread": range(size), "start": range(max(n, size // 5)), "end": range(size - max(n, size // 5), size)}[where]
    for i in sorted(rng.sample(among, n), reverse=True):
        kind = rng.choice(kinds)
        if kind == "d":
            del out[i]
        else:
            out[i : i + (kind == "s")] = [f"new{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("where", ["spread", "start", "end"])
@pytest.mark.parametrize("length", [5, 15, 32, 33, 60, 300, 1000])
def test_recall_at_a_fifth_of_edits(length, where):
    rng = random.Random(length)
    plain = [rng.choices(VOCABULARY, k=length) for _ in range(60)]
    items = decontam.Items([(k, " ".join(w)) for k, w in enumerate(plain)])
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randrange(50)) + edited(w, int(0.2 * length + 1e-9), where, rng) + rng.choices(VOCABULARY, k=30)) for w in plain]
    found = decontam.hits(items, texts)
    assert sum(k in f for k, f in enumerate(found)) >= 0.9 * len(plain)
    assert all(d <= items.most[k] for f in found for k, (d, _) in f.items())
    # what is found in a text depends on it alone
    assert [decontam.hits(items, [t])[0] for t in texts[:9]] == found[:9]


@pytest.mark.parametrize("kinds", ["d", "i"])
@pytest.mark.parametrize("length", [6, 15, 25, 32, 60, 300])
def test_recall_of_deletions_and_insertions_alone(length, kinds):
    rng = random.Random(length + len(kinds))
    plain = [rng.choices(VOCABULARY, k=length) for _ in range(300)]
    items = decontam.Items([(k, " ".join(w)) for k, w in enumerate(plain)])
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randrange(50)) + edited(w, int(0.2 * length + 1e-9), "spread", rng, kinds) + rng.choices(VOCABULARY, k=30)) for w in plain]
    assert sum(k in f for k, f in enumerate(decontam.hits(items, texts))) >= 0.9 * len(plain)


def test_a_passage_that_all_items_share():
    """1,000 items with one passage of 40 words: a text that holds it costs no more than twice a plain one; those that hold an item have it."""
    rng = random.Random(5)
    shared = [f"common{k}" for k in range(40)]
    own = [[f"own{rng.randrange(30_000)}" for _ in range(25)] for _ in range(1000)]
    items = decontam.Items([(k, " ".join(shared + w)) for k, w in enumerate(own)])
    filler = lambda n: rng.choices(VOCABULARY, k=n)
    plain = [" ".join(filler(300)) for _ in range(200)]
    same = [" ".join([*filler(130), *shared, *filler(130)]) for _ in range(200)]
    took = []
    for texts in (plain, same, plain, same):
        start = time.process_time()
        assert not any(decontam.hits(items, texts))
        took.append(time.process_time() - start)
    assert min(took[1::2]) < 2 * min(took[::2]) + 0.1, took
    texts = [" ".join(filler(20) + edited(shared + w, 12, "spread", rng) + filler(20)) for w in own[:100]]
    assert sum(k in f for k, f in enumerate(decontam.hits(items, texts))) >= 95
    # items that differ in a few words only are found, all of them
    near = decontam.Items([(k, " ".join([*shared, f"q{k}"])) for k in range(50)])
    assert len(decontam.hits(near, [" ".join(["before", *shared, "after"])])[0]) == 50


def test_all_pairs(spark, pytestconfig):
    documents = spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet").collect()
    items = decontam.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{pytestconfig.DATA}/benchmark.parquet").collect()])
    want = {}
    for r in documents:
        code = [items.symbol.get(w, 0) for w in decontam.WORD.findall((r.text or "").lower())]
        known = set(code)
        for k, mask in enumerate(items.masks):
            n, most = len(items.words[k]), items.most[k]
            if sum(s in known for s in items.words[k]) >= n - most and (d := decontam.best_match(mask, n, code)[0]) <= most:
                want[r.doc_id, items.ids[k]] = d
    got = {(r.doc_id, r.item_id): r.edit_distance for r in queries.op3_benchmark_decontamination(spark, pytestconfig.DATA).collect()}
    assert want and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(got[k] >= want[k] for k in got) and sum(got[k] == want[k] for k in got) >= 0.9 * len(got)
