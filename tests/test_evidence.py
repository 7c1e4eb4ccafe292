"""Quotes found again in texts, against a plain search of every place."""

import random

import pytest

import __spark_entry__  # noqa: F401  it registers the queries
from rostrum.operators import evidence
from rostrum.plans.registry import QUERIES, SQL
from rostrum.sources.tables import table

ONE = {**dict.fromkeys("\u2018\u2019\u201a\u201b`\u00b4", "'"), **dict.fromkeys("\u201c\u201d\u201e\u201f", '"'), **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d", "-")}


def units(text):
    """(character in its one form, start, end) of the text; runs of white space are one, and none at the ends."""
    out = []
    for i, c in enumerate(text or ""):
        if c.isspace():
            if out and out[-1][0] == " ":
                out[-1] = (" ", out[-1][1], i + 1)
            elif out:
                out.append((" ", i, i + 1))
        else:
            out.append((ONE.get(c, c), i, i + 1))
    return out[:-1] if out and out[-1][0] == " " else out


def plain(text, quote):
    u, q = units(text), [c for c, _, _ in units(quote)]
    hits = [k for k in range(len(u) - len(q) + 1) if [c for c, _, _ in u[k : k + len(q)]] == q] if q else []
    if len(hits) != 1:
        return "ambiguous" if hits else "unmatched", None, None
    return "matched", u[hits[0]][1], u[hits[0] + len(q) - 1][2]


@pytest.mark.parametrize("seed", range(2))
def test_located_is_plain_search(spark, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "'", "\u2019", "`", '"', "\u201c", "-", "\u2013", " ", "  ", "\n", "\u00a0", "\u3000", "\U0001f600", "\u00e9"]
    draw = lambda n: "".join(rng.choices(alphabet, k=rng.randrange(n)))
    rows = [(None, "a"), ("a", None), ("", ""), ("a", " "), ("aaa", "aa")]
    for _ in range(400):
        t = draw(40)
        a = rng.randrange(len(t) + 1)
        q = t[a : a + rng.randrange(12)].replace("'", "\u2018").replace("-", "\u2014").replace(" ", "\n ")
        rows += [(t, q), (t, draw(4))]
    got = evidence.located(spark.createDataFrame(rows, "text string, quote string"), "text", "quote").collect()
    assert {r.status for r in got} == {"matched", "unmatched", "ambiguous"}
    for r in got:
        assert (r.status, r.start_offset, r.end_offset) == plain(r.text, r.quote), r


def test_query_takes_every_document(spark, pytestconfig):
    docs = {r.doc_id: r.text for r in table(spark, pytestconfig.DATA, "documents").collect()}
    got = QUERIES["evidence_located"](spark, pytestconfig.DATA).collect()
    assert "evidence_located" not in SQL
    assert sorted((r.doc_id, r.quote_no) for r in got) == sorted((i, k) for i in docs for k in range(4))
    for r in got:
        assert (r.status, r.start_offset, r.end_offset) == plain(docs[r.doc_id], r.quote), r
    at = [r for r in got if r.status == "matched"]
    assert any("\n" in docs[r.doc_id] for r in at) and any(not docs[r.doc_id].isascii() for r in at)
    assert any(r.start_offset > 1000 for r in at) and any(r.quote_no == 1 and docs[r.doc_id][r.start_offset : r.end_offset] != r.quote for r in at)
    assert all(r.status == "unmatched" for r in got if r.quote_no == 3)


@pytest.mark.parametrize("few", [0, 8])
def test_few_quotes_are_searched_without_an_automaton(monkeypatch, few):
    monkeypatch.setattr(evidence, "FEW", few)
    if few:
        monkeypatch.setattr(evidence.ahocorasick, "Automaton", None)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "aa", "’", "–", "`", " ", "  ", "\n", "é"], k=rng.randrange(40)))
        quotes = ["", *(text[a : a + 4] for a in rng.choices(range(len(text) + 1), k=6))]
        assert evidence.resolved(text, quotes) == [plain(text, q) for q in quotes]
