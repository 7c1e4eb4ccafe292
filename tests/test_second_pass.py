"""Second passes against a plain reading of each response."""

import json
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_evidence import plain

from rostrum.operators import evidence, rules, second_pass
from rostrum.plans import second  # noqa: F401  it registers its queries
from rostrum.plans.registry import QUERIES, SQL

TARGETS = ("OPPOSING_PARTISAN_TARGET", "OTHER_POLITICAL_TARGET", "NON_POLITICAL_TARGET", "UNSURE", "N/A")
TEXT = "The Minister’s  plan – a “plan” – failed.\n\nHe said so, and so did she. \U0001f600 End"


@pytest.mark.parametrize("seed", range(2))
def test_many_quotes_at_once(seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "ab", "'", "’", "-", "–", " ", "  ", "\n", " ", "\U0001f600", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        quotes = [None, "", " "]
        for _ in range(rng.randrange(12)):
            a = rng.randrange(len(text) + 1)
            quotes += [text[a : a + rng.randrange(9)].replace("'", "‘"), "".join(rng.choices(alphabet, k=2))]
        assert evidence.resolved(text, quotes) == [plain(text, q) for q in quotes]
    assert evidence.resolved(None, ["a"]) == [("unmatched", None, None)] and evidence.resolved("a", []) == []


def answer(presence="YES", target="UNSURE", spans=({"text": "a \"plan\" - failed"},), **more):
    return json.dumps({"hostility_present": presence, "target": target, "evidence_spans": spans, "reasoning": "r"} | more)


@pytest.mark.parametrize(
    ("response", "error"),
    [
        (answer(), None), (answer("UNSURE"), None), (answer("NO", "N/A", []), None), (answer("NO"), "NO_WITH_EVIDENCE"), (answer("NO", "N/A"), "NO_WITH_EVIDENCE"), (answer("NO", "UNSURE", []), "NO_WITH_EVIDENCE"),
        (answer("UNSURE", "N/A"), "WITHOUT_EVIDENCE"), (answer("YES", "UNSURE", []), "WITHOUT_EVIDENCE"), (answer("yes"), "PRESENCE_UNKNOWN"), (answer(1), "PRESENCE_UNKNOWN"), (answer(target=None), "TARGET_UNKNOWN"),
        (answer(reasoning="x" * 4000), None), (answer(reasoning="x" * 4001), "REASONING"), (answer(reasoning=None), "REASONING"), (answer(reasoning=3), "REASONING"), (answer(extra=1), "FIELDS"),
        (answer(spans="none"), "SPANS_NOT_A_LIST"), (answer(spans=None), "SPANS_NOT_A_LIST"), (answer(spans=[{"text": ""}]), "SPAN_TEXT"), (answer(spans=[{"text": 5}]), "SPAN_TEXT"), (answer(spans=["a"]), "SPAN_FIELDS"), (answer(spans=[{"text": "a", "x": 1}]), "SPAN_FIELDS"),
        ("[1]", "FIELDS"), ("nothing", "FIELDS"), ("", "FIELDS"), (None, "FIELDS"), ("null", "FIELDS"),
    ],
)
def test_rules(spark, response, error):
    row = second_pass.validated(spark.createDataFrame([(response, TEXT)], "r string, t string"), "r", "t").first()
    assert row.error == error and (row.category is None) == (error is None) and (row.presence is None) == (error is not None)


def test_evidence_of_a_label(spark):
    spans = [{"text": q} for q in ("a \"plan\" - failed", "so", "never said", " ", "He said so")]
    rows = spark.createDataFrame([(1, answer(spans=spans), TEXT), (2, answer("NO", "N/A", []), None), (3, answer(), None)], "k int, r string, t string")
    got = {r.k: r for r in second_pass.validated(rows.withColumn("keep", rows.k), "r", "t").collect()}
    assert [s.text for s in got[1].spans] == ["a “plan” – failed", "He said so"] and all(TEXT[s.start_offset : s.end_offset] == s.text for s in got[1].spans)
    assert (got[1].unmatched, got[1].ambiguous, got[1].n_requested, got[1].n_resolved, got[1].evidence_valid) == (["never said", " "], ["so"], 5, 2, False)
    assert got[2].evidence_valid and got[2].spans == [] and got[3].unmatched == ["a \"plan\" - failed"] and got[3].keep == 3


@pytest.mark.parametrize(
    ("span", "error"),
    [
        ((0, 3, "The"), None), ((0, 3, "the"), "SPAN_PLACE"), ((3, 3, ""), "SPAN_TEXT"), ((-1, 3, "The"), "SPAN_PLACE"), (("0", 3, "The"), "SPAN_PLACE"), ((False, 3, "The"), "SPAN_PLACE"), ((0.0, 3, "The"), "SPAN_PLACE"),
        ((0, 10**20, "The"), "SPAN_PLACE"), ((0, 5_000_000_000, "The"), "SPAN_PLACE"), ((len(TEXT) - 3, len(TEXT), "End"), None), ((len(TEXT) - 3, len(TEXT) + 1, "End"), "SPAN_PLACE"),
    ],
)
def test_places_that_are_given(spark, span, error):
    made = dict(zip(("start_offset", "end_offset", "text"), span))
    rows = spark.createDataFrame([(answer(spans=[made]), TEXT)], "r string, t string")
    row = second_pass.validated(rows, "r", "t", offsets=True).first()
    assert row.error == error and (error or (row.spans[0].start_offset, row.spans[0].end_offset) == span[:2])
    stored = second_pass.adapted(rows, "r", "t").first()
    assert (stored.error is None) == (error is None) and (error is None or stored.error == "SPANS_DIFFER")


def test_stored_labels(spark):
    place = lambda q: {"start_offset": TEXT.index(q), "end_offset": TEXT.index(q) + len(q), "text": q}
    cases = [
        (answer(), True, None), (answer(spans=[{"text": "so"}]), True, "EVIDENCE_UNRESOLVED"), (answer(spans=[place("failed")]), True, None), (answer(spans=[place("so")]), True, "EVIDENCE_UNRESOLVED"),
        (answer(spans=[place(" did she")]), True, "SPANS_DIFFER"), (answer(spans=[place("failed"), {"text": "End"}]), True, "SPAN_FIELDS"), (answer(spans=[place("failed")], reasoning=""), False, None), (answer(reasoning=""), False, "FIELDS"),
        (answer(spans=[place("failed")], reasoning="r"), False, "FIELDS"), (answer("NO", "N/A", []), True, None), ("[", True, "FIELDS"),
    ]
    for response, reasoning, error in cases:
        assert second_pass.adapted(spark.createDataFrame([(response, TEXT)], "r string, t string"), "r", "t", reasoning).first().error == error, response


def test_where_a_parser_stops(spark):
    whole = '{"a": [1, "two", {"b": null}], "c": "d"}'
    cases = [whole[:k] for k in range(len(whole) + 1)] + [whole[:k] + "?" + whole[k:] for k in range(len(whole))] + [None, whole + "}", "[" * 100_000, '{"x": NaN}', '{"é": "\U0001f600']
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, r string").withColumn("s", rules.json_stop("r"))
    for r in rows.withColumn("c", rules.json_category(rows.r, rows.s)).collect():
        try:
            json.loads(r.r or "0")
            want = None if r.r != "" else "JSON_TRUNCATION"
        except RecursionError:
            want = "STRUCTURED_OUTPUT_INVALID"
        except json.JSONDecodeError as e:
            at_end = e.pos >= max(0, len(r.r) - 1)
            want = "JSON_TRUNCATION" if at_end and e.msg in ("Unterminated string starting at", "Expecting value", "Expecting ',' delimiter", "Expecting ':' delimiter") else "STRUCTURED_OUTPUT_INVALID"
        assert r.c == want, (r.r, r.s)


def test_changed_fields(spark):
    rows = spark.createDataFrame([("N/A", None, "YES", "YES"), ("UNSURE", None, "YES", "NO")], "a string, b string, p string, q string")
    got = rows.select(second_pass.changed_fields({"hostility_present": rows.p, "target": rows.a}, {"hostility_present": rows.q, "target": rows.b}).alias("c"))
    assert [r.c for r in got.collect()] == [[], ["hostility_present", "target"]]


def test_artifact_of_nothing(spark):
    none = spark.createDataFrame([], "k int, r string, t string")
    verdicts = second_pass.artifact_verdicts(none.select("k", "r"), none.select("k", "t"), "k", "r", "t")
    assert verdicts.isEmpty() and second_pass.artifact_accounts(verdicts, none, none, none, "k").first().importable


def test_labels_of_packages(spark):
    good = '{"start_offset":1,"end_offset":3,"text":"\U0001f600b","more":0}'
    row = lambda h, t, e: f'{{"hostility_present":{h},"target":{t},"evidence_span":{e}}}'
    wanted = {
        row('"YES"', '"UNSURE"', f"[{good}]"): None, row('"NO"', "null", "[]"): None, row('"NO"', '"UNSURE"', "[]"): "NO_WITH_TARGET", row('"NO"', "null", f"[{good}]"): "CARDINALITY", row('"NO"', "null", "null"): "CARDINALITY",
        row('"YES"', "null", f"[{good}]"): "TARGET_UNKNOWN", row('"YES"', '"N/A"', f"[{good}]"): "TARGET_UNKNOWN", row("true", '"UNSURE"', "[]"): "PRESENCE_UNKNOWN", row('"UNSURE"', '"UNSURE"', "[]"): "CARDINALITY",
        row('"YES"', '"UNSURE"', f"[{good},null]"): "SPAN_PLACE", row('"YES"', '"UNSURE"', "[{}]"): "SPAN_PLACE", row('"YES"', '"UNSURE"', f"[{good.replace('3', '4')}]"): "SPAN_PLACE", row('"YES"', '"UNSURE"', f"[{good.replace('3', 'true')}]"): "SPAN_PLACE",
        "[]": "FIELDS", "{": "FIELDS", "{}": "FIELDS", row('"NO"', "null", '[],"x":1'): "FIELDS", None: "FIELDS",
    }
    rows = spark.createDataFrame([(v, "a\U0001f600bc") for v in wanted], "v string, t string")
    assert {r.v: r.e for r in rows.select("v", second_pass.package_error(F.col("v"), F.col("t")).alias("e")).collect()} == wanted


#: Documents whose quotes have hyphens and apostrophes, which the queries' responses write in other characters.
MARKED = "a man's well-known son-in-law didn't come to O'Brien's co-op, and it's so-so"


def rows_of_both(spark, folder, name):
    (folder / "documents.parquet").mkdir()
    pq.write_table(pa.table({"doc_id": list(range(200)), "text": [f"{MARKED} {k}" for k in range(200)]}), folder / "documents.parquet" / "0.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    return sorted(map(repr, map(tuple, QUERIES[name](spark, str(folder)).select(names).collect()))), sorted(map(repr, want.fetchall()))


def test_responses_hold_characters_beyond_latin(spark, tmp_path):
    got, want = rows_of_both(spark, tmp_path, "hostility_validation")
    assert got == want


def test_repairs_hold_characters_beyond_latin(spark, tmp_path):
    got, want = rows_of_both(spark, tmp_path, "repair_errors")
    assert got == want


def test_artifact_verdicts_are_made_once(spark, pytestconfig):
    plan = QUERIES["artifact_accounts"](spark, pytestconfig.DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
