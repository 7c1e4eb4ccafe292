"""Records out of frozen plans, and results out of audits, against Python's own JSON."""

import json
import random

from rostrum.operators import baseline as B


def prompt(**more):
    head = {"date": None, "chamber": "x", "speaker_name": "a \"b\" \\ é\t\U0001f600", "major_heading": "", "minor_heading": 3, "business_type": True} | more
    return "METADATA:\n" + json.dumps({k: v for k, v in head.items() if v != "gone"}, ensure_ascii=False, sort_keys=True) + "\n\nSPEECH:\n"


def request(key, text, config=None, **more):
    return {"metadata": {"key": key}, "request": {"contents": [{"parts": [{"text": text}]}], "generationConfig": config or {"b": 1, "a": [2]}} | more}


def plan(*entries):
    return json.dumps({"provenance": {"model": "m", "n": 1}, "request": {"batch": {"input_config": {"requests": {"requests": entries}}}}})


def test_records_of_a_plan(spark):
    texts = {
        "a": prompt() + "said", "b": prompt() + "", "c": prompt() + "x\n\nSPEECH:\ny", "twice": prompt(), "no": "SPEECH:\n", "cut": prompt().replace("}", "") + "z", "more": prompt(q=1), "less": prompt(date="gone"),
        "space": prompt().replace(": ", ":") + "z", "array": "METADATA:\n[1]\n\nSPEECH:\nz", "nothing": None,
    }
    odd = [request("turn:parts", "", contents=[{"parts": [{"text": "a"}, {"text": "b"}]}]), request("turn:contents", "", contents=[]), request("other:a", "x"), request(None, "x"), request("turn:outside", "x")]
    rows = [("p", plan(*[request(f"turn:{k}", t) for k, t in texts.items()], request("turn:twice", "again"), *odd)), ("q", plan()), ("r", "{"), ("s", None), ("t", "[]")]
    asked = B.requests(spark.createDataFrame(rows, "id string, json string"), "id", "json")
    assert asked.count() == len(texts) + 4
    expected = spark.createDataFrame([(k,) for k in [*texts, "parts", "contents", "absent", "absent"]], "turn_key string")
    got = {r.turn_key: r for r in B.records(expected, asked).collect()}
    assert {k: r.error for k, r in got.items()} == dict.fromkeys("abc") | {
        "twice": "REPEATED", "no": "STRUCTURE", "cut": "METADATA_JSON", "more": "METADATA_FIELDS", "less": "METADATA_FIELDS", "space": "ROUND_TRIP", "array": "METADATA_FIELDS", "nothing": "PARTS", "parts": "PARTS", "contents": "PARTS", "absent": "MISSING"}
    assert [got[k].speech for k in "abc"] == ["said", "", "x\n\nSPEECH:\ny"]
    assert (got["a"].speaker_name, got["a"].date, got["a"].minor_heading, got["a"].major_heading) == ("a \"b\" \\ é\t\U0001f600", None, "3", "")
    row = B.accounts(B.records(expected, asked), asked, {"model": "m"}).first()
    assert (row.n_turns, row.n_records, row.n_missing, row.n_repeated, row.n_broken, row.n_configurations, row.provenance_holds, row.usable) == (14, 3, 1, 1, 9, 1, True, False)
    good = expected.filter("turn_key in ('a', 'b')")
    for wanted, holds in (({"model": "m"}, True), ({"model": "k"}, False), ({"model": "m", "none": "x"}, False)):
        row = B.accounts(B.records(good, asked), asked, wanted).first()
        assert (row.usable, row.provenance_holds) == (holds, holds)
    nothing = B.accounts(B.records(good.limit(0), asked), asked, {}).first()
    assert nothing.n_turns == 0 and not nothing.usable


def test_configurations_differ_by_content_only(spark):
    rows = [("p", plan(request("turn:a", prompt(), {"b": 1, "a": [2]}), request("turn:b", prompt(), {"a": [2], "b": 1}), request("turn:c", prompt(), {"a": [3], "b": 1})))]
    asked = B.requests(spark.createDataFrame(rows, "id string, json string"), "id", "json")
    for names, n in (("ab", 1), ("abc", 2)):
        assert B.accounts(B.records(asked.filter(asked.turn_key.isin(*names)).select("turn_key"), asked), asked, {}).first().n_configurations == n


def test_results_of_an_audit(spark):
    rng = random.Random(1)
    rows = [
        (k, rng.choice([True, False, None]), rng.choice(['{"a":1}', "[1]", "{", "", None]), rng.choice(["PREDICTION", "", None, "BAD"]), rng.choice(["Unmatched x", "", None]), rng.choice(["AMBIGUOUS", None]))
        for k in range(300)
    ]
    got = {r.record_id: r for r in B.results(spark.createDataFrame(rows, "record_id int, valid boolean, values string, outcome string, diagnostic string, reason string")).collect()}
    for k, valid, values, outcome, diagnostic, reason in rows:
        r = got[k]
        if valid:
            assert (r.status, r.prediction, r.error_type, r.error_message, r.evidence_unmatched) == ("success", values, None, None, [])
            assert r.error == (None if values == '{"a":1}' else "VALUES_NOT_AN_OBJECT")
        else:
            message = diagnostic or reason or outcome
            assert (r.status, r.prediction, r.error_type, r.error_message) == ("invalid", None, outcome, message)
            assert r.evidence_unmatched == ([message] if "unmatched" in (message or "").lower() else []) and r.evidence_ambiguous == ([message] if "ambiguous" in (message or "").lower() else [])
            assert r.error == ("OUTCOME_MISSING" if outcome in ("", "PREDICTION", None) else None)
