"""Review audits against a plain reading of each row, the choice of a run, and what may be exported."""

import csv
import io
import json
import random

import pytest

from rostrum.operators import audits as A

PREDICTIONS = "prediction_id int, turn_id int, task string, values string"
REVIEWS = "prediction_id int, review_id int, reviewed_at int, review_status string, note string, version_id int"
VERSIONS = "version_id int, human_turn_id int, human_values string"


def audit(spark, predictions, failures, reviews, after, versions):
    made = [spark.createDataFrame(r, s) for r, s in ((predictions, PREDICTIONS), (failures, PREDICTIONS), (reviews, REVIEWS), (after, REVIEWS), (versions, VERSIONS))]
    return A.audited(A.review_rows(*made))


def test_rows_against_a_plain_reading(spark):
    rng = random.Random(3)
    pick = rng.choice
    policy = lambda: {k: v for k, v in {"is_non_policy": pick([True, False, None]), "primary_australian_domain": pick(["a", "b", None]), "secondary_australian_domains": pick([["x"], ["x", "y"], [], None])}.items() if pick([1, 1, 0])}
    span = [{"start": 1, "text": "q"}]
    ai_h = lambda: {"hostility_present": pick(["YES", "NO"]), "target": pick(["N/A", "P", None]), "evidence_spans": pick([span, [], None])}
    hu_h = lambda: {"hostility_present": pick(["YES", "NO"]), "target": pick(["P", None]), "evidence_span": pick([[{"text": "q", "start": 1}], [], None])}
    predictions, reviews, versions, kept = [], [], [], {}
    for k in range(400):
        task = pick(["policy", "hostility"])
        ai, human = (policy(), policy()) if task == "policy" else (ai_h(), hu_h())
        state, text, turn = pick(["accepted", "edited", "skipped", None, "edited"]), pick([json.dumps(human)] * 6 + [None, "[1]", "{", "{}"]), pick([k] * 9 + [k + 1])
        predictions.append((k, k, task, json.dumps(ai)))
        versions.append((k, turn, text))
        if state:
            reviews += [(k, 1, 5, pick(["accepted", "edited"]), "early", None), (k, 2, 7, state, "late", pick([k] * 9 + [None]))]
        flags = rng.sample(range(100), pick([0, 0, 1, 3]))
        reviews += [(k, 10 + i, at, A.FLAG, pick(["n", "m", None]), None) for i, at in enumerate(flags)]
        kept[k] = task, ai, human, state, text, turn
    by = {}
    for r in reviews:
        by.setdefault(r[0], []).append(r)
    rng.shuffle(reviews)
    for r in audit(spark, predictions, [], reviews, [], versions).collect():
        task, ai, human, state, text, turn = kept[r.prediction_id]
        mine = by.get(r.prediction_id, [])
        version = next((x[5] for x in mine if x[1] == 2), None)
        flags = sorted((x for x in mine if x[3] == A.FLAG), key=lambda x: (x[2], x[1]))
        assert (r.n_flags, r.notes, r.review_status) == (len(flags), [x[4] for x in flags if x[4]], state)
        try:
            read = json.loads(text) if version is not None else None
        except (TypeError, ValueError):
            read = None
        said = read if isinstance(read, dict) else {}
        changed = []
        if state in ("accepted", "edited"):
            if task == "policy":
                pairs = [(bool(ai.get(n)), bool(said.get(n))) if n == A.POLICY[0] else (ai.get(n) or [], said.get(n) or []) if n == A.POLICY[2] else (ai.get(n), said.get(n)) for n in A.POLICY]
                changed = [n for n, (x, y) in zip(A.POLICY, pairs) if x != y]
            else:
                wanted = [ai["hostility_present"], None if ai["target"] == "N/A" else ai["target"], ai["evidence_spans"] or []]
                changed = [n for n, x in zip(A.HOSTILITY, wanted) if said.get(n) != x]
        assert r.changed == changed, (r, kept[r.prediction_id])
        if state in ("accepted", "edited") and not isinstance(read, dict):
            error = "NO_ANNOTATION"
        elif state in ("accepted", "edited") and turn != r.prediction_id:
            error = "OTHER_TURN"
        else:
            error = "EDITED_UNCHANGED" if state == "edited" and not changed else "ACCEPTED_CHANGED" if state == "accepted" and changed else None
        assert r.error == error
        assert (r.edit_category is None) == (state != "edited")
        assert (r.human_label == "") == (not said)


def test_failures_and_odd_states(spark):
    after = [(1, 1, 1, A.AFTER_FAILURE, None, 1), (2, 1, 1, "odd", None, None), (3, 1, 1, A.AFTER_FAILURE, None, None)]
    got = {r.prediction_id: r for r in audit(spark, [], [(k, k, "hostility", None) for k in range(1, 5)], [(1, 9, 9, A.FLAG, "n", None)], after, [(1, 1, '{"hostility_present":"NO"}')]).collect()}
    assert {k: (r.error, r.ai_label, r.human_label, r.n_flags, r.changed) for k, r in got.items()} == {
        1: (None, "INVALID_OUTPUT", "NO:N/A", 0, []), 2: ("UNEXPECTED_STATE", "INVALID_OUTPUT", "", 0, []), 3: ("NO_ANNOTATION", "INVALID_OUTPUT", "", 0, []), 4: (None, "INVALID_OUTPUT", "", 0, [])}
    nothing = A.summary(audit(spark, [], [], [], [], []), 0).first()
    assert nothing.consistent and nothing.total == 0


def test_one_run_is_chosen(spark):
    runs = spark.createDataFrame([(1, "a", 5), (2, "b", 7), (3, "c", 7), (4, "2", 1)], "id int, public_id string, imported_at int")
    assert A.chosen_run(runs).id == 3 and A.chosen_run(runs, "a").id == 1
    for wanted in ("2", "z"):
        with pytest.raises(ValueError):
            A.chosen_run(runs, wanted)
    with pytest.raises(ValueError):
        A.chosen_run(runs.limit(0))


def test_what_may_be_exported(spark, tmp_path):
    values = [json.dumps({"is_non_policy": False, "primary_australian_domain": d, "secondary_australian_domains": []}) for d in ("a", "é, \"b\"")]
    predictions, versions = [(1, 1, "policy", values[0]), (2, 2, "policy", values[0])], [(1, 1, values[1]), (2, 2, values[0])]
    edited, flag = (1, 1, 1, "edited", "line\nline", 1), (1, 2, 2, A.FLAG, "why", None)
    some = audit(spark, predictions, [], [edited, flag], [], versions)
    with pytest.raises(ValueError, match="not reviewed"):
        A.export(some, 2, f"{tmp_path}/no", "package")
    with pytest.raises(ValueError, match="not consistent"):
        A.export(some, 3, f"{tmp_path}/no", "edited")
    A.export(some, 2, f"{tmp_path}/some", "edited")
    assert not (tmp_path / "no").exists() and sorted(p.name for p in (tmp_path / "some").iterdir()) == ["edited"]
    whole = audit(spark, predictions, [], [edited, flag, (2, 3, 1, "accepted", None, 2)], [], versions)
    A.export(whole, 2, f"{tmp_path}/all", "package")
    assert sorted(p.name for p in (tmp_path / "all").iterdir()) == ["breakdown", "edited", "flags", "full", "summary"]
    parts = [p.read_bytes() for p in sorted((tmp_path / "all" / "full").glob("part-*"))]
    assert parts[0].startswith(b"\xef\xbb\xbf") and b"".join(parts).count(b"\xef\xbb\xbf") == 1
    back = list(csv.DictReader(io.StringIO(b"".join(parts).decode("utf-8-sig"), newline="")))
    assert {r["prediction_id"]: (r["note"], r["human_values"], r["valid"]) for r in back} == {"1": ("line\nline", values[1], "true"), "2": ("", values[0], "true")}
    facts = json.loads(next((tmp_path / "all" / "summary").glob("part-*")).read_text())
    assert (facts["edited"], facts["accepted"], facts["primary_domain_changes"], facts["edited_and_flagged"], facts["consistent"]) == (1, 1, 1, 1, True)
