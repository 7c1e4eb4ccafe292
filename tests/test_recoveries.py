"""Recoveries against plain loops: histories, what is left, chains of campaigns."""

import json
import random

from pyspark.sql import functions as F

from rostrum.operators import recoveries as R

ATTEMPTS = "recovery int, campaign int, attempt_number int, provider_job_id string, recovery_mode string, status string, artifact string"
RECORDS = "recovery int, record_id string, original_validation_error string"
ROWS = "artifact string, record_id string, status string, recovery_attempt_number int, recovery_provider_job_id string, recovery_mode string, original_validation_error string, validation_error string, provider_error string"


def test_two_attempts_of_one_record_from_files_read_once(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"attempt-{n}").mkdir()
        row = {"record_id": "turn:x", "status": "invalid", "recovery_attempt_number": n, "recovery_provider_job_id": f"jobs/{n}", "recovery_mode": "evidence_only", "original_validation_error": "no quote", "validation_error": f"attempt {n}", "more": 1}
        (tmp_path / f"attempt-{n}" / "predictions.jsonl").write_text(json.dumps(row) + "\n")
    attempts = spark.createDataFrame([(n, 42, n, f"jobs/{n}", "evidence_only", "COLLECTED", f"attempt-{n}") for n in (1, 2)], ATTEMPTS)
    records = spark.createDataFrame([(n, "turn:x", "no quote") for n in (1, 2)], RECORDS)
    read = spark.read.schema(ROWS.split(", ", 1)[1]).json(f"{tmp_path}/*/predictions.jsonl")
    rows = R.history(attempts, records, read.withColumn("artifact", F.regexp_extract(F.input_file_name(), "([^/]+)/predictions", 1)))
    assert str(rows._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    got = sorted(rows.collect(), key=lambda r: r.attempt_number)
    assert [(r.attempt_number, r.replacement_validation_error, r.lineage_consistent, r.lineage_complete) for r in got] == [(1, "attempt 1", True, True), (2, "attempt 2", True, True)]
    one = R.terminal_histories(rows).first()
    assert (one.n_attempts, one.original_validation_error, one.last_error, one.history_error) == (2, "no quote", "attempt 2", None)


def test_rows_that_do_not_bear_an_attempt_out(spark):
    attempts = spark.createDataFrame(
        [(1, 7, 1, "j", None, "COLLECTED", "a"), (2, 7, 2, "j", "evidence_only", "SUBMITTED", "a"), (3, 7, 3, "j", "classification_retry", "COLLECTED", None), (4, 7, 4, None, "odd", "COLLECTED", "b")], ATTEMPTS
    )
    records = spark.createDataFrame([(1, k, "e") for k in ("same", "twice", "none", "job", "number", "error", "mode", "other")] + [(2, "same", "e"), (3, "same", "e"), (4, "same", None)], RECORDS)
    row = lambda k, n=1, job="j", mode=None, e="e": ("a", k, "invalid", n, job, mode, e, "", "why")
    rows = [row("same"), row("twice"), row("twice"), row("job", job="k"), row("number", n=2), row("error", e=None), row("mode", mode="classification_retry"), row("other", mode="evidence_only"), ("b", "same", "success", 4, None, "odd", None, None, None)]
    got = {(r.record_id, r.attempt_number): r for r in R.history(attempts, records, spark.createDataFrame(rows, ROWS)).withColumn("broken", R.attempt_error()).collect()}
    assert {k for k, r in got.items() if r.lineage_consistent} == {("same", 1), ("mode", 1), ("same", 4)}
    assert {k for k, r in got.items() if r.replacement_validation_result == "missing"} == {("twice", 1), ("none", 1), ("same", 3)}
    assert got["twice", 1].n_rows == 2 and got["twice", 1].replacement_validation_error is None and got["same", 1].replacement_validation_error == "why"
    assert ("same", 2) not in got and not got["same", 3].lineage_complete
    assert [got["same", 1].broken, got["same", 3].broken, got["same", 4].broken, got["job", 1].broken] == [None, "LINEAGE_INCOMPLETE", "JOB_MISSING", "LINEAGE_INCONSISTENT"]
    again = R.terminal_histories(R.history(attempts.filter("recovery = 1"), records.filter("record_id = 'same'").union(records.limit(1)), spark.createDataFrame(rows, ROWS))).first()
    assert (again.n_attempts, again.history_error) == (2, "ATTEMPTS_REPEATED")


def test_what_is_left(spark):
    effective = spark.createDataFrame([(1, k, s, c, e, p) for k, s, c, e, p in [("a", "invalid", "", "", "p"), ("b", "success", None, None, None), ("c", "missing", "X", "v", None), ("d", "invalid", None, "v", None)]], "campaign int, record_id string, status string, failure_category string, validation_error string, provider_error string")
    turns = spark.createDataFrame([(k, k.upper()) for k in "abc"], "record_id string, text string")
    lists = R.attempt_lists(spark.createDataFrame([(1, "a", n, n, s) for n, s in ((2, "COLLECTED"), (1, "FAILED"))], "campaign int, record_id string, attempt_number int, recovery int, status string"), "status")
    got = {r.record_id: r for r in R.unresolved(effective, turns, lists).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"].failure_category, got["a"].reason, got["a"].attempt_count, got["a"].terminal, [x.status for x in got["a"].attempts]) == ("invalid", "p", 3, True, ["FAILED", "COLLECTED"])
    assert (got["c"].failure_category, got["c"].reason, got["c"].attempt_count, got["c"].terminal, got["c"].attempts) == ("X", "v", 1, False, [])


def plain_root(sources, c):
    seen, n = set(), 0
    while c in sources and c not in seen:
        seen.add(c)
        if sources[c] is None:
            return c, n
        c, n = sources[c], n + 1
    return None, None


def test_generations(spark):
    rng = random.Random(3)
    sources = {0: None, 500: 501, 501: 502, 502: 500, 503: 502, 600: 999, 601: 600, 700: None, 800: 800}
    sources |= {k: k - 1 for k in range(1, 130)} | {k: rng.randrange(100, k) if k > 200 else 0 for k in range(200, 260)}
    got = R.generations(spark.createDataFrame(list(sources.items()), "campaign int, source int")).collect()
    assert {r.campaign: (r.root, r.generation) for r in got} == {c: plain_root(sources, c) for c in sources}
    assert R.generations(spark.createDataFrame([], "campaign int, source int")).collect() == []


def test_chains(spark):
    rng = random.Random(5)
    sources = {0: None, 1: 0, 2: 1, 3: 2, 4: 1, 10: None, 11: 10, 20: 21, 21: 20, 30: 99}  # 4 and 2 have one source
    rows = []
    for c in sources:
        for k in range(300):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2])):
                rows.append((c, k, rng.choice(["success", "invalid", "invalid", None]), rng.choice("ef"), rng.choice("ef")))
    linked = R.links(spark.createDataFrame(rows, "campaign int, record_id int, status string, validation_error string, original_validation_error string"), R.generations(spark.createDataFrame(list(sources.items()), "campaign int, source int")))
    by = {}
    for c, k, *rest in rows:
        by.setdefault((c, k), []).append(rest)
    flat = {x: [r[0][0] or "missing", *r[0][1:]] if len(r) == 1 else ["duplicate", None, None] for x, r in by.items()}

    def link(c, k):
        status, _, claimed = flat[c, k]
        if plain_root(sources, c)[0] is None:
            return "NO_ROOT"
        if sources[c] is None:
            return "DUPLICATE" if status == "duplicate" else "ORIGINAL"
        before = flat.get((sources[c], k))
        if before is None:
            return "NOT_IN_SOURCE"
        if before[0] == "success":
            return "ALREADY_RESOLVED"
        return "DUPLICATE" if "duplicate" in (status, before[0]) else "CONSISTENT" if before[1] == claimed else "ERROR_DIFFERS"

    def trusted(c, k):
        return link(c, k) == "ORIGINAL" or link(c, k) == "CONSISTENT" and trusted(sources[c], k)

    got = {(r.campaign, r.record_id): (r.link, r.trusted) for r in linked.collect()}
    assert got == {x: (link(*x), trusted(*x)) for x in flat}
    assert {"CONSISTENT", "ERROR_DIFFERS", "ALREADY_RESOLVED", "DUPLICATE", "NOT_IN_SOURCE", "NO_ROOT"} <= {a for a, _ in got.values()} and any(t and c == 3 for (c, _), (_, t) in got.items())
    want = {}
    for c, k in sorted(flat, key=lambda x: (plain_root(sources, x[0])[1] or 0, x[0])):
        root, g = plain_root(sources, c)
        if root is not None:
            old = want.setdefault((root, k), (None, None, "missing"))
            if g == 0 or trusted(c, k) and flat[c, k][0] == "success":
                want[root, k] = (c, g, flat[c, k][0])
            assert old is not None
    assert {(r.root, r.record_id): (r.campaign, r.generation, r.status) for r in R.effective(linked).collect()} == want


def chains_and_stars(spark, folder):
    sources = {0: None, 50: 3} | {k: k - 1 for k in range(1, 13)} | {k: 0 for k in range(20, 45)}
    rows = [(c, k, "invalid", f"e{c}", None if s is None else f"e{s}") for c, s in sources.items() for k in (1, 2, 3, None) if (c, k) not in ((5, 2), (0, 3))] + [(7, 1, "invalid", "e7", "e6")]
    spark.createDataFrame(rows, "campaign int, record_id int, status string, validation_error string, original_validation_error string").write.parquet(f"{folder}/results")
    return sources, R.links(spark.read.parquet(f"{folder}/results"), R.generations(spark.createDataFrame(list(sources.items()), "campaign int, source int")))


def plan(df):
    return str(df._jdf.queryExecution().executedPlan())


def test_links_read_results_once_and_meet_once(spark, tmp_path):
    """Long chains and wide trees are one plan, without rounds over the rows."""
    sources, linked = chains_and_stars(spark, tmp_path)
    assert plan(linked).count("FileScan") == 1 and plan(linked).count("Exchange hashpartitioning(root") == 1
    rows = linked.collect()
    got = {(r.campaign, r.record_id): (r.link, r.trusted) for r in rows}
    assert len(got) == len(rows) == 4 * len(sources) - 2 and {c for (c, k), (_, t) in got.items() if k == 1 and not t} == set(range(7, 13)) and got[7, 1] == got[8, 1] == ("DUPLICATE", False) and got[9, 1] == ("CONSISTENT", False)
    assert {c for (c, k), (_, t) in got.items() if k == 2 and t} == {0, 1, 2, 3, 4, 50, *range(20, 45)} and got[6, 2] == ("NOT_IN_SOURCE", False)
    assert not any(t for (_, k), (_, t) in got.items() if k == 3) and got[1, 3] == got[20, 3] == ("NOT_IN_SOURCE", False) and got[50, 3] == ("CONSISTENT", False)
    assert got[0, None] == ("ORIGINAL", False) and {got[c, None] for c in sources if c} == {("NOT_IN_SOURCE", False)}


def test_effective_rows_are_not_dealt_again(spark, tmp_path):
    sources, linked = chains_and_stars(spark, tmp_path)
    rows = R.effective(linked)
    assert plan(rows).count("FileScan") == 1 and plan(rows).count("Exchange ") == plan(linked).count("Exchange ")
    assert {r.record_id: (r.campaign, r.status, r.n_rows, r.n_distrusted) for r in rows.collect()} == {1: (0, "invalid", len(sources), 6), 2: (0, "invalid", len(sources) - 1, 7), 3: (None, "missing", len(sources) - 1, len(sources) - 1), None: (0, "invalid", len(sources), len(sources))}


def test_links_deal_results_twice_and_sort_them_once(spark, tmp_path):
    """By campaign and by record, never broadcast for being small on disk; copies are counted where a record's rows meet, in the same order."""
    _, linked = chains_and_stars(spark, tmp_path)
    rows = spark.read.parquet(f"{tmp_path}/results")
    for df in (linked, R.effective(linked)):
        steps = [x.strip(" :+-") for x in plan(df).split("\n")]
        at = next(i for i, x in enumerate(steps) if x.startswith("Exchange hashpartitioning(root"))
        assert not any("Broadcast" in x for x in steps) and sum(x.startswith("Sort ") for x in steps[:at]) == 1 and sum(x.startswith("Window ") for x in steps[:at]) == 2
        assert not any(x.startswith("Exchange hashpartitioning(campaign") and "record_id" in x for x in steps)
    copies = rows.union(rows.filter("campaign = 3 and record_id = 2").crossJoin(spark.range(3000)).drop("id"))
    placed = linked.select("campaign", "source", "root", "generation").distinct()
    got = {(r.campaign, r.record_id): (r.status, r.validation_error, r.link, r.trusted) for r in R.links(copies, placed).collect()}
    assert len(got) == linked.count() and got[3, 2] == ("duplicate", None, "DUPLICATE", False) and got[50, 2][2:] == got[4, 2][2:] == ("DUPLICATE", False) and got[2, 2] == ("invalid", "e2", "CONSISTENT", True)
