"""Workspaces against plain loops over the same rows."""

import random

from rostrum.operators import samples as S
from rostrum.operators import workspaces as W

STATES = ["assigned", "claimed", "in_progress", "submitted", "skipped", "flagged", "withdrawn"]


def tables(spark, seed):
    rng = random.Random(seed)
    projects = [(p, rng.choice(["active", "paused", "draft", "archived"]), rng.choice([None, 1]), rng.randrange(3)) for p in range(20)]
    tasks = [(t, rng.randrange(18), t, rng.choice(["submitted", "open"])) for t in range(120)]
    assigned = [(a, rng.randrange(130), rng.choice([1, 1, 2, None]), rng.choice([*STATES, None]), rng.randrange(4)) for a in range(400)]
    noted = [(a, rng.choice(["draft", "submitted", "revised", "other"])) for a in range(0, 400, 3)]
    members = [(p, u, rng.choice(["annotator", "manager"]), rng.choice(["active", "active", "gone"])) for p in range(16) for u in (1, 2)]
    frames = (
        spark.createDataFrame(projects, "project_id int, status string, source_project_id int, updated_at int"), spark.createDataFrame(tasks, "task_id int, project_id int, turn_id int, status string"),
        spark.createDataFrame(assigned, "assignment_id int, task_id int, user_id int, status string, updated_at int"), spark.createDataFrame(noted, "assignment_id int, status string"),
        spark.createDataFrame(members, "project_id int, user_id int, project_role string, status string"),
    )
    of = {t: p for t, p, *_ in tasks}
    rows = [(a, of[t], u, s, at, dict(noted).get(a)) for a, t, u, s, at in assigned if t in of]
    return projects, tasks, rows, members, frames


def test_projects_as_their_reader_sees_them(spark):
    for seed, admin in ((1, False), (2, True)):
        projects, tasks, rows, members, (dp, dt, da, dn, dm) = tables(spark, seed)
        got = W.project_list(dp, dt, W.work(da, dt, dn), dm, 1, admin).collect()
        role = {p: r for p, u, r, s in members if u == 1 and s == "active"}
        listed = sorted((x for x in projects if admin or x[0] in role), key=lambda x: ({"active": 0, "paused": 1, "draft": 2}.get(x[1], 3), x[2] is not None, -x[3], -x[0]))
        assert [r.project_id for r in got] == [x[0] for x in listed]
        for r in got:
            mine = [x for x in rows if x[1] == r.project_id and x[3] not in (None, "withdrawn", "flagged") and (admin or role[r.project_id] != "annotator" or x[2] == 1)]
            wanted = [
                sum(t[1] == r.project_id for t in tasks), sum(t[1] == r.project_id and t[3] == "submitted" for t in tasks), len(mine), sum(x[3] in ("assigned", "claimed") and x[5] is None for x in mine),
                sum(x[3] != "skipped" and (x[5] == "draft" or x[3] == "in_progress") for x in mine), sum(x[5] in ("submitted", "revised") or x[3] == "submitted" for x in mine), sum(x[3] == "skipped" for x in mine),
            ]
            assert [r.task_count, r.submitted_count, r.human_total, r.human_to_annotate, r.human_in_progress, r.human_completed, r.human_skipped] == wanted


def test_queues_dashboards_and_progress(spark):
    projects, _, rows, _, (dp, dt, da, dn, _) = tables(spark, 3)
    active, work = {p for p, s, *_ in projects if s == "active"}, W.work(da, dt, dn)
    for u in (1, 2, None):
        mine = [x for x in rows if x[1] in active and x[2] == u and x[3] in W.OPEN]
        wanted = [x[0] for x in sorted(mine, key=lambda x: ({"in_progress": 0, "claimed": 1}.get(x[3], 3), -x[4], x[0]))[:5]]
        assert {r.assignment_id for r in W.queues(work, dp, 5).collect() if r.user_id == u} == set(wanted)
        row = next(r for r in W.dashboards(work, dp).collect() if r.user_id == u)
        own = [x for x in rows if x[1] in active and x[2] == u]
        assert (row.assigned, row.drafts, row.flagged) == (len(mine), sum(x[5] == "draft" for x in own), sum(x[3] == "flagged" for x in own))
    done = {(r.user_id, r.project_id): (r.total, r.completed) for r in W.progress(work).collect()}
    for (u, p), n in done.items():
        kept = [x for x in rows if x[2] == u and x[1] == p and x[3] not in (None, "withdrawn")]
        assert n == (len(kept), sum(x[3] == "submitted" for x in kept))


def test_versions_in_short(spark):
    said = {
        '{"is_non_policy":true}': ("Non-Policy", True, "Non-Policy", None, []), '{"is_non_policy":null,"content_status":"other"}': ("Policy", True, "Policy", None, []),
        '{"content_status":"substantive_policy","primary_australian_domain":"a","secondary_australian_domains":["b"]}': ("Policy", True, "Policy", "a", ["b"]), '{"content_status":null}': ("Non-Policy", True, "Non-Policy", None, []),
        '{"hostility_present":"NO"}': ("Not applicable", False, "Hostility: NO", None, []), '{"hostility_present":""}': ("Not applicable", False, "Annotation", None, []), "[1]": ("Not applicable", False, "Annotation", None, []), "{": ("Not applicable", False, "Annotation", None, []),
    }
    rows = [(*x, None) for x in enumerate(said)] + [(99, None, None)]
    got = {r.v: tuple(r)[-5:] for r in W.with_label(spark.createDataFrame(rows, "k int, v string, clash string"), "v").collect()}
    assert got == said | {None: ("Not applicable", False, "Annotation", None, [])}


def test_lists_of_campaigns_and_corpora(spark):
    corpora = spark.createDataFrame([(1, "z", True, 7), (2, "a", True, None), (3, "b", False, 7), (4, "c", None, 7)], "corpus_id int, name string, is_active boolean, current_run_id int")
    runs = spark.createDataFrame([(7, "seven", "p7")], "run_id int, run_name string, public_id string")
    assert [(r.name, r.run_name) for r in W.corpus_list(corpora, runs).collect()] == [("a", None), ("z", "seven")]
    campaigns = spark.createDataFrame([(1, 1, 7, 5), (2, 3, None, 5), (3, 9, 7, 9), (4, 2, 8, 8)], "campaign_id int, corpus_id int, run_id int, created_at int")
    assert [(r.campaign_id, r.corpus_name, r.run_public_id) for r in W.campaign_list(campaigns, corpora, runs).collect()] == [(4, "a", None), (2, "b", None), (1, "z", "p7")]


def test_frozen_samples(spark):
    sample = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c"), (4, "d"), (5, "d"), (6, None)], "sample_order int, turn_key string")
    turns = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (13, "d"), (14, "e")], "turn_id int, turn_key string")
    taken = spark.createDataFrame([("a",), ("a",)], "turn_key string")
    got = {r.sample_order: (r.turn_id, r.error, r.priority) for r in S.sample_batch(sample, turns, taken).collect()}
    assert got == {1: (None, "TAKEN", -1), 2: (None, "AMBIGUOUS", -2), 3: (None, "MISSING", -3), 4: (None, "TWICE", -4), 5: (None, "TWICE", -5), 6: (None, "MISSING", -6)}
    good = S.sample_batch(sample.filter("turn_key in ('a')"), turns, taken.limit(0))
    row = S.batch_accounts(good, 1).first()
    assert row.usable and row.first_missing == "" and not S.batch_accounts(good, 2).first().usable and not S.batch_accounts(good.limit(0), 0).first().usable
    stored = spark.createDataFrame([(1, "a")], "sample_order int, turn_key string")
    assert S.same_batch(good, stored) and not S.same_batch(good, stored.limit(0)) and not S.same_batch(good, stored.union(stored)) and not S.same_batch(good, sample)


def test_eligible_by_the_latest_policy_label(spark):
    records = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 1), (3, 9)], "campaign int, turn_id int")
    turns = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "turn_id int, turn_key string")
    said = [(1, 1, 1, 5, "policy", True), (2, 1, 2, 5, "policy", False), (3, 1, 9, 9, "hostility", True), (4, 2, 1, 1, "policy", None), (5, 4, 1, 1, "policy", False)]
    got = {tuple(r) for r in S.eligibility(records, turns, spark.createDataFrame(said, "prediction_id int, turn_id int, run_id int, imported_at int, task string, is_non_policy boolean")).collect()}
    assert got == {(1, 3, 2, "b"), (2, 2, 0, None)}
