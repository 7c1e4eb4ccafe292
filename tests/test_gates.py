"""Gates on nulls, empty tables and rows that break one rule each."""

import pytest
from pyspark.sql import functions as F

from rostrum.operators import exports, gates, selection

FACTS = {"human_status": "policy", "human_domain": "health", "model_status": "policy", "model_domain": None}
RULING = FACTS | {"outcome": "model_error", "status": "policy", "domain": "health", "issue_type": "scope", "rationale": "r", "revise": "no"}
KINDS = "k string, human_status string, human_domain string, model_status string, model_domain string"


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None), ({"outcome": None}, "OUTCOME_UNKNOWN"), ({"status": "?"}, "STATUS_UNKNOWN"), ({"human_status": None}, "STATUS_UNKNOWN"), ({"rationale": ""}, "REASON_MISSING"), ({"revise": None}, "REVISION_UNKNOWN"),
        ({"status": "non-policy"}, "NON_POLICY_WITH_DOMAIN"), ({"domain": None}, "POLICY_WITHOUT_DOMAIN"), ({"domain": None, "outcome": "codebook_ambiguous"}, None), ({"model_domain": "x"}, "FACTS_DIFFER"), ({"model_domain": ""}, None),
    ],
)
def test_ruling(spark, change, error):
    given = spark.createDataFrame([("a", *FACTS.values())], KINDS)
    ruled = spark.createDataFrame([("a", *(RULING | change).values())], KINDS + ", outcome string, status string, domain string, issue_type string, rationale string, revise string")
    assert [r.error for r in gates.ruling_errors(given, ruled, "k").collect()] == ([error] if error else [])


def test_rulings_of_nothing(spark):
    given = spark.createDataFrame([("a", *FACTS.values())], KINDS)
    none = spark.createDataFrame([], KINDS + ", outcome string, status string, domain string, issue_type string, rationale string, revise string")
    assert [tuple(r) for r in gates.ruling_errors(given, none, "k").collect()] == [("a", "RULING_MISSING")]
    assert gates.ruling_errors(given.limit(0), none, "k").isEmpty()


@pytest.mark.parametrize(
    ("planned", "outcomes", "want"),
    [
        ([], [], (0, 0, 0, 0, 0, True)), (["a", "b"], [("a", "ok"), ("b", "no")], (2, 0, 0, 0, 0, True)), (["a", "b"], [("a", "ok")], (2, 1, 0, 0, 0, False)),
        (["a"], [("a", "ok"), ("c", "ok")], (1, 0, 1, 0, 0, False)), (["a"], [("a", "ok"), ("a", "ok")], (1, 0, 0, 1, 0, False)), (["a"], [("a", None)], (1, 0, 0, 0, 1, False)),
    ],
)
def test_coverage(spark, planned, outcomes, want):
    row = gates.coverage(spark.createDataFrame([(p,) for p in planned], "k string"), spark.createDataFrame(outcomes, "k string, s string"), "k", "s", ("ok", "no")).collect()
    assert [tuple(r) for r in row] == [want]


def test_file_failures(spark):
    """A file without fault has no row; one whose elements were all lost has a row per tag; an unknown tag is not reported."""
    counts = lambda *rows: spark.createDataFrame(rows, "source_file string, tag string, n bigint")
    key = "source_file string, sequence_number bigint"
    fragments = spark.createDataFrame([("good", 1, "speech"), ("good", 2, "interjection"), ("good", 3, "continuation"), ("bad", 1, None)], key + ", talktype_raw string")
    lineage = spark.createDataFrame([("good", 1, 1, "initial"), ("good", 3, 1, "continuation")], key + ", turn bigint, relation string")
    said = spark.createDataFrame([("good", 2)], key)
    tags = ("speech", "major-heading", "minor-heading", "division", "bills", "bill")
    found = gates.file_failures(counts(("good", "speech", 3), *[("bad", t, 2) for t in (*tags, "p")]), counts(("good", "speech", 3)), fragments, lineage, said, lineage)
    assert {tuple(r) for r in found.collect()} == {("bad", gates.COUNT_CODES[t], 2) for t in tags} | {("bad", "FRAGMENT_DISPOSITION_INVALID", 1)}


def test_queue_is_checked(spark):
    rows = spark.createDataFrame([(1, None, None, '{"target":"UNSURE"}'), (2, "edited", "flagged", None)], "k int, last_status string, flagged_status string, v string")
    ask = lambda *a, **more: [r.k for r in selection.review_queue(rows, *a, **more).collect()]
    assert (ask("unreviewed"), ask("reviewed"), ask("flagged_codebook"), ask("edited"), ask("accepted")) == ([1], [2], [2], [2], [])
    assert ask("unreviewed", json={"target": ("v", "UNSURE")}) == [1] and ask("reviewed", json={"target": ("v", "UNSURE")}) == []
    with pytest.raises(ValueError):
        selection.review_queue(rows, "reviewed", year=("v", 1800))


def test_preview_and_order(spark):
    none = spark.createDataFrame([], "text string, d date, p string, n int, k string")
    assert [tuple(r) for r in selection.preview(none, selection.Criteria(words_min=1), 5).collect()] == [(0, 0)]
    assert exports.canonical_order(none, "d", "p", "n", "k").isEmpty()
    rows = spark.createDataFrame([("é", 1), ("z", 2), ("Z", 3)], "p string, id int").select("*", F.lit("2000-01-01").cast("date").alias("d"), F.lit(1).alias("n"), F.lit("").alias("k"))
    assert [r.id for r in exports.canonical_order(rows, "d", "p", "n", "k").orderBy("corpus_order").collect()] == [3, 2, 1]
