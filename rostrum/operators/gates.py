"""Gates that results pass before they leave: the first broken rule of a row, or what fails in a file or a campaign."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a file's element counts are called when they differ, and codes of rulings and second passes.
COUNT_CODES = {
    "speech": "SPEECH_FRAGMENT_COUNT_MISMATCH", "major-heading": "MAJOR_HEADING_COUNT_MISMATCH", "minor-heading": "MINOR_HEADING_COUNT_MISMATCH",
    "division": "DIVISION_COUNT_MISMATCH", "bills": "BILLS_COUNT_MISMATCH", "bill": "BILL_RECORD_COUNT_MISMATCH",
}
OUTCOMES = ("human_correct", "human_needs_revision", "model_error", "codebook_ambiguous")
STATUSES = ("policy", "non-policy")
PRESENCES = ("YES", "NO", "UNSURE")
TARGETS = ("OPPOSING_PARTISAN_TARGET", "OTHER_POLITICAL_TARGET", "NON_POLITICAL_TARGET", "UNSURE")


def first(**rules: Column) -> Column:
    """The name of the first rule that a row breaks; null if it breaks none.  A rule that is null isn't broken."""
    return F.coalesce(*[F.when(broken, name) for name, broken in rules.items()])


def _in(c: Column, codes: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*codes), F.lit(False))


def file_failures(observed: DataFrame, produced: DataFrame, fragments: DataFrame, lineage: DataFrame, interjections: DataFrame, turns: DataFrame) -> DataFrame:
    """(source_file, failure_code, n): what was read from each file against what became of it.

    ``observed``, ``produced``: (source_file, tag, n).  ``fragments``: talktype_raw by (source_file, sequence_number); ``lineage``: the
    turn and relation of those that are part of one; ``interjections``: the others.  ``turns``: (source_file, turn).  A fragment that
    is there twice counts twice.
    """
    n, key = F.col("n"), ["source_file", "sequence_number"]
    sides = [d.select("source_file", "tag", n.alias("_a") if k == 0 else F.lit(0).alias("_a"), n.alias("_b") if k else F.lit(0).alias("_b")) for k, d in enumerate((observed, produced))]
    tags = sides[0].unionByName(sides[1]).groupBy("source_file", "tag").agg(F.abs(F.sum("_a") - F.sum("_b")).alias("n")).filter("n > 0")
    code = reduce(lambda c, t: c.when(F.col("tag") == t[0], t[1]), COUNT_CODES.items(), F.when(F.lit(False), ""))
    differing = tags.select("source_file", code.alias("failure_code"), "n").filter("failure_code is not null")

    none, false = F.lit(0), F.lit(False)
    kinds = F.col("talktype_raw") == "interjection", F.col("talktype_raw") == "continuation", F.col("relation").isin("continuation", "orphan")
    marks = [
        fragments.select(*key, F.lit(1).alias("f"), none.alias("l"), none.alias("i"), F.coalesce(kinds[0], false).alias("said_in"), F.coalesce(kinds[1], false).cast("int").alias("c")),
        lineage.select(*key, none.alias("f"), F.lit(1).alias("l"), none.alias("i"), false.alias("said_in"), (-F.coalesce(kinds[2], false).cast("int")).alias("c")),
        interjections.select(*key, none.alias("f"), none.alias("l"), F.lit(1).alias("i"), false.alias("said_in"), none.alias("c")),
    ]
    each = reduce(DataFrame.unionByName, marks).groupBy(*key).agg(*[F.sum(c).alias(c) for c in "flic"], F.bool_or("said_in").alias("said_in"))
    there, inside = F.col("f") > 0, F.col("said_in")
    rules = {
        "DUPLICATE_GENERATED_FRAGMENT_KEY": F.count_if(F.col("f") > 1),
        "INTERJECTION_DISPOSITION_INVALID": F.sum(F.when(there & inside & ~((F.col("l") == 0) & (F.col("i") == 1)), F.col("f"))),
        "FRAGMENT_DISPOSITION_INVALID": F.sum(F.when(there & ~inside & ~((F.col("l") == 1) & (F.col("i") == 0)), F.col("f"))),
        "LINEAGE_REFERENCES_UNKNOWN_FRAGMENT": F.count_if(~there & (F.col("l") > 0)),
        "CONTINUATION_DISPOSITION_MISMATCH": F.abs(F.sum("c")),
    }
    disposed = each.groupBy("source_file").agg(*[F.coalesce(c, none).cast("long").alias(name) for name, c in rules.items()])
    disposed = disposed.unpivot("source_file", list(rules), "failure_code", "n").filter("n > 0")
    strays = lineage.join(turns.select("source_file", "turn"), ["source_file", "turn"], "left_anti").groupBy("source_file").agg(F.count("*").alias("n"))
    return differing.unionByName(disposed).unionByName(strays.select("source_file", F.lit("LINEAGE_REFERENCES_UNKNOWN_TURN").alias("failure_code"), "n"))


def ruling_errors(mismatches: DataFrame, rulings: DataFrame, key: str) -> DataFrame:
    """(key, error) of every ruling that can't be used, and of mismatches that have none.

    Both have human_status, human_domain, model_status and model_domain, which must agree; a ruling has outcome, status, domain,
    issue_type, rationale and revise too.
    """
    facts = ["human_status", "human_domain", "model_status", "model_domain"]
    given = mismatches.groupBy(key).agg(F.count("*").alias("_n_given"), F.min(F.struct(*facts)).alias("_given"))
    said = ["outcome", "status", "domain", "issue_type", "rationale", "revise", *facts]
    ruled = rulings.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*said)).alias("_r"))
    r, empty = (lambda c: F.col(f"_r.{c}")), (lambda c: F.coalesce(c, F.lit("")) == "")
    differs = [~F.coalesce(r(c), F.lit("")).eqNullSafe(F.coalesce(F.col(f"_given.{c}"), F.lit(""))) for c in facts]
    error = first(
        ID_MISSING=empty(F.col(key).cast("string")), RULING_MISSING=F.col("_n").isNull(), RULING_UNEXPECTED=F.col("_n_given").isNull(), REPEATED=(F.col("_n") > 1) | (F.col("_n_given") > 1),
        OUTCOME_UNKNOWN=~_in(r("outcome"), OUTCOMES), STATUS_UNKNOWN=~(_in(r("status"), STATUSES) & _in(r("human_status"), STATUSES) & _in(r("model_status"), STATUSES)),
        REASON_MISSING=empty(r("issue_type")) | empty(r("rationale")), REVISION_UNKNOWN=~_in(r("revise"), ("yes", "no")),
        NON_POLICY_WITH_DOMAIN=(r("status") == "non-policy") & ~empty(r("domain")), POLICY_WITHOUT_DOMAIN=(r("status") == "policy") & empty(r("domain")) & (r("outcome") != "codebook_ambiguous"),
        FACTS_DIFFER=reduce(Column.__or__, differs),
    )
    return given.join(ruled, key, "full").select(key, error.alias("error")).filter("error is not null")


def provenance_error(row: dict[str, Column], expected: dict[str, str]) -> Column:
    """The first field, in the order of ``expected``, that a row has with another value than the one configured; null if there is none."""
    return first(**{name: row[name].isNotNull() & (row[name] != F.lit(want)) for name, want in expected.items() if name in row})


def coverage(planned: DataFrame, outcomes: DataFrame, key: str, status: str, known: tuple[str, ...]) -> DataFrame:
    """One row: do the outcomes cover the planned records, each once, with a status that is known; and how many don't."""
    sides = planned.select(key, F.lit(1).alias("_p"), F.lit(0).alias("_o"), F.lit(0).alias("_u")).unionByName(
        outcomes.select(key, F.lit(0).alias("_p"), F.lit(1).alias("_o"), (~_in(F.col(status), known)).cast("int").alias("_u"))
    )
    each = sides.groupBy(key).agg(F.sum("_p").alias("p"), F.sum("_o").alias("o"), F.sum("_u").alias("u"))
    row = each.agg(
        F.count_if(F.col("p") > 0).alias("n_planned"), F.count_if((F.col("p") > 0) & (F.col("o") == 0)).alias("n_missing"),
        F.count_if((F.col("p") == 0) & (F.col("o") > 0)).alias("n_outside"), F.count_if((F.col("o") > 1) | (F.col("p") > 1)).alias("n_repeated"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_unknown"),
    )
    return row.withColumn("complete", F.col("n_missing") + F.col("n_outside") + F.col("n_repeated") + F.col("n_unknown") == 0)
