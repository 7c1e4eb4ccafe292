"""Recoveries of campaigns: what was tried again, whether artifacts bear it out, what is left, and recoveries of recoveries.

A campaign's failed records are sent again in numbered attempts, each with an artifact of its own; the results of one recovery may be the
source of the next.  Groups are of a record's attempts, which are few, so nothing here gathers a campaign.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.storage import settled

# Results that are left to recover, modes of recovery, the mode where none is given, attempts of a record at most with the
# first, a review that settles a failure.
LEFT = ("invalid", "provider_failure", "missing")
MODES = ("classification_retry", "evidence_only")
MODE = "classification_retry"
MOST = 3
BY_HAND = "human_annotated_after_ai_failure"


def _filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def single(rows: DataFrame, *key: str) -> DataFrame:
    """A row of each key: ``n_rows`` and ``_row``, the other columns where the key has one row only, null where it has several."""
    more = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min(F.struct(*more)).alias("_one")).select(*key, "n_rows", F.when(F.col("n_rows") == 1, F.col("_one")).alias("_row"))


def history(attempts: DataFrame, records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A row per record and collected attempt, with what the attempt's artifact says of the record.

    ``attempts``: recovery, campaign, attempt_number, provider_job_id, recovery_mode, status, artifact; ``records``: recovery, record_id,
    original_validation_error; ``artifacts``: the rows of all artifacts, read once, with artifact, record_id, status,
    recovery_attempt_number, recovery_provider_job_id, recovery_mode, original_validation_error, validation_error, provider_error.

    A record that its artifact lacks, or has twice, counts as missing.  ``lineage_consistent``: the artifact's row names the same attempt,
    job, mode (or none) and error.  ``lineage_complete``: the attempt has an artifact at all.
    """
    tried = attempts.filter("status = 'COLLECTED'").select(
        "recovery", "campaign", "attempt_number", "provider_job_id", F.coalesce("recovery_mode", F.lit(MODE)).alias("recovery_mode"), _filled(F.col("artifact")).alias("artifact"))
    both = records.select("recovery", "record_id", "original_validation_error").join(tried, "recovery").join(single(artifacts, "artifact", "record_id"), ["artifact", "record_id"], "left")
    row, n = F.col("_row"), F.coalesce("n_rows", F.lit(0))
    same = [row["recovery_attempt_number"].eqNullSafe(F.col("attempt_number")), row["recovery_provider_job_id"].eqNullSafe(F.col("provider_job_id")), row["original_validation_error"].eqNullSafe(F.col("original_validation_error"))]
    mode = row["recovery_mode"].isNull() | (row["recovery_mode"] == F.col("recovery_mode"))
    return both.select(
        "campaign", "record_id", "attempt_number", "recovery", F.coalesce("provider_job_id", F.lit("")).alias("provider_job_id"), "recovery_mode", "original_validation_error",
        F.coalesce(_filled(row["status"]), F.lit("missing")).alias("replacement_validation_result"),
        F.coalesce(_filled(row["validation_error"]), row["provider_error"]).alias("replacement_validation_error"),
        n.alias("n_rows"), reduce(Column.__and__, same, (n == 1) & mode).alias("lineage_consistent"), F.col("artifact").isNotNull().alias("lineage_complete"),
    )


def attempt_error() -> Column:
    """The first rule that a row of ``history`` breaks as a step towards a terminal failure, null if none."""
    result, error = F.col("replacement_validation_result"), F.col("replacement_validation_error")
    return (
        F.when(~F.col("lineage_complete"), "LINEAGE_INCOMPLETE").when(F.coalesce(F.col("provider_job_id") == "", F.lit(True)), "JOB_MISSING").when(~result.isin(*LEFT), "NOT_A_FAILURE")
        .when((result != "missing") & error.isNull(), "ERROR_MISSING").when(~F.col("recovery_mode").isin(*MODES), "MODE_UNKNOWN")
        .when(_filled(F.col("original_validation_error")).isNull(), "ORIGINAL_ERROR_MISSING").when(~F.col("lineage_consistent"), "LINEAGE_INCONSISTENT")
    )


def attempt_lists(rows: DataFrame, *columns: str) -> DataFrame:
    """campaign, record_id, ``attempts``: the record's attempts in order, as structs of attempt_number, recovery and the columns."""
    return rows.groupBy("campaign", "record_id").agg(F.array_sort(F.collect_list(F.struct("attempt_number", "recovery", *columns))).alias("attempts"))


def terminal_histories(rows: DataFrame) -> DataFrame:
    """A row per record: ``n_attempts``, first error, last result, error and mode, and ``history_error``, the first rule broken by any of its
    attempts in order: those of ``attempt_error``, or two attempts of one number."""
    worked = attempt_lists(rows.withColumn("error", attempt_error()), "original_validation_error", "replacement_validation_result", "replacement_validation_error", "recovery_mode", "error")
    a = F.col("attempts")
    repeated = F.size(F.array_distinct(a["attempt_number"])) < F.size(a)
    first, last = F.get(a, 0), F.element_at(a, -1)
    return worked.select(
        "campaign", "record_id", F.size(a).cast("long").alias("n_attempts"), first["original_validation_error"].alias("original_validation_error"),
        last["replacement_validation_result"].alias("last_result"), last["replacement_validation_error"].alias("last_error"), last["recovery_mode"].alias("last_mode"),
        F.coalesce(F.get(F.array_compact(a["error"]), 0), F.when(repeated, "ATTEMPTS_REPEATED")).alias("history_error"),
    )


def unresolved(effective: DataFrame, turns: DataFrame, attempts: DataFrame, most: int = MOST) -> DataFrame:
    """Failed rows of a campaign's present results (campaign, record_id, status, failure_category, validation_error, provider_error) with
    their turn and attempts.

    ``attempts`` are lists as of ``attempt_lists``, of all attempts, collected or not; the first pass counts as one more.  Rows without a turn drop out.
    """
    left = effective.filter(F.col("status").isin(*LEFT)).join(turns, "record_id").join(attempts, ["campaign", "record_id"], "left")
    n = F.coalesce(F.size("attempts"), F.lit(0)) + 1
    return left.select(
        "campaign", *turns.columns, F.coalesce(_filled(F.col("failure_category")), F.col("status")).alias("failure_category"),
        F.coalesce(_filled(F.col("validation_error")), F.col("provider_error")).alias("reason"),
        n.cast("long").alias("attempt_count"), F.coalesce("attempts", F.array().cast(attempts.schema["attempts"].dataType)).alias("attempts"), (n >= most).alias("terminal"),
    )


def unsettled(outcomes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Outcomes (outcome_id, and more) of invalid output whose last review (outcome_id, ts, review_id, review_status) is not one by hand."""
    last = reviews.groupBy("outcome_id").agg(F.max_by("review_status", F.struct("ts", "review_id")).alias("review_status"))
    rows = outcomes.filter("resolution_type = 'INVALID_OUTPUT'").join(last, "outcome_id", "left")
    return rows.filter(~F.col("review_status").eqNullSafe(F.lit(BY_HAND)))


def generations(campaigns: DataFrame) -> DataFrame:
    """campaign, source, root, generation of campaigns (campaign, source): how many sources up the root is, a campaign without a source.

    Pointers are doubled, so a chain of n campaigns takes log n rounds.  Where a source is not in the table, or the sources go in a circle,
    root and generation are null.  A round makes every campaign done whose pointer is at one that is, so one without progress is the last.
    """
    source = F.col("source")
    state = campaigns.select("campaign", "source", F.coalesce("source", "campaign").alias("up"), F.when(source.isNull(), 0).otherwise(1).cast("long").alias("generation"), source.isNull().alias("done"))
    reached = -1
    while True:
        state = settled(state)
        n = state.filter("done").count()
        if n == reached or state.filter("not done").isEmpty():
            break
        reached = n
        above = state.select(F.col("campaign").alias("up"), F.col("up").alias("_up"), F.col("generation").alias("_g"), F.col("done").alias("_done"))
        # a root points at itself, so to go on from one that is done changes nothing
        state = state.join(above, "up", "left").select("campaign", "source", F.col("_up").alias("up"), F.when(F.col("done"), F.col("generation")).otherwise(F.col("generation") + F.col("_g")).alias("generation"), F.coalesce(F.col("done") | F.col("_done"), F.lit(False)).alias("done"))
    return state.select("campaign", "source", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("generation")).alias("generation"))


def links(results: DataFrame, placed: DataFrame) -> DataFrame:
    """A row per campaign and record of results (campaign, record_id, status, validation_error, original_validation_error) with ``link``, how
    it follows from its source's row: ORIGINAL, CONSISTENT, or why it doesn't; and ``trusted``: the link and all those up to the root hold.

    ``placed`` is of ``generations``.  A record that a campaign has twice has the status ``duplicate``.  A record's rows under one root
    meet once, where copies are counted, each row finds its source's row and goes up from it, so the rows take no round a generation and are
    sorted once.  Each is given the group's rows of campaigns that are sources, which are few however many recoveries end there.  A null
    record follows from nothing.  Copies are not combined before they meet: however many, they are one task's stream.
    """
    inner = placed.select(F.col("source").alias("campaign")).distinct().withColumn("_inner", F.lit(True))
    # rows that cannot have a source's row are groups of their own
    alone = F.when(F.col("root").isNull() | F.col("record_id").isNull(), F.col("campaign"))
    key = ("root", "record_id", "_alone", "_above", "campaign", "source", "_inner")
    # no side is broadcast: the size of results on disk says little of their rows.  Campaigns are the side that is hashed, being the fewer
    dealt = results.join(placed.join(inner, "campaign", "left").hint("shuffle_hash"), "campaign").repartition("root", "record_id").withColumn("_alone", alone).withColumn("_above", -F.col("generation"))
    rows = single(dealt.select(*key, "status", "validation_error", "original_validation_error"), *key).select(
        *key, (-F.col("_above")).alias("generation"), F.coalesce(F.col("_row.status"), F.when(F.col("n_rows") > 1, "duplicate"), F.lit("missing")).alias("status"), "_row.validation_error", "_row.original_validation_error"
    )
    # in the order that the groups of single have already
    group = Window.partitionBy("root", "record_id", "_alone").orderBy("_above").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = rows.withColumn("_met", F.collect_list(F.when(F.col("_inner"), F.struct("campaign", "status", "validation_error"))).over(group))
    met = met.withColumn("_before", F.get("_met", F.array_position("_met.campaign", F.col("source")).cast("int") - 1))
    link = (
        F.when(F.col("root").isNull(), "NO_ROOT").when(F.col("source").isNull(), F.when(F.col("status") == "duplicate", "DUPLICATE").otherwise("ORIGINAL")).when(F.col("_before").isNull(), "NOT_IN_SOURCE").when(F.col("_before.status") == "success", "ALREADY_RESOLVED")
        .when((F.col("status") == "duplicate") | (F.col("_before.status") == "duplicate"), "DUPLICATE").when(~F.col("_before.validation_error").eqNullSafe(F.col("original_validation_error")), "ERROR_DIFFERS").otherwise("CONSISTENT")
    )
    kind, holds = rows.schema["campaign"].dataType, F.col("link").isin("ORIGINAL", "CONSISTENT")
    linked = met.withColumn("link", link).withColumn("_source", F.col("source").cast(kind)).withColumn("_held", F.collect_list(F.when(F.col("_inner") & holds, F.struct("campaign", "_source"))).over(group))
    # up from the row's source as long as links hold: beyond the root's row is null
    top = F.aggregate("_held", F.col("_source"), lambda at, x: F.when(x["campaign"] == at, x["_source"]).otherwise(at))
    return linked.select("campaign", "record_id", "root", "source", "generation", "status", "validation_error", "link", (holds & F.col("record_id").isNotNull() & top.isNull()).alias("trusted"))


def effective(linked: DataFrame) -> DataFrame:
    """A row per root and record of ``links``: the last trusted success, or the original where there is none; with the number of rows and of
    those that are not trusted.  Records without an original row of the root are ``missing``."""
    order, value = F.struct("generation", "campaign"), F.struct("campaign", "generation", "status")
    best = F.max_by(F.when(F.col("trusted") & (F.col("status") == "success"), value), F.when(F.col("trusted") & (F.col("status") == "success"), order))
    own = F.max(F.when(F.col("generation") == 0, value))
    rows = linked.filter("root is not null").groupBy("root", "record_id").agg(F.coalesce(best, own).alias("_v"), F.count("*").alias("n_rows"), F.count_if(~F.col("trusted")).alias("n_distrusted"))
    return rows.select("root", "record_id", "_v.campaign", "_v.generation", F.coalesce("_v.status", F.lit("missing")).alias("status"), "n_rows", "n_distrusted")
