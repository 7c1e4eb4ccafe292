"""Audits of reviews: every outcome of a run with the review that ended it, what people changed, and what may be exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rostrum.operators import exports
from rostrum.operators.events import latest, outcomes

# States that end a review, the flag, names of fields, labels, exports that need a finished review.
ENDED = ("accepted", "edited", "skipped")
AFTER_FAILURE = "human_annotated_after_ai_failure"
FLAG = "flagged_codebook"
POLICY = ("is_non_policy", "primary_australian_domain", "secondary_australian_domains")
HOSTILITY = ("hostility_present", "target", "evidence_span")
COMPLETE = frozenset({"summary", "report", "package"})


def chosen_run(runs: DataFrame, wanted: str | None = None) -> Row:
    """The run with the id or public_id, or the one imported last (ties: the larger id).  ValueError unless it is exactly one."""
    if wanted is None:
        found = [r.run for r in runs.agg(F.max_by(F.struct(*runs.columns), F.struct("imported_at", "id")).alias("run")).collect() if r.run is not None]
    else:
        found = runs.filter((F.col("id").cast("string") == wanted) | (F.col("public_id").cast("string") == wanted)).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{wanted or 'the latest'} is not exactly one run")
    return found[0]


def review_rows(predictions: DataFrame, failures: DataFrame, reviews: DataFrame, failure_reviews: DataFrame, versions: DataFrame) -> DataFrame:
    """A row per prediction and per failure (prediction_id, turn_id, task, values: JSON): with ``valid``, the review that ended it, the values
    of the annotation that this made, and its flags in order.

    Reviews have prediction_id, review_id, reviewed_at, review_status, note, version_id; versions have version_id, human_turn_id,
    human_values: JSON.  A failure's last review counts whatever its state, and it has no flags.  All notes of an outcome are one cell, as in
    the exports; counts of notes over all outcomes are in ``breakdown``.
    """
    what = ["prediction_id", "review_status", "note", "version_id"]
    ended = latest(reviews, "prediction_id", "reviewed_at", "review_id", only=F.col("review_status").isin(*ENDED)).select(*what)
    flags = reviews.filter(F.col("review_status") == FLAG).groupBy("prediction_id").agg(F.count("*").alias("n_flags"), F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("reviewed_at", "review_id", "note")))).alias("_f"))
    failed = failures.join(latest(failure_reviews, "prediction_id", "reviewed_at", "review_id").select(*what), "prediction_id", "left").withColumn("values", F.lit(None).cast("string"))
    told = predictions.join(ended, "prediction_id", "left").join(flags, "prediction_id", "left")
    rows = outcomes(told, failed, ("PREDICTION", "INVALID_OUTPUT")).join(versions, "version_id", "left")
    notes = F.coalesce(F.transform("_f", lambda f: f["note"]), F.array().cast("array<string>"))
    return rows.withColumns({"valid": F.col("outcome") == "PREDICTION", "n_flags": F.coalesce("n_flags", F.lit(0)), "notes": notes}).drop("_f")


def _field(values: Column, name: str) -> Column:
    """A field as JSON with sorted names; null where it is null or absent."""
    return F.nullif(F.to_json(F.try_variant_get(values, f"$.{name}", "variant")), F.lit("null"))


def _said(values: Column, name: str) -> Column:
    return F.try_variant_get(values, f"$.{name}", "string")


def audited(rows: DataFrame) -> DataFrame:
    """Adds the labels of both, ``changed`` (names of fields), ``edit_category`` and ``error``: why the review contradicts itself, or null."""
    df = rows.withColumns({"_a": F.try_parse_json("values"), "_h": F.try_parse_json("human_values")})
    object_ = F.coalesce(F.startswith(F.schema_of_variant("_h"), F.lit("OBJECT")), F.lit(False))
    a, h, state, valid = F.col("_a"), F.col("_h"), F.col("review_status"), F.col("valid")
    human, flag = object_ & (F.to_json(h) != "{}"), lambda v: F.coalesce(F.try_variant_get(v, "$.is_non_policy", "boolean"), F.lit(False))
    empty, none = F.lit("[]"), F.lit("None")
    target = _field(a, "target")
    differs = {
        "policy": (
            flag(a) != flag(h), ~_field(a, POLICY[1]).eqNullSafe(_field(h, POLICY[1])), F.coalesce(_field(a, POLICY[2]), empty) != F.coalesce(_field(h, POLICY[2]), empty),
        ),
        "hostility": (
            ~_field(a, HOSTILITY[0]).eqNullSafe(_field(h, HOSTILITY[0])), ~F.when(target != '"N/A"', target).eqNullSafe(_field(h, HOSTILITY[1])),
            ~F.coalesce(_field(a, "evidence_spans"), empty).eqNullSafe(_field(h, HOSTILITY[2])),
        ),
    }
    names = {task: F.array_compact(F.array(*[F.when(d, n) for n, d in zip(fields, differs[task], strict=True)])) for task, fields in (("policy", POLICY), ("hostility", HOSTILITY))}
    looked_at = state.isin("accepted", "edited") & valid
    changed = F.when(~F.coalesce(looked_at, F.lit(False)), F.array().cast("array<string>")).when(F.col("task") == "hostility", names["hostility"]).otherwise(names["policy"])
    pair = lambda v, t: F.concat(F.coalesce(_said(v, HOSTILITY[0]), none), F.lit(":"), t)
    policy = lambda v: F.when(flag(v), "Non-Policy").otherwise(F.coalesce(_said(v, POLICY[1]), none))
    as_pair = ~valid | (F.col("task") == "hostility")
    df = df.withColumns({
        "changed": changed,
        "ai_label": F.when(~valid, "INVALID_OUTPUT").when(as_pair, pair(a, F.coalesce(_said(a, "target"), none))).otherwise(policy(a)),
        "human_label": F.when(~human, "").when(as_pair, pair(h, F.coalesce(F.nullif(_said(h, "target"), F.lit("")), F.lit("N/A")))).otherwise(policy(h)),
    })
    n, has = F.size("changed"), lambda name: F.array_contains("changed", name)
    category = (
        F.when(as_pair, F.concat(F.lit("HOSTILITY_"), F.when(n > 0, F.upper(F.array_join("changed", "_AND_"))).otherwise("UNCHANGED")))
        .when(~flag(a) & flag(h), "POLICY_TO_NON_POLICY").when(flag(a) & ~flag(h), "NON_POLICY_TO_POLICY").when(n == 2, "PRIMARY_AND_SECONDARY_CHANGED")
        .when((n == 1) & has(POLICY[1]), "PRIMARY_DOMAIN_CHANGED").when((n == 1) & has(POLICY[2]), "SECONDARY_DOMAINS_CHANGED").otherwise("OTHER_MULTIPLE")
    )
    made = state.isin("accepted", "edited", AFTER_FAILURE)
    error = (
        F.when(~state.isin(*ENDED, AFTER_FAILURE), "UNEXPECTED_STATE").when(state.isNull() & F.col("version_id").isNotNull(), "UNREVIEWED_WITH_ANNOTATION")
        .when(made & (~object_ | F.col("version_id").isNull()), "NO_ANNOTATION").when(made & ~F.col("human_turn_id").eqNullSafe(F.col("turn_id")), "OTHER_TURN")
        .when((state == "edited") & (n == 0), "EDITED_UNCHANGED").when((state == "accepted") & (n > 0), "ACCEPTED_CHANGED")
    )
    return df.withColumns({"edit_category": F.when(state == "edited", category), "error": error}).drop("_a", "_h")


def edited_cases(audit: DataFrame) -> DataFrame:
    return audit.filter("review_status = 'edited'")


def flagged_cases(audit: DataFrame) -> DataFrame:
    return audit.filter("n_flags > 0").withColumn("ai_annotation_changed", F.size("changed") > 0)


def summary(audit: DataFrame, declared: int) -> DataFrame:
    """One row of counts, and ``consistent``: as many rows as the run declares, none twice, of one task, none contradicting itself."""
    state, flagged, n = F.col("review_status"), F.col("n_flags") > 0, F.size("changed")
    has = lambda name: F.array_contains("changed", name)
    edited = state == "edited"
    row = audit.agg(
        F.count("*").alias("total"), F.count("review_status").alias("reviewed"), F.count_if(state.isNull()).alias("unreviewed"), *[F.count_if(state == s).alias(s) for s in (*ENDED, AFTER_FAILURE)],
        F.count_if(flagged).alias("codebook_flagged"), *[F.count_if((state == s) & flagged).alias(f"{s}_and_flagged") for s in ENDED], *[F.count_if((state == s) & ~flagged).alias(f"{s}_not_flagged") for s in ENDED[:2]],
        F.count_if(edited & has(POLICY[0])).alias("policy_gate_changes"), F.count_if(edited & has(POLICY[1])).alias("primary_domain_changes"), F.count_if(edited & (n == 1) & has(POLICY[2])).alias("secondary_only_changes"),
        F.count_if(edited & (n > 1)).alias("multiple_changes"), F.count_if(flagged & has(POLICY[0])).alias("flagged_policy_gate_changes"), F.count_if(F.col("valid")).alias("valid_predictions"),
        F.count("error").alias("n_errors"), (F.count("*") - F.count_distinct("prediction_id")).alias("n_repeated"), (F.min("task") == F.max("task")).alias("_one"),
    )
    good = (F.col("total") == declared) & (F.col("n_repeated") == 0) & (F.col("n_errors") == 0) & F.coalesce("_one", F.lit(True))
    return row.withColumn("consistent", good).drop("_one")


def breakdown(audit: DataFrame) -> DataFrame:
    """(kind, label, n): categories and transitions of edits, labels and transitions of flagged rows, and notes, counted in one pass."""
    one = lambda kind, label: F.array(F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    none = F.array().cast("array<struct<kind: string, label: string>>")
    final = F.when(F.col("human_label") != "", F.col("human_label")).otherwise("No terminal annotation")
    arrow = lambda to: F.concat_ws(" → ", F.col("ai_label"), to)
    edits = F.when(F.col("review_status") == "edited", F.concat(one("edit_category", F.col("edit_category")), one("transition", arrow(F.col("human_label")))))
    flags = F.when(F.col("n_flags") > 0, F.concat(one("flags_by_ai", F.col("ai_label")), one("flags_by_human", final), one("flag_transition", arrow(final))))
    notes = F.transform("notes", lambda x: F.struct(F.lit("note").alias("kind"), x.alias("label")))
    each = audit.select(F.explode(F.concat(F.coalesce(edits, none), F.coalesce(flags, none), notes)).alias("_e"))
    return each.groupBy("_e.kind", "_e.label").agg(F.count("*").alias("n"))


def export(audit: DataFrame, declared: int, path: str, artifact: str) -> None:
    """Writes ``full``, ``edited``, ``flags`` (CSV for spreadsheets), ``summary`` (counts and breakdown), or ``package``: all of them.

    Nothing is written where a row contradicts itself or rows are missing.  What is of a finished review is refused while any row is
    unreviewed; the tables remain available, as partial ones.
    """
    tables = {"full": lambda: audit, "edited": lambda: edited_cases(audit), "flags": lambda: flagged_cases(audit)}
    if artifact not in {*tables, "summary", "package"}:
        raise ValueError(f"no artifact {artifact}")
    facts = summary(audit, declared).first().asDict()
    if not facts["consistent"]:
        raise ValueError(f"the audit is not consistent: {facts}")
    if artifact in COMPLETE and facts["unreviewed"]:
        raise ValueError(f"{facts['unreviewed']} rows are not reviewed")
    for name, made in tables.items():
        if artifact in (name, "package"):
            exports.write_excel(made(), f"{path}/{name}")
    if artifact in ("summary", "package"):
        exports.write_jsonl(breakdown(audit), f"{path}/breakdown")
        exports.write_manifest(audit.sparkSession, f"{path}/summary", facts)
