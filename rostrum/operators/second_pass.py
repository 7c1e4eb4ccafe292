"""Labels of a second pass: a response checked rule by rule, its quotes resolved in one reading of the text.

A response is read as VARIANT, so that a number isn't taken for a string, nor true for 1.  Only NO has no target and no evidence; YES and
UNSURE have both.  A response that repeats a field can't be read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators.evidence import align_all
from rostrum.operators.gates import PRESENCES, TARGETS, first

# The target of a text without hostility, the longest reasoning, and the category of each broken rule.
NONE, LONGEST = "N/A", 4000
STRUCTURE, EVIDENCE, SEMANTIC = "STRUCTURED_OUTPUT_INVALID", "EVIDENCE_RESOLUTION_FAILURE", "SEMANTIC_CONTRACT_INVALID"
CATEGORY = {
    "FIELDS": STRUCTURE, "PRESENCE_UNKNOWN": STRUCTURE, "TARGET_UNKNOWN": STRUCTURE, "REASONING": STRUCTURE, "SPANS_NOT_A_LIST": STRUCTURE, "SPAN_FIELDS": STRUCTURE, "SPAN_TEXT": STRUCTURE,
    "SPAN_PLACE": EVIDENCE, "NO_WITH_EVIDENCE": SEMANTIC, "WITHOUT_EVIDENCE": SEMANTIC,
}
SPAN = ["end_offset", "start_offset", "text"]


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    """A string there; null if it is anything else."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _fields(v: Column) -> Column:
    return F.array_sort(F.json_object_keys(F.to_json(v)))


def _stands(s: Column, text: Column) -> Column:
    """Are a span's offsets whole numbers, half-open, inside the text, and its text what stands there."""
    a, b = F.try_variant_get(s, "$.start_offset", "long"), F.try_variant_get(s, "$.end_offset", "long")
    whole = (_kind(s, "$.start_offset") == "BIGINT") & (_kind(s, "$.end_offset") == "BIGINT")
    inside = (a >= 0) & (b > a) & (b <= F.length(text))
    # offsets out of range never reach substring, which takes 32-bit numbers
    at, n = (F.when(inside, x).otherwise(0).cast("int") for x in (a + 1, b - a))
    return F.coalesce(whole & inside & F.substring(text, at, n).eqNullSafe(_text(s, "$.text")), F.lit(False))


def _rules(v: Column, spans: Column, text: Column, reasoning: bool, offsets: bool, lenient: Column) -> dict[str, Column]:
    """Broken rules in the order of checking.  ``lenient``: an empty reasoning may stand where there should be none."""
    presence, target = _text(v, "$.hostility_present"), _text(v, "$.target")
    names = sorted(["hostility_present", "target", "evidence_spans", *["reasoning"] * reasoning])
    wanted = lambda fields: F.array(*map(F.lit, fields))
    with_empty = lenient & _fields(v).eqNullSafe(wanted(sorted([*names, "reasoning"]))) & _text(v, "$.reasoning").eqNullSafe(F.lit("")) if not reasoning else F.lit(False)
    broken = F.transform(spans, lambda s: F.when(~_fields(s).eqNullSafe(wanted(SPAN if offsets else ["text"])), "SPAN_FIELDS").when(F.coalesce(_text(s, "$.text"), F.lit("")) == "", "SPAN_TEXT").when(F.lit(offsets) & ~_stands(s, text), "SPAN_PLACE"))
    span = F.get(F.filter(broken, lambda b: b.isNotNull()), 0)
    some = (F.size(spans) > 0) | (target != NONE)
    return {
        "FIELDS": ~_fields(v).eqNullSafe(wanted(names)) & ~with_empty,
        "PRESENCE_UNKNOWN": ~F.coalesce(presence.isin(*PRESENCES), F.lit(False)), "TARGET_UNKNOWN": ~F.coalesce(target.isin(*TARGETS, NONE), F.lit(False)),
        "REASONING": (F.coalesce(F.length(_text(v, "$.reasoning")), F.lit(LONGEST + 1)) > LONGEST) if reasoning else F.lit(False),
        "SPANS_NOT_A_LIST": spans.isNull(), **{r: span == r for r in ("SPAN_FIELDS", "SPAN_TEXT", "SPAN_PLACE")},
        "NO_WITH_EVIDENCE": (presence == "NO") & some, "WITHOUT_EVIDENCE": (presence != "NO") & ((target == NONE) | (F.size(spans) == 0)),
    }


def validated(df: DataFrame, response: str, text: str, reasoning: bool = True, offsets: bool = False) -> DataFrame:
    """Adds to each row what its response is worth.

    ``error``: the first broken rule; ``category``: its kind; of valid labels ``presence``, ``target``, ``spans`` (start_offset, end_offset
    and text as it stands in the source, of quotes found once), ``unmatched`` and ``ambiguous`` (quotes), ``n_requested``, ``n_resolved`` and
    ``evidence_valid``.  ``offsets``: spans bring their places, which must hold, instead of being looked up.
    """
    df = df.withColumn("_v", F.try_parse_json(F.col(response))).withColumn("_spans", F.try_variant_get("_v", "$.evidence_spans", "array<variant>"))
    v, spans, source = F.col("_v"), F.col("_spans"), F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("error", first(**_rules(v, spans, source, reasoning, offsets, F.lit(False))))
    df = df.withColumn("_quotes", F.when(F.col("error").isNull(), F.transform(spans, lambda s: F.try_variant_get(s, "$.text", "string"))))
    if offsets:
        place = lambda s, name: F.try_variant_get(s, f"$.{name}", "int")
        found = F.when(F.col("error").isNull(), F.transform(spans, lambda s: F.struct(F.lit("matched").alias("status"), place(s, "start_offset").alias("start_offset"), place(s, "end_offset").alias("end_offset"))))
    else:
        found = align_all(source, F.col("_quotes"))
    return _diagnosed(df.withColumn("_found", found), source).drop("_v", "_spans", "_quotes", "_found")


def _diagnosed(df: DataFrame, source: Column) -> DataFrame:
    v, quotes, found, fine = F.col("_v"), F.col("_quotes"), F.col("_found"), F.col("error").isNull()
    both = F.arrays_zip(quotes.alias("quote"), found.alias("at"))
    these = lambda status: F.transform(F.filter(both, lambda b: b["at"]["status"] == status), lambda b: b["quote"])
    spans = F.transform(F.filter(found, lambda f: f["status"] == "matched"), lambda f: F.struct(f["start_offset"].alias("start_offset"), f["end_offset"].alias("end_offset"), F.substring(source, f["start_offset"] + 1, f["end_offset"] - f["start_offset"]).alias("text")))
    category = reduce(lambda c, r: c.when(F.col("error") == r[0], r[1]), CATEGORY.items(), F.when(F.lit(False), ""))
    df = df.withColumns({
        "category": category, "presence": F.when(fine, _text(v, "$.hostility_present")), "target": F.when(fine, _text(v, "$.target")), "spans": spans, "unmatched": these("unmatched"), "ambiguous": these("ambiguous"),
    })
    return df.withColumns({"n_requested": F.size(quotes), "n_resolved": F.size("spans"), "evidence_valid": F.size("spans") == F.size(quotes)})


def adapted(df: DataFrame, response: str, text: str, reasoning: bool = True) -> DataFrame:
    """Labels as they are stored, from a provider's answer or from an artifact whose spans already have places.

    As ``validated``, but a label whose quotes aren't all found once has the error EVIDENCE_UNRESOLVED, and one whose own places don't hold,
    or aren't the ones where its quotes stand once, SPANS_DIFFER.  In an artifact an empty reasoning may stand where there should be none.
    """
    df = df.withColumn("_v", F.try_parse_json(F.col(response))).withColumn("_spans", F.try_variant_get("_v", "$.evidence_spans", "array<variant>"))
    v, spans, source = F.col("_v"), F.col("_spans"), F.coalesce(F.col(text), F.lit(""))
    placed = F.coalesce((F.size(spans) > 0) & F.forall(spans, lambda s: _fields(s).eqNullSafe(F.array(*map(F.lit, SPAN)))), F.lit(False))
    df = df.withColumn("_placed", placed)
    standing = F.coalesce(F.forall(spans, lambda s: _stands(s, source)), F.lit(False))
    bare = F.when(placed, F.transform(spans, lambda s: F.to_variant_object(F.struct(F.try_variant_get(s, "$.text", "string").alias("text"))))).otherwise(spans)
    df = df.withColumns({"error": F.when(placed & ~standing, "SPANS_DIFFER"), "_bare": bare})
    df = df.withColumn("error", F.coalesce("error", first(**_rules(v, F.col("_bare"), source, reasoning, False, F.col("_placed")))))
    df = df.withColumn("_quotes", F.when(F.col("error").isNull(), F.transform("_bare", lambda s: F.try_variant_get(s, "$.text", "string"))))
    df = _diagnosed(df.withColumn("_found", align_all(source, F.col("_quotes"))), source)
    own = F.transform("_spans", lambda s: F.struct(F.try_variant_get(s, "$.start_offset", "int").alias("start_offset"), F.try_variant_get(s, "$.end_offset", "int").alias("end_offset")))
    met = F.transform("spans", lambda s: F.struct(s["start_offset"].alias("start_offset"), s["end_offset"].alias("end_offset")))
    late = F.when(F.col("error").isNull() & ~F.col("evidence_valid"), "EVIDENCE_UNRESOLVED").when(F.col("error").isNull() & F.col("_placed") & ~own.eqNullSafe(met), "SPANS_DIFFER")
    return df.withColumn("error", F.coalesce("error", late)).drop("_v", "_spans", "_bare", "_placed", "_quotes", "_found")


def row_error(task: Column, values: Column, policy_fields: list[Column]) -> Column:
    """The first broken rule of an exported second-pass prediction, ``values`` its JSON; null if it is consistent."""
    v = F.try_parse_json(values)
    spans, presence, target = F.try_variant_get(v, "$.evidence_spans", "array<variant>"), _text(v, "$.hostility_present"), _text(v, "$.target")
    a, b = (lambda s: F.try_variant_get(s, "$.start_offset", "long")), (lambda s: F.try_variant_get(s, "$.end_offset", "long"))
    fine = lambda s: (_kind(s, "$.start_offset") == "BIGINT") & (_kind(s, "$.end_offset") == "BIGINT") & (a(s) >= 0) & (b(s) > a(s))
    bad = F.exists(spans, lambda s: ~F.coalesce(_fields(s).eqNullSafe(F.array(*map(F.lit, SPAN))) & fine(s) & (_text(s, "$.text") != ""), F.lit(False)))
    n = F.size(spans)
    return first(
        TASK_DIFFERS=~task.eqNullSafe(F.lit("hostility")), VALUES_NOT_AN_OBJECT=_fields(v).isNull(), POLICY_FIELDS=reduce(Column.__or__, [c.isNotNull() for c in policy_fields]),
        VALUE_FIELDS=~_fields(v).eqNullSafe(F.array(*map(F.lit, ("evidence_spans", "hostility_present", "target")))),
        LABEL_UNKNOWN=~F.coalesce(presence.isin(*PRESENCES) & target.isin(*TARGETS, NONE), F.lit(False)), SPANS_INVALID=spans.isNull() | bad,
        INCONSISTENT=((presence == "NO") & ((target != NONE) | (n > 0))) | ((presence != "NO") & ((target == NONE) | (n == 0))),
    )


def package_error(values: Column, text: Column) -> Column:
    """The first broken rule of a person's label in a package, ``values`` its JSON and ``text`` the record's; null if all hold.

    Here NO has a null target, and each span's place is checked against the text; spans may have further fields.
    """
    v = F.try_parse_json(values)
    spans, presence, target = F.try_variant_get(v, "$.evidence_span", "array<variant>"), _text(v, "$.hostility_present"), _text(v, "$.target")
    no, n = presence == "NO", F.size(spans)
    return first(
        FIELDS=~_fields(v).eqNullSafe(F.array(*map(F.lit, ("evidence_span", "hostility_present", "target")))), PRESENCE_UNKNOWN=~F.coalesce(presence.isin(*PRESENCES), F.lit(False)),
        NO_WITH_TARGET=no & (_kind(v, "$.target") != "VOID"), TARGET_UNKNOWN=~no & ~F.coalesce(target.isin(*TARGETS), F.lit(False)),
        CARDINALITY=spans.isNull() | (no & (n > 0)) | (~no & (n == 0)), SPAN_PLACE=F.exists(spans, lambda s: ~_stands(s, text)),
    )


def policy_row_error(task: Column, values: Column, non_policy: Column, primary: Column, secondary: Column) -> Column:
    """The same of a first-pass prediction: its own columns are there, and ``values``, unless it is empty, says the same."""
    v = F.try_parse_json(values)
    said = F.coalesce(F.size(F.json_object_keys(F.to_json(v))) > 0, F.lit(False))
    codes = F.try_variant_get(v, "$.secondary_australian_domains", "array<string>")
    differs = ~_fields(v).eqNullSafe(F.array(*map(F.lit, ("is_non_policy", "primary_australian_domain", "secondary_australian_domains"))))
    differs = differs | (_kind(v, "$.is_non_policy") != "BOOLEAN") | ~F.try_variant_get(v, "$.is_non_policy", "boolean").eqNullSafe(non_policy)
    differs = differs | ~_text(v, "$.primary_australian_domain").eqNullSafe(primary) | ~codes.eqNullSafe(secondary)
    return first(TASK_DIFFERS=~task.eqNullSafe(F.lit("policy")), POLICY_FIELDS=non_policy.isNull() | secondary.isNull(), VALUES_DIFFER=said & differs)


def repaired(df: DataFrame, output: str, presence: str, target: str, text: str) -> DataFrame:
    """Adds what an evidence-only repair is worth, as ``validated`` does.

    Its label stays as it was and must be one that has evidence, its JSON has evidence alone, of just one passage, which is found once.
    """
    v = F.try_parse_json(F.col(output))
    spans = F.try_variant_get(v, "$.evidence_spans", "array<variant>")
    early = first(
        NOT_REPAIRABLE=~F.coalesce(F.col(presence).isin("YES", "UNSURE") & F.col(target).isin(*TARGETS), F.lit(False)), OUTPUT_FIELDS=~_fields(v).eqNullSafe(F.array(F.lit("evidence_spans"))),
        NOT_ONE_PASSAGE=~F.size(spans).eqNullSafe(F.lit(1)),
    )
    whole = F.to_json(F.struct(F.col(presence).alias("hostility_present"), F.col(target).alias("target")))
    whole = F.concat(F.left(whole, F.length(whole) - 1), F.lit(',"evidence_spans":'), F.to_json(F.try_variant_get(v, "$.evidence_spans", "variant")), F.lit("}"))
    df = df.withColumns({"_early": early, "_whole": F.when(early.isNull(), whole)})
    df = validated(df, "_whole", text, reasoning=False)
    late = F.when(F.col("error").isNull() & ~F.col("evidence_valid"), "NOT_RESOLVED")
    return df.withColumn("error", F.coalesce("_early", "error", late)).drop("_early", "_whole")


def changed_fields(suggested: dict[str, Column], human: dict[str, Column]) -> Column:
    """Names of fields in which a person's label differs from the one suggested; a target of none is no target."""
    same = lambda a: F.nullif(a, F.lit(NONE))
    pairs = [(n, same(suggested[n]) if n == "target" else suggested[n], same(human[n]) if n == "target" else human[n]) for n in suggested]
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), n) for n, a, b in pairs]))


def artifact_verdicts(predictions: DataFrame, records: DataFrame, key: str, response: str, text: str, reasoning: bool = True) -> DataFrame:
    """(key, error, n_requested, n_resolved, n_unmatched, n_ambiguous) of each prediction of a campaign's artifact against the records' texts.

    Texts are joined by key, once for each prediction.  A prediction of no record has the error NO_TEXT; one of several rows of a key, REPEATED.
    """
    once = predictions.groupBy(key).agg(F.count("*").alias("_n"), F.min(response).alias(response))
    known = once.join(records.select(key, text).withColumn("_there", F.lit(True)), key, "left")
    rows = adapted(known, response, text, reasoning)
    error = F.when(F.col("_n") > 1, "REPEATED").when(F.col("_there").isNull(), "NO_TEXT").otherwise(F.col("error"))
    return rows.select(key, error.alias("error"), "n_requested", "n_resolved", F.size("unmatched").alias("n_unmatched"), F.size("ambiguous").alias("n_ambiguous"))


def artifact_accounts(verdicts: DataFrame, refused: DataFrame, invalid: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """One row: may a campaign's artifact be imported.  Every planned record is either validly labelled, refused, or invalid for good, once."""
    others = [(refused, "refused"), (invalid, "invalid"), (planned, "planned")]
    # verdicts are made once, and no filter on them is pushed down with all their rules written out in it
    judged = verdicts.select(key, F.when(F.col("error").isNull(), "valid").otherwise("wrong").alias("_w"))
    rows = reduce(DataFrame.unionByName, [d.select(key, F.lit(w).alias("_w")) for d, w in others], judged)
    ways = ["valid", "wrong", *[w for _, w in others]]
    each = rows.groupBy(key).agg(*[F.count_if(F.col("_w") == w).alias(w) for w in ways])
    done, there = F.col("valid") + F.col("refused") + F.col("invalid"), F.col("planned") > 0
    sums = each.agg(
        *[F.coalesce(F.sum(w), F.lit(0)).alias(f"n_{w}") for w in ways], F.count_if(there & (done == 0)).alias("n_missing"), F.count_if(~there).alias("n_outside"), F.count_if((done > 1) | (F.col("planned") > 1)).alias("n_repeated"),
    )
    return sums.withColumn("importable", (F.col("n_wrong") + F.col("n_missing") + F.col("n_outside") + F.col("n_repeated")) == 0)
