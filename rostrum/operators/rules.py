"""Label schemas compiled to columns: field rules, a small condition language, prediction checks and repairs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def condition(c: dict, lists: set[str] = frozenset()) -> Column:
    """``all``, ``any``, ``field_equals``, ``field_not_equals``, ``code_equals`` (each [field, value]) as a column.

    On a list field equality means membership, but inequality compares the whole list with the value, so it holds.
    """
    ((kind, arg),) = c.items()
    if kind in ("all", "any"):
        return reduce(and_ if kind == "all" else or_, [condition(x, lists) for x in arg], F.lit(kind == "all"))
    name, value = arg
    if kind in ("field_equals", "code_equals"):
        return F.coalesce(F.array_contains(name, value), F.lit(False)) if name in lists else F.col(name).eqNullSafe(F.lit(value))
    if kind == "field_not_equals":
        return F.lit(True) if name in lists else ~F.col(name).eqNullSafe(F.lit(value))
    raise ValueError(f"unknown condition {kind}")


@dataclass(frozen=True)
class Field:
    name: str
    many: bool = False
    codes: tuple[str, ...] | None = None
    excluded: tuple[str, ...] = ()
    items: tuple[int, int] = (0, 1000)
    unique: bool = False
    required: bool = False
    required_when: dict | None = None
    null_unless: dict | None = None
    different_from: str | None = None


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def errors(self) -> Column:
        """Sorted codes ``FIELD:RULE`` of a row's broken rules."""
        lists = {f.name for f in self.fields if f.many}
        out = []
        for f in self.fields:
            c = F.col(f.name)
            present = (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0) if f.many else (F.coalesce(c.cast("string"), F.lit("")) != "")
            broken: dict[str, Column] = {}
            if f.codes is not None:
                allowed = F.array(*[F.lit(x) for x in f.codes if x not in f.excluded])
                broken["UNKNOWN_CODE"] = F.exists(c, lambda x: ~F.array_contains(allowed, x)) if f.many else present & ~F.array_contains(allowed, c)
            if f.many:
                broken["TOO_FEW"], broken["TOO_MANY"] = F.size(c) < f.items[0], F.size(c) > f.items[1]
                if f.unique:
                    broken["REPEATED"] = F.size(F.array_distinct(c)) < F.size(c)
            if f.different_from:
                other = F.col(f.different_from)
                broken["SAME_AS_OTHER"] = F.array_contains(c, other) if f.many else c == other
            if f.null_unless:
                broken["MUST_BE_EMPTY"] = present & ~condition(f.null_unless, lists)
            if f.required or f.required_when:
                broken["REQUIRED"] = ~present & (F.lit(True) if f.required else condition(f.required_when, lists))
            out += [F.when(F.coalesce(b, F.lit(False)), f"{f.name}:{code}") for code, b in broken.items()]
        return F.array_sort(F.array_compact(F.array(*out)))


def prediction_error(non_policy: Column, primary: Column, secondary: Column, reasoning: Column, codes: list[str], never_second: tuple[str, ...] = (), second: int = 2) -> Column:
    """The first broken rule of a model's label; null if it is valid."""
    known = F.array(*map(F.lit, codes))
    also = F.array(*[F.lit(c) for c in codes if c not in never_second])
    bad = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(non_policy.isNull(), "NON_POLICY_MISSING")
        .when(bad(~F.array_contains(known, primary)), "PRIMARY_UNKNOWN")
        .when(secondary.isNull() | bad(F.size(secondary) > second), "SECONDARY_COUNT")
        .when(bad(F.size(F.array_distinct(secondary)) < F.size(secondary)), "SECONDARY_REPEATED")
        .when(bad(F.exists(secondary, lambda s: ~F.array_contains(also, s))), "SECONDARY_UNKNOWN")
        .when(reasoning.isNull() | bad(F.length(reasoning) > 1000), "REASONING")
        .when(bad(non_policy & (primary.isNotNull() | (F.size(secondary) > 0))), "NON_POLICY_WITH_DOMAIN")
        .when(bad(~non_policy & primary.isNull()), "POLICY_WITHOUT_DOMAIN")
        .when(bad(F.array_contains(secondary, primary)), "PRIMARY_IN_SECONDARY")
    )


def repaired_secondary(non_policy: Column, primary: Column, secondary: Column, reasoning: Column, codes: list[str], **more) -> Column:
    """Secondary codes without the primary one, where that alone makes the label valid; else as they are."""
    without = F.array_remove(secondary, primary)
    fixes = (prediction_error(non_policy, primary, secondary, reasoning, codes, **more) == "PRIMARY_IN_SECONDARY") & prediction_error(non_policy, primary, without, reasoning, codes, **more).isNull()
    return F.when(F.coalesce(fixes, F.lit(False)), without).otherwise(secondary)


def span_errors(text: Column, spans: Column) -> Column:
    """Per span, in order: the first broken rule or null.  Offsets count code points, half-open."""
    return F.transform(
        spans,
        lambda s: F.when(s["start_offset"].isNull() | s["end_offset"].isNull(), "OFFSET_MISSING").when(s["start_offset"] < 0, "START_NEGATIVE")
        .when(s["end_offset"] <= s["start_offset"], "EMPTY").when(s["end_offset"] > F.length(text), "OUT_OF_BOUNDS")
        .when(F.substring(text, s["start_offset"] + 1, s["end_offset"] - s["start_offset"]) != s["text"], "TEXT_DIFFERS"),
    )


def partisan(present: Column, target: Column) -> Column:
    return F.coalesce((present == "YES") & (target == "OPPOSING_PARTISAN_TARGET"), F.lit(False))


def refused(response: Column) -> Column:
    """A provider's refusal: a block reason for prohibited content and no text."""
    reason = F.get_json_object(response, "$.promptFeedback.blockReason")
    return F.coalesce(reason == "PROHIBITED_CONTENT", F.lit(False)) & F.get_json_object(response, "$.candidates[0].content.parts[0].text").isNull()


STOP = T.StructType([T.StructField("reason", T.StringType()), T.StructField("place", T.LongType())])


@F.pandas_udf(STOP)
def json_stop(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Why and where (in code points) a JSON parser stops; null where it reads to the end."""

    def stop(response: str | None) -> tuple[str | None, int | None]:
        try:
            if response is not None:
                json.loads(response)
            return None, None
        except json.JSONDecodeError as e:
            return e.msg, e.pos
        except (RecursionError, ValueError):
            return "Too deep", 0

    for response in batches:
        yield pd.DataFrame([stop(r) for r in response], columns=STOP.names).astype({"reason": "string", "place": "Int64"})


# Where a parser stops at the end of a response that was cut off, and categories of failed attempts, first attempts and repairs.
CUT = ("Unterminated string starting at", "Expecting value", "Expecting ',' delimiter", "Expecting ':' delimiter")
CATEGORIES = (
    "EVIDENCE_RESOLUTION_FAILURE", "EVIDENCE_REPAIR_VALIDATION_FAILURE", "EVIDENCE_REPAIR_PROVIDER_FAILURE", "EVIDENCE_REPAIR_MISSING_RESULT", "EVIDENCE_REPAIR_MAPPING_FAILURE",
    "JSON_TRUNCATION", "STRUCTURED_OUTPUT_INVALID", "SEMANTIC_CONTRACT_INVALID", "PROVIDER_FAILURE", "MISSING_RESULT",
)


def json_category(response: Column, stop: Column) -> Column:
    """Of a response that is no JSON: was it cut off, or is it broken elsewhere; null if it is JSON."""
    cut = (stop["place"] >= F.greatest(F.length(response) - 1, F.lit(0))) & stop["reason"].isin(*CUT)
    return F.when(stop["reason"].isNotNull(), F.when(cut, "JSON_TRUNCATION").otherwise("STRUCTURED_OUTPUT_INVALID"))


def failure_category(status: Column, repair: Column, broken: Column, invalid: Column) -> Column:
    """Why an attempt failed, null if it didn't.

    ``status``: missing, mapping_error, provider_failure, or anything else for an answer.  ``repair``: it was to mend evidence only.
    ``broken``: what ``json_category`` says of the answer; ``invalid``: the category of the first rule that it breaks.
    """
    either = lambda first, again: F.when(repair, again).otherwise(first)
    return (
        F.when(status == "missing", either("MISSING_RESULT", "EVIDENCE_REPAIR_MISSING_RESULT"))
        .when(status == "mapping_error", either("STRUCTURED_OUTPUT_INVALID", "EVIDENCE_REPAIR_MAPPING_FAILURE"))
        .when(status == "provider_failure", either("PROVIDER_FAILURE", "EVIDENCE_REPAIR_PROVIDER_FAILURE"))
        .when(broken.isNotNull(), broken).when(invalid.isNotNull(), F.when(repair, "EVIDENCE_REPAIR_VALIDATION_FAILURE").otherwise(invalid))
    )


def categories(df: DataFrame, category: str) -> DataFrame:
    """How many rows each category has, categories without rows too."""
    known = df.sparkSession.createDataFrame([(c,) for c in CATEGORIES], f"{category} string")
    return known.join(df.groupBy(category).agg(F.count("*").alias("n")), category, "left").select(category, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def effective(rows: DataFrame, group: str, valid: Column, repaired: Column, refused_: Column) -> DataFrame:
    """Rows of a result by what they count as: valid, repaired, refused, or invalid, in this order; the four add up to all."""
    kind = F.when(valid, "valid").when(repaired, "repaired").when(refused_, "refused").otherwise("invalid")
    return rows.groupBy(group).agg(*[F.count_if(kind == k).alias(f"n_{k}") for k in ("valid", "repaired", "refused", "invalid")], F.count("*").alias("n_all"))


def export_status(predicted: Column, refused_: Column, invalid: Column, usable: Column) -> Column:
    return (
        F.when(predicted & ~usable, "AI_VALID_NO_USABLE_TEXT").when(predicted, "AI_VALID").when(refused_, "AI_PROVIDER_REFUSAL")
        .when(invalid, "AI_TERMINAL_INVALID").when(~usable, "NO_USABLE_TEXT").otherwise("NO_AI_PREDICTION")
    )
