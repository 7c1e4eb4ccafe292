"""A benchmark's records and results as they were: records out of the requests of a frozen plan, results out of an audit's rows.

A plan is one JSON document with its requests, so it is one row; its requests are rows at once, and nothing gathers them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import keys

# The parts of a prompt, the fields of its head, where a plan keeps its requests.
HEAD, BETWEEN = "METADATA:\n", "\n\nSPEECH:\n"
FIELDS = ("business_type", "chamber", "date", "major_heading", "minor_heading", "speaker_name")
PREFIX = "turn:"
PLAN = """struct<provenance map<string, string>, request struct<batch struct<input_config struct<requests struct<requests array<struct<
    metadata struct<key string>, request struct<contents array<struct<parts array<struct<text string>>>>, generationConfig string>>>>>>>>"""


def requests(plans: DataFrame, plan: str, text: str) -> DataFrame:
    """A row per request of plans (``plan``, an id, and ``text``, JSON) with a key of a turn: plan, turn_key, prompt, configuration, provenance.

    ``prompt`` is null unless there is one content of one part.  ``configuration`` is JSON with sorted names, so that equal ones are equal texts.
    A plan that is no JSON has no requests.
    """
    read = plans.select(F.col(plan).alias("plan"), F.from_json(text, PLAN).alias("_p"))
    each = read.select("plan", F.col("_p.provenance").alias("provenance"), F.explode("_p.request.batch.input_config.requests.requests").alias("_r")).filter(F.startswith(F.col("_r.metadata.key"), F.lit(PREFIX)))
    contents = F.col("_r.request.contents")
    parts = F.get(contents, 0)["parts"]
    prompt = F.when((F.size(contents) == 1) & (F.size(parts) == 1), F.get(parts, 0)["text"])
    return each.select(
        "plan", F.substring(F.col("_r.metadata.key"), F.lit(len(PREFIX) + 1), F.length("_r.metadata.key")).alias("turn_key"), prompt.alias("prompt"),
        F.to_json(F.try_parse_json("_r.request.generationConfig")).alias("configuration"), "provenance",
    )


def _value(v: Column, name: str) -> Column:
    """A field of the head as JSON."""
    one = F.try_variant_get(v, f"$.{name}", "variant")
    kind = F.schema_of_variant(one)
    return F.when(F.coalesce(kind, F.lit("VOID")) == "VOID", "null").when(kind == "STRING", keys.json_text(F.try_variant_get(v, f"$.{name}", "string"))).otherwise(F.to_json(one))


def with_record(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Adds the head's fields, ``speech``, and ``error``: why the prompt isn't the one of these fields, or null.

    A prompt that is not written again exactly, white space and order of names included, is refused, as no record that it came from is known.
    """
    p = F.col(prompt)
    rest = F.substring(p, F.lit(len(HEAD) + 1), F.length(p))
    at = F.position(F.lit(BETWEEN), rest)
    whole = F.startswith(p, F.lit(HEAD)) & (at > 0)
    df = df.withColumns({"_head": F.when(whole, F.substring(rest, F.lit(1), at - 1)), "speech": F.when(whole, F.substring(rest, at + len(BETWEEN), F.length(rest)))})
    df = df.withColumn("_v", F.try_parse_json("_head"))
    again = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), _value(F.col("_v"), n)) for n in FIELDS]), F.lit("}"))
    known = F.array_sort(F.json_object_keys("_head")).eqNullSafe(F.array(*map(F.lit, FIELDS)))
    error = (
        F.when(p.isNull(), "PARTS").when(~whole, "STRUCTURE").when(F.col("_v").isNull(), "METADATA_JSON")
        .when(~known, "METADATA_FIELDS").when(again != F.col("_head"), "ROUND_TRIP")
    )
    return df.withColumns({n: F.try_variant_get("_v", f"$.{n}", "string") for n in FIELDS} | {"error": error}).drop("_head", "_v")


def records(expected: DataFrame, asked: DataFrame) -> DataFrame:
    """A row per expected turn (turn_key) with the record of its request.  ``error`` is also MISSING without a request, REPEATED with several, of
    which none is taken.  Requests of other turns are left out before anything is read from them."""
    mine = asked.select("turn_key", "prompt", "configuration").join(expected.select("turn_key").distinct(), "turn_key", "left_semi")
    one = mine.groupBy("turn_key").agg(F.count("*").alias("n"), F.min(F.struct("prompt", "configuration")).alias("_r"))
    both = expected.select("turn_key").distinct().join(one, "turn_key", "left").withColumn("prompt", F.when(F.col("n") == 1, F.col("_r.prompt"))).withColumn("configuration", F.when(F.col("n") == 1, F.col("_r.configuration")))
    rows = with_record(both.drop("_r"))
    return rows.withColumn("error", F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "REPEATED").otherwise(F.col("error"))).drop("n", "prompt")


def accounts(rows: DataFrame, asked: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """One row: turns, those with a record, by kind of error, how many configurations the records have, whether every plan has the wanted
    provenance, and ``usable``: all turns have a record of one configuration and the provenance holds."""
    n = rows.agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("error").isNull()).alias("n_records"), F.count_if(F.col("error") == "MISSING").alias("n_missing"), F.count_if(F.col("error") == "REPEATED").alias("n_repeated"),
        F.count_if(~F.col("error").isin("MISSING", "REPEATED")).alias("n_broken"), F.count_distinct("configuration").alias("n_configurations"),
    )
    wanted = reduce(Column.__and__, [F.element_at("provenance", F.lit(k)).eqNullSafe(F.lit(v)) for k, v in provenance.items()], F.lit(True))
    held = asked.agg(F.coalesce(F.bool_and(wanted), F.lit(False)).alias("provenance_holds"))
    row = n.crossJoin(held)  # one row and one row
    return row.withColumn("usable", (F.col("n_turns") > 0) & (F.col("n_records") == F.col("n_turns")) & (F.col("n_configurations") == 1) & F.col("provenance_holds"))


def results(audit: DataFrame) -> DataFrame:
    """An audit's rows (record_id, valid, values: JSON, outcome, diagnostic, reason) as results: success with the prediction, or invalid with
    type, message and the evidence that the message is about.  ``error``: a valid row without an object, an invalid one without an outcome."""
    low = lambda c: F.coalesce(c, F.lit(""))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    ok = F.coalesce(F.col("valid"), F.lit(False))
    message = F.when(~ok, F.coalesce(filled("diagnostic"), filled("reason"), F.col("outcome")))
    about = lambda word: F.when(F.contains(F.lower(low(message)), F.lit(word)), F.array(message)).otherwise(F.array().cast("array<string>"))
    object_ = F.startswith(F.schema_of_variant(F.try_parse_json("values")), F.lit("OBJECT"))
    return audit.select(
        "record_id", F.when(ok, "success").otherwise("invalid").alias("status"), F.when(ok, F.col("values")).alias("prediction"), F.when(~ok, F.col("outcome")).alias("error_type"), message.alias("error_message"),
        about("unmatched").alias("evidence_unmatched"), about("ambiguous").alias("evidence_ambiguous"),
        F.when(ok & ~F.coalesce(object_, F.lit(False)), "VALUES_NOT_AN_OBJECT").when(~ok & low(F.col("outcome")).isin("", "PREDICTION"), "OUTCOME_MISSING").alias("error"),
    )
