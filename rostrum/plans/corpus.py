"""The debate corpus: from parsed rows to turns, and the same fold over an event log as a query."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import checks, ordered, reconstruct, reviews
from rostrum.plans.registry import query
from rostrum.sources import debates, pages
from rostrum.sources.tables import table

# Collective speakers, with what the record says when they interject.
COLLECTIVE = {f"{who} Members": f"{who} members interjecting[—–-]?" for who in ("Honourable", "Opposition", "Government")}
RULES = reconstruct.Rules(collective=COLLECTIVE, interjection_code="COLLECTIVE_INTERJECTION_EXPLICIT_PATTERN")


def build(spark: SparkSession, root: str, mapping: DataFrame | None = None, report: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of an archive.  Parsed rows, fragments and the fold are kept for the tables that share them.

    ``report`` has a row per processed file (source_file and more): a file without one is an error.
    """
    rows = debates.parsed(debates.discover(spark, root)).persist(StorageLevel.DISK_ONLY)
    fragments = debates.fragments(rows)
    if mapping is not None:
        fragments = debates.business(fragments, mapping)
    fragments = fragments.persist(StorageLevel.DISK_ONLY)
    folded = reconstruct.fold(fragments, RULES).persist(StorageLevel.DISK_ONLY)
    files = rows.groupBy("source_file", "source_file_sha256", "byte_size").agg(F.max("error").alias("error"))
    if report is not None:
        known = report.withColumn("_reported", F.lit(True))
        missing = F.raise_error(F.concat(F.lit("no processing report of "), "source_file")).cast("boolean")
        files = files.join(known, "source_file", "left").withColumn("_reported", F.coalesce("_reported", missing)).filter("_reported").drop("_reported")
    turns = reconstruct.turns(fragments, folded)
    return {
        "source_files": files, "debate_sections": debates.sections(rows), "debate_events": debates.events(rows), "speech_fragments": fragments,
        "speaker_turns": reviews.with_first_fragment(turns, fragments, ["fragment_key", "major", "minor"]), "speaker_turn_fragments": reconstruct.lineage(folded),
        "interjections": folded.filter("relation = 'interjection'"), "continuation_anomalies": folded.filter("relation = 'orphan'"), "images": debates.images(fragments),
    }


def as_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as fragments: a user is a file; errors are boundaries, clicks interjections, views continuations, others speeches."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_type")
    rows = ordered.with_boundaries(rows, "user_id", ["ts", "event_id"], kind, kind != "error").withColumn("n", F.row_number().over(ordered.W.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.filter("event_type <> 'error'").select(
        F.col("user_id").alias("source_file"), F.col("n").cast("long").alias("sequence_number"), "event_id",
        F.when(kind == "click", "interjection").when(kind == "view", "continuation").otherwise("speech").alias("talktype_raw"),
        F.when(F.col("k") % 4 == 0, "unknown").otherwise(F.concat(F.lit("s"), (F.col("k") % 4).cast("string"))).alias("speaker_id_raw"),
        F.when(F.col("k") % 5 == 0, "unknown").otherwise(F.concat(F.lit("Member "), (F.col("k") % 3).cast("string"))).alias("speaker_name_raw"),
        F.lit(None).cast("string").alias("nospeaker_raw"), F.concat(F.lit("said "), F.col("k").cast("string")).alias("text_clean"),
        F.when(F.col("event_id") % 11 == 0, F.array(F.lit("SOURCE_FRAGMENT_ID_MISSING"))).otherwise(F.array().cast("array<string>")).alias("warning_codes"),
        F.col("boundary_reason").alias("boundary_reason_before"), F.lit("").alias("heading"),
    )


FOLD = """with recursive e as (select *, json_extract_string(props, '$.k')::int as k, row_number() over (partition by user_id order by ts, event_id) as n, lag(event_type) over (partition by user_id order by ts, event_id) as before from events),
    f as (select user_id, n, row_number() over (partition by user_id order by n) as i, case event_type when 'click' then 'I' when 'view' then 'C' else 'T' end as kind,
        case when k % 4 <> 0 then 's' || (k % 4) end as id, case when k % 5 <> 0 then 'member ' || (k % 3) end as name, event_id % 11 = 0 as bad, case when before is null then 'FILE_START' when before = 'error' then 'ERROR_BOUNDARY' end as why from e where event_type <> 'error'),
    s as (select user_id, i, n, kind, null::bigint as a, null::varchar as aid, null::varchar as aname, null::boolean as abad, null::varchar as relation, null::varchar as reason, null::bigint as turn, null::bigint as cand from f where false
        union all select user_id, 0, 0, null, null, null, null, null, null, null, null, null from (select distinct user_id from f)
        union all (
        with j as (select f.*, s.a as pa, case when f.why is null then s.a end as oa, s.aid as oid, s.aname as oname, s.abad as obad from s join f on f.user_id = s.user_id and f.i = s.i + 1),
        m as (select *, case when why is not null then why when oa is null then 'NO_ACTIVE_CANDIDATE' when obad or bad then 'BLOCKING_IDENTITY_WARNING' when oid is not null and id is not null then case when oid = id then 'CONTINUATION_SPEAKER_ID_MATCH' else 'KNOWN_SPEAKER_ID_MISMATCH' end
            when oname is not null and oname = name then 'CONTINUATION_EXACT_NAME_FALLBACK' else 'IDENTITY_MISSING_OR_AMBIGUOUS' end as cw from j),
        d as (select *, cw like 'CONTINUATION%' as joins from m)
        select user_id, i, n, kind,
            case when kind = 'I' then oa when kind = 'T' then case when name is not null then n end when joins then oa when name is not null and not bad then n end,
            case when kind = 'I' or (kind = 'C' and joins) then oid else id end, case when kind = 'I' or (kind = 'C' and joins) then oname else name end, case when kind = 'I' or (kind = 'C' and joins) then obad else bad end,
            case kind when 'I' then 'interjection' when 'T' then 'initial' else case when joins then 'continuation' else 'orphan' end end,
            case kind when 'I' then case when oa is not null then 'ACTIVE_TURN_SAME_SCOPE' when why is not null then why else 'NO_ACTIVE_TURN' end when 'C' then cw end,
            case kind when 'I' then oa when 'C' then case when joins then oa else n end else n end,
            case when kind = 'C' and not joins then pa end from d))
    """


@query(FOLD + "select user_id as source_file, n as sequence_number, relation, reason, turn from s where i > 0")
def turn_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.fold(as_fragments(spark, sf_dir), RULES).select("source_file", "sequence_number", "relation", "reason", "turn")


@query(FOLD + "select user_id as source_file, n as sequence_number, turn as interrupted_turn, reason, case when turn is null then 'none' else 'high' end as link_confidence from s where relation = 'interjection'")
def interjection_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruct.fold(as_fragments(spark, sf_dir), RULES).filter("relation = 'interjection'")
    return rows.select("source_file", "sequence_number", F.col("turn").alias("interrupted_turn"), "reason", F.when(F.col("turn").isNull(), "none").otherwise("high").alias("link_confidence"))


@query(FOLD + "select user_id as source_file, n as sequence_number, cand as candidate_turn, reason from s where relation = 'orphan'")
def continuation_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruct.fold(as_fragments(spark, sf_dir), RULES).filter("relation = 'orphan'")
    return rows.select("source_file", "sequence_number", F.col("candidate").alias("candidate_turn"), "reason")


@query(FOLD + """, t as (select user_id, turn, count(*) filter (where relation <> 'interjection') as fragment_count, count(*) filter (where relation = 'interjection') as interruption_count from s where i > 0 and turn is not null group by all)
    select user_id as source_file, turn as first_fragment_sequence, fragment_count, interruption_count, row_number() over (partition by user_id order by turn)::bigint as turn_sequence, fragment_count * 2 as word_count from t""")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = as_fragments(spark, sf_dir)
    t = reconstruct.turns(fragments, reconstruct.fold(fragments, RULES))
    return t.select("source_file", "first_fragment_sequence", F.col("fragment_count").cast("long").alias("fragment_count"), "interruption_count", F.col("turn_sequence").cast("long").alias("turn_sequence"), F.col("word_count").cast("long").alias("word_count"))


NAMES = ["fragment_not_folded", "fragment_folded_twice", "turn_without_first_fragment", "fragment_count_differs", "interjection_in_turn_text", "continuation_without_reason"]


# A fold that lost every 17th fragment, so that checks have something to find.
LOST = FOLD + """, own as (select *, n % 17 = 0 as lost from s where i > 0), t as (select user_id, turn, count(*) filter (where relation <> 'interjection') as n_all, count(*) filter (where relation <> 'interjection' and not lost) as n_left,
        bool_or(n = turn and not lost and relation <> 'interjection') as first_left from own where turn is not null group by all)
    select 'fragment_not_folded' as "check", count(*) as violations from own where lost union all select 'fragment_folded_twice', 0 union all select 'turn_without_first_fragment', count(*) from t where not first_left
    union all select 'fragment_count_differs', count(*) from t where n_left > 0 and n_left <> n_all union all select 'interjection_in_turn_text', 0 union all select 'continuation_without_reason', 0"""


@query(LOST)
def turn_lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = as_fragments(spark, sf_dir)
    folded = reconstruct.fold(fragments, RULES)
    return checks.report(checks.turn_checks(fragments, folded.filter("sequence_number % 17 <> 0"), reconstruct.turns(fragments, folded)))


@query()
def html_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.block_text(table(spark, sf_dir, "pages"))
