"""Queries of review audits.  Documents stand in for outcomes, labels for what people said, events for the log of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import audits
from rostrum.plans.recovering import made
from rostrum.plans.registry import query
from rostrum.sources.tables import table

# What both engines say of the tables in the same words: plain columns, of which only Spark's side makes JSON.
SAID = "select doc_id, doc_id % 4 = 0 as hostile, doc_id % 11 > 0 as valid, n_chars < 300 as np, source as prim, lang as sec, case doc_id % 3 when 0 then 'YES' when 1 then 'NO' else 'UNSURE' end as present, case when doc_id % 3 = 1 then 'N/A' else source end as target from documents "
LOG = """select event_id % 450 as doc_id, event_id as review_id, ts as reviewed_at, case event_type when 'view' then 'accepted' when 'click' then 'edited' when 'error' then 'flagged_codebook' else 'skipped' end as review_status,
    case when user_id % 5 > 0 then 'note ' || user_id % 3 end as note, case when event_type in ('view', 'click') and event_id % 97 > 0 then event_id % 450 end as version_id from events """
DECLARED = 10_000


def human(rows: DataFrame) -> DataFrame:
    """What people said of the labelled documents: another policy flag where of no quality, another domain where toxic, fewer domains for every fifth."""
    d = F.col("doc_id")
    np = F.when(F.col("quality") == 0, ~F.col("np")).otherwise(F.col("np"))
    policy = F.struct(F.when(d % 5 > 0, F.array("sec")).otherwise(F.array().cast("array<string>")).alias("secondary_australian_domains"), np.alias("is_non_policy"), F.when(F.col("toxic") == 1, "other").otherwise(F.col("prim")).alias("primary_australian_domain"))
    target = F.when(F.col("toxic") == 1, "other").when(F.col("target") != "N/A", F.col("target"))
    other = F.struct(F.when(F.col("quality") == 1, F.col("present")).otherwise("NO").alias("hostility_present"), target.alias("target"), F.array().cast("array<string>").alias("evidence_span"))
    return rows.select(d.alias("version_id"), F.when(d % 89 > 0, d).otherwise(-1).alias("human_turn_id"), F.when(F.col("hostile"), F.to_json(other)).otherwise(F.to_json(policy)).alias("human_values"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, log = made(spark, sf_dir, SAID), made(spark, sf_dir, LOG).withColumnRenamed("doc_id", "prediction_id")
    policy = F.struct(F.col("np").alias("is_non_policy"), F.col("prim").alias("primary_australian_domain"), F.array("sec").alias("secondary_australian_domains"))
    other = F.struct(F.col("present").alias("hostility_present"), "target", F.array().cast("array<string>").alias("evidence_spans"))
    rows = said.select(F.col("doc_id").alias("prediction_id"), F.col("doc_id").alias("turn_id"), F.when(F.col("hostile"), "hostility").otherwise("policy").alias("task"), F.when(F.col("hostile"), F.to_json(other)).otherwise(F.to_json(policy)).alias("values"), "valid")
    versions = human(said.join(table(spark, sf_dir, "labels"), "doc_id"))
    after = log.filter("review_status in ('edited', 'skipped')").withColumn("review_status", F.when(F.col("review_status") == "edited", audits.AFTER_FAILURE).otherwise("skipped"))
    return audits.audited(audits.review_rows(rows.filter("valid").drop("valid"), rows.filter("not valid").drop("valid"), log, after, versions))


ROWS = f"""with s as ({SAID}), l as ({LOG}), v as (select s.doc_id as version_id, case when doc_id % 89 > 0 then doc_id else -1 end as human_turn, case when quality = 0 then not np else np end as h_np, case when toxic = 1 then 'other' else prim end as h_prim, doc_id % 5 = 0 as none,
        case when quality = 1 then present else 'NO' end as h_present, case when toxic = 1 then 'other' when target <> 'N/A' then target end as h_target from s join labels using (doc_id)),
    e as (select s.doc_id, case when s.valid then l.review_status when l.review_status = 'edited' then 'human_annotated_after_ai_failure' else l.review_status end as review_status, l.version_id from s join l using (doc_id)
        where case when s.valid then l.review_status <> 'flagged_codebook' else l.review_status in ('edited', 'skipped') end qualify row_number() over (partition by s.doc_id order by reviewed_at desc, review_id desc) = 1),
    f as (select doc_id, count(*) as n_flags, string_agg(note, '|' order by reviewed_at, review_id) as notes from s join l using (doc_id) where s.valid and review_status = 'flagged_codebook' group by 1),
    j as (select s.*, e.review_status, e.version_id, coalesce(n_flags, 0) as n_flags, coalesce(notes, '') as notes, v.* exclude (version_id), v.version_id is not null as there, coalesce(s.valid and e.review_status in ('accepted', 'edited'), false) as looked from s left join e using (doc_id) left join f using (doc_id) left join v on v.version_id = e.version_id),
    d as (select *, case when hostile then present <> h_present or h_present is null else np <> coalesce(h_np, false) end as d1, case when hostile then nullif(target, 'N/A') is distinct from h_target else prim is distinct from h_prim end as d2, case when hostile then not there else not there or none end as d3 from j),
    c as (select *, case when not looked then '' when hostile then concat_ws(',', case when d1 then 'hostility_present' end, case when d2 then 'target' end, case when d3 then 'evidence_span' end)
        else concat_ws(',', case when d1 then 'is_non_policy' end, case when d2 then 'primary_australian_domain' end, case when d3 then 'secondary_australian_domains' end) end as changed from d),
    a as (select *, case when not valid then 'INVALID_OUTPUT' when hostile then present || ':' || target when np then 'Non-Policy' else prim end as ai_label,
        case when not there then '' when hostile then h_present || ':' || coalesce(h_target, 'N/A') when not valid then 'None:N/A' when h_np then 'Non-Policy' else h_prim end as human_label,
        case when review_status = 'edited' then case when hostile then 'HOSTILITY_' || case when changed = '' then 'UNCHANGED' else replace(upper(changed), ',', '_AND_') end when not np and coalesce(h_np, false) then 'POLICY_TO_NON_POLICY' when np and not coalesce(h_np, false) then 'NON_POLICY_TO_POLICY'
            when d2 and d3 then 'PRIMARY_AND_SECONDARY_CHANGED' when d2 then 'PRIMARY_DOMAIN_CHANGED' when d3 then 'SECONDARY_DOMAINS_CHANGED' else 'OTHER_MULTIPLE' end end as edit_category,
        case when review_status in ('accepted', 'edited', 'human_annotated_after_ai_failure') and not there then 'NO_ANNOTATION' when review_status in ('accepted', 'edited', 'human_annotated_after_ai_failure') and human_turn <> doc_id then 'OTHER_TURN'
            when review_status = 'edited' and changed = '' then 'EDITED_UNCHANGED' when review_status = 'accepted' and changed <> '' then 'ACCEPTED_CHANGED' end as error from c)"""


@query(ROWS + " select doc_id as prediction_id, valid, review_status, n_flags, notes, changed, ai_label, human_label, edit_category, error from a")
def review_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir).select("prediction_id", "valid", "review_status", "n_flags", F.array_join("notes", "|").alias("notes"), F.array_join("changed", ",").alias("changed"), "ai_label", "human_label", "edit_category", "error")


@query(ROWS + f""" select count(*) as total, count(review_status) as reviewed, count(*) - count(review_status) as unreviewed, count(*) filter (where review_status = 'accepted') as accepted, count(*) filter (where review_status = 'edited') as edited, count(*) filter (where review_status = 'skipped') as skipped,
    count(*) filter (where review_status like 'human%') as human_annotated_after_ai_failure, count(*) filter (where n_flags > 0) as codebook_flagged, count(*) filter (where n_flags > 0 and review_status = 'accepted') as accepted_and_flagged, count(*) filter (where n_flags > 0 and review_status = 'edited') as edited_and_flagged,
    count(*) filter (where n_flags > 0 and review_status = 'skipped') as skipped_and_flagged, count(*) filter (where n_flags = 0 and review_status = 'accepted') as accepted_not_flagged, count(*) filter (where n_flags = 0 and review_status = 'edited') as edited_not_flagged,
    count(*) filter (where review_status = 'edited' and changed like '%is_non_policy%') as policy_gate_changes, count(*) filter (where review_status = 'edited' and changed like '%primary%') as primary_domain_changes, count(*) filter (where review_status = 'edited' and changed = 'secondary_australian_domains') as secondary_only_changes,
    count(*) filter (where review_status = 'edited' and changed like '%,%') as multiple_changes, count(*) filter (where n_flags > 0 and changed like '%is_non_policy%') as flagged_policy_gate_changes, count(*) filter (where valid) as valid_predictions, count(error) as n_errors, 0::bigint as n_repeated,
    count(*) = {DECLARED} and count(error) = 0 and min(hostile) = max(hostile) as consistent from a""")
def review_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.summary(audit(spark, sf_dir), DECLARED)


@query(ROWS + """, z as (select 'edit_category' as kind, edit_category as label from a where review_status = 'edited' union all select 'transition', ai_label || ' → ' || human_label from a where review_status = 'edited' union all select 'flags_by_ai', ai_label from a where n_flags > 0
    union all select 'flags_by_human', coalesce(nullif(human_label, ''), 'No terminal annotation') from a where n_flags > 0 union all select 'flag_transition', ai_label || ' → ' || coalesce(nullif(human_label, ''), 'No terminal annotation') from a where n_flags > 0
    union all select 'note', unnest(string_split(notes, '|')) from a where notes <> '') select kind, label, count(*) as n from z group by all""")
def review_audit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.breakdown(audit(spark, sf_dir))
