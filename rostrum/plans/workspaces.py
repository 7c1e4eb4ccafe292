"""Queries of workspaces.  Customers stand in for projects and campaigns, orders for tasks, their lines for assignments and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import samples, workspaces
from rostrum.plans.recovering import made
from rostrum.plans.registry import query

# What both engines say of the tables in the same words.
PROJECTS = "select c_custkey as project_id, case c_custkey % 4 when 0 then 'paused' when 1 then 'draft' else 'active' end as status, case when c_custkey % 3 = 0 then c_custkey - 1 end as source_project_id, c_nationkey as updated_at from customer "
TASKS = "select o_orderkey as task_id, o_custkey as project_id, o_orderkey % 100 as turn_id, case o_orderstatus when 'F' then 'submitted' else 'open' end as status from orders "
ASSIGNED = "select 10 * l_orderkey + l_linenumber as assignment_id, l_orderkey as task_id, l_suppkey % 7 as user_id, case l_partkey % 8 when 0 then 'withdrawn' when 1 then 'flagged' when 2 then 'skipped' when 3 then 'submitted' when 4 then 'in_progress' when 5 then 'claimed' else 'assigned' end as status, l_partkey as updated_at from lineitem "
NOTED = "select l_orderkey as annotation_id, 10 * l_orderkey + l_linenumber as assignment_id, case l_returnflag when 'R' then 'draft' when 'A' then 'submitted' else 'revised' end as status, case when l_suppkey % 9 > 0 then 10 * l_orderkey + l_linenumber end as current_version_id from lineitem where l_linenumber = 2"
VERSIONS = """select l_orderkey as annotation_id, 10 * l_orderkey + l_linenumber as version_id, l_linenumber as revision, l_linestatus as event_type, l_partkey % 6 as kind, case l_partkey % 6 when 0 then '{"is_non_policy":true,"primary_australian_domain":"a"}' when 1 then '{"is_non_policy":null,"secondary_australian_domains":["x","y"]}'
    when 2 then '{"content_status":"substantive_policy"}' when 3 then '{"content_status":"other","primary_australian_domain":"' || l_linestatus || '"}' when 4 then '{"hostility_present":"' || l_returnflag || '"}' else '[]' end as said, l_linestatus, l_returnflag from lineitem """
MEMBERS = "select c_custkey as project_id, 3 as user_id, case c_custkey % 5 when 0 then 'annotator' else 'manager' end as project_role, case when c_custkey % 7 = 0 then 'gone' else 'active' end as status from customer where c_custkey % 6 > 0"
WORK = f"w as (select a.*, project_id, turn_id, n.status as annotation from ({ASSIGNED}) a join ({TASKS}) t using (task_id) left join ({NOTED}) n using (assignment_id))"
SHORT = """case kind when 0 then 'Non-Policy' when 1 then 'Policy' when 2 then 'Policy' when 3 then 'Non-Policy' when 4 then 'Hostility: ' || l_returnflag else 'Annotation' end as summary_label, kind < 4 as has_policy_summary,
    case kind when 0 then 'a' when 3 then l_linestatus end as primary_domain, case when kind = 1 then 'x,y' else '' end as secondary_domains"""


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.work(*(made(spark, sf_dir, s) for s in (ASSIGNED, TASKS, NOTED)))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, VERSIONS).select("annotation_id", "version_id", "revision", "event_type", F.col("said").alias("values"))


def short(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "summary_label", "has_policy_summary", "primary_domain", F.array_join("secondary_domains", ",").alias("secondary_domains"))


@query(f"""with {WORK}, m as (select project_id, project_role from ({MEMBERS}) where status = 'active'), c as (select project_id, count(*) as task_count, count(*) filter (where status = 'submitted') as submitted_count from ({TASKS}) group by 1),
    h as (select project_id, count(*) as human_total, count(*) filter (where w.status in ('assigned', 'claimed') and annotation is null) as human_to_annotate, count(*) filter (where w.status <> 'skipped' and (annotation = 'draft' or w.status = 'in_progress')) as human_in_progress,
        count(*) filter (where annotation in ('submitted', 'revised') or w.status = 'submitted') as human_completed, count(*) filter (where w.status = 'skipped') as human_skipped from w join m using (project_id) where w.status not in ('withdrawn', 'flagged') and (project_role <> 'annotator' or user_id = 3) group by 1)
    select project_id, status, project_role, coalesce(task_count, 0) as task_count, coalesce(submitted_count, 0) as submitted_count, coalesce(human_total, 0) as human_total, coalesce(human_to_annotate, 0) as human_to_annotate, coalesce(human_in_progress, 0) as human_in_progress,
        coalesce(human_completed, 0) as human_completed, coalesce(human_skipped, 0) as human_skipped from ({PROJECTS}) join m using (project_id) left join c using (project_id) left join h using (project_id)""")
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, tasks, members = (made(spark, sf_dir, s) for s in (PROJECTS, TASKS, MEMBERS))
    return workspaces.project_list(projects, tasks, work(spark, sf_dir), members, 3).drop("source_project_id", "updated_at")


@query(f"""with {WORK} select user_id, count(*) filter (where w.status in ('assigned', 'claimed', 'in_progress')) as assigned, count(*) filter (where annotation = 'draft') as drafts, count(*) filter (where w.status = 'submitted') as submitted, count(*) filter (where w.status = 'skipped') as skipped,
    count(*) filter (where w.status = 'flagged') as flagged from w join ({PROJECTS}) p using (project_id) where p.status = 'active' group by 1""")
def user_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.dashboards(work(spark, sf_dir), made(spark, sf_dir, PROJECTS))


@query(f"""with {WORK} select user_id, assignment_id, w.status from w join ({PROJECTS}) p using (project_id) where p.status = 'active' and w.status in ('assigned', 'claimed', 'in_progress')
    qualify row_number() over (partition by user_id order by case w.status when 'in_progress' then 0 when 'claimed' then 1 else 3 end, w.updated_at desc, assignment_id) <= 20""")
def user_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.queues(work(spark, sf_dir), made(spark, sf_dir, PROJECTS)).select("user_id", "assignment_id", "status")


@query(f"with {WORK} select user_id, project_id, count(*) as total, count(*) filter (where status = 'submitted') as completed from w where status <> 'withdrawn' group by all")
def assignment_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.progress(work(spark, sf_dir))


@query(f"select v.version_id, assignment_id, revision, {SHORT}, v.version_id is not distinct from current_version_id as current from ({VERSIONS}) v join ({NOTED}) n using (annotation_id)")
def revision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(workspaces.histories(made(spark, sf_dir, NOTED), versions(spark, sf_dir)), "version_id", "assignment_id", "revision", "current")


@query(f"""with {WORK}, v as (select *, count(*) over (partition by annotation_id) as n_versions from ({VERSIONS})) select w.assignment_id, w.status as assignment_status, user_id, revision, n_versions, {SHORT} from ({NOTED}) n join v on v.version_id = n.current_version_id join w on w.assignment_id = n.assignment_id where n.status in ('submitted', 'revised')""")
def completed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(workspaces.completed(work(spark, sf_dir), made(spark, sf_dir, NOTED), versions(spark, sf_dir)), "assignment_id", "assignment_status", "user_id", "revision", "n_versions")


RECORDS = "select o_custkey as campaign, o_orderkey % 300 as turn_id from orders "
TURNS = "select doc_id as turn_id, 't' || doc_id % 190 as turn_key from documents where doc_id % 13 > 0"
LABELLED = "select event_id as prediction_id, event_id % 300 as turn_id, user_id as run_id, ts as imported_at, case event_type when 'error' then 'hostility' else 'policy' end as task, case when event_type <> 'signup' then value > 60 end as is_non_policy from events where event_id % 300 % 5 > 0"


@query(f"""with p as (select * from ({LABELLED}) where task = 'policy' qualify row_number() over (partition by turn_id order by imported_at desc, run_id desc, prediction_id desc) = 1)
    select campaign, count(*) as n_records, count(*) filter (where is_non_policy is distinct from false) as invalid_count, min(turn_key) filter (where is_non_policy is distinct from false) as example_turn_key from ({RECORDS}) r join ({TURNS}) t using (turn_id) left join p using (turn_id) group by 1""")
def eligible_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.eligibility(*(made(spark, sf_dir, s) for s in (RECORDS, TURNS, LABELLED)))


SAMPLE = "select doc_id + 1 as sample_order, 't' || case when doc_id % 41 = 7 then doc_id - 1 else doc_id end as turn_key from documents "
TAKEN = "select 't' || o_orderkey % 190 as turn_key from orders where o_custkey % 11 = 0"
BATCH = f"""with i as (select turn_key, count(*) as n, min(turn_id) as turn_id from ({TURNS}) group by 1), k as (select distinct turn_key, true as taken from ({TAKEN})), b as (select sample_order, s.turn_key, case when count(*) over (partition by s.turn_key) > 1 then 'TWICE' when n is null then 'MISSING' when n > 1 then 'AMBIGUOUS' when taken then 'TAKEN' end as error,
    turn_id as t, -sample_order as priority from ({SAMPLE}) s left join i using (turn_key) left join k using (turn_key))"""


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.sample_batch(*(made(spark, sf_dir, s) for s in (SAMPLE, TURNS, TAKEN)))


@query(BATCH + " select sample_order, turn_key, error, case when error is null then t end as turn_id, priority from b")
def frozen_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir)


@query(BATCH + """ select count(*) as n, count(*) filter (where error = 'TWICE') as n_twice, count(*) filter (where error = 'MISSING') as n_missing, count(*) filter (where error = 'AMBIGUOUS') as n_ambiguous, count(*) filter (where error = 'TAKEN') as n_taken,
    (select string_agg(turn_key, ',' order by sample_order) from (select * from b where error = 'MISSING' order by sample_order limit 5)) as first_missing, false as usable from b""")
def frozen_batch_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.batch_accounts(batch(spark, sf_dir), 200)


FAILED = "select user_id % 50 as artifact, case event_type when 'view' then 'success' when 'signup' then null else 'invalid' end as status, case event_type when 'error' then 'JSON_TRUNCATION' when 'click' then 'odd' when 'purchase' then 'JSON_MALFORMED' end as failure_category from events "


@query(f"select a.artifact, c.failure_category, count(x.artifact) as n from (select distinct artifact from ({FAILED})) a cross join (select unnest(['JSON_TRUNCATION', 'JSON_MALFORMED', 'NEVER', 'UNCLASSIFIED']) as failure_category) c left join (select artifact, case when failure_category in ('JSON_TRUNCATION', 'JSON_MALFORMED') then failure_category else 'UNCLASSIFIED' end as failure_category from ({FAILED}) where status is distinct from 'success') x on x.artifact = a.artifact and x.failure_category = c.failure_category group by all")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.failure_counts(made(spark, sf_dir, FAILED), "artifact", ["JSON_TRUNCATION", "JSON_MALFORMED", "NEVER"])
