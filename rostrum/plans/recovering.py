"""Queries of recoveries and of frozen plans.  Orders stand in for records, their customers for campaigns, their lines for the rows of attempts' artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import keys
from rostrum.operators import baseline, recoveries
from rostrum.plans.registry import query
from rostrum.plans.second import quoted
from rostrum.sources.tables import table

# What both engines say of the tables in the same words.
RECORDS = "select distinct 100 * o_custkey + l_linenumber as recovery, o_orderkey as record_id, case when o_orderkey % 23 = 0 then '' else 'error ' || o_orderkey % 5 end as original_validation_error from orders join lineitem on l_orderkey = o_orderkey where l_linenumber <= 3"
ATTEMPTS = """select distinct 100 * o_custkey + l_linenumber as recovery, o_custkey as campaign, l_linenumber as attempt_number, case when o_custkey % 19 > 0 then 'jobs/' || o_custkey || '/' || l_linenumber end as provider_job_id,
    case (o_custkey + l_linenumber) % 3 when 0 then 'evidence_only' when 1 then 'classification_retry' end as recovery_mode, case when (o_custkey + l_linenumber) % 11 = 0 then 'SUBMITTED' else 'COLLECTED' end as status,
    case when o_custkey % 29 = 0 then '' when o_custkey % 31 > 0 then 'a/' || o_custkey || '/' || l_linenumber end as artifact from orders join lineitem on l_orderkey = o_orderkey where l_linenumber <= 3"""
ARTIFACTS = """select 'a/' || o_custkey || '/' || l_linenumber as artifact, o_orderkey as record_id, case l_returnflag when 'R' then 'invalid' when 'A' then 'provider_failure' else case when l_linestatus = 'F' then 'success' else '' end end as status,
    case when l_partkey % 41 = 0 then 9 else l_linenumber end as recovery_attempt_number, case when o_custkey % 19 > 0 then case when l_partkey % 43 = 0 then 'jobs/other' else 'jobs/' || o_custkey || '/' || l_linenumber end end as recovery_provider_job_id,
    case when l_suppkey % 2 = 0 then case (o_custkey + l_linenumber) % 3 when 0 then 'evidence_only' else 'classification_retry' end end as recovery_mode, case when o_orderkey % 23 = 0 then '' when l_partkey % 47 = 0 then 'another' else 'error ' || o_orderkey % 5 end as original_validation_error,
    case when l_returnflag = 'R' then 'again ' || l_suppkey % 3 when l_suppkey % 5 = 0 then '' end as validation_error, case when l_returnflag = 'A' and l_suppkey % 7 > 0 then 'no answer' end as provider_error
    from orders join lineitem on l_orderkey = o_orderkey where l_linenumber <= 3 and l_quantity <= 45"""
HISTORY = f"""with rec as ({RECORDS}), att as ({ATTEMPTS}), art as ({ARTIFACTS}), num as (select *, count(*) over (partition by artifact, record_id) as n from art),
    h as (select a.campaign, r.record_id, a.attempt_number, a.recovery, coalesce(a.provider_job_id, '') as provider_job_id, coalesce(a.recovery_mode, 'classification_retry') as recovery_mode, r.original_validation_error,
        case when n = 1 and num.status <> '' then num.status else 'missing' end as replacement_validation_result, case when n = 1 then coalesce(nullif(num.validation_error, ''), num.provider_error) end as replacement_validation_error, coalesce(n, 0) as n_rows,
        coalesce(n = 1 and num.recovery_attempt_number = a.attempt_number and num.recovery_provider_job_id is not distinct from a.provider_job_id and num.original_validation_error is not distinct from r.original_validation_error
            and (num.recovery_mode is null or num.recovery_mode = coalesce(a.recovery_mode, 'classification_retry')), false) as lineage_consistent, coalesce(a.artifact, '') <> '' as lineage_complete
        from rec r join att a using (recovery) left join (select distinct * from num where n = 1 union all select distinct artifact, record_id, null, null, null, null, null, null, null, n from num where n > 1) num on num.artifact = a.artifact and num.record_id = r.record_id where a.status = 'COLLECTED')"""


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of an expression over the tables that both engines know."""
    names = [t for t in ("orders", "lineitem", "customer", "events", "documents") if f" {t} " in f"{sql} "]
    for t in names:
        table(spark, sf_dir, t).createOrReplaceTempView(f"rostrum_{t}")
        sql = sql.replace(f"from {t}", f"from rostrum_{t}").replace(f"join {t}", f"join rostrum_{t}")
    rows = spark.sql(sql)
    for t in names:
        spark.catalog.dropTempView(f"rostrum_{t}")
    return rows


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoveries.history(*(made(spark, sf_dir, s) for s in (ATTEMPTS, RECORDS, ARTIFACTS)))


@query(HISTORY + " select * from h")
def recovery_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir)


@query(HISTORY + """, e as (select *, case when not lineage_complete then 'LINEAGE_INCOMPLETE' when provider_job_id = '' then 'JOB_MISSING' when replacement_validation_result not in ('invalid', 'provider_failure', 'missing') then 'NOT_A_FAILURE'
        when replacement_validation_result <> 'missing' and replacement_validation_error is null then 'ERROR_MISSING' when original_validation_error = '' then 'ORIGINAL_ERROR_MISSING' when not lineage_consistent then 'LINEAGE_INCONSISTENT' end as error from h)
    select campaign, record_id, count(*) as n_attempts, arg_min_null(original_validation_error, attempt_number) as original_validation_error, arg_max_null(replacement_validation_result, attempt_number) as last_result,
        arg_max_null(replacement_validation_error, attempt_number) as last_error, arg_max_null(recovery_mode, attempt_number) as last_mode, arg_min(error, attempt_number) filter (where error is not null) as history_error from e group by all""")
def terminal_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoveries.terminal_histories(history(spark, sf_dir))


RESULTS = """select o_custkey as campaign, o_orderkey as record_id, case o_orderstatus when 'F' then case o_orderkey % 3 when 0 then 'invalid' when 1 then 'provider_failure' else 'missing' end else 'success' end as status,
    case when o_orderkey % 7 = 0 then '' when o_orderkey % 7 = 1 then 'JSON_TRUNCATION' end as failure_category, case when o_orderkey % 3 = 0 then 'error ' || o_orderkey % 5 when o_orderkey % 4 = 0 then '' end as validation_error, case when o_orderkey % 3 = 1 then 'no answer' end as provider_error from orders """


@query(f"""with rec as ({RECORDS}), att as ({ATTEMPTS}), res as ({RESULTS}), l as (select campaign, record_id, count(*) as n, string_agg(attempt_number || ':' || status, ',' order by attempt_number) as said from rec join att using (recovery) group by all)
    select campaign, record_id, source, coalesce(nullif(failure_category, ''), status) as failure_category, coalesce(nullif(validation_error, ''), provider_error) as reason, coalesce(n, 0) + 1 as attempt_count, coalesce(said, '') as attempts, coalesce(n, 0) + 1 >= 3 as terminal
    from res join (select doc_id as record_id, source from documents) using (record_id) left join l using (campaign, record_id) where status in ('invalid', 'provider_failure', 'missing')""")
def unresolved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed records with a turn (documents stand in), and all attempts, also those that are under way."""
    tried = made(spark, sf_dir, RECORDS).join(made(spark, sf_dir, ATTEMPTS), "recovery")
    turns = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "source")
    rows = recoveries.unresolved(made(spark, sf_dir, RESULTS), turns, recoveries.attempt_lists(tried, "status"))
    said = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["attempt_number"].cast("string"), a["status"])), ",")
    return rows.withColumn("attempts", said)


OUTCOMES = "select event_id as outcome_id, user_id as record_id, case when value > 40 then 'INVALID_OUTPUT' else 'PROVIDER_REFUSAL' end as resolution_type from events "
REVIEWS = "select event_id % 500 as outcome_id, ts, event_id as review_id, case event_type when 'error' then 'human_annotated_after_ai_failure' else event_type end as review_status from events "


@query(f"""with o as ({OUTCOMES}), r as (select * from ({REVIEWS}) qualify row_number() over (partition by outcome_id order by ts desc, review_id desc) = 1)
    select outcome_id, record_id, review_status from o left join r using (outcome_id) where resolution_type = 'INVALID_OUTPUT' and review_status is distinct from 'human_annotated_after_ai_failure'""")
def unsettled_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoveries.unsettled(made(spark, sf_dir, OUTCOMES), made(spark, sf_dir, REVIEWS)).select("outcome_id", "record_id", "review_status")


# Chains of five generations; some have no beginning, some go in a circle.
SOURCES = "select c_custkey as campaign, case when c_custkey % 35 = 11 then -1 when c_custkey % 35 = 17 then c_custkey + 1 when c_custkey % 5 > 0 then c_custkey - 1 end as source from customer "
TRIES = """select o_custkey - o_custkey % 5 + g as campaign, o_orderkey as record_id, case (o_orderkey * 13 + g * 3 + o_custkey) % 10 when 0 then 'success' when 1 then 'success' when 2 then 'missing' else 'invalid' end as status,
    'error ' || (o_orderkey + g) % 4 as validation_error, case when (o_orderkey + g) % 13 = 0 then 'another' when g > 0 then 'error ' || (o_orderkey + g - 1) % 4 end as original_validation_error
    from orders {g} where g = 0 and o_orderkey % 53 > 0 or g > 0 and (o_orderkey * 7 + g * 3) % 11 < 10"""
TWICE = "select * from ({t}) as t union all select * from ({t}) as u where (record_id + campaign) % 37 = 0"
CHAINS = f"""with recursive src as ({SOURCES}), gen as (select campaign, source, campaign as root, 0::bigint as generation from src where source is null union all select s.campaign, s.source, g.root, g.generation + 1 from src s join gen g on s.source = g.campaign),
    t as ({TWICE.format(t=TRIES.format(g=", range(5) as x(g)"))}), r as (select campaign, record_id, case when count(*) > 1 then 'duplicate' else any_value(status) end as status, case when count(*) = 1 then any_value(validation_error) end as validation_error, case when count(*) = 1 then any_value(original_validation_error) end as claimed from t group by all),
    l as (select g.root, r.record_id, r.campaign, src.source, g.generation, r.status, r.validation_error, case when g.root is null then 'NO_ROOT' when src.source is null and r.status = 'duplicate' then 'DUPLICATE' when src.source is null then 'ORIGINAL' when b.status is null then 'NOT_IN_SOURCE' when b.status = 'success' then 'ALREADY_RESOLVED'
        when r.status = 'duplicate' or b.status = 'duplicate' then 'DUPLICATE' when b.validation_error is distinct from r.claimed then 'ERROR_DIFFERS' else 'CONSISTENT' end as link from r join src using (campaign) left join gen g on g.campaign = r.campaign left join r b on b.campaign = src.source and b.record_id = r.record_id),
    sure as (select campaign, record_id from l where link = 'ORIGINAL' union all select l.campaign, l.record_id from l join sure s on s.campaign = l.source and s.record_id = l.record_id where l.link = 'CONSISTENT'), z as (select l.*, s.campaign is not null as trusted from l left join sure s on s.campaign = l.campaign and s.record_id = l.record_id)"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = made(spark, sf_dir, TWICE.format(t=TRIES.format(g="lateral view explode(sequence(0, 4)) as g")))
    return recoveries.links(tries, recoveries.generations(made(spark, sf_dir, SOURCES)))


@query(CHAINS + " select * from z")
def recovery_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir)


@query(CHAINS + """, b as (select *, row_number() over (partition by root, record_id order by trusted and status = 'success' desc, case when trusted and status = 'success' then generation end desc nulls last, generation) as k, count(*) over p as n_rows, count(*) filter (where not trusted) over p as n_distrusted from z where root is not null window p as (partition by root, record_id))
    select root, record_id, case when good then campaign end as campaign, case when good then generation end as generation, case when good then status else 'missing' end as status, n_rows, n_distrusted from (select *, (trusted and status = 'success') or generation = 0 as good from b where k = 1)""")
def recovery_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoveries.effective(linked(spark, sf_dir))


# Documents as requests of plans of eight: prompts whose heads are whole, or odd in one of several ways.
HEAD = f"""'{{"business_type": ' || case when doc_id % 5 = 0 then 'null' else {quoted("source")} end || case when doc_id % 11 = 0 then ', "extra": 1' else '' end || ', "chamber":' || case when doc_id % 13 = 0 then '' else ' ' end || {quoted("lang")}
    || case when doc_id % 23 = 0 then '' else ', "date": "2000-01-01"' end || ', "major_heading": ' || {quoted("substr(coalesce(text, ''), 1, 30)")} || ', "minor_heading": ' || (doc_id % 7) || ', "speaker_name": null' || case when doc_id % 17 = 0 then '' else '}}' end"""
ASKED = f"""select doc_id, cast(doc_id as string) as turn_key, 'METADATA:' || chr(10) || {HEAD} || chr(10) || chr(10) || case when doc_id % 19 = 0 then 'TEXT:' else 'SPEECH:' end || chr(10) || coalesce(text, '') as prompt,
    case when doc_id % 3 = 0 then '{{"b":[1,2],"a":0}}' when doc_id % 3 = 1 then '{{"a": 0, "b": [1, 2]}}' else '{{"a":1}}' end as configuration from documents where doc_id % 31 > 0"""
READ = f"""with a as ({ASKED}), t as (select * from a union all select * from a where doc_id % 29 = 0), n as (select turn_key, count(*) as n, any_value(prompt) as prompt, any_value(configuration) as configuration from t group by 1),
    p as (select d.doc_id::varchar as turn_key, coalesce(n, 0) as n, prompt, configuration, split_part(substr(prompt, 11), chr(10) || chr(10) || 'SPEECH:' || chr(10), 1) as head, prompt like '%' || chr(10) || chr(10) || 'SPEECH:' || chr(10) || '%' as whole from documents d left join n on n.turn_key = d.doc_id::varchar where lang <> 'de'),
    v as (select *, case when whole and json_valid(head) then head end as j from p),
    r as (select *, case when n = 0 then 'MISSING' when n > 1 then 'REPEATED' when not whole then 'STRUCTURE' when j is null then 'METADATA_JSON' when list_sort(json_keys(j)) <> ['business_type', 'chamber', 'date', 'major_heading', 'minor_heading', 'speaker_name'] then 'METADATA_FIELDS'
        when concat('{{"business_type": ', j -> 'business_type', ', "chamber": ', j -> 'chamber', ', "date": ', j -> 'date', ', "major_heading": ', j -> 'major_heading', ', "minor_heading": ', j -> 'minor_heading', ', "speaker_name": ', j -> 'speaker_name', '}}') <> head then 'ROUND_TRIP' end as error from v)"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of plans with eight requests each."""
    rows = made(spark, sf_dir, ASKED)
    rows = rows.union(rows.filter("doc_id % 29 = 0"))
    one = F.concat(F.lit('{"metadata":{"key":'), keys.json_text(F.concat(F.lit("turn:"), "turn_key")), F.lit('},"request":{"contents":[{"parts":[{"text":'), keys.json_text(F.col("prompt")), F.lit('}]}],"generationConfig":'), "configuration", F.lit("}}"))
    many = rows.groupBy(F.floor(F.col("doc_id") / 8).alias("plan")).agg(F.array_join(F.collect_list(one), ",").alias("_r"))
    return many.select("plan", F.concat(F.lit('{"provenance":{"model":"m"},"request":{"batch":{"input_config":{"requests":{"requests":['), "_r", F.lit("]}}}}}")).alias("text"))


def frozen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = baseline.requests(plans(spark, sf_dir), "plan", "text")
    expected = table(spark, sf_dir, "documents").filter("lang <> 'de'").select(F.col("doc_id").cast("string").alias("turn_key"))
    return baseline.records(expected, asked), asked


@query(READ + """ select turn_key, error, case when error is null then sha256(substr(prompt, 11 + length(head) + 10)) end as speech_sha256, case when error is null then j ->> 'chamber' end as chamber, case when error is null then j ->> 'major_heading' end as major_heading,
    case when error is null then j ->> 'minor_heading' end as minor_heading from r""")
def frozen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("error").isNull()
    return frozen(spark, sf_dir)[0].select("turn_key", "error", F.when(whole, F.sha2("speech", 256)).alias("speech_sha256"), *[F.when(whole, F.col(c)).alias(c) for c in ("chamber", "major_heading", "minor_heading")])


@query(READ + """ select count(*) as n_turns, count(*) filter (where error is null) as n_records, count(*) filter (where error = 'MISSING') as n_missing, count(*) filter (where error = 'REPEATED') as n_repeated, count(*) filter (where error not in ('MISSING', 'REPEATED')) as n_broken,
    count(distinct case when n = 1 then (configuration ->> 'a') || cast((configuration -> 'b') as varchar) end) + max(case when n = 1 and (configuration -> 'b') is null then 1 else 0 end) as n_configurations, true as provenance_holds, false as usable from r""")
def frozen_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.accounts(*frozen(spark, sf_dir), {"model": "m"})


AUDIT = """select doc_id as record_id, doc_id % 3 > 0 as valid, case when doc_id % 17 = 0 then '[1]' when doc_id % 19 = 0 then '{' else '{"chars":' || n_chars || '}' end as values, case when doc_id % 3 = 0 then case doc_id % 7 when 0 then 'PREDICTION' when 1 then '' else 'INVALID_OUTPUT' end else 'PREDICTION' end as outcome,
    case when doc_id % 5 = 0 then 'Unmatched: ' || lang when doc_id % 5 = 1 then '' when doc_id % 5 = 2 then 'ambiguous ' || source end as diagnostic, case when doc_id % 2 = 0 then 'unmatched and AMBIGUOUS' end as reason from documents"""


@query(f"""with a as ({AUDIT.replace("as values", 'as "values"')}), m as (select *, case when not valid then coalesce(nullif(diagnostic, ''), nullif(reason, ''), outcome) end as message from a)
    select case when valid then 'success' else 'invalid' end as status, case when valid then null else outcome end as error_type, message as error_message, coalesce(contains(lower(message), 'unmatched'), false) as unmatched, coalesce(contains(lower(message), 'ambiguous'), false) as ambiguous,
        case when valid and coalesce(json_type(case when json_valid("values") then "values" end), '') <> 'OBJECT' then 'VALUES_NOT_AN_OBJECT' when not valid and outcome in ('', 'PREDICTION') then 'OUTCOME_MISSING' end as error, count(*) as n from m group by all""")
def baseline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline.results(made(spark, sf_dir, AUDIT))
    return rows.groupBy("status", "error_type", "error_message", (F.size("evidence_unmatched") > 0).alias("unmatched"), (F.size("evidence_ambiguous") > 0).alias("ambiguous"), "error").agg(F.count("*").alias("n"))
