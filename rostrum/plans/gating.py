"""Queries of gates and lists: reconciliation of files, rulings, exported rows, coverage, queues, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import exports, gates, selection
from rostrum.plans import reviewing
from rostrum.plans.corpus import FOLD, RULES, as_fragments, reconstruct
from rostrum.plans.registry import query
from rostrum.sources.tables import table


# Every 23rd fragment is lost and every 29th is there twice; every 17th was not folded; every 19th turn is lost; counts differ.
@query(FOLD + """, x as (select *, case when n % 23 = 0 then 0 when n % 29 = 0 then 2 else 1 end as w, n % 17 <> 0 as kept from s where i > 0), u as (select user_id, sum(w) as w from x group by 1 having sum(w) > 0),
    c as (select user_id as source_file, 'SPEECH_FRAGMENT_COUNT_MISMATCH' as failure_code, 1 as n from u where user_id % 5 = 0 union all select user_id, 'BILL_RECORD_COUNT_MISMATCH', 3 from u where user_id % 7 = 0
        union all select user_id, 'DUPLICATE_GENERATED_FRAGMENT_KEY', count(*) filter (where w = 2) from x group by 1
        union all select user_id, 'INTERJECTION_DISPOSITION_INVALID', sum(w) filter (where kind = 'I' and not kept) from x group by 1
        union all select user_id, 'FRAGMENT_DISPOSITION_INVALID', sum(w) filter (where kind <> 'I' and not kept) from x group by 1
        union all select user_id, 'LINEAGE_REFERENCES_UNKNOWN_FRAGMENT', count(*) filter (where kind <> 'I' and kept and w = 0) from x group by 1
        union all select user_id, 'LINEAGE_REFERENCES_UNKNOWN_TURN', count(*) filter (where kind <> 'I' and kept and turn % 19 = 0) from x group by 1
        union all select user_id, 'CONTINUATION_DISPOSITION_MISMATCH', abs(sum(case when kind = 'C' then w else 0 end) - count(*) filter (where kind = 'C' and kept)) from x group by 1)
    select source_file, failure_code, n::bigint as n from c where n > 0""")
def file_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, n = as_fragments(spark, sf_dir), F.col("sequence_number")
    fragments = whole.filter(n % 23 != 0)
    fragments = fragments.unionByName(fragments.filter(n % 29 == 0))
    folded = reconstruct.fold(whole, RULES)
    kept = folded.filter(n % 17 != 0)
    file, count = F.col("source_file"), F.count("*")
    tags = fragments.groupBy(file).agg(F.create_map(F.lit("speech"), count, F.lit("bill"), F.lit(0).cast("long")).alias("p"), F.create_map(F.lit("speech"), count + (file % 5 == 0).cast("int"), F.lit("bill"), F.when(file % 7 == 0, 3).otherwise(0).cast("long")).alias("o"))
    observed, produced = (tags.select(file, F.explode(c).alias("tag", "n")) for c in "op")
    turns = reconstruct.lineage(folded).select("source_file", "turn").distinct().filter("turn % 19 <> 0")
    return gates.file_failures(observed, produced, fragments, kept.filter("relation <> 'interjection'"), kept.filter("relation = 'interjection'"), turns)


@query("""with d as (select doc_id as i, *, case when doc_id % 2 = 0 then 'policy' else 'non-policy' end as hs, case when doc_id % 2 = 0 then source end as hd from documents), g as (select * from d where i % 3 = 0),
    r as (select i, case i % 7 when 0 then 'human_correct' when 1 then 'human_needs_revision' when 2 then 'codebook_ambiguous' when 3 then 'no idea' else 'model_error' end as outcome, i % 5 = 0 as non, i % 4 <> 0 as domain,
        i % 11 = 0 as bare, i % 13 = 0 as maybe, i % 17 = 0 as other, i % 24 = 0 as twice from d where (i % 3 = 0 and i % 10 <> 9) or i % 30 = 1),
    e as (select coalesce(g.i, r.i) as doc_id, case when r.i is null then 'RULING_MISSING' when g.i is null then 'RULING_UNEXPECTED' when twice then 'REPEATED' when outcome = 'no idea' then 'OUTCOME_UNKNOWN' when bare then 'REASON_MISSING' when maybe then 'REVISION_UNKNOWN'
        when non and domain then 'NON_POLICY_WITH_DOMAIN' when not non and not domain and outcome <> 'codebook_ambiguous' then 'POLICY_WITHOUT_DOMAIN' when other then 'FACTS_DIFFER' end as error from g full join r using (i))
    select * from e where error is not null""")
def ruling_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    human = F.when(i % 2 == 0, "policy").otherwise("non-policy")
    rows = table(spark, sf_dir, "documents").select(i, human.alias("human_status"), F.when(i % 2 == 0, F.col("source")).alias("human_domain"), F.lit("policy").alias("model_status"), F.col("lang").alias("model_domain"))
    outcome = F.when(i % 7 == 0, "human_correct").when(i % 7 == 1, "human_needs_revision").when(i % 7 == 2, "codebook_ambiguous").when(i % 7 == 3, "no idea").otherwise("model_error")
    ruled = rows.filter((i % 3 == 0) & (i % 10 != 9) | (i % 30 == 1)).withColumns({
        "outcome": outcome, "status": F.when(i % 5 == 0, "non-policy").otherwise("policy"), "domain": F.when(i % 4 != 0, "health"), "issue_type": F.when(i % 11 == 0, "").otherwise("scope"),
        "rationale": F.lit("as the codebook says"), "revise": F.when(i % 13 == 0, "maybe").otherwise("no"), "model_domain": F.when(i % 17 == 0, "other").otherwise(F.col("model_domain")),
    })
    return gates.ruling_errors(rows.filter(i % 3 == 0), ruled.unionByName(ruled.filter(i % 24 == 0)), "doc_id")


@query("""select doc_id, case when lang <> 'en' then 'provider' when doc_id % 4 <> 0 and doc_id % 6 = 1 then 'prompt_version' end as error from documents""")
def provenance_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    row = {"provider": F.col("lang"), "prompt_version": F.when(i % 4 != 0, F.when(i % 6 == 1, "v0").otherwise("v1"))}
    return table(spark, sf_dir, "documents").select(i, gates.provenance_error(row, {"provider": "en", "prompt_version": "v1", "execution_mode": "batch"}).alias("error"))


@query("""with p as (select c_custkey as k from customer where c_custkey % 4 <> 0), o as (select o_custkey as k, count(*) as n, count(*) filter (where o_orderstatus not in ('F', 'O')) as u from orders group by 1),
    j as (select count(*) filter (where p.k is not null) as n_planned, count(*) filter (where o.k is null) as n_missing, count(*) filter (where p.k is null) as n_outside, count(*) filter (where n > 1) as n_repeated, coalesce(sum(u), 0)::bigint as n_unknown from p full join o on p.k = o.k)
    select *, n_missing + n_outside + n_repeated + n_unknown = 0 as complete from j""")
def outcome_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return gates.coverage(planned, table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey")), "k", "o_orderstatus", ("F", "O"))


@query("""with runs as (select distinct user_id as run_id from events union select unnest([-1, -2])), p as (select event_id, user_id from events where event_type <> 'error'), t as (select distinct event_id % 7000 as event_id from events where event_type in ('view', 'click')),
    r as (select user_id, count(*) as n from events where event_type = 'error' group by 1)
    select run_id, count(p.event_id) as prediction_count, count(t.event_id) as reviewed_count, coalesce(any_value(r.n), 0) as provider_refusal_count, count(p.event_id) - count(t.event_id) as unreviewed_count
    from runs left join p on p.user_id = run_id left join t on t.event_id = p.event_id left join r on r.user_id = run_id group by 1""")
def export_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("run_id", F.col("user_id"))
    runs = log.select("run_id").union(spark.createDataFrame([(-1,), (-2,)], "run_id bigint")).distinct()
    reviews = reviewing.log(spark, sf_dir).select((F.col("review_id") % 7000).alias("prediction_id"), F.when(F.col("status") == "skipped", "open").otherwise(F.col("status")).alias("review_status"))
    return exports.catalogue(runs, log.filter("event_type <> 'error'").select("run_id", F.col("event_id").alias("prediction_id")), reviews, log.filter("event_type = 'error'"))


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderpriority, o_custkey, o_orderkey::varchar) as corpus_order from orders")
def corpus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey", F.col("o_orderkey").cast("string").alias("key"))
    return exports.canonical_order(rows, "o_orderdate", "o_orderpriority", "o_custkey", "key").select("o_orderkey", "corpus_order")


@query(f"""{reviewing.CURRENT} select 'unreviewed' as queue, doc_id from c where last_status is null union all select 'edited', doc_id from c where last_status = 'edited' and lang = 'en' union all select 'reviewed', doc_id from c where last_status is not null and lang = 'de'
    union all select 'flagged_codebook', doc_id from c where flagged_status is not null and doc_id in (select doc_id from labels where toxic = 1)""")
def review_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = reviewing.current(spark, sf_dir)
    sample = table(spark, sf_dir, "labels").filter("toxic = 1")
    asked = {"unreviewed": {}, "edited": {"equal": {"lang": "en"}}, "reviewed": {"equal": {"lang": "de"}}, "flagged_codebook": {"sample": ("doc_id", sample)}}
    return reduce(DataFrame.unionByName, [selection.review_queue(current, wanted, **more).select(F.lit(wanted).alias("queue"), "doc_id") for wanted, more in asked.items()])


@query("select count(*) as eligible_count, least(count(*), 100) as selected_count from documents where lang in ('en', 'de') and text ilike '%er%'")
def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.preview(table(spark, sf_dir, "documents"), selection.Criteria(one_of={"lang": ("en", "de")}, keywords_any=("er",)), 100)


@query(FOLD + """select user_id as source_file, n as sequence_number, case when relation <> 'interjection' then turn end as turn, case when relation <> 'interjection' then row_number() over (partition by user_id, turn, relation <> 'interjection' order by n) end as ordinal,
    relation = 'interjection' as is_interjection, case when relation = 'interjection' then turn end as interrupted_turn from s where i > 0""")
def fragment_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fragment with its turn and its place there, or with the turn that it interrupted."""
    key, fragments = ["source_file", "sequence_number"], as_fragments(spark, sf_dir)
    folded = reconstruct.fold(fragments, RULES)
    said = folded.filter("relation = 'interjection'").select(*key, F.col("turn").alias("interrupted_turn"), F.lit(True).alias("_i"))
    rows = fragments.select(*key).join(reconstruct.lineage(folded).select(*key, "turn", F.col("ordinal").cast("long").alias("ordinal")), key, "left").join(said, key, "left")
    return rows.withColumn("is_interjection", F.col("_i").isNotNull()).drop("_i")
