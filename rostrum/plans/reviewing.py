"""Queries over reviews, attempts and campaigns.  The event log stands in for the review log, documents for predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import checks, reviews
from rostrum.plans.registry import query
from rostrum.sources.tables import table

LOG = """select event_id as review_id, event_id % 900 as doc_id, ts, case event_type when 'view' then 'accepted' when 'click' then 'edited' when 'error' then 'flagged' else 'skipped' end as status, case when event_type = 'click' then event_id end as revision_id from events"""
CURRENT = f"""with r as ({LOG}), c as (select d.doc_id, d.lang, max_by(r.status, (ts, review_id)) as last_status, max_by(review_id, (ts, review_id)) as last_review,
    max_by(r.status, (ts, review_id)) filter (where revision_id is not null) as revised_status, max_by(review_id, (ts, review_id)) filter (where revision_id is not null) as revised_review,
    max_by(r.status, (ts, review_id)) filter (where r.status = 'flagged') as flagged_status, max_by(review_id, (ts, review_id)) filter (where r.status = 'flagged') as flagged_review
    from documents d left join r using (doc_id) group by all)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "accepted").when(kind == "click", "edited").when(kind == "error", "flagged").otherwise("skipped")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), (F.col("event_id") % 900).alias("doc_id"), "ts", status.alias("status"), F.when(kind == "click", F.col("event_id")).alias("revision_id"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.current_reviews(table(spark, sf_dir, "documents").select("doc_id", "lang"), log(spark, sf_dir), "doc_id", "ts", "review_id")


@query(f"{CURRENT} select * from c")
def review_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir)


@query(f"""{CURRENT} select lang, count(*) as total, count(*) filter (where last_status is not null and last_status <> 'skipped') as reviewed, count(*) filter (where last_status = 'accepted') as accepted,
    count(*) filter (where last_status = 'edited') as edited, count(*) filter (where flagged_status is not null) as flagged, count(*) filter (where last_status is null) as unreviewed from c group by lang""")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.review_totals(current(spark, sf_dir), ["lang"])


EDITS = "select doc_id, case when doc_id % 3 = 0 then 'edited' else 'accepted' end as status, quality as q0, case when doc_id % 5 = 0 then 1 - quality else quality end as q1, toxic as t0, case when doc_id % 7 = 0 then null else toxic end as t1 from labels"


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(i % 3 == 0, "edited").otherwise("accepted").alias("status"), F.col("quality").alias("q0"), F.when(i % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("q1"),
        F.col("toxic").alias("t0"), F.when(i % 7 != 0, F.col("toxic")).alias("t1"),
    )


@query(f"select doc_id from ({EDITS}) where (status = 'edited') = (q0 is not distinct from q1 and t0 is not distinct from t1)")
def inconsistent_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.inconsistent(edits(spark, sf_dir), "status", ["q0", "t0"], ["q1", "t1"]).select("doc_id")


@query(f"select array_to_string(list_filter([case when q0 is distinct from q1 then 'quality' end, case when t0 is distinct from t1 then 'toxic' end], lambda x: x is not null), ',') as fields, status, count(*) as n from ({EDITS}) group by all")
def edit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array_join(reviews.changed_fields({"quality": ("q0", "q1"), "toxic": ("t0", "t1")}), ",")
    return edits(spark, sf_dir).groupBy(fields.alias("fields"), "status").agg(F.count("*").alias("n"))


RULED = "select doc_id, lang as truth, lang as a, case when doc_id % 6 = 0 then 'en' else lang end as b, case when doc_id % 12 = 0 then lang end as ruling from documents"


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, lang = F.col("doc_id"), F.col("lang")
    return table(spark, sf_dir, "documents").select("doc_id", lang.alias("truth"), lang.alias("a"), F.when(i % 6 == 0, "en").otherwise(lang).alias("b"), F.when(i % 12 == 0, lang).alias("ruling"))


@query(f"select reference, count(*) as n, count(*) filter (where b = reference) as b_correct from (select *, coalesce(ruling, case when a = b then a end) as reference from ({RULED})) where reference is not null group by 1")
def adjudicated_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews.adjudicated(ruled(spark, sf_dir), "a", "b", "ruling")
    return rows.groupBy("reference").agg(F.count("*").alias("n"), F.count_if(F.col("b") == F.col("reference")).alias("b_correct"))


@query(f"""select count(*) as n, count(*) filter (where a = truth) as a_correct, count(*) filter (where b = truth) as b_correct, count(*) filter (where a <> b) as disagreements,
    round((count(*) filter (where b = truth) - count(*) filter (where a = truth)) / count(*), 6) as delta, case when count(*) filter (where b = truth) > count(*) filter (where a = truth) then 'IMPROVED' when count(*) filter (where b = truth) < count(*) filter (where a = truth) then 'REGRESSED' else 'UNCHANGED' end as verdict from ({RULED})""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ruled(spark, sf_dir)
    a, b = (rows.select("doc_id", "truth", F.col(c).alias("said")) for c in "ab")
    return reviews.compared(a, b, "doc_id", "truth", "said").withColumn("delta", F.round("delta", 6))


TRIES = "select event_id % 3000 as record_id, event_id as attempt, case event_type when 'purchase' then 'success' when 'error' then 'refused' when 'click' then 'invalid' else 'failed' end as status from events"


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "success").when(kind == "error", "refused").when(kind == "click", "invalid").otherwise("failed")
    return table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("record_id"), F.col("event_id").alias("attempt"), status.alias("status"))


@query(f"select record_id, string_agg(status, '>' order by attempt) as history, count(*) as attempts, bool_and(status = 'refused') as all_refused, max_by(status, attempt) as last_status from ({TRIES}) group by 1")
def attempt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.attempts(tries(spark, sf_dir), "record_id", "attempt", "status")


@query(f"""with a as (select record_id, count(*) as n, max_by(status, attempt) as s from ({TRIES}) group by 1)
    select case when s = 'success' then 'DONE' when s = 'refused' then 'TERMINAL_REFUSAL' when n >= 3 then 'ATTEMPTS_EXHAUSTED' else 'ELIGIBLE' end as bucket, count(*) as n from a group by 1""")
def recovery_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews.attempts(tries(spark, sf_dir), "record_id", "attempt", "status")
    return rows.groupBy(reviews.recovery_bucket(F.col("last_status"), F.col("attempts"), 3).alias("bucket")).agg(F.count("*").alias("n"))


@query("""select case when o_orderstatus = 'P' then 'skipped' when o_orderstatus = 'F' then 'completed' when o_orderkey % 2 = 0 then 'in_progress' else 'to_annotate' end as status, o_orderpriority, count(*) as n from orders group by all""")
def workflow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reviews.workflow(F.when(F.col("o_orderkey") % 2 == 0, "draft"), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").groupBy(s.alias("status"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("""select source, case when count(*) filter (where lang = 'es') > 5 then 0 else greatest(0, floor(900000 * 0.9)::bigint - sum(n_chars)::bigint) end::bigint as room from documents group by 1""")
def quota_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = reviews.quota_left(F.sum("n_chars"), 900_000, 0.9, F.when(F.count_if(F.col("lang") == "es") > 5, 1).otherwise(0))
    return table(spark, sf_dir, "documents").groupBy("source").agg(room.alias("room"))


@query("""select c_custkey, case c_nationkey % 3 when 0 then 'ALGERIA | n1 | n99' else 'n' || c_nationkey || ' | n99' end as nations from (select c_custkey, c_nationkey % 3 * 50 as c_nationkey from customer)""")
def readable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("c_nationkey") % 3 * 50
    codes = F.when(first % 3 == 0, F.array(F.lit("n0"), F.lit("n1"), F.lit("n99"))).otherwise(F.array(F.concat(F.lit("n"), first.cast("string")), F.lit("n99")))
    book = table(spark, sf_dir, "nation").filter("n_nationkey in (0, 7)").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("code"), F.when(F.col("n_nationkey") == 0, "ALGERIA").otherwise("OTHER").alias("name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", codes.alias("codes"))
    return reviews.named(rows, "codes", book, "code", "name", "n").select("c_custkey", F.array_join("n", " | ").alias("nations"))


@query("select source, count(*) as n, min(doc_id) as first from documents where source not in ('src0', 'src1', 'src2', 'src3') group by 1")
def unknown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(f"src{k}",) for k in range(4)], "source string")
    return reviews.unknown_values(table(spark, sf_dir, "documents"), "source", known, "doc_id")


@query("select conv_id, max(turn) - min(turn) + 1 = count(*) and count(distinct turn) = count(*) as gapless from (select conv_id, turn from conversations where not (conv_id % 4 = 0 and turn = 1)) group by 1")
def ordinal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.gapless(table(spark, sf_dir, "conversations").filter("not (conv_id % 4 = 0 and turn = 1)"), "conv_id", "turn")


@query("select conv_id, unnest(range(len(r)))::bigint as place, unnest(r) as role, unnest(l)::bigint as chars from (select conv_id, list(role order by turn) as r, list(length(text) order by turn) as l from conversations group by 1)")
def zipped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("chars"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.chars").alias("chars_"))
    return reviews.zipped(rows, "roles", "chars_").select("conv_id", F.col("place").cast("long").alias("place"), F.col("a").alias("role"), F.col("b").cast("long").alias("chars"))


@query("""with s as (select count(*) as documents, count(distinct source) as sources, sum(n_chars)::bigint as chars, count(*) filter (where n_chars < 100) as short from documents)
    select 'documents' as measure, documents as value from s union all select 'sources', sources from s union all select 'chars', chars from s union all select 'short', short from s""")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 100).alias("short"))
    return checks.unpivoted(row)


@query("""with a as (select lang, count(*) as n from documents group by 1), e as (select * from (values ('en', 124::bigint), ('fr', 0), ('xx', 5)) v(lang, expected))
    select coalesce(a.lang, e.lang) as lang, expected, n as actual, expected is not distinct from n as same from e full join a on a.lang = e.lang""")
def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return checks.against_baseline(actual, {"en": 124, "fr": 0, "xx": 5})


@query("""select doc_id, rank from (select doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::bigint as rank from documents) where rank <= 3""")
def longest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    top = reviews.top_per(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 3)
    return top.select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
