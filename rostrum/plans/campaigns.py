"""Compositions of the operators for campaigns and reviews: pages, prompts, failures, second passes, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import text
from rostrum.operators import events, metrics, ordered, rules, selection
from rostrum.plans.corpus import FOLD, RULES, as_fragments, reconstruct
from rostrum.plans.registry import query
from rostrum.sources.tables import table


@query("select o_orderkey, o_custkey, count(*) over () as total from orders where o_orderstatus = 'P' order by o_orderdate desc, o_orderkey limit 25 offset 50")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return selection.page_with_total(rows, [F.desc("o_orderdate"), "o_orderkey"], 25, 50).select("o_orderkey", "o_custkey", "total")


@query("""select doc_id, 'turn:' || doc_id as record_id, doc_id::varchar as turn_key, case when doc_id % 9 = 0 then null else 1990 + doc_id % 30 end as year, (60 * (doc_id % 90) + 0.5)::double as seconds from documents""")
def record_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat(F.when(i % 9 == 0, "x").otherwise((1990 + i % 30).cast("string")), F.lit("/2000-01-01.xml"))
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rows = table(spark, sf_dir, "documents").select(i, F.concat(F.lit("turn:"), i.cast("string")).alias("record_id"), path.alias("path"), iso(start).alias("a"), iso(start + F.make_dt_interval(mins=(i % 90).cast("int"), secs=F.lit(0.5))).alias("b"))
    return rows.select("doc_id", "record_id", text.without_prefix(F.col("record_id"), "turn:").alias("turn_key"), text.path_head(F.col("path")).cast("long").alias("year"), text.seconds_between(F.col("a"), F.col("b")).alias("seconds"))


@query("""select doc_id, sha256('Label the ' || lang || ' text.' || chr(10) || chr(10) || coalesce(text, '')) as prompt_sha256, left(text, 100) as text, length(text) > 100 as text_truncated from documents""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    whole = text.prompt(F.concat(F.lit("Label the "), "lang", F.lit(" text.")), F.coalesce("text", F.lit("")))
    return rows.select("doc_id", whole[1], *text.excerpt(F.col("text"), 100))


@query("""select lang, round(avg(length(coalesce(text, '')) + 4131), 6) as mean_chars, round(4131 * count(*) / sum(length(coalesce(text, '')) + 4131), 6) as invariant_share from documents group by lang""")
def prompt_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit(""))) + 4131
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.lit(4131) * F.count("*") / F.sum(n), 6).alias("invariant_share"))


@query("select year(ts) as year, count(*) as n_files, sum(strlen(props))::bigint as n_bytes from events group by 1")
def bytes_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.year("ts").cast("long").alias("year")).agg(F.count("*").alias("n_files"), F.sum(F.octet_length("props")).alias("n_bytes"))


@query("""select event_id % 40 as campaign, count(*) filter (where event_type = 'purchase') as n_valid, count(*) filter (where event_type <> 'purchase' and value > 50) as n_repaired,
    count(*) filter (where event_type = 'error' and not coalesce(value > 50, false)) as n_refused, count(*) filter (where event_type not in ('purchase', 'error') and not coalesce(value > 50, false)) as n_invalid, count(*) as n_all from events group by 1""")
def effective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.coalesce(F.col("value") > 50, F.lit(False))
    return rules.effective(table(spark, sf_dir, "events").withColumn("campaign", F.col("event_id") % 40), "campaign", kind == "purchase", value, kind == "error")


@query("""with o as (select *, lag(o_orderkey) over w as before, lag(o_orderstatus) over w as s, lag(o_orderpriority) over w as p from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
    select o_orderkey, nullif(o_orderstatus, 'P') is not distinct from nullif(s, 'P') and o_orderpriority is not distinct from p as same from o where before is not null""")
def configuration_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null field agrees with a null one: status P stands for none here."""
    config = F.struct(F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority"))
    rows = table(spark, sf_dir, "orders").withColumn("now", config)
    rows = rows.withColumn("then", F.lag("now").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("then is not null")
    return rows.select("o_orderkey", selection.same_configuration("now", "then", ["status", "priority"]).alias("same"))


@query("""select kind, id from (select 'order' as kind, o_orderkey as id, o_totalprice as p from orders where o_orderstatus = 'P' union all select 'event', event_id, value from events where event_type = 'error') order by p desc nulls last, kind, id limit 1""")
def next_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    b = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.lit("event"), "event_id", "value").toDF("kind", "id", "p")
    return selection.page(a.union(b), [F.desc_nulls_last("p"), "kind", "id"], 1).select("kind", "id")


@query("""select c_nationkey, count(*) as n, count(*) filter (where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_orderpriority = '1-URGENT')) as n_partial from customer group by 1""")
def exists_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    marked = events.with_exists(table(spark, sf_dir, "customer"), partial, ["c_custkey"], "has")
    return marked.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if("has").alias("n_partial"))


@query("""with p as (select doc_id, case when doc_id % 4 <> 0 then source end as primary_, case when doc_id % 3 = 0 then [lang, 'src1'] when doc_id % 3 = 1 then [lang] end as secondary from documents)
    select doc_id, primary_ as "primary" from p where coalesce(primary_ = 'src1', false) or coalesce(list_contains(secondary, 'src1'), false)""")
def derived_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    secondary = F.when(i % 3 == 0, F.array("lang", F.lit("src1"))).when(i % 3 == 1, F.array("lang"))
    rows = table(spark, sf_dir, "documents").select(i, F.when(i % 4 != 0, F.col("source")).alias("primary"), secondary.alias("secondary"))
    return selection.derived(rows, "primary", "secondary", "src1").select("doc_id", "primary")


@query("""select event_type, count(*) filter (where json_extract_string(props, '$.k') is not null) as n_with_key, count(*) filter (where json_extract_string(props, '$.k')::int = 7) as n_seven, count(*) filter (where (json_extract_string(props, '$.k')::int > 50) is not true) as n_not_above from events group by 1""")
def json_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(k.isNotNull()).alias("n_with_key"), F.count_if(k.cast("int") == 7).alias("n_seven"), F.count_if(selection.not_true(k.cast("int") > 50)).alias("n_not_above"),
    )


@query("""with o as (select o_custkey, o_orderkey, o_orderkey % 1000 as a, o_orderkey % 1000 + 1 + o_orderkey % 5 as b from orders), w as (select *, max(b) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as upto from o)
    select o_custkey, coalesce(bool_or(a < greatest(upto, 0)), false) as overlap from w group by 1""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    span = F.struct(k.alias("k"), (k % 1000).alias("start_offset"), (k % 1000 + 1 + k % 5).alias("end_offset"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return rows.select("o_custkey", ordered.spans_overlap(F.col("spans")).alias("overlap"))


@query("""select lang, coalesce(round(sum(case when doc_id % 10 = 0 then n_chars * 0.001 end) * count(*) / nullif(count(*) filter (where doc_id % 10 = 0), 0), 4), 0.0) as cost from documents group by lang""")
def projected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth that was paid for, projected to all."""
    paid = F.col("doc_id") % 10 == 0
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.when(paid, F.col("n_chars") * 0.001)).alias("spent"), F.count_if(paid).alias("n"), F.count("*").alias("all"))
    return rows.select("lang", F.round(metrics.ratio(F.col("spent") * F.col("all"), F.col("n")), 4).alias("cost"))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 200")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "event_type")


@query(FOLD + """select user_id as source_file, turn as first_fragment_sequence, string_agg(n::varchar, ',' order by n) as fragments from s where i > 0 and relation <> 'interjection' group by all""")
def turn_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn with its fragments in order."""
    own = reconstruct.lineage(reconstruct.fold(as_fragments(spark, sf_dir), RULES))
    each = own.groupBy("source_file", F.col("turn").alias("first_fragment_sequence")).agg(F.array_sort(F.collect_list("sequence_number")).alias("_s"))
    return each.select("source_file", "first_fragment_sequence", F.array_join(F.col("_s").cast("array<string>"), ",").alias("fragments"))


@query("""with d as (select doc_id, replace(replace(coalesce(text, ''), 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)) as t, replace(lang || '  Émile ' || source, 'É', 'E' || chr(769)) as name from documents)
    select doc_id, sha256(trim(regexp_replace(nfc_normalize(t), '[\\s]+', ' ', 'g'))) as clean_sha256, lower(regexp_replace(nfc_normalize(name), '[\\s]+', ' ', 'g')) as identity from d""")
def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and names whose accents were taken apart, cleaned."""
    t, name = F.coalesce("text", F.lit("")), F.concat("lang", F.lit("  Émile "), "source")
    for c, apart in (("é", "e\u0301"), ("ü", "u\u0308")):
        t = F.replace(t, F.lit(c), F.lit(apart))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), F.replace(name, F.lit("É"), F.lit("E\u0301")).alias("name"))
    return rows.select("doc_id", F.sha2(text.clean(F.col("t")), 256).alias("clean_sha256"), text.identity(F.col("name")).alias("identity"))


@query("select doc_id from labels where doc_id in (select doc_id from documents where source = 'src1') and doc_id not in (select doc_id from documents where lang = 'de')")
def in_and_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return selection.in_and_out(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", include=docs.filter("source = 'src1'").select("doc_id"), exclude=docs.filter("lang = 'de'").select("doc_id"))


@query("select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1 having count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.repeated(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), "o_custkey")
