"""Selections: filters, seeded and stratified samples, fingerprints, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import keys, text
from rostrum.operators import events, metrics, selection
from rostrum.operators.selection import Criteria
from rostrum.plans.registry import query
from rostrum.sources.tables import table

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'))"
SELECTED = f"""select doc_id, text, lang, {WORDS}::bigint as n_words from documents d
    where {WORDS} >= 50 and lang in ('en', 'fr') and not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)
    order by md5(doc_id::varchar || 'seed-1'), doc_id limit 40"""


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    rows = Criteria(words_min=50, one_of={"lang": ("en", "fr")}).apply(table(spark, sf_dir, "documents"))
    return selection.seeded_sample(selection.without(rows, toxic, "doc_id"), "doc_id", "seed-1", 40)


@query(f"select doc_id, lang, n_words from ({SELECTED})")
def seeded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir).select("doc_id", "lang", text.words(F.col("text")).cast("long").alias("n_words"))


@query(f"""with s as ({SELECTED}) select count(*) as n,
    sha256('["' || string_agg(doc_id::varchar, '","' order by md5(doc_id::varchar || 'seed-1'), doc_id) || '"]') as ids_sha256,
    sha256(string_agg(doc_id::varchar || '|1|' || md5(text), chr(10) order by md5(doc_id::varchar || 'seed-1'), doc_id)) as lines_sha256 from s""")
def selection_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(keys.seeded(F.col("doc_id"), "seed-1"), "doc_id")
    line = F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("1"), F.md5("text"))
    return selected(spark, sf_dir).agg(
        F.count("*").alias("n"), keys.list_hash(keys.ordered_ids(order, F.col("doc_id").cast("string"))).alias("ids_sha256"), keys.lines_hash(keys.ordered_ids(order, line)).alias("lines_sha256")
    )


@query("""with d as (select * from documents where doc_id not in (select doc_id from labels)),
    p as (select lang, count(*) as n from d group by lang), t as (select sum(n)::bigint as t from p),
    f as (select lang, (n * 60) // t as fl, (n * 60) % t as rest from p, t),
    a as (select lang, fl + case when row_number() over (order by rest desc, lang) <= 60 - sum(fl) over () then 1 else 0 end as al from f),
    r as (select doc_id, lang, row_number() over (partition by lang order by sha256(doc_id::varchar || ':s2'), doc_id) as sample_rank from d)
    select r.doc_id, r.lang, r.sample_rank::bigint as sample_rank from r join a using (lang) where sample_rank <= al""")
def stratified_hamilton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")
    allocation = selection.hamilton(rows.groupBy("lang").agg(F.count("*").alias("n")), "lang", "n", 60)
    return selection.stratified_sample(rows, "doc_id", "lang", allocation, "s2").select("doc_id", "lang", F.col("sample_rank").cast("long").alias("sample_rank"))


@query("""with d as (select doc_id, row_number() over (order by doc_id) as n, count(*) over () as t from documents),
    p as (select distinct round_even(i * (t - 1) / 24.0, 0)::bigint + 1 as n from range(25) r(i), (select count(*) as t from documents))
    select doc_id from d join p using (n)""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.systematic_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25)


@query("""with o as (select o_orderkey, o_orderpriority, row_number() over w as n, count(*) over (partition by o_orderpriority) as t
    from orders window w as (partition by o_orderpriority order by o_orderdate, o_orderkey))
    select o_orderkey, o_orderpriority from o where n = 1 or n = t or n = t // 2 + 1""")
def first_mid_last_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return selection.first_middle_last(rows, "o_orderpriority", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("select doc_id, lang from documents where text ilike '%license%' or text ilike '%copyright%' or text ilike '%idiot%'")
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Criteria(keywords_any=("license", "copyright", "idiot")).apply(table(spark, sf_dir, "documents")).select("doc_id", "lang")


@query("select doc_id, lang from documents where text ilike '%the%' and text ilike '%and%' and text ilike '%stupid%'")
def keyword_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Criteria(keywords_all=("the", "and", "stupid")).apply(table(spark, sf_dir, "documents")).select("doc_id", "lang")


VARIANTS = """select doc_id, case doc_id % 4 when 0 then text when 1 then '' when 2 then '   ' end as c, case when doc_id % 3 = 0 then ' ' else text end as r from documents"""


@query(f"""select doc_id, case when length(c) > 0 then length(trim(c, ' ')) > 0 when length(r) > 0 then length(trim(r, ' ')) > 0 else false end as usable,
    length(coalesce(nullif(c, ''), nullif(r, ''), ''))::bigint as prompt_chars, (4131 + greatest(1, ceil(strlen(coalesce(nullif(c, ''), nullif(r, ''), '')) / 3.0)))::bigint as tokens from ({VARIANTS})""")
def usable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    clean = F.when(m == 0, F.col("text")).when(m == 1, "").when(m == 2, "   ")
    raw = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text"))
    said = text.prompt_text(F.col("c"), F.col("r"))
    rows = table(spark, sf_dir, "documents").select("doc_id", clean.alias("c"), raw.alias("r"))
    return rows.select("doc_id", text.usable(F.col("c"), F.col("r")).alias("usable"), F.length(said).cast("long").alias("prompt_chars"), text.tokens_estimated(said).alias("tokens"))


@query(f"select lang, count(*) as docs, sum({WORDS})::bigint as words, sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))))::bigint as clean_chars from documents group by lang")
def word_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(text.words(c)).alias("words"), F.sum(F.length(text.clean(c))).cast("long").alias("clean_chars"))


@query("""select doc_id, sha256('{"discriminator":"' || lang || '","kind":"speech_fragment","pipeline_version":"1.0.0","sequence_number":' || doc_id || ',"source_file_sha256":"' || sha256(source) || '"}') as key,
    sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') as record_sha256 from documents""")
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.stable_key("speech_fragment", F.sha2("source", 256), F.col("doc_id"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), keys.record_hash("doc_id", "lang", "source").alias("record_sha256"))


@query("""with e as (select case event_id % 7 when 0 then strftime(ts, '%H:%M') when 1 then strftime(ts, '%H:%M:%S') when 2 then 'unknown' when 3 then null when 4 then '25:99' when 5 then '9:15' else '' end as raw from events)
    select case when raw is null or raw in ('', 'unknown') then 'MISSING_OR_UNKNOWN' when regexp_full_match(raw, '([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d') then 'HH:MM:SS'
    when regexp_full_match(raw, '([01]\\d|2[0-3]):[0-5]\\d') then 'HH:MM' else 'MALFORMED' end as kind, count(*) as n from e group by 1""")
def time_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 7
    raw = F.when(m == 0, F.date_format("ts", "HH:mm")).when(m == 1, F.date_format("ts", "HH:mm:ss")).when(m == 2, "unknown").when(m == 4, "25:99").when(m == 5, "9:15").when(m == 6, "")
    return table(spark, sf_dir, "events").groupBy(text.time_class(raw).alias("kind")).agg(F.count("*").alias("n"))


@query("""with e as (select event_id, case event_id % 5 when 0 then null when 1 then '' when 2 then 'many' else json_extract_string(props, '$.k') end as raw from events)
    select event_id, case when raw is null or raw = '' then 'WORDCOUNT_MISSING' when not regexp_full_match(raw, '\\d+') then 'WORDCOUNT_MALFORMED' end as warning from e""")
def int_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 5
    raw = F.when(m == 1, "").when(m == 2, "many").when(m > 2, F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", text.integer_warning(raw, "WORDCOUNT").alias("warning"))


@query("""select doc_id, array_to_string(list_sort(list_distinct(list_filter([case when n_chars > 3000 then 'LONG' end, case when n_chars < 100 then 'SHORT' end,
    case when lang <> 'en' then 'FOREIGN' end, case when text like '%#%' then 'SYMBOLS' end, case when source = 'src1' then 'LONG' end], lambda x: x is not null))), ',') as codes from documents""")
def warning_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lambda c, code: F.when(c, code)
    found = [w(F.col("n_chars") > 3000, "LONG"), w(F.col("n_chars") < 100, "SHORT"), w(F.col("lang") != "en", "FOREIGN"), w(F.col("text").contains("#"), "SYMBOLS"), w(F.col("source") == "src1", "LONG")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.codes(*found), ",").alias("codes"))


@query("select doc_id, count(*) over (partition by text) > 1 as is_duplicate from documents")
def duplicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return events.with_exists(rows, events.repeated(rows, "h"), ["h"], "is_duplicate").select("doc_id", "is_duplicate")


@query("""with a as (select doc_id, source from documents order by md5('s5' || source || doc_id::varchar), doc_id limit 101)
    select doc_id, source from a order by sha256('s5:' || source || ':' || doc_id::varchar), doc_id limit 100""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.two_seeded_samples(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "s5", 101, 100)


@query("select distinct on (o_custkey) o_custkey, o_orderkey, o_orderstatus from orders order by o_custkey, o_orderdate desc, o_orderkey desc")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return events.latest(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""select o_orderkey, o_orderstatus, o_orderpriority from orders order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_orderdate desc nulls last, o_orderkey limit 50 offset 100""")
def paged_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = selection.page(table(spark, sf_dir, "orders"), [rank, F.desc_nulls_last("o_orderdate"), "o_orderkey"], 50, 100)
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""with d as (select lang, case when doc_id % 5 = 0 then 'REFUSAL' else 'PREDICTION' end as o, case when doc_id % 5 = 0 then '' when n_chars > 900 then 'false' else 'true' end as np, case when doc_id % 5 <> 0 and n_chars > 900 then source end as dom from documents)
    select lang, case when o <> 'PREDICTION' then 'UNAVAILABLE' when np = 'true' then 'NON_POLICY' else 'POLICY' end as policy_status, count(*) as n from d group by 1, 2""")
def policy_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused, policy = F.col("doc_id") % 5 == 0, F.col("n_chars") > 900
    status = selection.policy_status(F.when(refused, "REFUSAL").otherwise("PREDICTION"), F.when(refused, "").when(policy, "false").otherwise("true"), F.when(~refused & policy, F.col("source")))
    return table(spark, sf_dir, "documents").groupBy("lang", status.alias("policy_status")).agg(F.count("*").alias("n"))


@query("""with c as (select x as lang, count(d.doc_id) as n from (values ('en'), ('fr'), ('de'), ('es'), ('it')) v(x) left join documents d on d.lang = x group by 1), t as (select sum(n)::bigint as t from c)
    select lang, n, round(n / t, 6) as share from c, t union all select 'TOTAL', t, 1.0 from t""")
def population_share_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return metrics.shares(n, "lang", "n", ["en", "fr", "de", "es", "it"]).withColumn("share", F.round("share", 6))


@query("""with s as (select doc_id, row_number() over (order by sha256(doc_id::varchar || ':s9'), doc_id) as sample_order from documents order by 2 limit 30)
    select count(*) = 30 as size_ok, count(distinct doc_id) = count(*) as unique_ok, min(sample_order) = 1 and max(sample_order) = count(*) and count(distinct sample_order) = count(*) as order_ok from s""")
def sample_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rostrum.operators.ordered import numbered

    sample = selection.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "s9", 30, "sha256")
    placed = numbered(sample, [keys.seeded(F.col("doc_id"), "s9", "sha256"), "doc_id"], "sample_order")
    return selection.sample_holds(placed, "doc_id", "sample_order", 30)


@query("""with d as (select * from documents), l as (select * from labels)
    select case when text is null or trim(text, ' ') = '' then 'NO_USABLE_TEXT' when l.toxic = 1 then 'EXCLUDED_TOXIC' when l.doc_id is not null then 'HUMAN_LABELLED' when n_chars < 200 then 'TOO_SHORT' when n_chars > 8000 then 'TOO_LONG' else 'ELIGIBLE' end as bucket, count(*) as n
    from d left join l using (doc_id) group by 1""")
def exclusion_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    n = F.col("n_chars")
    bucket = (
        F.when(~text.usable(F.col("text"), F.lit(None).cast("string")), "NO_USABLE_TEXT").when(F.col("toxic") == 1, "EXCLUDED_TOXIC").when(F.col("labelled"), "HUMAN_LABELLED")
        .when(n < 200, "TOO_SHORT").when(n > 8000, "TOO_LONG").otherwise("ELIGIBLE")
    )
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
