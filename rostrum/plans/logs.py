"""Queries on event logs, joins and set reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text
from rostrum.operators import checks, events, exports, ordered, reviews
from rostrum.plans.registry import query
from rostrum.sources.tables import table


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 1 when 'click' then 2 else 3 end, ts desc, event_id desc) = 1")
def latest_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return events.latest_by_priority(rows, "user_id", "event_type", ["purchase", "signup", "click"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""select user_id, count(*) filter (where event_type = 'view') as views, count(*) filter (where event_type = 'purchase') as purchases,
    count(*) filter (where event_type = 'error') as errors, count(*) filter (where value > 50) as high, count(distinct event_type) as kinds,
    min(case when event_type = 'error' then event_id end) as first_error from events group by user_id""")
def event_counts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.col("event_type") == k
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind("view")).alias("views"), F.count_if(kind("purchase")).alias("purchases"), F.count_if(kind("error")).alias("errors"), F.count_if(F.col("value") > 50).alias("high"),
        F.countDistinct("event_type").alias("kinds"), F.min(F.when(kind("error"), F.col("event_id"))).alias("first_error"),
    )


@query("""select user_id, coalesce(string_agg(event_id::varchar, ',' order by ts, event_id) filter (where event_type = 'error'), '') as errors,
    coalesce(array_to_string(list(event_id order by event_id) filter (where event_type = 'signup')[1:20], ','), '') as first_signups from events group by user_id""")
def flag_agg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))
    ids = F.transform(F.array_sort(F.collect_list(wanted)), lambda s: s["event_id"].cast("string"))
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    first = reviews.top_per(log.filter("event_type = 'signup'"), "user_id", ["event_id"], 20).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("_first"))
    own = log.groupBy("user_id").agg(F.array_join(ids, ",").alias("errors")).join(first, "user_id", "left")
    return own.select("user_id", "errors", F.coalesce(F.array_join(F.col("_first").cast("array<string>"), ","), F.lit("")).alias("first_signups"))


@query("select c_custkey, exists (select 1 from orders o where o.o_custkey = c_custkey and o_orderstatus = 'P') as has_partial from customer")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return events.with_exists(table(spark, sf_dir, "customer").select("c_custkey"), partial, ["c_custkey"], "has_partial")


@query("select c_custkey from customer where not exists (select 1 from orders o where o.o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'P')")
def not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("select c_custkey from customer where exists (select 1 from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c_custkey and l_returnflag = 'R')")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    chain = table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(chain, "c_custkey", "left_semi").select("c_custkey")


@query("""select event_id, (select max_by(c.event_id, c.ts) from events c where c.user_id = e.user_id and c.event_type = 'click' and c.ts < e.ts) as click_id from events e where event_type = 'purchase'""")
def asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    left, right = rows.filter("event_type = 'purchase'").drop("event_type"), rows.filter("event_type = 'click'").drop("event_type")
    return ordered.asof_before(left, right, "user_id", "ts", "event_id", "click_id").select("event_id", "click_id")


RANGES = "select source, doc_id // 500 as chunk, (doc_id // 500) * 500 + 50 as lo, (doc_id // 500) * 500 + 350 as hi from documents group by all"


@query(f"select d.doc_id, r.chunk::bigint as chunk from documents d join ({RANGES}) r on d.source = r.source and d.doc_id between r.lo and r.hi")
def range_join_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunk = table(spark, sf_dir, "documents").select("doc_id", "source"), F.floor(F.col("doc_id") / 500)
    ranges = docs.select("source", chunk.alias("chunk")).distinct().withColumns({"lo": F.col("chunk") * 500 + 50, "hi": F.col("chunk") * 500 + 350})
    return ordered.range_join(docs, ranges, "source", "doc_id", "lo", "hi", 1000).select("doc_id", F.col("chunk").cast("long").alias("chunk"))


@query("""with g as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id) as grp from events)
    select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as major,
    last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id, grp order by ts, event_id rows unbounded preceding) as minor from g""")
def forward_fill_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = ordered.with_headings(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind == "signup", kind == "purchase", F.col("event_id"))
    return rows.select("event_id", "major", "minor")


@query("""with b as (select *, case when event_type <> 'error' then case when lag(event_type) over w is null then 'FILE_START' when lag(event_type) over w = 'error' then 'ERROR_BOUNDARY' end end as reason from events window w as (partition by user_id order by ts, event_id))
    select event_id, reason as boundary_reason, sum((reason is not null)::int) over (partition by user_id order by ts, event_id)::bigint as segment from b""")
def boundary_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.with_boundaries(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type"), F.col("event_type") != "error")
    return rows.select("event_id", "boundary_reason", F.col("segment").cast("long").alias("segment"))


STATE_SQL = "lag(event_type) over (partition by user_id order by ts, event_id)"


@query(f"""with m as (select user_id, {STATE_SQL} as from_state, event_type from events)
    select from_state, event_type, (from_state, event_type) in (('view', 'click'), ('click', 'purchase'), ('signup', 'view')) as allowed, count(*) as n from m where from_state is not null and from_state <> event_type group by all""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = [("view", "click"), ("click", "purchase"), ("signup", "view")]
    moves = events.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", allowed)
    return moves.groupBy("from_state", "event_type", "allowed").agg(F.count("*").alias("n"))


@query("""with e as (select c_custkey as k from customer where c_custkey % 3 <> 0), c as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), r as (select o_custkey as k from orders where o_orderstatus = 'P' group by 1 having count(*) > 1),
    t as (select distinct o_custkey as k from orders where o_orderstatus = 'P'), a as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'),
    k as (select k, bool_or(s = 'e') as e, bool_or(s = 'c') as c, bool_or(s = 't') as t, bool_or(s = 'a') as a from (select k, 'e' as s from e union all select k, 'c' from c union all select k, 't' from t union all select k, 'a' from a) group by k)
    select count(*) filter (where e) as n_eligible, count(*) filter (where c) as n_completed, count(*) filter (where t) as n_terminal, count(*) filter (where a) as n_active,
    count(*) filter (where c::int + t::int + a::int > 1) as n_overlapping, count(*) filter (where not e and (c or t or a)) as n_outside, (select count(*) from r) as n_repeated,
    count(*) filter (where e and not (c or t or a)) as n_remaining from k""")
def set_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_custkey").alias("k")
    eligible = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    pick = lambda c: orders.filter(c).select(key).distinct()
    return events.reconcile(eligible, pick("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'P'").select(key), pick("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'"), "k")


@query("""select count(*) filter (where c is not null and o is not null) as n_both, count(*) filter (where o is null) as n_left_only, count(*) filter (where c is null) as n_right_only
    from (select c_custkey as c from customer where c_custkey % 2 = 0) full join (select distinct o_custkey as o from orders) on c = o""")
def matched_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return events.matched(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""select 'PREDICTION' as outcome, doc_id, lang, null::integer as toxic from documents where n_chars > 2000 union all select 'FAILURE', doc_id, null, toxic from labels where quality = 0""")
def union_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = table(spark, sf_dir, "documents").filter("n_chars > 2000").select("doc_id", "lang")
    return events.outcomes(predictions, table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", "toxic")).select("outcome", "doc_id", "lang", "toxic")


@query("""with o as (select user_id, event_id, event_type as status, value from events where event_type in ('view', 'error') qualify row_number() over (partition by user_id order by event_id) = 1),
    a as (select user_id, max_by(value, event_id) as nv, max_by(event_id, event_id) as ne from events where event_type = 'purchase' group by user_id)
    select user_id, coalesce(ne, event_id) as event_id, round(coalesce(nv, value), 6) as value, ne is not null as recovered from o left join a using (user_id)""")
def recovery_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    first = rows.filter("event_type in ('view', 'error')").groupBy("user_id").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("s")).select("user_id", "s.*")
    attempts = rows.withColumn("status", F.when(F.col("event_type") == "purchase", "success").otherwise("failed")).withColumn("attempt", F.col("event_id"))
    out = events.overlay(first, attempts, "user_id", "attempt", "status", ["event_id", "value"])
    return out.select("user_id", "event_id", F.round("value", 6).alias("value"), "recovered")


@query("""with p as (select o_orderkey as k from orders where o_orderkey % 10 = 0), r as (select event_id as i, event_id % 20000 as k, event_type as t from events where event_id % 5 = 0),
    n as (select *, row_number() over (partition by k order by i) as n from r)
    select case when p.k is null then 'unknown_key' when n.k is null then 'missing' when n > 1 then 'duplicate' when t = 'error' then 'provider_failure' when t in ('view', 'click') then 'success' else 'invalid' end as status, count(*) as n
    from p full join n using (k) group by 1""")
def batch_response_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("k"))
    said = table(spark, sf_dir, "events").filter("event_id % 5 = 0").select(F.col("event_id").alias("i"), (F.col("event_id") % 20000).alias("k"), F.col("event_type").alias("t"))
    rows = events.responses(plan, said, "k", "i", F.col("t").isin("view", "click"), F.col("t") == "error")
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("""with s as (select user_id, event_id, ts, md5((value > 50)::varchar || event_type) as h, case when event_type = 'purchase' then 'submitted' else 'draft' end as st from events),
    l as (select *, lag(h) over (partition by user_id order by ts, event_id) as p from s),
    k as (select * from l where not coalesce(p = h and st = 'draft', false))
    select event_id, row_number() over (partition by user_id order by ts, event_id)::bigint as revision from k""")
def revision_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(F.concat((F.col("value") > 50).cast("string"), "event_type"))
    saves = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", digest.alias("h"), F.when(F.col("event_type") == "purchase", "submitted").otherwise("draft").alias("st"))
    return events.revisions(saves, "user_id", ["ts", "event_id"], "h", "st").select("event_id", F.col("revision").cast("long").alias("revision"))


@query("""select a.doc_id from (select doc_id, md5(text) as h from documents where doc_id % 2 = 0) a join (select doc_id, md5(text || case when doc_id % 6 = 0 then 'x' else '' end) as h from documents) b using (doc_id) where a.h <> b.h""")
def load_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    loaded = docs.filter("doc_id % 2 = 0").select("doc_id", F.md5("text").alias("h"))
    incoming = docs.select("doc_id", F.md5(F.concat("text", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(""))).alias("h"))
    return events.conflicts(loaded, incoming, "doc_id", "h")


@query("""with y as (select year(o_orderdate)::bigint as year, count(o_orderkey) as orders from orders group by 1),
    l as (select year(l_shipdate)::bigint as year, count(*) as items from lineitem group by 1), e as (select year(ts)::bigint as year, count(*) as events from events group by 1)
    select year, orders, coalesce(items, 0) as items, coalesce(events, 0) as events from y left join l using (year) left join e using (year)""")
def year_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = lambda t, c: table(spark, sf_dir, t).withColumn("year", F.year(c).cast("long"))
    orders = dated("orders", "o_orderdate")
    return checks.year_summary(orders.groupBy("year").agg(F.count("o_orderkey").alias("orders")), (dated("lineitem", "l_shipdate"), "l_orderkey", "items"), (dated("events", "ts"), "event_id", "events"))


@query("""with recursive n as (select 'n' || n_nationkey as id, n_name as name, 'r' || n_regionkey as parent from nation union all select 'r' || r_regionkey, r_name, null from region),
    up as (select id, id as ancestor, parent, 0::bigint as depth from n union all select u.id, n.id, n.parent, u.depth + 1 from up u join n on n.id = u.parent)
    select id, ancestor, depth from up""")
def recursive_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("_nation")
    table(spark, sf_dir, "region").createOrReplaceTempView("_region")
    return spark.sql("""with recursive n as (select concat('n', n_nationkey) as id, concat('r', n_regionkey) as parent from _nation union all select concat('r', r_regionkey), cast(null as string) from _region),
        up as (select id, id as ancestor, parent, cast(0 as bigint) as depth from n union all select u.id, n.id, n.parent, u.depth + 1 from up u join n on n.id = u.parent)
        select id, ancestor, depth from up""")


PREDICTED = "select doc_id as turn_key, event_id as prediction_id, user_id as run_id from events join documents on doc_id = event_id % 1500"


@query(f"""with p as ({PREDICTED}), f as (select *, count(*) over (partition by turn_key) as n, row_number() over (partition by turn_key order by run_id, prediction_id) as k from p),
    r as (select event_id % 7000 as prediction_id, max_by(event_type, (ts, event_id)) as review_status from events group by 1)
    select d.doc_id as turn_key, d.lang, l.quality, f.prediction_id, r.review_status, coalesce(f.n, 0) as n_predictions
    from documents d left join labels l on l.doc_id = d.doc_id left join (select * from f where k = 1) f on f.turn_key = d.doc_id left join r on r.prediction_id = f.prediction_id""")
def canonical_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("turn_key"), "lang")
    first = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("turn_key"), "quality")
    log = table(spark, sf_dir, "events")
    predictions = log.select((F.col("event_id") % 1500).alias("turn_key"), F.col("event_id").alias("prediction_id"), F.col("user_id").alias("run_id")).join(turns.select("turn_key"), "turn_key", "left_semi")
    reviews = log.select((F.col("event_id") % 7000).alias("prediction_id"), F.col("event_type").alias("review_status"), F.col("ts").alias("reviewed_at"), F.col("event_id").alias("review_id"))
    return exports.canonical(turns, first, predictions, reviews).select("turn_key", "lang", "quality", "prediction_id", "review_status", "n_predictions")


@query("""select event_id, coalesce(value::decimal(18, 2)::varchar, '') as value, case when event_type = 'error' then 'unknown' when value > 50 then 'true' else 'false' end as high, case when event_type = 'view' then '' else event_type || ' | ' || user_id end as tags from events""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("event_type") != "view", F.array("event_type", F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("decimal(18,2)").alias("value"), F.when(F.col("event_type") != "error", F.col("value") > 50).alias("high"), tags.alias("tags"))
    return rows.select("event_id", text.csv_cell(F.col("value"), "decimal").alias("value"), text.yes_no_unknown(F.col("high")).alias("high"), text.csv_cell(F.col("tags"), "array<string>").alias("tags"))
