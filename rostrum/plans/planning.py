"""Campaigns from plan to artifact: preflight, merged chunks, hashes of long lists, stored configurations, typed loads, lateral rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.operators import preflight, selection, streams
from rostrum.plans.registry import query
from rostrum.sources import typed
from rostrum.sources.tables import table


@query("""with recursive e as (select doc_id, 4131 + greatest(1, ceil(strlen(text) / 3.0))::bigint as t from documents where lang <> 'de'), c as (select doc_id from labels where quality = 1), x as (select doc_id from labels where toxic = 1), a as (select doc_id from documents where doc_id % 7 = 0),
    i as (select doc_id from e union select doc_id from c union select doc_id from x union select doc_id from a),
    f as (select i.doc_id, i.doc_id in (select doc_id from e) as e, i.doc_id in (select doc_id from c) as c, i.doc_id in (select doc_id from x) as x, i.doc_id in (select doc_id from a) as a from i),
    n as (select count(*) filter (where e) as n_eligible, count(*) filter (where c) as n_completed, count(*) filter (where x) as n_terminal, count(*) filter (where a) as n_active, count(*) filter (where c::int + x::int + a::int > 1) as n_overlapping,
        count(*) filter (where not e) as n_outside, 0::bigint as n_repeated, count(*) filter (where e and not (c or x or a)) as n_remaining from f),
    d as (select doc_id, t, row_number() over (order by sha256(doc_id::varchar || ':seed'), doc_id::varchar) as n from e join f using (doc_id) where not (f.c or f.x or f.a)),
    p as (select doc_id, n, t, 1::bigint as chunk, 1::bigint as k, t as used from d where n = 1
        union all select d.doc_id, d.n, d.t, case when p.k + 1 > 20 or p.used + d.t > 60000 then p.chunk + 1 else p.chunk end, case when p.k + 1 > 20 or p.used + d.t > 60000 then 1 else p.k + 1 end, case when p.k + 1 > 20 or p.used + d.t > 60000 then d.t else p.used + d.t end from p join d on d.n = p.n + 1),
    s as (select chunk, sum(t) as t, count(*) as r from p group by 1), t as (select count(*) as n_chunks, coalesce(max(t), 0)::bigint as most_chunk_tokens, coalesce(sum(t), 0)::bigint as input_tokens, coalesce(sum(r), 0)::bigint as r from s),
    h as (select sha256('[' || coalesce(string_agg('"' || doc_id || '"', ',' order by n), '') || ']') as remaining_sha256 from d)
    select n.*, n_chunks, most_chunk_tokens, input_tokens, remaining_sha256, floor(r * 5000 / 1000.0)::bigint as output_tokens, ((input_tokens * 0.15 + floor(r * 5000 / 1000.0) * 1.25) / 1000000)::decimal(18, 6) as estimated_cost, 10000 + most_chunk_tokens <= 60000 as quota_fits from n, t, h""")
def preflight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.filter("lang <> 'de'").select("doc_id", (F.lit(4131) + F.greatest(F.lit(1), F.ceil(F.octet_length("text") / 3))).cast("long").alias("tokens"))
    return preflight.preflight(
        rows, labels.filter("quality = 1"), labels.filter("toxic = 1"), docs.filter("doc_id % 7 = 0"), "doc_id", "tokens",
        seed="seed", most_records=20, ceiling=60_000, active_tokens=10_000, unknown_jobs=0, pilot=(5000, 1000), prices=(0.15, 1.25),
    )


@query("""select count(*) as n, sha256('[' || string_agg('"' || event_id || '"', ',' order by ts, event_id) || ']') as sha256 from events""")
def record_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.list_hash(table(spark, sf_dir, "events"), ["ts", "event_id"], F.col("event_id"))


# Chunks of 50 documents; some records have no row, two, or one in another chunk, and some rows are of no record.
ARTIFACT = """select doc_id, doc_id // 50 as chunk, case doc_id % 5 when 0 then 'structurally_repaired' when 1 then 'provider_refused' else 'original_valid' end as state, n_chars as tokens from documents where doc_id % 31 <> 0
    union all select doc_id, doc_id // 50, 'unresolved_invalid', n_chars from documents where doc_id % 37 = 0 union all select doc_id, doc_id // 50 + 1, 'original_valid', n_chars from documents where doc_id % 41 = 0 union all select -doc_id - 1, 0, 'original_valid', 0 from documents where doc_id % 43 = 0"""
MERGED = f"""with a as ({ARTIFACT}), g as (select doc_id, chunk, count(*) as n_rows, min(struct_pack(state, tokens)) as r from a group by all), p as (select doc_id, doc_id // 50 as chunk, row_number() over (order by sha256(doc_id::varchar || ':plan'), doc_id) as ordinal from documents),
    m as (select coalesce(p.doc_id, g.doc_id) as doc_id, coalesce(p.chunk, g.chunk) as chunk, ordinal, coalesce(n_rows, 0) as n_rows, case when n_rows is null then 'missing' else r.state end as state, r.tokens as tokens from p full join g on p.doc_id = g.doc_id and p.chunk = g.chunk)"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    i, chunk = F.col("doc_id"), F.floor(F.col("doc_id") / 50)
    row = lambda d, c, state, n=F.col("n_chars").cast("long"), k=i: d.select(k.alias("doc_id"), c.alias("chunk"), state.alias("state"), n.alias("tokens"))
    state = F.when(i % 5 == 0, "structurally_repaired").when(i % 5 == 1, "provider_refused").otherwise("original_valid")
    valid = F.lit("original_valid")
    artifact = row(docs.filter("doc_id % 31 <> 0"), chunk, state).unionByName(row(docs.filter("doc_id % 37 = 0"), chunk, F.lit("unresolved_invalid"))).unionByName(row(docs.filter("doc_id % 41 = 0"), chunk + 1, valid))
    artifact = artifact.unionByName(row(docs.filter("doc_id % 43 = 0"), F.lit(0).cast("long"), valid, F.lit(0).cast("long"), -i - 1))
    from rostrum.functions import keys
    from rostrum.operators.ordered import numbered

    plan = numbered(docs.select("doc_id", keys.seeded(i, "plan", "sha256").alias("o")), ["o", "doc_id"], "ordinal").select("doc_id", chunk.alias("chunk"), "ordinal")
    return streams.merged(plan, artifact, "doc_id", "chunk", "ordinal", "state")


@query(MERGED + " select doc_id, chunk, ordinal, n_rows, state, tokens::bigint as tokens from m")
def merged_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)


@query(MERGED + f""", c as (select count(ordinal) as planned, {", ".join(f"count(*) filter (where ordinal is not null and state = '{s}') as {s}" for s in streams.STATES)}, sum(case when ordinal is null then n_rows else greatest(n_rows - 1, 0) end)::bigint as duplicate,
    sha256('[' || string_agg(case when ordinal is not null then '"' || doc_id || '"' end, ',' order by ordinal) || ']') as record_set_sha256 from m)
    select *, planned = {" + ".join(streams.STATES)} and duplicate = 0 as accounted, false as complete from c""")
def merge_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.accounts(merged(spark, sf_dir), "doc_id", "ordinal", "state", "0" * 64)


# Stored configurations with nested objects, lists in another order, numbers written in two ways, nulls and missing fields.
CONFIG = """'{"thinking":{"budget":' || case when event_id % 3 = 0 then '0' when event_id % 3 = 1 then '0.0' else 'null' end || ',"levels":' || case when event_id % 4 = 0 then '["low","high"]' when event_id % 4 = 1 then '["high","mid","low"]' when event_id % 4 = 2 then '["high",["low"]]' else '[]' end || '}'
    || case when event_id % 5 = 0 then '' else ',"mode":"' || event_type || '"' end || ',"runs":[{"k":' || event_id % 7 || ',"ok":true},{"k":' || event_id % 11 || '}]}'"""


@query(f"""with c as (select event_id, {CONFIG} as j from events), f as (select event_id, json_extract(j, '$.thinking.levels') as l, j ->> '$.thinking.budget' as b, json_type(j, '$.thinking.budget') as t, j ->> '$.mode' as m, (j ->> '$.runs[0].k')::int as k0, (j ->> '$.runs[1].k')::int as k1 from c)
    select event_id, t <> 'NULL' and b::double = 0 as no_thinking, coalesce(list_contains(l ->> '$[*]', 'high') and list_contains(l ->> '$[*]', 'low'), false) as both_levels, t = 'NULL' and coalesce(m = 'click', false) as null_budget, (k0 = 3 or k1 = 3) and k0 = 5 as two_runs, true as nothing_wanted from f""")
def configuration_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {
        "no_thinking": {"thinking": {"budget": 0}}, "both_levels": {"thinking": {"levels": ["low", "high", "low"]}}, "null_budget": {"mode": "click", "thinking": {"budget": None}},
        "two_runs": {"runs": [{"k": 3}, {"k": 5, "ok": True}]}, "nothing_wanted": {},
    }
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.expr(CONFIG)).alias("c"))
    return rows.select("event_id", *[selection.json_contains(F.col("c"), w).alias(n) for n, w in wanted.items()])


@query("""select c_custkey, o_orderkey, coalesce(n, 0) as n from customer left join (select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, count(*) as n from orders where o_orderstatus <> 'P' group by 1) on o_custkey = c_custkey""")
def lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the latest of its orders that are settled, the one of the largest key among those of one day, and how many there are:
    a lateral row with a count of its siblings.  Several rows are no error; one is taken, and the count says so."""
    own = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").filter(F.col("c_custkey").outer() == F.col("o_custkey"))
    last = own.select("o_orderkey", F.row_number().over(W.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("_n"), F.count("*").over(W.partitionBy()).alias("n")).filter(F.col("_n") == 1)
    rows = table(spark, sf_dir, "customer").select("c_custkey").lateralJoin(last, F.lit(True), "left")
    return rows.select("c_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


# Orders as strings with cells that don't fit.
CELLS = {
    "key": "cast(o_orderkey as string)", "customer": "case when o_orderkey % 10 = 3 then '' when o_orderkey % 17 = 0 then concat('9', cast(100000000 + o_custkey as string)) else cast(o_custkey as string) end",
    "day": "case when o_orderkey % 13 = 0 then '1995-02-30' else cast(o_orderdate as string) end", "price": "case when o_orderkey % 11 = 0 then 'n/a' else cast(o_orderkey % 1000 as string) end", "final": "case when o_orderkey % 7 = 0 then 'perhaps' when o_orderkey % 7 = 1 then '' else 'true' end",
}
CAST = "with s as (select " + ", ".join(f"{e} as {c}" for c, e in CELLS.items()).replace("as string", "as varchar") + " from orders)"


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(*[F.expr(e).alias(c) for c, e in CELLS.items()])
    return typed.typed(rows, {"key": "bigint", "customer": "bigint", "day": "date", "price": "double", "final": "boolean"}, required=("final",))


@query(CAST + """, b as (select key::bigint as key, unnest([case when try_cast(day as date) is null then {'c': 'day', 'v': day, 'r': 'NOT_DATE'} end, case when try_cast(price as double) is null then {'c': 'price', 'v': price, 'r': 'NOT_DOUBLE'} end,
    case when final = 'perhaps' then {'c': 'final', 'v': final, 'r': 'NOT_BOOLEAN'} when final = '' then {'c': 'final', 'v': final, 'r': 'REQUIRED'} end]) as x from s) select key, x.c as "column", x.v as value, x.r as reason from b where x is not null""")
def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.ledger(loaded(spark, sf_dir), "key")


@query(CAST + """, t as (select key, try_cast(nullif(customer, '') as bigint) as customer, (try_cast(day as date) is null)::int + (try_cast(price as double) is null)::int + (final <> 'true')::int as bad from s), f as (select *, case when customer is not null then customer in (select c_custkey from customer where c_custkey % 3 <> 0) end as found from t)
    select count(*) as n_read, count(*) filter (where bad = 0 and coalesce(found, true)) as n_loaded, count(*) filter (where bad > 0) as n_bad_rows, sum(bad)::bigint as n_bad_cells, count(*) filter (where found) as customer_resolved, count(*) filter (where not found) as customer_unresolved, count(*) filter (where found is null) as customer_absent from f""")
def load_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed.resolved(loaded(spark, sf_dir), {"customer": (table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0"), "c_custkey")})
    return typed.accounts(rows, ["customer"])
