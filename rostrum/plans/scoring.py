"""Queries that score labels, account for costs and plan campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text
from rostrum.operators import chunking, evidence, metrics, rules
from rostrum.plans.registry import query
from rostrum.sources.tables import table

LANGS = ["de", "en", "es", "fr", "it"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


SCORES = """round(case when tp + fp = 0 then 0.0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0.0 else tp / (tp + fn) end, 6) as recall,
    round(case when 2 * tp + fp + fn = 0 or tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end, 6) as f1"""
JOINED = "labels join documents using (doc_id)"


@query(f"""with b as (select count(*) filter (where q and s) as tp, count(*) filter (where not q and s) as fp, count(*) filter (where q and not s) as fn, count(*) filter (where not q and not s) as tn
    from (select quality = 1 as q, n_chars > 1000 as s from {JOINED})) select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, {SCORES} from b""")
def binary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary(labelled(spark, sf_dir), F.col("quality") == 1, F.col("n_chars") > 1000), "accuracy", "precision", "recall", "f1")


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 7 == 0, "en").when(F.col("doc_id") % 11 != 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth"), said.alias("said"))


GUESSED = "select doc_id, lang as truth, coalesce(case when doc_id % 7 = 0 then 'en' when doc_id % 11 <> 0 then lang end, '__NONE__') as said from documents"
GRID = "(values ('de'), ('en'), ('es'), ('fr'), ('it')) t(truth)"


@query(f"select g.truth, s.said, (select count(*) from ({GUESSED}) d where d.truth = g.truth and d.said = s.said) as n from {GRID.replace('t(truth)', 'g(truth)')}, (values ('de'), ('en'), ('es'), ('fr'), ('it'), ('__NONE__')) s(said)")
def multiclass_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(guessed(spark, sf_dir), "truth", "said", LANGS)


PER_CLASS = f"""select g.truth as class, (select count(*) from d where d.truth = g.truth) as support, (select count(*) from d where d.truth = g.truth and d.said = g.truth) as tp,
    (select count(*) from d where d.truth <> g.truth and d.said = g.truth) as fp, (select count(*) from d where d.truth = g.truth and d.said <> g.truth) as fn from {GRID.replace('t(truth)', 'g(truth)')}"""


@query(f"with d as ({GUESSED}), c as ({PER_CLASS}) select class, support, tp, fp, fn, {SCORES} from c")
def per_class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_class(guessed(spark, sf_dir), "truth", "said", LANGS), "precision", "recall", "f1")


@query(f"with d as ({GUESSED}), c as ({PER_CLASS}) select round(sum(case when tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end) / 5, 6) as macro_f1 from c")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.macro_f1(guessed(spark, sf_dir), "truth", "said", LANGS), "macro_f1")


PRESENT = f"select case when toxic = 1 then 'YES' when quality = 0 then 'UNSURE' else 'NO' end as t, case when n_chars % 3 = 0 then 'YES' when n_chars % 3 = 1 then 'NO' else 'UNSURE' end as s from {JOINED}"


@query(f"""with b as (select count(*) filter (where t = 'YES' and s = 'YES') as tp, count(*) filter (where t <> 'YES' and s = 'YES') as fp, count(*) filter (where t = 'YES' and s <> 'YES') as fn,
    count(*) filter (where t <> 'YES' and s <> 'YES') as tn, count(*) filter (where t = s) as same, count(*) as n from ({PRESENT})) select tp, fp, fn, tn, n, round(same / n, 6) as accuracy, {SCORES} from b""")
def presence_target_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("n_chars") % 3
    truth = F.when(F.col("toxic") == 1, "YES").when(F.col("quality") == 0, "UNSURE").otherwise("NO")
    return rounded(metrics.presence(labelled(spark, sf_dir), truth, F.when(m == 0, "YES").when(m == 1, "NO").otherwise("UNSURE")), "accuracy", "precision", "recall", "f1")


@query(f"select t || '->' || s as category, count(*) as n from ({PRESENT}) group by 1")
def transition_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("n_chars") % 3
    truth = F.when(F.col("toxic") == 1, "YES").when(F.col("quality") == 0, "UNSURE").otherwise("NO")
    said = F.when(m == 0, "YES").when(m == 1, "NO").otherwise("UNSURE")
    return labelled(spark, sf_dir).groupBy(metrics.transition(truth, said).alias("category")).agg(F.count("*").alias("n"))


@query(f"""with p as (select quality as t, (n_chars > 800)::int as a, (n_chars % 2)::int as b from {JOINED})
    select case when a = t and b = t then 'both_correct' when a = t then 'only_a_correct' when b = t then 'only_b_correct' when a = b then 'both_wrong_same' else 'both_wrong_different' end as category, count(*) as n from p group by 1""")
def pairwise_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = metrics.pair_category(F.col("quality"), (F.col("n_chars") > 800).cast("int"), (F.col("n_chars") % 2).cast("int"))
    return labelled(spark, sf_dir).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


RUNS = "select l_suppkey as run, count(*) as q, sum(l_quantity)::bigint as c from lineitem group by 1"


@query(f"with r as ({RUNS}) select run, exists (select 1 from r o where o.q >= r.q and o.c <= r.c and (o.q > r.q or o.c < r.c)) as dominated from r")
def pareto_dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.count("*").alias("q"), F.sum("l_quantity").cast("long").alias("c"))
    return metrics.dominated(runs, "run", "q", "c").select("run", "dominated")


@query("""with m as (select user_id, count(*) as n, count(*) filter (where event_type <> 'error') as ok, count(*) filter (where event_type = 'purchase') as p from events group by 1)
    select user_id, round(ok / n, 6) as coverage, ok / n >= 0.75 and p / n >= 0.1 and n <= 100 as passed from m""")
def reliability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.count("*")
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("n"), metrics.ratio(F.count_if(kind != "error"), n).alias("coverage"), metrics.ratio(F.count_if(kind == "purchase"), n).alias("share"))
    passed = metrics.gate({"coverage": F.col("coverage"), "share": F.col("share"), "n": F.col("n")}, {"coverage": 0.75, "share": 0.1}, {"n": 100})
    return m.select("user_id", F.round("coverage", 6).alias("coverage"), passed.alias("passed"))


@query("""with r as (select case when doc_id % 9 = 0 then 'failed' else 'success' end as status, n_chars as i, n_chars // 4 as ca, n_chars % 50 as o, n_chars % 7 as re from documents),
    s as (select count(*) as attempted, count(*) filter (where status = 'success') as valid, sum(i)::bigint as input_tokens, sum(ca)::bigint as cached_tokens, sum(o)::bigint as output_tokens, sum(re)::bigint as reasoning_tokens from r)
    select *, round(((input_tokens - cached_tokens) * 1.25 + cached_tokens * 0.125 + (output_tokens + reasoning_tokens) * 10.0) / 1000000.0, 6)::double as cost from s""")
def cost_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 9 == 0, "failed").otherwise("success").alias("status"), n.alias("input_tokens"), F.floor(n / 4).alias("cached_tokens"), (n % 50).alias("output_tokens"), (n % 7).alias("reasoning_tokens")
    )
    return metrics.costs(rows, {"input": 1.25, "cached": 0.125, "output": 10.0}).drop("per_attempted", "per_valid").withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@query("""select o_orderpriority, sum(case o_orderstatus when 'F' then o_custkey % 700 when 'P' then 0 else greatest(o_orderkey % 900, o_custkey % 700) end)::double as spend from orders group by 1""")
def committed_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COLLECTED").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SUBMITTED")
    spend = metrics.committed(status, (F.col("o_orderkey") % 900).cast("decimal(18,8)"), (F.col("o_custkey") % 700).cast("decimal(18,8)"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum(spend).cast("double").alias("spend"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by all), t as (select *, max(n) over (partition by user_id) as m from c)
    select user_id, case when count(*) = 1 then min(event_type) else 'mixed' end as mode, max(m) as n from t where n = m group by 1""")
def issue_mode_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.modes(table(spark, sf_dir, "events"), "user_id", "event_type")


PACKED = """with recursive d as (select source, doc_id, 4131 + greatest(1, ceil(strlen(text) / 3.0))::bigint as t, row_number() over (partition by source order by doc_id) as n from documents),
    p as (select source, doc_id, n, t, 1::bigint as chunk_number, 1::bigint as k, t as used from d where n = 1
    union all select d.source, d.doc_id, d.n, d.t, case when p.k + 1 > 20 or p.used + d.t > 60000 then p.chunk_number + 1 else p.chunk_number end,
    case when p.k + 1 > 20 or p.used + d.t > 60000 then 1 else p.k + 1 end, case when p.k + 1 > 20 or p.used + d.t > 60000 then d.t else p.used + d.t end from p join d on d.source = p.source and d.n = p.n + 1)
    select doc_id, chunk_number from p"""


@query(PACKED)
def bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", text.tokens_estimated(F.col("text")).alias("tokens"))
    return chunking.greedy_chunks(rows, "source", "doc_id", "tokens", 20, 60_000).select("doc_id", "chunk_number")


LABEL = """select doc_id, quality = 0 as np, case when quality = 1 then 'D' || (doc_id % 6) end as p, [x for x in ['D' || (doc_id % 4), 'D' || (doc_id % 5)] if doc_id % 3 <> 0] as s from labels"""
ERROR = """case when p is not null and p not in ('D0', 'D1', 'D2', 'D3', 'D4') then 'PRIMARY_UNKNOWN' when len(list_distinct(s)) < len(s) then 'SECONDARY_REPEATED' when list_contains(s, 'D4') then 'SECONDARY_UNKNOWN'
    when np and (p is not null or len(s) > 0) then 'NON_POLICY_WITH_DOMAIN' when not np and p is null then 'POLICY_WITHOUT_DOMAIN' when list_contains(s, p) then 'PRIMARY_IN_SECONDARY' end"""


def label(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda m: F.concat(F.lit("D"), (F.col("doc_id") % m).cast("string"))
    second = F.when(F.col("doc_id") % 3 != 0, F.array(code(4), code(5))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("np"), F.when(F.col("quality") == 1, code(6)).alias("p"), second.alias("s"), F.lit("because").alias("r"))


CODES = dict(codes=["D0", "D1", "D2", "D3", "D4"], never_second=("D4",))


@query(f"select doc_id, {ERROR} as error from ({LABEL})")
def prediction_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = [F.col(c) for c in ("np", "p", "s", "r")]
    return label(spark, sf_dir).select("doc_id", rules.prediction_error(*args, **CODES).alias("error"))


@query(f"""with l as ({LABEL}), e as (select *, {ERROR} as e1 from l), w as (select doc_id, np, p, list_filter(s, lambda x: x <> p) as s, s as old, e1 from e)
    select doc_id, array_to_string(case when e1 = 'PRIMARY_IN_SECONDARY' then s else old end, ',') as secondary, coalesce(e1 = 'PRIMARY_IN_SECONDARY', false) as repaired from w""")
def structural_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = [F.col(c) for c in ("np", "p", "s", "r")]
    rows = label(spark, sf_dir).withColumn("fixed", rules.repaired_secondary(*args, **CODES))
    return rows.select("doc_id", F.array_join("fixed", ",").alias("secondary"), (F.col("fixed") != F.col("s")).alias("repaired"))


@query("""with l as (select doc_id, case when doc_id % 13 = 0 then '' when quality = 0 then 'unclear' else 'policy' end as status, case when doc_id % 4 <> 0 then source end as domain, lang as note from labels join documents using (doc_id))
    select doc_id, array_to_string(list_sort(list_filter([case when status = '' then 'status:REQUIRED' end, case when coalesce(domain, '') <> '' and domain not in ('src0', 'src1', 'src2', 'src3', 'src5', 'src6', 'src7') then 'domain:UNKNOWN_CODE' end,
    case when coalesce(domain, '') <> '' and status <> 'policy' then 'domain:MUST_BE_EMPTY' end, case when coalesce(domain, '') = '' and status = 'policy' then 'domain:REQUIRED' end, case when note = domain then 'note:SAME_AS_OTHER' end], lambda x: x is not null)), ',') as errors from l""")
def rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = rules.Schema((
        rules.Field("status", codes=("policy", "unclear"), required=True),
        rules.Field("domain", codes=tuple(f"src{k}" for k in range(8)), excluded=("src4",), null_unless={"field_equals": ["status", "policy"]}, required_when={"all": [{"field_equals": ["status", "policy"]}]}),
        rules.Field("note", different_from="domain"),
    ))
    status = F.when(F.col("doc_id") % 13 == 0, "").when(F.col("quality") == 0, "unclear").otherwise("policy")
    rows = labelled(spark, sf_dir).select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("domain"), F.col("lang").alias("note"))
    return rows.select("doc_id", F.array_join(schema.errors(), ",").alias("errors"))


@query("""with q as (select doc_id, coalesce(text, '') as t, substr(coalesce(text, ''), 5 + doc_id % 50, 6) || case when doc_id % 3 = 0 then '~' else '' end as quote from documents)
    select doc_id, case when quote = '' then 0 else ((length(t) - length(replace(t, quote, ''))) // length(quote))::bigint end as hits from q""")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as they stand, in all texts."""
    t = F.coalesce("text", F.lit(""))
    quote = F.concat(F.substring(t, (F.col("doc_id") % 50 + 5).cast("int"), F.lit(6)), F.when(F.col("doc_id") % 3 == 0, "~").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.exact_hits(t, quote).alias("hits"))


@query()
def evidence_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents, four quotes from a hashed place: as it stands, with other quotes, dashes and white space, from the start,
    and one that does not stand in the text.  SQL can't keep the offsets, so this has none."""
    t = F.coalesce("text", F.lit(""))
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(t) - 40, F.lit(1))).cast("int") + 1
    taken = F.substring(t, place, F.lit(40))
    other = F.regexp_replace(F.translate(taken, "'\"-\u2019\u201c\u2013", "\u2019\u201d\u2014`\"-"), r"(?U)\s+", " \n\u00a0")
    quotes = F.array(taken, other, F.substring(t, 1, 40), F.concat(taken, F.lit("~no such words~")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(quotes).alias("quote_no", "quote"))
    return evidence.located(rows, "text", "quote").select("doc_id", "quote_no", "quote", "status", "start_offset", "end_offset")


@query("""with c as (select event_id % 40 as campaign, count(*) filter (where event_type = 'purchase') as collected, count(*) filter (where event_type = 'error') as failed, count(*) as records,
    coalesce(sum(case when event_type = 'purchase' then value end), 0) as spent from events group by 1)
    select campaign, collected, failed, records, round(spent, 4) as spent, records - collected - failed as open from c""")
def campaign_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    c = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 40).alias("campaign")).agg(
        F.count_if(kind == "purchase").alias("collected"), F.count_if(kind == "error").alias("failed"), F.count("*").alias("records"), F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)).alias("spent")
    )
    return c.select("campaign", "collected", "failed", "records", F.round("spent", 4).alias("spent"), (F.col("records") - F.col("collected") - F.col("failed")).alias("open"))


@query("""select case when usable and k = 0 then 'AI_VALID' when k = 0 then 'AI_VALID_NO_USABLE_TEXT' when k = 1 then 'AI_PROVIDER_REFUSAL' when k = 2 then 'AI_TERMINAL_INVALID' when not usable then 'NO_USABLE_TEXT' else 'NO_AI_PREDICTION' end as status, count(*) as n
    from (select doc_id % 4 as k, n_chars > 300 as usable from documents) group by 1""")
def export_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").groupBy(rules.export_status(k == 0, k == 1, k == 2, F.col("n_chars") > 300).alias("status")).agg(F.count("*").alias("n"))
