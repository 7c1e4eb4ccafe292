"""Queries of second passes: responses, artifacts, exported rows and repairs.

Responses are JSON that both engines make of the documents by the same expressions; each then reads that JSON by its own functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import rules, second_pass
from rostrum.operators.evidence import DOUBLE, HYPHEN, SINGLE
from rostrum.plans.registry import query
from rostrum.sources.tables import table


def quoted(sql: str) -> str:
    """A string expression as a JSON string, for texts whose only control characters are line ends and tabs."""
    plain = f"translate({sql}, chr(10) || chr(13) || chr(9), '   ')"
    return f"(chr(34) || replace(replace({plain}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || chr(34))"


#: Documents with a quote from anywhere, the same in other characters, and one character.
TAKEN = """select doc_id, doc_id as i, coalesce(text, '') as t, doc_id * 37 % greatest(length(coalesce(text, '')) - 60, 1) as place, substr(coalesce(text, ''), cast(1 + doc_id * 37 % greatest(length(coalesce(text, '')) - 60, 1) as int), 40) as q,
    substr(coalesce(text, ''), 3, 1) as c from documents"""
OTHER = "replace(replace(replace(q, chr(39), chr(8217)), '-', chr(8212)), ' ', '  ')"
SPAN = lambda sql: f"""'{{"text":' || {quoted(sql)} || '}}'"""
RESPONSE = f"""'{{"hostility_present":' || case when i % 13 in (0, 4) then '"NO"' when i % 13 in (1, 5, 8, 12) then '"YES"' when i % 13 = 6 then '"MAYBE"' else '"UNSURE"' end
    || ',"target":' || case when i % 13 in (0, 3) then '"N/A"' when i % 13 = 7 then '7' when i % 13 in (1, 12) then '"OPPOSING_PARTISAN_TARGET"' else '"OTHER_POLITICAL_TARGET"' end
    || ',"evidence_spans":' || case when i % 13 in (0, 3, 4) then '[]' when i % 13 = 2 then '[' || {SPAN("q")} || ',' || {SPAN("c")} || ',' || {SPAN(OTHER)} || ']' when i % 13 = 5 then '[' || {SPAN("q || '~~'")} || ']'
        when i % 13 = 9 then '[{{"quote":"a"}}]' when i % 13 = 10 then '[{{"text":5}}]' when i % 13 = 11 then '"none"' when i % 13 = 12 then '[' || {SPAN("q")} || ',{{"text":" "}},' || {SPAN(OTHER)} || ']' else '[' || {SPAN(OTHER)} || ']' end
    || case when i % 13 = 8 then '' when i % 35 = 1 then ',"reasoning":"' || repeat('x', cast(4000 + i % 2 as int)) || '"' else ',"reasoning":"why"' end || case when i % 41 = 0 then '' else '}}' end"""

SPACES = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def folded(sql: str) -> str:
    """DuckDB's way to the one form of a text."""
    one = f"translate({sql}, '{''.join(SINGLE + DOUBLE + HYPHEN)}', '{chr(39) * 2 * len(SINGLE)}{chr(34) * len(DOUBLE)}{'-' * len(HYPHEN)}')"
    return f"trim(regexp_replace({one}, '{SPACES}', ' ', 'g'))"


PRESENT, TARGETED = "('YES', 'NO', 'UNSURE')", "('OPPOSING_PARTISAN_TARGET', 'OTHER_POLITICAL_TARGET', 'NON_POLITICAL_TARGET', 'UNSURE', 'N/A')"
READ = f"""with d as ({TAKEN}), r as (select *, {RESPONSE} as response from d), j as (select *, case when json_valid(response) then response end as j from r),
    v as (select *, json_extract(j, '$.evidence_spans') as sp, j ->> '$.hostility_present' as p, j ->> '$.target' as g, json_type(j, '$.target') as gt, list_sort(json_keys(j)) as keys from j),
    s as (select doc_id, k, json_extract(sp, '$[' || k || ']') as s from v, range(10) as x(k) where json_type(sp) = 'ARRAY' and k < json_array_length(sp)),
    z as (select s.doc_id, k, case when list_sort(json_keys(s)) is distinct from ['text'] then 'SPAN_FIELDS' when json_type(s, '$.text') <> 'VARCHAR' or s ->> '$.text' = '' then 'SPAN_TEXT' end as bad, {folded("t")} as ft, {folded("s ->> '$.text'")} as fq from s join v using (doc_id)),
    h as (select *, case when fq = '' then 0 when instr(ft, fq) = 0 then 0 when instr(substr(ft, instr(ft, fq) + 1), fq) > 0 then 2 else 1 end as hits from z),
    a as (select doc_id, arg_min(bad, k) filter (where bad is not null) as bad, count(*) as n, count(*) filter (where hits = 1) as one, count(*) filter (where hits = 0) as no, count(*) filter (where hits = 2) as many from h group by 1),
    w as (select v.*, a.*, coalesce(n, 0) as spans, case when keys is distinct from ['evidence_spans', 'hostility_present', 'reasoning', 'target'] then 'FIELDS' when p not in {PRESENT} then 'PRESENCE_UNKNOWN' when gt <> 'VARCHAR' or g not in {TARGETED} then 'TARGET_UNKNOWN' when length(j ->> '$.reasoning') > 4000 then 'REASONING'
        when json_type(sp) <> 'ARRAY' then 'SPANS_NOT_A_LIST' when bad is not null then bad when p = 'NO' and (g <> 'N/A' or coalesce(n, 0) > 0) then 'NO_WITH_EVIDENCE' when p <> 'NO' and (g = 'N/A' or coalesce(n, 0) = 0) then 'WITHOUT_EVIDENCE' end as error from v left join a using (doc_id))"""


def spoken(sql: str) -> Column:
    """The expression in Spark, whose chr() takes numbers modulo 256: characters beyond that are written out."""
    return F.expr(re.sub(r"chr\((\d+)\)", lambda m: f"'{chr(int(m[1]))}'" if int(m[1]) > 255 else m[0], sql))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    rows.createOrReplaceTempView(view := "rostrum_second_documents")
    taken = spark.sql(TAKEN.replace("from documents", f"from {view}"))
    spark.catalog.dropTempView(view)
    return taken.withColumn("response", spoken(RESPONSE))


@query(READ + """ select doc_id, error, case when error in ('NO_WITH_EVIDENCE', 'WITHOUT_EVIDENCE') then 'SEMANTIC_CONTRACT_INVALID' when error is not null then 'STRUCTURED_OUTPUT_INVALID' end as category, case when error is null then p end as presence,
    case when error is null then spans end as n_requested, case when error is null then coalesce(one, 0) end as n_resolved, case when error is null then coalesce(no, 0) end as n_unmatched, case when error is null then coalesce(many, 0) end as n_ambiguous,
    coalesce(error is null and p = 'YES' and g = 'OPPOSING_PARTISAN_TARGET', false) as partisan from w""")
def hostility_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = second_pass.validated(responses(spark, sf_dir), "response", "t")
    n = {f"n_{c}": F.col(c).cast("long") for c in ("n_requested", "n_resolved")} | {f"n_{c}": F.size(c).cast("long") for c in ("unmatched", "ambiguous")}
    return rows.select("doc_id", "error", "category", "presence", *[c.alias(k.replace("n_n_", "n_")) for k, c in n.items()], rules.partisan(F.col("presence"), F.col("target")).alias("partisan"))


# Of responses that are cut off at every length, changed inside, or replaced; some are repairs.
STATUS = "case when event_id % 11 = 0 then 'missing' when event_id % 11 = 1 then 'mapping_error' when event_id % 11 = 2 then 'provider_failure' else 'answer' end"
PART = "case when event_id % 5 = 0 then replace(props, ':', ';') when event_id % 5 = 1 then '[' || props when event_id % 5 = 2 then '[' || props || props else substr(props, 1, cast(event_id % 10 as int)) end"


@query(f"""with r as (select *, {STATUS} as status, {PART} as response, event_id % 3 = 0 as repair from events),
    b as (select *, case when json_valid(response) then null when regexp_matches(response, '^$|^\\{{"$|^\\{{"k"$|^\\{{"k": ?$|^\\{{"k": [0-9]+$|^\\[\\{{"k": [0-9]+\\}}$') then 'JSON_TRUNCATION' else 'STRUCTURED_OUTPUT_INVALID' end as broken from r),
    c as (select case status when 'missing' then case when repair then 'EVIDENCE_REPAIR_MISSING_RESULT' else 'MISSING_RESULT' end when 'mapping_error' then case when repair then 'EVIDENCE_REPAIR_MAPPING_FAILURE' else 'STRUCTURED_OUTPUT_INVALID' end
        when 'provider_failure' then case when repair then 'EVIDENCE_REPAIR_PROVIDER_FAILURE' else 'PROVIDER_FAILURE' end else coalesce(broken, case when value > 50 then case when repair then 'EVIDENCE_REPAIR_VALIDATION_FAILURE' when event_type = 'error' then 'SEMANTIC_CONTRACT_INVALID' else 'EVIDENCE_RESOLUTION_FAILURE' end end) end as category from b)
    select k as category, count(category) as n from (select unnest({list(rules.CATEGORIES)}) as k) left join c on k = category group by k""")
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({"status": F.expr(STATUS), "response": F.expr(PART), "repair": F.col("event_id") % 3 == 0})
    rows = rows.withColumn("stop", rules.json_stop("response"))
    invalid = F.when(F.col("value") > 50, F.when(F.col("event_type") == "error", "SEMANTIC_CONTRACT_INVALID").otherwise("EVIDENCE_RESOLUTION_FAILURE"))
    category = rules.failure_category(F.col("status"), F.col("repair"), rules.json_category(F.col("response"), F.col("stop")), invalid)
    return rules.categories(rows.select(category.alias("category")), "category")


# An artifact whose spans bring their places: some are off by one or are strings, some are of no record, some rows are there twice.
PLACED = f"""'{{"hostility_present":"YES","target":"UNSURE","reasoning":"","evidence_spans":[{{"start_offset":' || case when i % 11 = 0 then '"' || place || '"' else '' || place end || ',"end_offset":' || (place + length(q) + case when i % 7 = 0 then 1 else 0 end)
    || ',"text":' || (chr(34) || replace(replace(replace(replace(q, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || chr(34)) || '}}]}}'"""
VERDICTS = f"""with d as ({TAKEN}), r as (select *, case when i % 13 = 0 then i + 10000000 else i end as record, {PLACED} as j from d where i % 19 <> 0),
    x as (select r.record, r.i, o.t, json_extract(j, '$.evidence_spans[0]') as s from r left join d o on o.i = r.record),
    y as (select *, case when json_type(s, '$.start_offset') = 'UBIGINT' then (s ->> '$.start_offset')::bigint end as a, (s ->> '$.end_offset')::bigint as b, s ->> '$.text' as q from x),
    f as (select *, {folded("t")} as ft, {folded("q")} as fq from y),
    v as (select record as doc_id, i, case when i % 17 = 0 then 'REPEATED' when t is null then 'NO_TEXT' when not coalesce(a >= 0 and b > a and b <= length(t) and substr(t, a + 1, b - a) = q, false) then 'SPANS_DIFFER' when fq = '' or instr(substr(ft, instr(ft, fq) + 1), fq) > 0 then 'EVIDENCE_UNRESOLVED'
        when regexp_matches(q, '^{SPACES}|{SPACES}$') then 'SPANS_DIFFER' end as error from f)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir).drop("response")
    made = rows.filter("i % 19 <> 0").select(F.when(F.col("i") % 13 == 0, F.col("i") + 10000000).otherwise(F.col("i")).alias("doc_id"), "i", F.expr(PLACED).alias("response"))
    made = made.unionByName(made.filter("i % 17 = 0")).select("doc_id", "response")
    return second_pass.artifact_verdicts(made, rows.select("doc_id", "t"), "doc_id", "response", "t", reasoning=False)


@query(VERDICTS + " select doc_id, error from v")
def artifact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("doc_id", "error")


@query(VERDICTS + """, u as (select doc_id, case when error is null then 'valid' else 'wrong' end as w from v union all select doc_id, 'refused' from labels where toxic = 1 union all select doc_id, 'invalid' from documents where doc_id % 19 = 0 union all select doc_id, 'planned' from documents),
    e as (select doc_id, count(*) filter (where w = 'valid') as a, count(*) filter (where w = 'wrong') as b, count(*) filter (where w = 'refused') as c, count(*) filter (where w = 'invalid') as i, count(*) filter (where w = 'planned') as p from u group by 1),
    s as (select sum(a)::bigint as n_valid, sum(b)::bigint as n_wrong, sum(c)::bigint as n_refused, sum(i)::bigint as n_invalid, sum(p)::bigint as n_planned, count(*) filter (where p > 0 and a + c + i = 0) as n_missing, count(*) filter (where p = 0) as n_outside, count(*) filter (where a + c + i > 1 or p > 1) as n_repeated from e)
    select *, n_wrong + n_missing + n_outside + n_repeated = 0 as importable from s""")
def artifact_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    refused = table(spark, sf_dir, "labels").filter("toxic = 1")
    return second_pass.artifact_accounts(verdicts(spark, sf_dir), refused, docs.filter("doc_id % 19 = 0"), docs, "doc_id")


# Exported rows: values of both passes, with numbers as strings, offsets that no 64 bits hold, and fields of the other pass.
EXPORTED = f"""'{{"hostility_present":' || case when i % 10 = 1 then '"MAYBE"' when i % 10 = 2 then '"NO"' when i % 10 = 3 then 'null' else '"YES"' end || ',"target":"UNSURE"' || case when i % 10 = 4 then ',"more":1' else '' end
    || ',"evidence_spans":[{{"start_offset":' || case when i % 10 = 5 then '"0"' when i % 10 = 6 then '1.0' when i % 10 = 7 then 'true' else '0' end || ',"end_offset":' || case when i % 10 = 8 then '99999999999999999999' when i % 10 = 9 then '0' else '4' end
    || ',"text":' || {quoted("substr(coalesce(text, ''), 1, 4)")} || '}}]' || case when i % 23 = 0 then '' else '}}' end"""
POLICY = """case when i % 6 = 0 then null when i % 6 = 1 then '{}' else '{"is_non_policy":' || case when i % 4 = 0 then 'true' when i % 8 = 1 then '"false"' else 'false' end || ',"primary_australian_domain":' || case when i % 5 = 0 then 'null' else '"' || source || '"' end
    || ',"secondary_australian_domains":["' || lang || case when i % 9 = 0 then '","x' else '' end || '"]}' end"""


@query(f"""with d as (select *, doc_id as i from documents), e as (select doc_id, i, text, {EXPORTED} as h, {POLICY} as p, lang, source, i % 4 = 0 as non, case when i % 5 = 0 then null else source end as first from d),
    v as (select *, case when json_valid(h) then h end as j, case when json_valid(p) then p end as k from e), s as (select *, json_extract(j, '$.evidence_spans[0]') as s from v)
    select doc_id, case when i % 29 = 0 then 'TASK_DIFFERS' when j is null then 'VALUES_NOT_AN_OBJECT' when i % 31 = 0 then 'POLICY_FIELDS' when list_sort(json_keys(j)) <> ['evidence_spans', 'hostility_present', 'target'] then 'VALUE_FIELDS' when (j ->> '$.hostility_present') is null or j ->> '$.hostility_present' not in {PRESENT} then 'LABEL_UNKNOWN'
        when json_type(s, '$.start_offset') <> 'UBIGINT' or json_type(s, '$.end_offset') <> 'UBIGINT' or try_cast(s ->> '$.end_offset' as bigint) is null or (s ->> '$.end_offset')::hugeint <= 0 or s ->> '$.text' = '' then 'SPANS_INVALID' when j ->> '$.hostility_present' = 'NO' then 'INCONSISTENT' end as second_error,
        case when i % 29 = 0 then 'TASK_DIFFERS' when i % 37 = 0 then 'POLICY_FIELDS' when k is null or k = '{{}}' then null when json_type(k, '$.is_non_policy') <> 'BOOLEAN' or (k ->> '$.is_non_policy')::boolean <> non or (k ->> '$.primary_australian_domain') is distinct from first or json_array_length(k, '$.secondary_australian_domains') <> 1 then 'VALUES_DIFFER' end as first_error from s""")
def prediction_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    rows = table(spark, sf_dir, "documents").withColumn("i", F.col("doc_id"))
    second = second_pass.row_error(F.when(i % 29 == 0, "policy").otherwise("hostility"), F.expr(EXPORTED), [F.when(i % 31 == 0, "true"), F.lit(None).cast("string")])
    one = second_pass.policy_row_error(F.when(i % 29 == 0, "hostility").otherwise("policy"), F.expr(POLICY), F.when(i % 37 != 0, i % 4 == 0), F.when(i % 5 != 0, F.col("source")), F.array("lang"))
    return rows.select("doc_id", second.alias("second_error"), one.alias("first_error"))


REPAIR = f"""case when i % 6 = 0 then '{{"evidence_spans":[]}}' when i % 6 = 1 then '{{"evidence_spans":[' || {SPAN("q")} || '],"target":"UNSURE"}}' when i % 6 = 2 then '{{"evidence_spans":[' || {SPAN("c")} || ']}}' else '{{"evidence_spans":[' || {SPAN(OTHER)} || ']}}' end"""


@query(f"""with d as ({TAKEN}), r as (select *, {REPAIR} as j from d), x as (select *, {folded("t")} as ft, {folded("coalesce(j ->> '$.evidence_spans[0].text', '')")} as fq from r)
    select doc_id, case when i % 4 >= 2 then 'NOT_REPAIRABLE' when list_sort(json_keys(j)) <> ['evidence_spans'] then 'OUTPUT_FIELDS' when json_array_length(j, '$.evidence_spans') <> 1 then 'NOT_ONE_PASSAGE' when coalesce(j ->> '$.evidence_spans[0].text', '') = '' then 'SPAN_TEXT'
        when fq = '' or instr(ft, fq) = 0 or instr(substr(ft, instr(ft, fq) + 1), fq) > 0 then 'NOT_RESOLVED' end as error from x""")
def repair_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    presence = F.when(i % 4 == 0, "YES").when(i % 4 == 1, "UNSURE").when(i % 4 == 2, "NO")
    rows = responses(spark, sf_dir).withColumns({"repair": spoken(REPAIR), "p": presence, "g": F.lit("UNSURE")})
    return second_pass.repaired(rows, "repair", "p", "g", "t").select("doc_id", "error")


# People's labels of documents as packages hold them: spans that stand, or are off by one, too long, or say something else.
PACKED = f"""'{{"hostility_present":"' || case doc_id % 5 when 0 then 'NO' when 4 then 'MAYBE' when 1 then 'UNSURE' else 'YES' end || '","target":' || case when doc_id % 5 = 0 and doc_id % 4 > 0 then 'null' when doc_id % 11 = 0 then '"N/A"' else '"UNSURE"' end || case when doc_id % 19 = 0 then ',"more":1' else '' end || ',"evidence_span":' || case when doc_id % 23 = 0 then '"x"'
    when doc_id % 5 = 0 and doc_id % 3 > 0 then '[]' when doc_id % 17 = 0 then '[]' else '[{{"start_offset":' || case when doc_id % 7 = 3 then 3 else 2 end || ',"end_offset":' || case when doc_id % 7 = 4 then '7.5' when doc_id % 7 = 5 then '90000000000' else '7' end || ',"text":' || {quoted("case when doc_id % 7 = 6 then 'other' else substr(coalesce(text, ''), 3, 5) end")} || '}}]' end || '}}'"""


@query(f"""with d as (select doc_id, coalesce(text, '') as t, {PACKED} as j from documents), s as (select *, json_extract(j, '$.evidence_span[0]') as s, j ->> '$.hostility_present' as h, j ->> '$.target' as g from d)
    select doc_id, case when list_sort(json_keys(j)) <> ['evidence_span', 'hostility_present', 'target'] then 'FIELDS' when h not in ('YES', 'NO', 'UNSURE') then 'PRESENCE_UNKNOWN' when h = 'NO' and g is not null then 'NO_WITH_TARGET' when h <> 'NO' and g <> 'UNSURE' then 'TARGET_UNKNOWN'
        when json_type(j, '$.evidence_span') <> 'ARRAY' or (h = 'NO') = (json_array_length(j, '$.evidence_span') > 0) then 'CARDINALITY'
        when s is not null and not (json_type(s, '$.end_offset') = 'UBIGINT' and (s ->> '$.end_offset')::double <= length(t) and coalesce(substr(t, (s ->> '$.start_offset')::bigint + 1, least(try_cast(s ->> '$.end_offset' as bigint), 1000000) - (s ->> '$.start_offset')::bigint) = s ->> '$.text', false)) then 'SPAN_PLACE' end as error from s""")
def package_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.select("doc_id", second_pass.package_error(F.expr(PACKED), F.coalesce("text", F.lit(""))).alias("error"))
