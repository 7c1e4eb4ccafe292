"""Queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import bestfit, chat, codes, decontam, langid, licenses, middle, packing, pieces, quality, simhash, tokens, warc
from rostrum.llm.storage import shared_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.examples(rows.unionByName(more), whole=True))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    made = warc.read(spark, path)
    return made.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = langid.predict(rows.select("doc_id", "text"), langid.learn(rows))
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return said.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_xxh64"), "lossless")


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = written(packing.pack(table(spark, sf_dir, "documents")), "packed")
    return packing.segments(packed).withColumn("ids_xxh64", F.xxhash64("ids")).drop("ids")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids", "home")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = codes.compress(table(spark, sf_dir, "embeddings"))
    rows = codes.with_label_error(made.rows)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(made.book)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_simhash_components": op6_simhash_components,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_packing": op10_token_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
        f as (select *, case when n >= 100 then min(page_id) over (partition by d) else page_id end as first from p)
        select page_id, n::bigint as payload_bytes, d as payload_digest,
            case when page_id > first then 'revisit' else 'response' end as record_type,
            case when page_id > first then first end as refers_to
        from f""",
    "op11_fill_in_middle": """
        with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
        u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]', 0, 's') as units, [('0x' || h[8 * k + 1 : 8 * k + 8])::bigint for k in range(4)] as r from d),
        c as (select *, len(units)::bigint as n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) as a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) as b from u),
        p as (select *, array_to_string(units[1 : a], '') as prefix, array_to_string(units[a + 1 : b], '') as middle, array_to_string(units[b + 1 : n], '') as suffix,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end as form from c)
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(text) as restored_sha256
        from p""",
    "op13_vector_codes": """
        with kept as (select vec_id, label, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
            where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
        parts as (select vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] as x from kept, range(16) as r(p)),
        firsts as (select vec_id, row_number() over (order by vec_id) - 1 as k from kept order by vec_id limit 64),
        b0 as (select p, k, x as c from parts join firsts using (vec_id)),
        a1 as (select vec_id, p, min({'d': list_sum([(y[1] - y[2]) ** 2 for y in list_zip(x, c)])::bigint, 'k': k}) as near, any_value(x) as x from parts join b0 using (p) group by vec_id, p),
        m1 as (select p, near.k as k, i, floor(sum(x[i])::double / count(*))::bigint as c from a1, (select unnest(range(1, len(any_value(x)) + 1)) as i from a1) group by p, near.k, i),
        b1 as (select p, k, coalesce(any_value(n.c), any_value(b.c)) as c from b0 b left join (select p, k, list(c order by i) as c from m1 group by p, k) n using (p, k) group by p, k),
        a2 as (select vec_id, p, min({'d': list_sum([(y[1] - y[2]) ** 2 for y in list_zip(x, c)])::bigint, 'k': k}) as near, any_value(x) as x from parts join b1 using (p) group by vec_id, p),
        m2 as (select p, near.k as k, i, floor(sum(x[i])::double / count(*))::bigint as c from a2, (select unnest(range(1, len(any_value(x)) + 1)) as i from a2) group by p, near.k, i),
        b2 as (select p, k, coalesce(any_value(n.c), any_value(b.c)) as c from b1 b left join (select p, k, list(c order by i) as c from m2 group by p, k) n using (p, k) group by p, k),
        a3 as (select vec_id, p, min({'d': list_sum([(y[1] - y[2]) ** 2 for y in list_zip(x, c)])::bigint, 'k': k}) as near from parts join b2 using (p) group by vec_id, p),
        done as (select vec_id, string_agg(printf('%02x', near.k), '' order by p) as code, sum(near.d)::bigint as error from a3 group by vec_id)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
            (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) from b2) as codebooks_sha256
        from done join kept using (vec_id)""",
}
