"""Chunks, streamed hashes, containment and typed loads against plain loops."""

import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rostrum.functions import keys
from rostrum.operators import chunking, preflight, selection, streams
from rostrum.sources import typed


def plain_chunks(needs, most_records, most_tokens):
    out, chunk, n, used = [], 1, 0, 0
    for need in needs:
        if n and (n + 1 > most_records or used + need > most_tokens):
            chunk, n, used = chunk + 1, 0, 0
        n, used = n + 1, used + need
        out.append(chunk)
    return out


@pytest.mark.parametrize(("most_records", "most_tokens", "block", "parts"), [(5, 40, 5, "7"), (5, 40, 8, "3"), (1, 20, 1, "2"), (50, 60, 50, "5"), (1000, 10_000, 50, "4"), (7, 20, 1000, "1")])
def test_chunks_of_many_tasks(spark, most_records, most_tokens, block, parts):
    rng = random.Random(most_records + block)
    sizes = {"one": 300, "two": 1, None: 40, "x": 6, "zero": 25}
    rows = [(c, k, 0 if c == "zero" else rng.choice([0, 1, 3, 9, 20]), "more") for c, n in sizes.items() for k in range(n)]
    want = [(c, k, m) for c in sizes for k, m in enumerate(plain_chunks([r[2] for r in rows if r[0] == c], most_records, most_tokens))]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(rows, "c string, k long, need int, _more string")
    got = chunking.greedy_chunks(df, "c", "k", "need", most_records, most_tokens, block)
    assert got.columns == [*df.columns, "chunk_number"] and sorted(map(repr, ((r.c, r.k, r.chunk_number) for r in got.collect()))) == sorted(map(repr, want))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chunks_of_nothing_and_too_much(spark):
    df = spark.createDataFrame([("a", 1, 7)], "c string, k int, need int")
    assert chunking.greedy_chunks(df.limit(0), "c", "k", "need", 5, 10).isEmpty()
    with pytest.raises(ValueError):
        chunking.greedy_chunks(df, "c", "k", "need", 5, 6)


def test_one_campaign_is_spread(spark):
    rows = spark.range(60_000).select(F.lit("c").alias("c"), "id", (F.col("id") % 90).alias("need"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = chunking.greedy_chunks(rows, "c", "id", "need", 100, 2000, block=2000).withColumn("task", F.spark_partition_id())
    tasks = {r.task: r["count"] for r in got.groupBy("task").count().collect()}
    assert len(tasks) == 4 and max(tasks.values()) < 30_000
    want = plain_chunks([k % 90 for k in range(60_000)], 100, 2000)
    assert [r.chunk_number for r in got.orderBy("id").collect()] == want
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_preflight_without_a_pilot(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(9)], "k long, t long")
    none = rows.select("k").limit(0)
    row = preflight.preflight(rows, none, none, none, "k", "t", seed="s", most_records=4, ceiling=100, active_tokens=61, unknown_jobs=0, pilot=(0, 0), prices=(1.0, 1.0)).first()
    assert (row.n_remaining, row.n_chunks, row.most_chunk_tokens, row.input_tokens, row.output_tokens, row.estimated_cost, row.quota_fits) == (9, 3, 40, 90, None, None, False)
    done = preflight.preflight(rows, rows.select("k"), none, none, "k", "t", seed="s", most_records=4, ceiling=100, active_tokens=0, unknown_jobs=1, pilot=(10, 5), prices=(1.0, 1.0)).first()
    assert (done.n_remaining, done.n_chunks, done.estimated_cost, done.quota_fits, done.remaining_sha256) == (0, 0, Decimal(0), False, hashlib.sha256(b"[]").hexdigest())


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_streamed_hash_is_the_collected_one(spark, n):
    rows = spark.range(n).select("id", F.concat(F.lit('q"\\é😀/'), F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("o")).repartition(5)
    want = rows.agg(keys.list_hash(keys.ordered_ids(F.col("o"), F.col("k")))).first()[0]
    row = streams.list_hash(rows, ["o"], F.col("k")).first()
    assert (row.n, row.sha256) == (n, want)


def test_streamed_hash_of_many(spark, monkeypatch):
    monkeypatch.setattr(streams, "PIECE", 1000)
    row = streams.list_hash(spark.range(160_000).repartition(7), [F.col("id")], F.col("id")).first()
    assert (row.n, row.sha256) == (160_000, hashlib.sha256(json.dumps([str(k) for k in range(160_000)], separators=(",", ":")).encode()).hexdigest())


def test_merge(spark):
    plan = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("c", 2, 3)], "k string, chunk int, ordinal int")
    rows = spark.createDataFrame([("a", 1, "original_valid"), ("c", 2, "provider_refused"), ("b", 1, "structurally_repaired")], "k string, chunk int, state string")
    sha = hashlib.sha256(b'["b","a","c"]').hexdigest()
    fine = streams.accounts(streams.merged(plan, rows, "k", "chunk", "ordinal", "state"), "k", "ordinal", "state", sha).first()
    assert fine.complete and fine.record_set_sha256 == sha and (fine.planned, fine.duplicate, fine.missing) == (3, 0, 0)
    for more in (rows.filter("k <> 'a'"), rows.union(rows.limit(1)), rows.withColumn("chunk", F.lit(1)), rows.withColumn("state", F.lit("odd"))):
        assert not streams.accounts(streams.merged(plan, more, "k", "chunk", "ordinal", "state"), "k", "ordinal", "state", sha).first().complete
    assert not streams.accounts(streams.merged(plan, rows, "k", "chunk", "ordinal", "state"), "k", "ordinal", "state", "0").first().complete


def contains(v, w, top=True):
    if isinstance(w, dict):
        return isinstance(v, dict) and all(k in v and contains(v[k], x, False) for k, x in w.items())
    if isinstance(w, list):
        return isinstance(v, list) and all(any(contains(i, x, False) for i in v) for x in w)
    if top and isinstance(v, list):
        return any(contains(i, w, False) for i in v)
    return type(v) is type(w) and v == w or {type(v), type(w)} == {int, float} and v == w


def test_containment(spark):
    values = [1, 1.0, 1.5, True, None, "1", "a", [], {}, [1, "a"], ["a", ["b", 1]], [[1, 2], [3]], {"a": 1, "b": None}, {"a": {"x": [1, 2, 2]}, "b c": "q"}, {"a": [{"k": 1, "z": 0}, {"k": 2}]}, {"a": []}, "a'b"]
    wanted = [v for v in values if v != "a'b"] + [[2, 1], {"a": {"x": [2]}}, {"a": [{"k": 2}, {"k": 1}]}, {"b c": "q"}, {"a": [{"k": 1, "z": 1}]}, [[2], [3]], {"c": None}, 0, False]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, j string").withColumn("v", F.try_parse_json("j"))
    got = rows.select("k", *[selection.json_contains(F.col("v"), w).alias(f"w{n}") for n, w in enumerate(wanted)]).collect()
    for r in got:
        for n, w in enumerate(wanted):
            assert r[f"w{n}"] is contains(values[r.k], w), (values[r.k], w)
    assert rows.select(selection.json_contains(F.try_parse_json(F.lit("no json")), {})).first()[0] is False


def test_typed_load(spark):
    rows = spark.createDataFrame([("a", "1", " 2001-02-03 ", "p"), ("b", "x", "2001-02-30", None), ("c", "", None, "q"), (None, "99999999999", "2001-01-01", "p")], "k string, n string, d string, parent string")
    t = typed.typed(rows, {"n": "int", "d": "date"}, required=("k", "d"))
    assert sorted(map(repr, map(tuple, typed.ledger(t, "k").collect()))) == sorted(map(repr, [("b", "n", "x", "NOT_INT"), ("b", "d", "2001-02-30", "NOT_DATE"), ("c", "d", None, "REQUIRED"), (None, "n", "99999999999", "NOT_INT"), (None, "k", None, "REQUIRED")]))
    assert t.dtypes[1:3] == [("n", "int"), ("d", "date")]
    parents = spark.createDataFrame([("p",), ("p",)], "id string")
    a = typed.accounts(typed.resolved(t, {"parent": (parents, "id")}), ["parent"]).first()
    assert (a.n_read, a.n_loaded, a.n_bad_rows, a.n_bad_cells, a.parent_resolved, a.parent_unresolved, a.parent_absent) == (4, 1, 3, 5, 2, 1, 1)
    assert set(typed.FRAGMENT.values()) == {"int", "date", "boolean"}


def test_sample_keeps_its_first_rows_before_the_shuffle(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("s"))
    allocation = selection.hamilton(rows.groupBy("s").agg(F.count("*").alias("n")), "s", "n", 20)
    drawn = selection.stratified_sample(rows, "id", "s", allocation, "x")
    assert drawn.count() == 20 and "WindowGroupLimit" in drawn._jdf.queryExecution().executedPlan().toString()
