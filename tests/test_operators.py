"""Operators whose cases the queries' tables don't hold."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text
from rostrum.operators import ordered, reconstruct, selection
from rostrum.sources import pages


def test_composed_and_folded(spark):
    rows = spark.createDataFrame([("Straße  é",), ("STRASSE É",), (None,), (" plain x ",)], "t string")
    got = [tuple(r) for r in rows.select(text.clean(F.col("t")), text.raw(F.col("t")), text.identity(F.col("t")), text.nfc(F.col("t"))).collect()]
    assert got[0] == ("Straße é", "Straße  é", "strasse é", "Straße  é") and got[1][2] == got[0][2]
    assert got[2] == (None, None, "", None) and got[3][0] == "plain x"


@pytest.mark.parametrize(("k", "want"), [(1, [3]), (2, [0, 6]), (7, list(range(7)))])
def test_systematic_sample(spark, k, want):
    assert sorted(r.id for r in selection.systematic_sample(spark.range(7), "id", k).collect()) == want
    with pytest.raises(ValueError):
        selection.systematic_sample(spark.range(7), "id", 0)


def test_prefix_max(spark):
    values = [3, None, 5, 1, 9, 2, 9, 4]
    df = spark.createDataFrame(list(enumerate(values)), "o int, v int")
    want, upto = [], None
    for v in values:
        want.append(upto)
        upto = v if upto is None else max(upto, v or upto)
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert [r.m for r in ordered.prefix_max(df, "o", "v", "m").orderBy("o").collect()] == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_asof_ties(spark):
    left, right = spark.createDataFrame([(1, 5)], "k int, t int"), spark.createDataFrame([(1, 4, "a"), (1, 4, "b"), (1, 5, "z")], "k int, t int, v string")
    assert ordered.asof_before(left, right, "k", "t", "v", "out").first().out == "b"


def test_long_run_is_linear(spark):
    """100,000 fragments without a start or boundary in one file."""
    kind = F.when(F.col("id") == 0, "speech").when(F.col("id") % 3 == 0, "interjection").otherwise("continuation")
    none = F.lit(None).cast("string")
    rows = spark.range(100_000).select(
        F.lit("f").alias("source_file"), F.col("id").alias("sequence_number"), kind.alias("talktype_raw"), F.lit("s1").alias("speaker_id_raw"), F.lit("A").alias("speaker_name_raw"), none.alias("nospeaker_raw"),
        F.lit("x").alias("text_clean"), F.array().cast("array<string>").alias("warning_codes"), none.alias("boundary_reason_before"), none.alias("heading"),
    )
    got = {r.relation: (r.n, r.t) for r in reconstruct.fold(rows, reconstruct.Rules()).groupBy("relation").agg(F.count("*").alias("n"), F.max("turn").alias("t")).collect()}
    assert got == {"initial": (1, 0), "interjection": (33_333, 0), "continuation": (66_666, 0)}


def test_block_text(spark):
    html = "<html><head><title>t</title></head><body><p>One  <b>two</b></p><ul><li>three</li><li>four</li></ul><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    rows = {r.page_id: r for r in pages.block_text(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")).collect()}
    want = ["t", "One two", "three", "four", "a\tb"]
    assert pages.blocks(html)[0] == want
    assert tuple(rows[1])[1:] == (5, 0, 7, hashlib.sha256("\n\n".join(want).encode()).hexdigest()) and rows[2].n_blocks == 0
