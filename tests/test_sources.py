"""XML archives, tables, sinks and the stream."""

import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import evidence, exports, rules, selection
from rostrum.plans import corpus
from rostrum.sources import csv_ranges, debates, tables
from rostrum.streaming import logs

GOOD = """<debates>
<major-heading id="h1" url="u">BILLS</major-heading>
<speech id="s1" speakerid="1" speakername="Ann" talktype="speech" time="10:15" approximate_wordcount="5"><p>Hello <i>there</i>, <b>all</b></p><ul><li>one</li><li>two <sup>x</sup></li></ul><table><tr><td>a</td><td> b </td></tr></table></speech>
<speech id="s2" speakerid="2" speakername="Bob" talktype="interjection" time="15:"><p>No!</p></speech>
<speech id="s3" speakerid="1" speakername="Ann" talktype="continuation" approximate_wordcount="many"><p>Look <img src="i" alt="a map"/> and <img src="j"/></p></speech>
<minor-heading id="h2">Second Reading</minor-heading>
<speech id="s4" speakerid="1" speakername="Ann" talktype="continuation"/>
<division id="d1"><divisioncount ayes="1" noes="2"/><bills><bill id="b1"/><bill id="b2"/></bills></division>
<stage-direction id="x">Bells</stage-direction>
<speech id="s4" speakerid="3" speakername="Cid" talktype="speech"><p>Same id</p></speech>
</debates>"""


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    for name, content in {
        "2010/2010-02-02.xml": GOOD, "2010/2010-02-03.xml": "<debates><speech>", "2010/2010-02-04.xml": "<!DOCTYPE x><debates/>", "2011/2010-02-05.xml": "<debates/>", "2010/2010-02-31.xml": "<debates/>",
        "2010/2010-02-06.xml": "<other/>", "2010/notes.xml": "<debates/>", "2010/2010-02-07.xml": "<debates/>",
    }.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(content)
    return str(root)


def test_errors_stay_with_their_file(spark, archive):
    rows = debates.parsed(debates.discover(spark, archive))
    assert {r.source_file: r.error for r in rows.filter("error is not null").collect()} == {
        "2010/2010-02-03.xml": "MALFORMED", "2010/2010-02-04.xml": "DOCTYPE", "2011/2010-02-05.xml": "PATH_YEAR", "2010/2010-02-31.xml": "PATH_DATE", "2010/2010-02-06.xml": "ROOT", "2010/notes.xml": "PATH_FORMAT",
    }
    assert rows.filter("error is null").count() == 9


def test_corpus(spark, archive):
    mapping = spark.createDataFrame([("BILLS", "bills", False, False)], "heading string, business_type string, is_procedural boolean, is_ceremonial boolean")
    t = corpus.build(spark, archive, mapping)
    f = {r.sequence_number: r for r in t["speech_fragments"].collect()}
    assert f[2].text_clean == "Hello there, all\n\none\n\ntwo x\n\na\tb" and f[2].block_structure == ["p", "li", "li", "tr"] and f[2].business_type == "bills"
    assert f[4].text_clean == "Look a map and [IMAGE]" and f[4].text_raw == "Look  and" and f[4].calculated_word_count == 5
    assert (f[2].parsed_time, f[2].boundary_reason_before, f[3].boundary_reason_before) == ("10:15:00", "MAJOR_HEADING_BOUNDARY", None)
    assert "TIME_MALFORMED" in f[3].warning_codes and {"APPROXIMATE_WORDCOUNT_MALFORMED", "IMAGE_PRESENT"} <= set(f[4].warning_codes)
    assert {"DUPLICATE_SOURCE_FRAGMENT_ID", "EMPTY_TEXT"} <= set(f[6].warning_codes) and f[6].minor == "Second Reading" and len(f[6].fragment_key) == 64
    lineage = [(r.sequence_number, r.turn, r.ordinal) for r in t["speaker_turn_fragments"].orderBy("sequence_number").collect()]
    assert lineage == [(2, 2, 1), (4, 2, 2), (6, 6, 1), (9, 9, 1)]
    assert [(r.element_type, r.bills_count, r.bill_record_count, r.warning_codes) for r in t["debate_events"].orderBy("sequence_number").collect()] == [("division", 1, 2, []), ("stage-direction", 0, 0, ["UNKNOWN_TOP_LEVEL_EVENT"])]
    heads = t["debate_sections"].orderBy("sequence_number").collect()
    assert heads[1].parent_section_key == heads[0].section_key and heads[0].parent_section_key is None
    assert [r.reason for r in t["continuation_anomalies"].collect()] == ["MINOR_HEADING_BOUNDARY"]
    assert debates.audit(debates.parsed(debates.discover(spark, archive))).filter("measure = 'tag' and value = 'speech'").first().n == 5


def test_only_changed_files(spark, archive):
    files = debates.discover(spark, archive)
    prior = files.select("source_file", F.sha2("content", 256).alias("source_file_sha256")).filter("source_file <> '2010/2010-02-07.xml'")
    assert [r.source_file for r in debates.changed(files, prior).collect()] == ["2010/2010-02-07.xml"]
    lines = "".join(f"{r.source_file}\0{r.length}\0{hashlib.sha256(r.content).hexdigest()}\n" for r in files.orderBy("source_file").collect())
    assert tuple(debates.inventory_hash(files).first()) == (files.count(), hashlib.sha256(lines.encode()).hexdigest())


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k,t,x\n1,"two\nlines",\n2,"a ""q""",z\n')
    rows = csv_ranges.csv_frame(spark, str(tmp_path / "a.csv"), ["k", "t", "x"], ["t", "x"]).collect()
    assert [tuple(r) for r in rows] == [("two\nlines", None), ('a "q"', "z")]
    (tmp_path / "a.jsonl").write_text('{"id":"a","n":1}\nnot json\n{"id":"b","n":2}\n{"id":"a","n":3}\n')
    good, bad = tables.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int")
    assert good.count() == 3 and bad.count() == 1
    assert {r.id: r.n for r in tables.last_lines(spark, str(tmp_path / "a.jsonl"), "id string, n int", "id").collect()} == {"a": 3, "b": 2}
    df = spark.createDataFrame([(2010, "a", ["x", "y"], None), (2011, "b", [], True)], "year int, k string, l array<string>, b boolean")
    exports.write_by_year(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").glob("year=*")) == ["year=2010", "year=2011"]
    exports.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text().splitlines()[1] == "2010,a,x | y,"
    exports.write_manifest(spark, str(tmp_path / "m"), {"rows": 2})
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"rows": 2}
    with pytest.raises(ValueError):
        tables.with_schema(spark, str(tmp_path / "p"), "k int")


KINDS = "event_id long, ts timestamp, user_id long, event_type string, used long"


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_stream_keeps_latest_and_sums(spark, tmp_path, pytestconfig):
    """Eleven small batches after a large one, with a restart before each: the state is right and no batch of itself writes the state again."""
    events = spark.read.parquet(f"{pytestconfig.DATA}/events.parquet").select("event_id", "ts", "user_id", "event_type", (F.col("event_id") % 5).alias("used"))
    events = events.withColumn("user_id", F.col("event_id") % 400)
    batches = [events.filter("event_id % 50 >= 11")] + [events.filter(f"event_id % 50 = {k}") for k in range(11)]
    order, state = ["ts", "event_id"], tmp_path / "state"
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = logs.new_files(spark, str(tmp_path / "in"), KINDS)
        logs.keep_latest(stream, "user_id", order, str(state), str(tmp_path / "check"), ["used"], fanout=3).awaitTermination(120)
    want = logs.reduced(events, "user_id", order, ["used"])
    got = logs.standing(spark, str(state), KINDS, "user_id", order, ["used"], fanout=3)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert logs.parts(11, 3) == ["level=2/upto=8", "level=1/upto=11"] and logs.parts(1, 3) == ["level=0/upto=0", "level=0/upto=1"]
    small = [folder_bytes(state / f"level=0/upto={k}") for k in range(1, 12)]
    assert max(small) < 1.5 * min(small) and max(small) < folder_bytes(state / "level=0/upto=0")
    left = logs.remaining(spark.range(410).select(F.col("id").alias("user_id")), got.withColumn("tries", F.col("used") % 4), "user_id", "event_type", ("purchase",), "tries", 3)
    kept = {r.user_id for r in got.collect() if r.event_type == "purchase" or r.used % 4 >= 3}
    assert {r.user_id for r in left.collect()} == set(range(410)) - kept


def test_batch_that_runs_again(spark, tmp_path):
    """A stream that lost its checkpoint's last entry writes the same folders again."""
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "c", 1)], "k long, s string, used long")
    for _ in range(2):
        rows.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
        logs.keep_latest(logs.new_files(spark, str(tmp_path / "in"), "k long, s string, used long"), "k", ["s"], str(tmp_path / "state"), str(tmp_path / f"check{_}"), ["used"]).awaitTermination(60)
    got = logs.standing(spark, str(tmp_path / "state"), "k long, s string, used long", "k", ["s"], ["used"])
    assert sorted(map(tuple, got.collect())) == [(1, "b", 12), (2, "c", 1)]


@pytest.mark.parametrize("split", [1, 2, 5, 17, 1 << 20])
def test_csv_by_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    cells = ["", "a", "two\nlines", 'say ""x""', "é😀", "c,d", "\r\n", " ", "\n\n", '""', "line\n"]
    texts = {}
    for name, end, mark in (("a.csv", "\n", "\ufeff"), ("b.csv", "\r\n", "")):
        rows = [[rng.choice(cells) for _ in range(3)] for _ in range(12 if split < 17 else 300)]
        quote = lambda c: f'"{c}"' if set(c) & set('",\n\r') or rng.random() < 0.2 else c
        texts[name] = mark + end.join(["k,t,x", *(",".join(map(quote, r)) for r in rows)]) + rng.choice(["", end])
        (tmp_path / name).write_bytes(texts[name].encode())
    want = []
    for text in texts.values():
        want += [(r[1], r[2]) for r in list(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), quoting=csv.QUOTE_NOTNULL))[1:]]
    got = csv_ranges.csv_frame(spark, str(tmp_path / "*.csv"), ["k", "t", "x"], ["t", "x"], split)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("k string, t string, x string").csv(str(tmp_path / "a.csv")).count()
    assert csv_ranges.csv_frame(spark, str(tmp_path / "a.csv"), ["k", "t", "x"], ["t"], split).count() == plain


def test_csv_of_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("k,t")
    assert csv_ranges.csv_frame(spark, str(tmp_path / "*.csv"), ["k", "t"], ["t"]).count() == 0
    with pytest.raises(ValueError):
        csv_ranges.csv_frame(spark, str(tmp_path), ["k"], ["t"])


def test_evidence_offsets():
    source = "He said “we  can’t — ever” 😀 again, again"
    assert evidence.resolved(source, ["we can't - ever"])[0] == ("matched", 9, 25)
    assert evidence.resolved(source, ["again"])[0][0] == "ambiguous" and evidence.resolved(source, ["never"])[0][0] == "unmatched" and evidence.resolved("aaa", ["aa"])[0][0] == "ambiguous" and evidence.resolved(None, [None])[0][0] == "unmatched"


def test_rules(spark):
    df = spark.createDataFrame([("a", ["x", "x"], "x"), (None, ["q"], None), ("b", [], "y")], "s string, l array<string>, p string")
    schema = rules.Schema((rules.Field("s", codes=("a",), required=True), rules.Field("l", many=True, codes=("x", "y"), items=(0, 1), unique=True, different_from="p"), rules.Field("p", required_when={"field_not_equals": ["l", "x"]})))
    assert [r[0] for r in df.select(schema.errors()).collect()] == [["l:REPEATED", "l:SAME_AS_OTHER", "l:TOO_MANY"], ["l:UNKNOWN_CODE", "p:REQUIRED", "s:REQUIRED"], ["s:UNKNOWN_CODE"]]
    spans = "array<struct<start_offset:int,end_offset:int,text:string>>"
    s = spark.createDataFrame([("a😀bc", [(1, 2, "😀"), (0, 9, "x"), (2, 2, ""), (-1, 2, "a"), (None, 1, "a"), (0, 1, "b")])], f"t string, s {spans}")
    assert s.select(rules.span_errors(F.col("t"), F.col("s"))).first()[0] == [None, "OUT_OF_BOUNDS", "EMPTY", "START_NEGATIVE", "OFFSET_MISSING", "TEXT_DIFFERS"]
    with pytest.raises(ValueError):
        selection.Criteria(words_min=5, words_max=1)


def test_last_lines_of_many_blocks(spark, tmp_path):
    """Files of one name in two folders, read in many small blocks: the last line of the last path counts."""
    for folder, sign in (("a", 1), ("b", -1)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.jsonl").write_text("".join(f'{{"id":"{i % 7}","n":{sign * i}}}\n' for i in range(1, 400 if sign > 0 else 700)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        rows = tables.last_lines(spark, str(tmp_path / "*"), "id string, n int", "id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {r.id: r.n for r in rows} == {str(i % 7): -i for i in range(693, 700)}


def test_gated_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, None), (3, "")], "id int, text string").repartition(2)
    exports.write_gated(df, str(tmp_path / "ok"), 3)
    sums = spark.read.json(str(tmp_path / "ok" / "checksums")).collect()
    for form in ("parquet", "csv"):
        files = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "ok" / form).glob("part-*")}
        assert files == {r.file: (r.size, r.sha256) for r in sums if r.form == form}
    with pytest.raises(ValueError):
        exports.write_gated(df, str(tmp_path / "no"), 4)
    assert not (tmp_path / "no" / "manifest").exists()
