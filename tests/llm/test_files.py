"""WARC archives, the pipeline, and odd tables through all stages."""

import gzip
import hashlib
import zlib

import duckdb
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from rostrum.llm import queries, warc

BIG = "<p>" + "x" * 200
PAGES = [(3, "http://c", BIG), (1, "http://a\nb", BIG), (2, None, BIG), (2, None, BIG), (1, "http://a", BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", BIG), (8, "u", "é\r\n\r\n" * 100)]


def test_archive(spark, tmp_path):
    warc.archive(spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int").repartition(3), str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w"), split=97).withColumn("page_id", warc.page_of("record_id")).withColumn("first", warc.page_of("refers_to")).collect()
    assert sorted([r.page_id for r in rows], key=str) == sorted([p[0] for p in PAGES], key=str)
    html = {p[0]: p[2] or "" for p in PAGES}
    for r in rows:
        body = html[r.page_id].encode()
        again = html[r.page_id] == BIG and r.page_id != 1
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.first) == (("revisit", 1) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == body


def test_other_readers_can_open_it(spark, tmp_path):
    warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    names = [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.gz")]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n") for p in names) == len(PAGES)


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_false_magic(tmp_path, split):
    """A payload that can't be compressed and is full of gzip magic, and of a whole member that is no record."""
    inner = gzip.compress(b"not a record") + warc.MAGIC * 50 + hashlib.sha256(b"x").digest() * 20
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    body = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    stored = pack.compress(body) + pack.flush()
    whole = b"junk" + stored + warc.member("response", "urn:page:1", None, None, "0", b"abc", 3) + b"\x1f\x8b\x08" + stored + b"\x1f\x8b"
    (tmp_path / "a.warc.gz").write_bytes(whole)
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz"))
    found = [at for a in range(0, len(whole), split) for at, _, _ in warc.members(file, a, min(a + split, len(whole)))]
    assert found == [4, 4 + len(stored), len(whole) - len(stored) - 2]


def test_second_write_adds(spark, tmp_path):
    rows = [(k, f"http://{k}", str(k) * 50 * k) for k in range(9)]
    for part in (rows[:5], rows[5:]):
        warc.archive(spark.createDataFrame(part, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r.payload_bytes for r in warc.read(spark, str(tmp_path / "w")).withColumn("page_id", warc.page_of("record_id")).collect()}
    assert got == {k: len(h) for k, _, h in rows}


def test_records_that_are_not_http(spark, tmp_path):
    """Blocks of other records are payload as a whole, blank lines too."""
    html = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nfirst\r\n\r\nsecond"
    blocks = [("conversion", "text/plain", b"first\r\n\r\nsecond"), ("resource", "text/html", b"<p>\r\n\r\n</p>"), ("warcinfo", "application/warc-fields", b"software: x\r\nformat: y\r\n\r\n"), ("metadata", None, b""), ("response", "application/http; msgtype=response", html), ("request", "Application/HTTP;msgtype=request", b"GET / HTTP/1.1\r\n\r\n")]
    whole = b""
    for k, (kind, mime, block) in enumerate(blocks):
        head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:x:%d>" % k, *([b"Content-Type: " + mime.encode()] if mime else []), b"Content-Length: %d" % len(block)]
        whole += gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(whole)
    want = [b.partition(b"\r\n\r\n")[2] if m and "http" in m.lower() else b for _, m, b in blocks]
    for split in (1 << 20, 100):
        got = {r.record_id: (r.record_type, bytes(r.payload), r.payload_bytes) for r in warc.read(spark, str(tmp_path), split).collect()}
        assert got == {f"urn:x:{k}": (b[0], p, len(p)) for k, (b, p) in enumerate(zip(blocks, want))}


def test_record_over_many_reads(tmp_path):
    payload = b"".join(hashlib.sha256(b"%d" % k).digest() for k in range(150_000))
    whole = b"".join(warc.member("response", f"urn:page:{k}", None, None, "0", p, len(p)) for k, p in enumerate([b"a", payload, b"b"]))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    file = fs.LocalFileSystem().open_input_file(str(tmp_path / "a.warc.gz"))
    half = len(whole) // 2
    assert [b.partition(b"\r\n\r\n")[2] for a, e in ((0, half), (half, len(whole))) for _, _, b in warc.members(file, a, e)] == [b"a", payload, b"b"]


def test_empty(spark, tmp_path):
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_sql(spark, pytestconfig):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{pytestconfig.DATA}/pages.parquet'")
    got = queries.op1_warc(spark, pytestconfig.DATA).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(queries.ORACLE["op1_warc"]).fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, pytestconfig):
    docs = spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, pytestconfig.DATA).cache()
    assert 0.5 * docs.count() < out.count() < docs.count() and out.columns[:5] == docs.columns
    assert out.filter(~F.col("lossless")).count() == 0 and out.groupBy("text").count().filter("count > 1").count() == 0


def test_odd_documents_go_through(spark, pytestconfig, tmp_path):
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{pytestconfig.DATA}/{name}.parquet")
    fine = spark.read.parquet(f"{pytestconfig.DATA}/documents.parquet").filter("n_chars between 500 and 3000").limit(20)
    more = fine.withColumns({"kept": F.lit("mine"), "_row": F.lit(1), "_text": F.lit(2), "lang_pred": F.lit(3), "score": F.lit(4), "component_id": F.lit(5)})
    odd = spark.createDataFrame([(None, "some words " * 20, None), (-1, None, None), (-2, "", "en"), (-3, "!!! " * 30, "en")], "doc_id long, text string, lang string")
    more.unionByName(more).unionByName(odd, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(more.columns) <= set(out.columns)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.kept for r in rows} <= {"mine", None} and not {-1, -2, -3} & {r.doc_id for r in rows}


def test_empty_tables_go_through(spark, pytestconfig, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{pytestconfig.DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{pytestconfig.DATA}/conversations.parquet").limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("pages", "embeddings"):
        spark.read.parquet(f"{pytestconfig.DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op5_chat_format" else 0), name
