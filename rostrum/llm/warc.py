"""WARC archives as a Spark data source, ``warc``: one gzip member a record.

Reading is splittable.  A task takes a range of bytes, scans it for the gzip magic, and takes a candidate for a member only if it
inflates to the end of a gzip member that holds one whole WARC record.  It owns the records that start inside its range, and reads
on past the range's end to finish the last.  A false magic inside compressed bytes fails the test and the scan goes on one byte
further.

Writing makes a file per task, under a name of its own per attempt; the driver's commit lists the files of the attempts that
counted in a list of its own, and only files of such lists are read.  So a lost executor leaves at most a file that nobody reads,
and a second write to a path adds to the first.

Paths are what pyarrow.fs opens: shared local folders, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rostrum.llm.storage import written

MAGIC, AHEAD, STEP, LISTED = b"\x1f\x8b\x08", 1 << 20, 1 << 15, "_committed-"
SPLIT, LEVEL, ROWS, BYTES = 32 << 20, 4, 512, 16 << 20
DATE = "2000-01-01T00:00:00Z"
COLUMNS = ["file", "start", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]
SCHEMA = "file string, start bigint, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, payload binary"
#: From here on equal payloads are kept once.
LEAST = 100


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def member(kind: str, record_id: str, refers_to: str | None, uri: str | None, digest: str, payload: bytes, size: int) -> bytes:
    """A record as a gzip member.  A revisit has the HTTP head only, and the length of the payload in a header of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>", f"X-Payload-Length: {size}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def record(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """The headers and the block, if the content is one whole WARC record."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = fields.get("content-length", "")
    if not size.isdecimal() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n") or "warc-type" not in fields:
        return None
    return fields, rest[:-4]


def members(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of the records that start in [start, end)."""
    held, base = bytearray(), start  # what is read and not yet passed, and the place of its first byte
    file.seek(start)

    def more() -> bool:
        got = file.read(AHEAD)
        held.extend(got)
        return bool(got)

    def passed(n: int) -> None:
        nonlocal base
        del held[:n]
        base += n

    while base < end:
        i = held.find(MAGIC)
        if i < 0:
            passed(max(0, len(held) - 2))
            if base >= end or not more():
                return
            continue
        passed(i)
        if base >= end:
            return
        inflate, out, used = zlib.decompressobj(31), bytearray(), 0
        try:
            while not inflate.eof and b"WARC/1."[: len(out)] == out[:7]:
                if used == len(held) and not more():
                    break
                given = bytes(held[used : used + STEP])
                out += inflate.decompress(given)
                used += len(given)
        except zlib.error:
            pass
        found = record(bytes(out)) if inflate.eof else None
        if found is None:
            passed(1)
        else:
            yield base, *found
            passed(used - len(inflate.unused_data))


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        store, root = opened(self.path)
        found = {x.path: x.size for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File}
        lists = sorted(p for p in found if p.rpartition("/")[2].startswith(LISTED))
        names = [f"{root}/{n}" for p in lists for n in json.loads(store.open_input_file(p).read())] if lists else sorted(p for p in found if p.endswith(".warc.gz"))
        return [Range(p, a, min(a + self.split, found[p])) for p in names for a in range(0, found[p], self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = opened(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], COLUMNS)

        with store.open_input_file(partition.file) as file:
            for at, h, block in members(file, partition.start, partition.end):
                # only blocks of HTTP messages have a head before the payload; those of other records are payload as a whole
                http = h.get("content-type", "").lower().startswith("application/http")
                payload = block.partition(b"\r\n\r\n")[2] if http else block
                whole = h["warc-type"] != "revisit"
                digest = hashlib.sha256(payload).hexdigest() if whole else h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                length = len(payload) if whole else int(h.get("x-payload-length", 0))
                rows.append((partition.file, at, h["warc-type"], h.get("warc-record-id", "").strip("<>"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, h.get("warc-target-uri"), digest, length, payload if whole else None))
                size += len(payload)
                if len(rows) >= ROWS or size >= BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name, file = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            if file is None:
                file = store.open_output_stream(f"{root}/{name}", compression=None)
            for row in zip(*(batch.column(c).to_pylist() for c in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload", "payload_bytes"))):
                file.write(member(*row))
        if file is not None:
            file.close()
        return Written(name if file is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{LISTED}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """spark.read.format("warc").option("split_bytes", n).load(path); df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split_bytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Records to write for rows (page_id, url, html).  Null html is empty.  Of equal payloads of at least ``least`` bytes, that of the
    smallest page_id is the response and those of larger or null ids revisit it; all rows of the smallest id are responses.

    The digests that occur twice are written first, from ids and digests alone, so Spark knows the size of their table: payloads are
    only shuffled where it is too large to be broadcast, and then a hot digest's rows are split, as the join is a left one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    same = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(written(same, "repeated"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") <= F.col("first"), F.lit(False))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return rows.select(
        F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        named("page_id").alias("record_id"), F.when(again, named("first")).alias("refers_to"), "target_uri", "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    register(pages.sparkSession)
    records(pages, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("split_bytes", split).load(path)


def page_of(urn: str):
    """The page's id in a record's name; null for other names."""
    return F.regexp_extract(F.col(urn), r"^urn:page:(-?\d+)$", 1).try_cast("long")
