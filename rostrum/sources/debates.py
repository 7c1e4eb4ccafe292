"""Debate XML archives: discovery, parsing and typed tables.

Files are read by Spark's binaryFile source; a task parses the files of its partition with a streaming parser and sends a row per
child of the root.  A file that breaks a rule gives one row with its error and nothing else; the others go on.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import keys, text
from rostrum.operators import ordered, streams

# Fixed values of the format.
ROOT, SPEECH = "debates", "speech"
BLOCKS, CONTAINERS = {"p", "li", "dt", "dd", "tr"}, {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot"}
NO_ALT = "[IMAGE]"

FILES = "path string, modificationTime timestamp, length bigint, content binary"
PARSED = (
    "source_file string, source_file_sha256 string, byte_size bigint, error string, sequence_number int, tag string, attributes map<string,string>, "
    "blocks array<struct<block_type:string,text_raw:string,text_clean:string>>, images array<struct<index:int,alt:string,replacement:string>>, "
    "heading string, payload_json string, bills_count int, bill_record_count int"
)


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 50 << 20
    elements: int = 2_000_000
    depth: int = 64
    text_chars: int = 10_000_000


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), length, content, path_error of every XML file below the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root)
    relative = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.select(relative.alias("source_file"), "length", "modificationTime", "content").withColumn("path_error", text.path_error(F.col("source_file")))


def changed(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files that are new or of another content than in a prior inventory (source_file, source_file_sha256)."""
    now = files.withColumn("source_file_sha256", F.sha2("content", 256))
    return now.join(prior.select("source_file", "source_file_sha256"), ["source_file", "source_file_sha256"], "left_anti")


def inventory_hash(files: DataFrame) -> DataFrame:
    """One row: how many files, and a hash of paths, sizes and contents in order of path."""
    line = F.concat("source_file", F.char(F.lit(0)), F.col("length").cast("string"), F.char(F.lit(0)), F.sha2("content", 256), F.lit("\n"))
    return streams.streamed_hash(files, ["source_file"], line).select(F.col("n").alias("n_files"), F.col("sha256").alias("inventory_sha256"))


def _nfc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def _spaced(s: str) -> str:
    return " ".join(_nfc(s).split())


def _inline(element: ET.Element, images: list[tuple], cell: str = "") -> tuple[str, str]:
    """Raw and clean text of an element with all its tails inside; images only show in the clean one."""
    raw, clean = [element.text or ""], [element.text or ""]
    for child in element:
        if child.tag == "img":
            alt = _spaced(child.get("alt") or "")
            images.append((len(images), alt or None, alt or NO_ALT))
            clean.append(images[-1][2])
        else:
            r, c = _inline(child, images)
            raw.append(r)
            clean.append(c)
        raw.append(child.tail or "")
        clean.append(child.tail or "")
    return "".join(raw), "".join(clean)


def _blocks(speech: ET.Element, images: list[tuple]) -> Iterator[tuple[str, str, str]]:
    if (speech.text or "").strip():
        yield "text", _nfc(speech.text).strip(), _spaced(speech.text)
    for child in speech:
        if child.tag in CONTAINERS:
            yield from _blocks(child, images)
        elif child.tag == "tr":
            cells = [_inline(c, images) for c in child]
            yield "tr", "\t".join(_nfc(r).strip() for r, _ in cells), "\t".join(_spaced(c) for _, c in cells)
        elif child.tag == "img":
            alt = _spaced(child.get("alt") or "")
            images.append((len(images), alt or None, alt or NO_ALT))
            yield "img", "", images[-1][2]
        else:
            raw, clean = _inline(child, images)
            yield child.tag, _nfc(raw).strip(), _spaced(clean)
        if (child.tail or "").strip():
            yield "text", _nfc(child.tail).strip(), _spaced(child.tail)


def _payload(element: ET.Element) -> dict:
    return {"attributes": dict(sorted(element.attrib.items())), "children": [_payload(c) for c in element], "tag": element.tag, "text": _spaced(element.text or "")}


def parse(content: bytes, limits: Limits = Limits()) -> tuple[list[tuple], str | None]:
    """Rows (tag, attributes, blocks, images, heading, payload, bills, bill records) of a file, or the code of what is wrong."""
    if len(content) > limits.file_bytes:
        return [], "FILE_TOO_LARGE"
    if re.search(rb"<!doctype", content[:65536], re.IGNORECASE):
        return [], "DOCTYPE"
    rows, depth, elements = [], 0, 0
    try:
        for event, e in ET.iterparse(io.BytesIO(content), ("start", "end")):
            if event == "start":
                depth, elements = depth + 1, elements + 1
                if depth == 1 and e.tag != ROOT:
                    return [], "ROOT"
                if depth > limits.depth or elements > limits.elements:
                    return [], "TOO_DEEP" if depth > limits.depth else "TOO_MANY_ELEMENTS"
                continue
            depth -= 1
            if len(e.text or "") > limits.text_chars:
                return [], "TEXT_TOO_LONG"
            if depth == 1:
                images: list[tuple] = []
                blocks = [*_blocks(e, images)] if e.tag == SPEECH else []
                head = "".join(e.itertext()) if e.tag.endswith("-heading") else None
                other = None if e.tag == SPEECH or head is not None else json.dumps(_payload(e), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
                rows.append((e.tag, {k: _nfc(v) for k, v in sorted(e.attrib.items())}, blocks, images, head, other, len(e.findall(".//bills")) + (e.tag == "bills"), len(e.findall(".//bill"))))
                e.clear()
    except ET.ParseError:
        return [], "MALFORMED"
    return rows, None


def parsed(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of PARSED for files (source_file, content, path_error).  Files are whole in memory one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, wrong in zip(*(batch.column(c) for c in ("source_file", "content", "path_error"))):
                raw = content.as_py()
                rows, error = ([], wrong.as_py()) if wrong.as_py() else parse(raw, limits)
                head = (name.as_py(), hashlib.sha256(raw).hexdigest(), len(raw))
                out = [(*head, None, i, *r) for i, r in enumerate(rows, 1)] if error is None else [(*head, error, None, *[None] * 8)]
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, _shaped(r))) for r in out], schema)

    def _shaped(r: tuple) -> tuple:
        b, i = r[7], r[8]
        blocks = None if b is None else [dict(zip(("block_type", "text_raw", "text_clean"), x)) for x in b]
        images = None if i is None else [dict(zip(("index", "alt", "replacement"), x)) for x in i]
        return (*r[:6], None if r[6] is None else [*r[6].items()], blocks, images, *r[9:])

    word, struct = pa.string(), lambda **f: pa.list_(pa.struct(list(f.items())))
    schema = pa.schema([
        ("source_file", word), ("source_file_sha256", word), ("byte_size", pa.int64()), ("error", word), ("sequence_number", pa.int32()), ("tag", word),
        ("attributes", pa.map_(word, word)), ("blocks", struct(block_type=word, text_raw=word, text_clean=word)), ("images", struct(index=pa.int32(), alt=word, replacement=word)),
        ("heading", word), ("payload_json", word), ("bills_count", pa.int32()), ("bill_record_count", pa.int32()),
    ])
    return files.select("source_file", "content", "path_error").mapInArrow(run, PARSED)


def fragments(rows: DataFrame, marker: str = "") -> DataFrame:
    """Speech fragments with their headings, boundary, texts, counts and warnings, from rows of PARSED."""
    speech, a = F.col("tag") == SPEECH, lambda k: F.col("attributes")[k]
    df = rows.filter("error is null")
    df = ordered.with_headings(df, "source_file", ["sequence_number"], F.col("tag") == "major-heading", F.col("tag") == "minor-heading", F.coalesce("heading", F.lit("")))
    kind = F.when(F.col("tag").isin("major-heading", "minor-heading", SPEECH, "division", "bills"), F.replace(F.col("tag"), F.lit("-"), F.lit("_"))).otherwise("event")
    df = ordered.with_boundaries(df, "source_file", ["sequence_number"], kind, speech).filter(speech)
    join = lambda part: F.array_join(F.filter(F.transform("blocks", lambda b: b[part]), lambda t: t != ""), "\n\n")
    df = df.select(
        "source_file", "source_file_sha256", "sequence_number", a("id").alias("source_fragment_id"), a("speakerid").alias("speaker_id_raw"), a("speakername").alias("speaker_name_raw"),
        a("talktype").alias("talktype_raw"), a("nospeaker").alias("nospeaker_raw"), a("time").alias("time_raw"), a("approximate_wordcount").alias("wordcount_raw"), a("url").alias("source_url"),
        join("text_raw").alias("text_raw"), join("text_clean").alias("text_clean"), F.col("blocks.block_type").alias("block_structure"), "images", "major", "minor", "segment",
        F.col("boundary_reason").alias("boundary_reason_before"), F.concat_ws("\n", "major", "minor").alias("heading"),
    )
    same_id = F.count("*").over(ordered.W.partitionBy("source_file", "source_fragment_id"))
    df = df.withColumns({"parsed_time": text.time_of(F.col("time_raw")), "calculated_word_count": text.words(F.col("text_clean")), "_same": same_id})
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    found = [
        F.when(none("source_fragment_id"), "SOURCE_FRAGMENT_ID_MISSING").when(F.col("_same") > 1, "DUPLICATE_SOURCE_FRAGMENT_ID"),
        F.when(none("speaker_id_raw"), "SPEAKER_ID_MISSING"), F.when(none("speaker_name_raw"), "SPEAKER_NAME_MISSING"),
        F.when(none("talktype_raw"), "TALKTYPE_MISSING").when(~F.col("talktype_raw").isin("speech", "continuation", "interjection"), "TALKTYPE_UNKNOWN"),
        F.when(text.time_class(F.col("time_raw")) == "MALFORMED", "TIME_MALFORMED").when(text.time_class(F.col("time_raw")) == "MISSING_OR_UNKNOWN", "TIME_MISSING_OR_UNKNOWN"),
        text.integer_warning(F.col("wordcount_raw"), "APPROXIMATE_WORDCOUNT"), F.when(none("text_clean"), "EMPTY_TEXT"), F.when(F.size("images") > 0, "IMAGE_PRESENT"),
        text.url_warning(F.col("source_url"), marker) if marker else F.lit(None).cast("string"),
    ]
    key = keys.stable_key("speech_fragment", F.col("source_file_sha256"), F.col("sequence_number"), F.col("source_fragment_id"))
    return df.withColumns({"warning_codes": text.codes(*found), "fragment_key": key}).drop("_same")


def sections(rows: DataFrame) -> DataFrame:
    """Major and minor headings; a minor one knows its major's key, and one without a major is left out."""
    heads = rows.filter("error is null and tag in ('major-heading', 'minor-heading')")
    key = keys.stable_key("debate_section", F.col("source_file_sha256"), F.col("sequence_number"), F.col("attributes")["id"])
    major = F.col("tag") == "major-heading"
    df = heads.select("source_file", "sequence_number", F.when(major, "major").otherwise("minor").alias("section_type"), F.col("heading").alias("heading_original"), text.heading(F.coalesce("heading", F.lit(""))).alias("heading_clean"), key.alias("section_key"))
    parent = ordered.previous(df, ["source_file"], ["sequence_number"], F.when(F.col("section_type") == "major", F.col("section_key")))
    return df.withColumn("parent_section_key", F.when(F.col("section_type") == "minor", parent)).filter("section_type = 'major' or parent_section_key is not null")


def events(rows: DataFrame) -> DataFrame:
    """What is neither speech nor heading, its payload as JSON, with the keys of the sections that it stands in."""
    section = keys.stable_key("debate_section", F.col("source_file_sha256"), F.col("sequence_number"), F.col("attributes")["id"])
    df = ordered.with_headings(rows.filter("error is null"), "source_file", ["sequence_number"], F.col("tag") == "major-heading", F.col("tag") == "minor-heading", section)
    df = df.filter(f"tag <> '{SPEECH}' and tag not in ('major-heading', 'minor-heading')")
    key = keys.stable_key("debate_event", F.col("source_file_sha256"), F.col("sequence_number"), F.col("attributes")["id"])
    unknown = F.when(~F.col("tag").isin("division", "bills"), "UNKNOWN_TOP_LEVEL_EVENT")
    minor = F.when(F.col("major").isNotNull(), F.col("minor"))  # a minor section without a major is no section
    return df.select("source_file", "sequence_number", F.col("major").alias("major_section_key"), minor.alias("minor_section_key"), F.col("tag").alias("element_type"), "payload_json", "bills_count", "bill_record_count", key.alias("event_key"), text.codes(unknown).alias("warning_codes"))


def images(fragments: DataFrame) -> DataFrame:
    """A row per image of a fragment, in order."""
    return fragments.select("fragment_key", "source_file", "sequence_number", F.posexplode("images").alias("image_ordinal", "image"))


def business(df: DataFrame, mapping: DataFrame, heading: str = "major") -> DataFrame:
    """Business type and flags by exact heading; unknown headings leave nulls.  ``mapping`` is a configuration table."""
    table = mapping.withColumn("_h", text.heading(F.col("heading"))).drop("heading").dropDuplicates(["_h"])
    return df.withColumn("_h", text.heading(F.col(heading))).join(table, "_h", "left").drop("_h")


def audit(rows: DataFrame) -> DataFrame:
    """(measure, value, n): elements, talk types and time formats over all files."""
    a = lambda k: F.col("attributes")[k]
    spoken = lambda c: F.when(F.col("tag") == SPEECH, c)
    values = {"tag": F.col("tag"), "talktype": spoken(F.coalesce(a("talktype"), F.lit(""))), "time": spoken(text.time_class(a("time"))), "error": F.col("error")}
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])
    return rows.select(F.inline(pairs)).filter("value is not null").groupBy("measure", "value").agg(F.count("*").alias("n"))

