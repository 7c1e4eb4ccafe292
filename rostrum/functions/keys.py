"""Stable keys and fingerprints, by SHA-256 of canonical JSON (sorted names, no white space, non-ASCII kept)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "1.0.0"


def json_text(c: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("a")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def stable_key(kind: str, source_sha: Column, sequence: Column, discriminator: Column, version: str = VERSION) -> Column:
    """The key of one record of a source file.  A null discriminator counts as empty."""
    said = F.concat(
        F.lit('{"discriminator":'), json_text(discriminator), F.lit(f',"kind":"{kind}","pipeline_version":"{version}","sequence_number":'),
        sequence.cast("string"), F.lit(',"source_file_sha256":"'), source_sha, F.lit('"}'),
    )
    return F.sha2(said, 256)


def record_hash(*columns: str) -> Column:
    """A record's hash: its columns in order of name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def ordered_ids(order: Column, key: Column) -> Column:
    """An aggregate: ids in order, as an array.  For sets that are bounded by what they are for: a sample, a chunk, a campaign."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), key.alias("k")))), lambda x: x["k"])


def list_hash(ids: Column) -> Column:
    """SHA-256 of the JSON list of string ids."""
    return F.sha2(F.to_json(ids), 256)


def lines_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, "\n"), 256)


def seeded(key: Column, seed: str, how: str = "md5") -> Column:
    """A pseudo-random order of keys.  ``md5``: of key and seed; ``sha256``: of ``key:seed``."""
    key = key.cast("string")
    return F.md5(F.concat(key, F.lit(seed))) if how == "md5" else F.sha2(F.concat(key, F.lit(":" + seed)), 256)
