"""Column functions on text: white space, words, times, numbers, warning codes.

All are built of Spark's own functions, so they stay inside generated code, except ``nfc`` and ``casefold``, which Spark lacks.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def _beyond_ascii(c: Column) -> Column:
    """The value if it has other characters, else null, so that only such values go to Python."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), c)


def nfc(c: Column) -> Column:
    """Below U+0300, where combining marks start, every text is composed already, so only texts beyond go to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\u02FF]"), c)), c)


def casefold(c: Column) -> Column:
    return F.coalesce(_casefold(_beyond_ascii(c)), F.lower(c))


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean(c: Column) -> Column:
    """Composed characters; runs of white space of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(nfc(c), SPACE, " "))


def raw(c: Column) -> Column:
    """Composed characters, line ends made alike and white space stripped at both ends only."""
    return F.regexp_replace(line_ends(nfc(c)), rf"^{SPACE}|{SPACE}$", "")


def words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def identity(c: Column) -> Column:
    """A name or id for comparison: composed characters, white space collapsed, case folded, null as empty."""
    return casefold(clean(F.coalesce(c, F.lit(""))))


def heading(c: Column) -> Column:
    return clean(c)


def usable(clean_text: Column, raw_text: Column) -> Column:
    """Has text to work on.  A clean text that is there but blank does not fall through to the raw one; spaces only are blank."""
    return (
        F.when(F.length(clean_text) > 0, F.length(F.btrim(clean_text)) > 0)
        .when(F.length(raw_text) > 0, F.length(F.btrim(raw_text)) > 0)
        .otherwise(False)
    )


def prompt_text(clean_text: Column, raw_text: Column) -> Column:
    """The first of both that is not empty."""
    return F.coalesce(F.nullif(clean_text, F.lit("")), F.nullif(raw_text, F.lit("")), F.lit(""))


def time_class(c: Column) -> Column:
    return (
        F.when(c.isNull() | c.isin("", "unknown"), "MISSING_OR_UNKNOWN")
        .when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), "HH:MM:SS")
        .when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "HH:MM")
        .otherwise("MALFORMED")
    )


def time_of(c: Column) -> Column:
    """``HH:mm:ss`` of a well-formed time, else null."""
    kind = time_class(c)
    return F.when(kind == "HH:MM:SS", c).when(kind == "HH:MM", F.concat(c, F.lit(":00")))


def integer_warning(c: Column, field: str) -> Column:
    return F.when(c.isNull() | (c == ""), f"{field}_MISSING").when(~c.rlike(r"^\d+$"), f"{field}_MALFORMED")


def url_warning(c: Column, marker: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(~F.lower(c).contains(marker.lower()), "SOURCE_URL_UNEXPECTED")


def codes(*found: Column) -> Column:
    """Warning codes as a sorted set; nulls drop out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def path_error(c: Column) -> Column:
    """Why a relative path is not ``YYYY/YYYY-MM-DD.xml``; null if it is."""
    folder, date = F.regexp_extract(c, r"^(\d{4})/", 1), F.regexp_extract(c, r"^\d{4}/(\d{4}-\d{2}-\d{2})\.xml$", 1)
    return (
        F.when(date == "", "PATH_FORMAT")
        .when(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNull(), "PATH_DATE")
        .when(folder != F.substring(date, 1, 4), "PATH_YEAR")
    )


def tokens_estimated(c: Column, fixed: int = 4131) -> Column:
    """Input tokens of a record: a fixed prompt and a token for every three bytes, one at least."""
    return F.lit(fixed) + F.greatest(F.lit(1), F.ceil(F.octet_length(c) / 3)).cast("long")


def excerpt(c: Column, n: int) -> list[Column]:
    return [F.left(c, F.lit(n)).alias("text"), (F.length(c) > n).alias("text_truncated")]


def csv_cell(c: Column, kind: str) -> Column:
    """A value as a plain CSV cell: null is empty, lists are joined by `` | ``, structs are JSON."""
    if kind.startswith("array<string"):
        return F.coalesce(F.array_join(c, " | "), F.lit(""))
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def yes_no_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def seconds_between(start: Column, end: Column) -> Column:
    """Of two ISO 8601 times; null if either is none."""
    return F.timestamp_diff("MICROSECOND", F.try_to_timestamp(start), F.try_to_timestamp(end)) / 1e6


def path_head(c: Column) -> Column:
    """The first part of a path as a number; null if it is none."""
    return F.split_part(c, F.lit("/"), F.lit(1)).try_cast("int")


def prompt(system: Column, user: Column) -> list[Column]:
    """A record's prompt and its hash: the code book's text, then the record's."""
    whole = F.concat(system, F.lit("\n\n"), user)
    return [whole.alias("prompt"), F.sha2(whole, 256).alias("prompt_sha256")]
