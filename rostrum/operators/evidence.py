"""Evidence quoted by a model, found again in the source text.

Quotes, dashes and white space are compared in one form; offsets are those of the source, in code points.  Spark's functions can't
keep offsets through such a mapping, so aligning is a small Arrow function; quotes that stand in the text as they are need none of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points taken for a single quote, a double quote and a hyphen.
SINGLE = "\u2018\u2019\u201a\u201b`\u00b4"
DOUBLE = "\u201c\u201d\u201e\u201f"
HYPHEN = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"
RUN = re.compile(r"\s{2,}")
REPLACED = [(c, one) for chars, one in ((SINGLE, "'"), (DOUBLE, '"'), (HYPHEN, "-")) for c in chars]
#: Up to so many quotes of a text are searched one by one, which is quicker than an automaton.
FEW = 8


class Folded:
    """A text in its one form, with the way back to the source's places.

    Only runs of white space change places, so what is kept is where such runs end and how much they took.
    """

    def __init__(self, source: str):
        for c, one in REPLACED:
            if c in source:
                source = source.replace(c, one)
        self.source, self.text, self.ends, self.shifts = source, " ".join(source.split()), None, []

    def _runs(self) -> None:
        source = self.source
        self.ends, self.shifts = [0], [len(source) - len(source.lstrip())]
        inner = len(source.rstrip())
        if inner - self.shifts[0] == len(self.text):
            return
        for run in RUN.finditer(source, self.shifts[0], inner):
            self.ends.append(run.start() - self.shifts[-1] + 1)
            self.shifts.append(self.shifts[-1] + run.end() - run.start() - 1)

    def place(self, at: int) -> int:
        if self.ends is None:  # most texts are only searched
            self._runs()
        return at + self.shifts[bisect_right(self.ends, at) - 1]


def resolved(text: str | None, quotes: list[str | None]) -> list[tuple[str, int | None, int | None]]:
    """(matched | unmatched | ambiguous, start, end) of each quote.  Overlapping hits count as several.

    The text is folded once; two hits of each quote at most are noted.  Many quotes are found in one reading by an automaton.
    """
    wanted = [Folded(q or "").text for q in quotes]
    hits: dict[str, list[int]] = {w: [] for w in wanted if w}
    source = Folded(text) if hits and text else None
    if source and len(hits) <= FEW:
        for w, ends in hits.items():
            at = source.text.find(w)
            while at >= 0 and len(ends) < 2:
                ends.append(at + len(w) - 1)
                at = source.text.find(w, at + 1)
    elif source:
        automaton = ahocorasick.Automaton()
        for w in hits:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for end, w in automaton.iter(source.text):
            if len(hits[w]) < 2:
                hits[w].append(end)
    out: list[tuple[str, int | None, int | None]] = []
    for w in wanted:
        ends = hits.get(w, ())
        if len(ends) == 1:
            out.append(("matched", source.place(ends[0] - len(w) + 1), source.place(ends[0]) + 1))
        else:
            out.append(("ambiguous" if ends else "unmatched", None, None))
    return out


ALIGNED = T.StructType([T.StructField("status", T.StringType()), T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType())])


@F.pandas_udf(ALIGNED)
def align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, quote in batches:
        rows = [resolved(t, [q])[0] for t, q in zip(text, quote, strict=True)]
        found = pd.DataFrame(rows, columns=["status", "start_offset", "end_offset"])
        yield found.astype({"start_offset": "Int32", "end_offset": "Int32"})


@F.pandas_udf(T.ArrayType(ALIGNED))
def align_all(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, quotes in batches:
        yield pd.Series([None if q is None else [dict(zip(ALIGNED.names, r)) for r in resolved(t, list(q))] for t, q in zip(text, quotes, strict=True)], dtype=object)


def located(df: DataFrame, text: str, quote: str) -> DataFrame:
    """Adds ``status``, ``start_offset`` and ``end_offset`` of the quote in the text."""
    df = df.withColumn("_e", align(F.col(text), F.col(quote)))
    return df.select("*", "_e.*").drop("_e")


def exact_hits(text: Column, quote: Column) -> Column:
    """How often a quote stands in a text as it is, overlapping hits not counted."""
    return F.when(F.length(quote) > 0, (F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).otherwise(0).cast("long")
