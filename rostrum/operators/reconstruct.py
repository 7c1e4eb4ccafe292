"""Speaker turns from ordered fragments.

A fragment is an interjection (I), a continuation (C) or a start (S for a speech that later continuations may join, O for one that
none may).  A continuation joins the open turn if no boundary stands before it and its speaker is that of the turn's first fragment:
by known ids, else by the same usable name.  Otherwise it is an orphan, a turn of its own, which may be joined if it has a name.

What a continuation joins depends on what those before it did, so this is a fold.  But a start or a boundary always resets the
open turn, so runs between resets are independent: they are the groups, and folding them is all the sequential work there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import text

BLOCKING = ("DUPLICATE_SOURCE_FRAGMENT_ID", "SOURCE_FRAGMENT_ID_MISSING")


@dataclass(frozen=True)
class Rules:
    """Names are compared by text.identity; patterns must match all of a text with its white space collapsed."""

    unknown_ids: tuple[str, ...] = ("", "unknown")
    unknown_names: tuple[str, ...] = ("", "unknown", "unknown member")
    collective: dict[str, str] = None
    interjection_code: str = "COLLECTIVE_INTERJECTION"

    def groups(self) -> dict[str, str]:
        return {k.casefold(): v for k, v in (self.collective or {}).items()}


def classified(fragments: DataFrame, rules: Rules) -> DataFrame:
    """Adds kind, speaker (known id or null), name (usable or null), blocked and collective (null if the name is unknown)."""
    name, who = text.identity(F.col("speaker_name_raw")), text.identity(F.col("speaker_id_raw"))
    groups = rules.groups()
    spoken = text.clean(F.coalesce("text_clean", F.lit("")))
    says = F.lit(False)
    for group, pattern in groups.items():
        says = says | ((name == group) & spoken.rlike(f"^(?:{pattern})$"))
    known = ~who.isin(*rules.unknown_ids)
    collective = F.when(name.isin(*rules.unknown_names), F.lit(None)).otherwise(name.isin(*groups) if groups else F.lit(False))
    shouted = (F.col("talktype_raw") == "speech") & ~known & says
    usable = ~name.isin(*rules.unknown_names, *groups)
    opens = (F.col("talktype_raw") == "speech") & usable & ~F.coalesce(collective, F.lit(False)) & ~F.coalesce(F.col("nospeaker_raw") == "true", F.lit(False))
    kind = F.when((F.col("talktype_raw") == "interjection") | shouted, "I").when(F.col("talktype_raw") == "continuation", "C").when(opens, "S").otherwise("O")
    return fragments.withColumns({
        "kind": kind, "shouted": F.coalesce(shouted, F.lit(False)), "speaker": F.when(known, F.col("speaker_id_raw")), "name": F.when(usable, name),
        "blocked": F.arrays_overlap(F.coalesce("warning_codes", F.array().cast("array<string>")), F.array(*map(F.lit, BLOCKING))), "collective": collective,
    })


# Reasons that a fold gives.
BLOCKED, ID_MATCH, ID_MISMATCH = "BLOCKING_IDENTITY_WARNING", "CONTINUATION_SPEAKER_ID_MATCH", "KNOWN_SPEAKER_ID_MISMATCH"
NAME_MATCH, AMBIGUOUS, NO_CANDIDATE = "CONTINUATION_EXACT_NAME_FALLBACK", "IDENTITY_MISSING_OR_AMBIGUOUS", "NO_ACTIVE_CANDIDATE"
SCOPE, SAME_SCOPE, NO_TURN = "HEADING_SCOPE_CHANGED", "ACTIVE_TURN_SAME_SCOPE", "NO_ACTIVE_TURN"


class Turn(NamedTuple):
    """The first fragment of the open turn."""

    seq: int
    speaker: str | None
    name: str | None
    blocked: bool
    heading: str


def _why(turn: Turn, f: Turn) -> tuple[bool, str]:
    """Does a continuation join the open turn, and why or why not."""
    if turn.heading != f.heading:
        return False, SCOPE
    if turn.blocked or f.blocked:
        return False, BLOCKED
    if turn.speaker is not None and f.speaker is not None:
        return (True, ID_MATCH) if turn.speaker == f.speaker else (False, ID_MISMATCH)
    return (True, NAME_MATCH) if turn.name is not None and turn.name == f.name else (False, AMBIGUOUS)


def _step(turn: Turn | None, kind: str, f: Turn, boundary: str | None, shouted: bool, shout: str) -> tuple[str, str | None, int | None, Turn | None]:
    """relation, reason, the turn it belongs to, and the open turn after the fragment."""
    if boundary is not None:
        turn = None
    if kind == "I":
        if turn is None:
            return "interjection", boundary or NO_TURN, None, None
        return "interjection", shout if shouted else SAME_SCOPE, turn.seq, turn
    if kind != "C":
        return "initial", None, f.seq, f if kind == "S" else None
    joined, why = (False, boundary or NO_CANDIDATE) if turn is None else _why(turn, f)
    if joined:
        return "continuation", why, turn.seq, turn
    return "orphan", why, f.seq, f if f.name is not None and not f.blocked else None


def fold(fragments: DataFrame, rules: Rules) -> DataFrame:
    """A row per fragment: file, seq, kind, relation, reason, turn (the seq of the turn's first fragment; of an interjection the turn it
    interrupts; else null) and candidate (for an orphan the turn that was open before it, even before a boundary).

    ``fragments``: source_file, sequence_number, talktype_raw, speaker_id_raw, speaker_name_raw, nospeaker_raw, text_clean,
    warning_codes, boundary_reason_before (null if none), heading (the scope; may be null).

    Runs are dealt over tasks, sorted, and streamed through with the open turn as the only state, so a run of any length takes time in
    proportion to its fragments.
    """
    w = W.partitionBy("source_file").orderBy("sequence_number")
    df = classified(fragments, rules).withColumn("run", F.sum(F.when(F.col("kind").isin("S", "O") | F.col("boundary_reason_before").isNotNull(), 1).otherwise(0)).over(w))
    seq = fragments.schema["sequence_number"].dataType.simpleString()
    shout = rules.interjection_code
    names = ["source_file", "run", "sequence_number", "kind", "speaker", "name", "blocked", "heading", "boundary_reason_before", "shouted"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, turn = None, None
        for batch in batches:
            out = []
            for file, run, n, kind, speaker, name, blocked, heading, boundary, shouted in zip(*(batch.column(c).to_pylist() for c in names)):
                if (file, run) != of:
                    of, turn = (file, run), None
                relation, reason, mine, turn = _step(turn, kind, Turn(n, speaker, name, blocked, heading), boundary, shouted, shout)
                out.append((relation, reason, mine, turn.seq if turn else None))
            number = batch.schema.field("sequence_number").type
            more = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), number, number))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_file", "sequence_number", "kind")), *more], ["source_file", "sequence_number", "kind", "relation", "reason", "turn", "_open"])

    rows = df.select(*names[:7], F.coalesce("heading", F.lit("")).alias("heading"), *names[8:]).repartition("source_file", "run").sortWithinPartitions("source_file", "run", "sequence_number")
    kind = fragments.schema["source_file"].dataType.simpleString()
    folded = rows.mapInArrow(stream, f"source_file {kind}, sequence_number {seq}, kind string, relation string, reason string, turn {seq}, _open {seq}")
    before = F.lag("_open").over(w)  # what the fragment before left open, if only in an earlier run
    return folded.withColumn("candidate", before).withColumn("candidate", F.when(F.col("relation") == "orphan", F.col("candidate"))).drop("_open")


def turns(fragments: DataFrame, folded: DataFrame) -> DataFrame:
    """A row per turn: its fragments' texts joined by blank lines, counts, first and last fragment, warnings."""
    rows = folded.join(fragments.select("source_file", "sequence_number", "text_clean", "warning_codes"), ["source_file", "sequence_number"])
    own = F.col("relation") != "interjection"
    part = F.struct("sequence_number", F.coalesce("text_clean", F.lit("")).alias("t"), F.coalesce("warning_codes", F.array().cast("array<string>")).alias("w"))
    t = rows.filter("turn is not null").groupBy("source_file", "turn").agg(
        F.array_sort(F.collect_list(F.when(own, part))).alias("_p"), F.count_if(~own).alias("interruption_count"), F.min("sequence_number").alias("first_fragment_sequence"),
    )
    joined = F.array_join(F.filter(F.transform("_p", lambda p: p["t"]), lambda s: s != ""), "\n\n")
    t = t.select(
        "source_file", F.col("turn").alias("first_fragment_sequence"), F.element_at(F.col("_p.sequence_number"), -1).alias("last_fragment_sequence"),
        F.size("_p").alias("fragment_count"), "interruption_count", joined.alias("text"), F.array_sort(F.array_distinct(F.flatten("_p.w"))).alias("warning_codes"),
    )
    return t.withColumns({
        "turn_sequence": F.row_number().over(W.partitionBy("source_file").orderBy("first_fragment_sequence")), "word_count": text.words(F.col("text")),
    })


def lineage(folded: DataFrame) -> DataFrame:
    """A row per fragment of a turn: its ordinal in it, from 1."""
    own = folded.filter("relation <> 'interjection'")
    return own.withColumn("ordinal", F.row_number().over(W.partitionBy("source_file", "turn").orderBy("sequence_number")))


def eligible(talktype: Column, collective: Column, procedural: Column, ceremonial: Column, words: Column, least: int = 50) -> Column:
    """May a fragment be labelled.  Not known to be collective counts as not collective; unknown procedure makes the answer unknown."""
    return (talktype == "speech") & ~F.coalesce(collective, F.lit(False)) & ~procedural & ~ceremonial & (words >= least)
