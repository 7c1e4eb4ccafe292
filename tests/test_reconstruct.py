"""Turn reconstruction: the specified cases, and random sequences against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from rostrum.functions import text
from rostrum.operators import reconstruct
from rostrum.plans.corpus import RULES

SCHEMA = "source_file string, sequence_number int, talktype_raw string, speaker_id_raw string, speaker_name_raw string, nospeaker_raw string, text_clean string, warning_codes array<string>, boundary_reason_before string, heading string"


def fragment(n, talk, who, name, boundary=None, said="words here", warnings=(), file="f", nospeaker=None):
    return file, n, talk, who, name, nospeaker, said, list(warnings), boundary, ""


def folded(spark, rows):
    return {(r.source_file, r.sequence_number): r for r in reconstruct.fold(spark.createDataFrame(rows, SCHEMA), RULES).collect()}


def test_cases(spark):
    rows = [
        fragment(1, "speech", "1", "Ann", "FILE_START", "one"), fragment(2, "interjection", "2", "Bob"), fragment(3, "continuation", "1", "Ann", said="two three"),
        fragment(4, "speech", "unknown", "Honourable Members", said="Honourable  members interjecting—"), fragment(5, "continuation", "unknown", "ann"),
        fragment(6, "speech", "unknown", "Honourable Members", said="Hear, hear!"), fragment(7, "continuation", "1", "Ann"), fragment(8, "continuation", "1", "Ann", "MINOR_HEADING_BOUNDARY"),
        fragment(9, "continuation", "3", "Ann"), fragment(10, "speech", "4", "Cid", warnings=["DUPLICATE_SOURCE_FRAGMENT_ID"]), fragment(11, "continuation", "4", "Cid"),
        fragment(12, "speech", "5", "Dee", nospeaker="true"), fragment(13, "continuation", "5", "Dee"), fragment(14, "continuation", "unknown", "unknown"), fragment(15, "interjection", "9", "X", "DIVISION_BOUNDARY"),
        fragment(16, "speech", "1", "X"), fragment(17, "continuation", "unknown", "X"), fragment(18, "continuation", "1", "Y"),
    ]
    got = folded(spark, rows)
    want = {
        1: ("initial", None, 1), 2: ("interjection", "ACTIVE_TURN_SAME_SCOPE", 1), 3: ("continuation", "CONTINUATION_SPEAKER_ID_MATCH", 1),
        4: ("interjection", "COLLECTIVE_INTERJECTION_EXPLICIT_PATTERN", 1), 5: ("continuation", "CONTINUATION_EXACT_NAME_FALLBACK", 1), 6: ("initial", None, 6),
        7: ("orphan", "NO_ACTIVE_CANDIDATE", 7), 8: ("orphan", "MINOR_HEADING_BOUNDARY", 8), 9: ("orphan", "KNOWN_SPEAKER_ID_MISMATCH", 9), 10: ("initial", None, 10),
        11: ("orphan", "BLOCKING_IDENTITY_WARNING", 11), 12: ("initial", None, 12), 13: ("orphan", "NO_ACTIVE_CANDIDATE", 13), 14: ("orphan", "IDENTITY_MISSING_OR_AMBIGUOUS", 14),
        15: ("interjection", "DIVISION_BOUNDARY", None), 16: ("initial", None, 16), 17: ("continuation", "CONTINUATION_EXACT_NAME_FALLBACK", 16), 18: ("continuation", "CONTINUATION_SPEAKER_ID_MATCH", 16),
    }
    assert {n: (r.relation, r.reason, r.turn) for (_, n), r in got.items()} == want
    assert {n: got["f", n].candidate for n in (8, 9, 11)} == {8: 7, 9: 8, 11: 10}
    df = spark.createDataFrame(rows, SCHEMA)
    turns = {r.first_fragment_sequence: r for r in reconstruct.turns(df, reconstruct.fold(df, RULES)).collect()}
    assert (turns[1].text, turns[1].fragment_count, turns[1].interruption_count, turns[1].word_count) == ("one\n\ntwo three\n\nwords here", 3, 2, 5)
    assert [r.turn_sequence for _, r in sorted(turns.items())] == [*range(1, len(turns) + 1)]


def plain(rows):
    """The rules once more, one fragment after another."""
    out, state = {}, {}
    for file, n, talk, who, name, nospeaker, said, warnings, boundary, _ in sorted(rows, key=lambda r: r[:2]):
        previous = state.get(file)
        current = None if boundary else previous
        known, usable = who not in ("", "unknown"), name.lower() not in ("", "unknown", "honourable members")
        bad = bool(warnings)
        mine = (n, who if known else None, name.lower() if usable else None, bad)
        shout = talk == "speech" and not known and name == "Honourable Members" and said == "Honourable members interjecting"
        if talk == "interjection" or shout:
            why = ("COLLECTIVE_INTERJECTION_EXPLICIT_PATTERN" if shout else "ACTIVE_TURN_SAME_SCOPE") if current else boundary or "NO_ACTIVE_TURN"
            out[file, n] = ("interjection", why, current and current[0], None)
        elif talk == "continuation":
            if boundary:
                why = boundary
            elif not current:
                why = "NO_ACTIVE_CANDIDATE"
            elif bad or current[3]:
                why = "BLOCKING_IDENTITY_WARNING"
            elif known and current[1]:
                why = "CONTINUATION_SPEAKER_ID_MATCH" if who == current[1] else "KNOWN_SPEAKER_ID_MISMATCH"
            elif usable and current[2] == name.lower():
                why = "CONTINUATION_EXACT_NAME_FALLBACK"
            else:
                why = "IDENTITY_MISSING_OR_AMBIGUOUS"
            if why.startswith("CONTINUATION"):
                out[file, n] = ("continuation", why, current[0], None)
            else:
                out[file, n] = ("orphan", why, n, previous and previous[0])
                current = mine if usable and not bad else None
        else:
            out[file, n] = ("initial", None, n, None)
            current = mine if talk == "speech" and usable and nospeaker != "true" else None
        state[file] = current
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_sequences(spark, seed):
    rng = random.Random(seed)
    rows = []
    for file in range(15):
        for n in range(1, 60):
            first = n == 1 or rng.random() < 0.12
            rows.append(fragment(
                n, rng.choice(["speech", "speech", "continuation", "continuation", "continuation", "interjection", None]), rng.choice(["1", "2", "unknown", ""]), rng.choice(["Ann", "Bob", "unknown", "Honourable Members"]),
                rng.choice(["FILE_START", "DIVISION_BOUNDARY"]) if first else None, rng.choice(["Honourable members interjecting", "said"]), ["SOURCE_FRAGMENT_ID_MISSING"] if rng.random() < 0.1 else [], f"f{file}", rng.choice([None, None, "true"]),
            ))
    assert {k: (r.relation, r.reason, r.turn, r.candidate) for k, r in folded(spark, rows).items()} == plain(rows)


def test_eligibility_is_three_valued(spark):
    df = spark.createDataFrame([("speech", None, False, False, 60), ("speech", False, None, False, 60), ("speech", True, False, False, 60), ("speech", False, False, False, 10)], "t string, c boolean, p boolean, q boolean, n int")
    got = [r[0] for r in df.select(reconstruct.eligible(*[F.col(x) for x in "tcpqn"])).collect()]
    assert got == [True, None, False, False]
    assert df.select(text.words(F.lit("it’s 3 a-b"))).first()[0] == 4
