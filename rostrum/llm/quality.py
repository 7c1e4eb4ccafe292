"""Quality rules: base statistics of a text, then a hashed n-gram likelihood ratio.  DataFrame functions only.

The ratio is of two multinomials over hashed words and pairs of words: one of trusted documents (labelled of quality and not toxic),
one of all documents.  A text's score is the mean log ratio of its n-grams.  The least score to be kept is learned too: a quarter of
the trusted documents, by a hash of their ids, is left out of the counts, and the least score lies under nearly all of theirs.

A null text counts as having no word.  A null ``doc_id`` is kept as it is and has no label; repeated rows each get their result.
Without labels all ratios are zero, and texts that pass the base rules are kept.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm.columns import aside, restored
from rostrum.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: The number of buckets that n-grams are hashed into is the power of two from so many times the cube root of the corpus's bytes on:
#: 2^14 at 0.5 GB, 2^20 at 100 TB.  The model is one number a bucket, so what the driver and each task hold grows that slowly.
PER_ROOT = 16
#: Trusted ids that are broadcast at most (some 50 MB), so that no text is shuffled; beyond that the texts are shuffled once.  All trusted
#: documents are learned from either way.
BROADCAST = 2_000_000
#: The least score kept lies under this share of the left-out trusted scores by this part of the way from their median to there.
SHARE, MARGIN = 0.001, 0.5
#: The least score where no trusted document is left out to learn it from.
THRESHOLD = -0.06


def without(text: Column, chars: str) -> Column:
    return reduce(lambda s, c: F.replace(s, F.lit(c), F.lit("")), chars, text)


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_text`` and ``_h``, the hashes of the text's words in order."""
    words = F.regexp_extract_all(F.col("_text"), F.lit(WORD), F.lit(0))
    return df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))


def with_base(df: DataFrame) -> DataFrame:
    """Adds the four base counts, ``n_words`` and ``base_failed``, given ``with_words``.

    Windows are compared by 64-bit hashes.  Repeats are looked for by sorting (hash, place), in n log n steps.
    """
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(5)])
    df = df.withColumns({
        "n_words": F.size("_h").cast("long"),
        "word_chars": F.length(without(F.col("_text"), SPACES)).cast("long"),
        "n_symbols": (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long"),
        "_lines": lines,
        "_windows": F.when(F.size("_h") >= 5, F.transform(F.sequence(F.lit(0), F.size("_h") - 5), window)),
    }).withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_placed": F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    })
    same = lambda s, k: F.coalesce(s["h"] == F.get("_placed", k)["h"], F.lit(False))
    twice = F.filter("_placed", lambda s, k: same(s, k - 1) | same(s, k + 1))
    starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(acc["end"], i)).alias("n"), (i + 5).alias("end")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_lines", "_windows", "_placed")


def with_grams(df: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_grams``: the buckets of the words and of the pairs of neighbours, repeats included."""
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    pairs = F.when(F.size("_h") > 1, F.transform(F.sequence(F.lit(0), F.size("_h") - 2), lambda i: bucket(F.xxhash64(F.get("_h", i), F.get("_h", i + 1)))))
    return df.withColumn("_grams", F.concat(F.transform("_h", bucket), F.coalesce(pairs, F.array().cast("array<int>"))))


def buckets_for(documents: DataFrame) -> int:
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << math.ceil(math.log2(max(64.0, PER_ROOT * size ** (1 / 3))))


def trusted(labels: DataFrame) -> DataFrame:
    """(_id, _out) of all trusted documents: whether they are left out of the counts, as a quarter is by a hash of their ids."""
    good = labels.filter((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").alias("_id")).distinct().withColumn("_out", F.crc32(F.col("_id").cast("string")) % 4 == 0)


def trusted_documents(documents: DataFrame, labels: DataFrame, most: int = BROADCAST) -> DataFrame:
    """(doc_id, text, _out) of all trusted documents, written once.  More than ``most`` ids are not broadcast."""
    good = trusted(labels)
    good = F.broadcast(good) if good.count() <= most else good.hint("shuffle_hash")
    return written(documents.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_id")).drop("_id"), "trusted_texts")


def counts(documents: DataFrame, buckets: int) -> list[int]:
    """Occurrences of each bucket's n-grams; ``buckets`` rows come to the driver."""
    grams = with_grams(with_words(documents.select("text")), buckets)
    # explode() would infer a filter on the array, which the optimizer pushes down with the array's whole expression in it
    found, out = grams.select(F.explode_outer("_grams").alias("bucket")).groupBy("bucket").count().collect(), [0] * buckets
    for r in filter(lambda r: r["bucket"] is not None, found):
        out[r["bucket"]] = r["count"]
    return out


def fit(documents: DataFrame, mine: DataFrame, buckets: int) -> list[float]:
    """log p_target / p_raw of each bucket, with add-one smoothing.

    Raw counts are of all documents, the target's of all ``trusted_documents`` but those left out.  With none of these the ratio is zero
    everywhere.
    """
    target = counts(mine.filter(~F.col("_out")), buckets)
    if not sum(target):
        return [0.0] * buckets
    raw = counts(documents, buckets)
    shift = math.log((sum(raw) + buckets) / (sum(target) + buckets))
    return [round(math.log((t + 1) / (n + 1)) + shift, 5) for t, n in zip(target, raw, strict=True)]


def with_ratio(df: DataFrame, model: list[float]) -> DataFrame:
    """Adds ``llr``: the mean over all n-grams of the text; null without any."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate("_grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return df.withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams")))


def least_kept(mine: DataFrame, model: list[float]) -> float:
    """The least score, from those of the trusted documents that were left out and pass the base rules."""
    scored = with_ratio(with_grams(with_base(with_words(mine.filter("_out").select("text"))), len(model)), model)
    low, middle = scored.select(F.when(~F.col("base_failed"), F.col("llr")).alias("llr")).agg(F.percentile_approx("llr", [SHARE, 0.5])).first()[0] or (None, None)
    return THRESHOLD if low is None else low - MARGIN * (middle - low)


def ruled(documents: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int | None = None) -> DataFrame:
    mine = trusted_documents(documents, labels)
    model = fit(documents, mine, buckets or buckets_for(documents))
    threshold = least_kept(mine, model) if threshold is None else threshold
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))
    return with_ratio(with_grams(with_base(with_words(aside(documents))), len(model)), model).withColumn("kept", kept)


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int | None = None) -> DataFrame:
    """``documents`` with the base counts, ``base_failed``, ``llr`` and ``kept``.  Columns of these names are replaced.  The least score
    and the number of buckets are found from the tables if not given."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    return restored(ruled(documents, labels, threshold, buckets), documents, made)


def passing(documents: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int | None = None) -> DataFrame:
    """The rows of ``documents`` that are kept.

    The verdict passes through a generator, as a filter right on it would be pushed down to the scan with all expressions behind it
    written out in one another.
    """
    worked = ruled(documents, labels, threshold, buckets)
    return restored(worked.select("_row", F.explode_outer(F.array("kept")).alias("kept")).filter("kept"), documents, [])
