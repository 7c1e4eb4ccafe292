"""Language identification by word-first backoff.

The model holds, for each language, log frequencies of known words and of character n-grams of words.  A word of a text that is
known scores by its log frequencies; an unseen one by the mean of its n-grams of the greatest length of which any is known, down
to single letters.  Words are runs of letters, in lower case, however long.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.  Ties go to the language
that sorts first.  Repeated rows each get their result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.storage import settled, written

#: Documents of each language that the model is learned from, in expectation.
LEARN = 5_000
#: Words, and n-grams of each length up to LONGEST, that the model holds; each language has an equal share, of its most frequent.
WORDS, GRAMS, LONGEST = 60_000, 30_000, 4
WORD = re.compile(r"[^\W\d_]+")
#: What is added to each count.
FLOOR = 0.5
#: Unseen words that a worker remembers the score of.
REMEMBERED = 300_000


def words_of(text: str | None) -> list[str]:
    words = WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):  # numerals of other kinds are no letters
        words = [w for w in ("".join(filter(str.isalpha, w)) for w in words) if w]
    return words


def grams_of(word: str, size: int) -> list[str]:
    """The word's n-grams; but for single letters, of the word with its ends marked."""
    padded = f"^{word}$" if size > 1 else word
    return [padded[k : k + size] for k in range(len(padded) - size + 1)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(documents: DataFrame, learn_from: int) -> DataFrame:
    """lang and text of about ``learn_from`` documents of each language that are not held out, by a hash of their ids and texts; of all
    where a language has fewer.  Shares are of all 64 bits of the hash, so they don't vanish in a large corpus."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    part = rows.groupBy("lang").agg((F.lit(2.0**64 * learn_from) / F.count("*") - F.lit(2.0**63)).alias("below"))
    # written, so that Spark knows that it is small and doesn't shuffle texts by language
    return rows.join(written(part, "shares"), "lang").filter(F.col("h") < F.col("below")).select("lang", "text")


def counted(rows: DataFrame) -> DataFrame:
    """(size, gram, lang, n): words have size 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, words = whole.slice(at, 256), Counter()
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    words.update((lang, w) for w in words_of(text))
                found: Counter = Counter()
                for (lang, word), n in words.items():
                    found[0, word, lang] += n
                    for size in range(1, LONGEST + 1):
                        for g in grams_of(word, size):
                            found[size, g, lang] += n
                keys = [pa.array([k[i] for k in found], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found.values(), pa.int64())], ["size", "gram", "lang", "n"])

    return rows.mapInArrow(count, "size int, gram string, lang string, n bigint").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))


def learn(documents: DataFrame, learn_from: int = LEARN, words: int = WORDS, grams: int = GRAMS) -> dict:
    """The model, from text and non-null lang of a sample of documents that are not held out: langs, and for words and each length of
    n-grams the keys with their rows of logs.  What reaches the driver is bounded by ``words`` and ``grams``."""
    found = settled(counted(sample(documents, learn_from)))
    langs = sorted(r.lang for r in found.select("lang").distinct().collect())
    tables: list[tuple[list[str], np.ndarray]] = [([], np.zeros((0, len(langs)), np.float32)) for _ in range(LONGEST + 1)]
    if langs:
        most = F.when(F.col("size") == 0, max(1, words // len(langs))).otherwise(max(1, grams // len(langs)))
        place = F.row_number().over(W.partitionBy("size", "lang").orderBy(F.desc("n"), "gram"))
        ranked = found.withColumn("known", place <= most)
        known = ranked.groupBy("size", "gram").agg(F.max("known").alias("known"), F.collect_list(F.struct("lang", "n")).alias("by")).filter("known")
        column = {x: i for i, x in enumerate(langs)}
        rows: list[list] = [[] for _ in tables]
        for r in known.select("size", "gram", "by.lang", "by.n").collect():
            rows[r.size].append((r.gram, r.lang, r.n))
        for size, of in enumerate(rows):
            of.sort()
            counts = np.zeros((len(of), len(langs)))
            for i, (_, lang, n) in enumerate(of):
                counts[i, [column[x] for x in lang]] = n
            tables[size] = [r[0] for r in of], np.log((counts + FLOOR) / (counts.sum(axis=0) + FLOOR * max(1, len(of)))).astype(np.float32)
    return {"langs": langs, "words": tables[0], "grams": tables[1:]}


class Scorer:
    """Scores of words under a model: rows of one array, those of known words first, then those of unseen words met so far."""

    def __init__(self, model: dict):
        self.langs, (self.known, logs) = model["langs"], model["words"]
        self.rows = np.zeros((len(self.known) + REMEMBERED, len(self.langs)), np.float32)
        self.rows[: len(self.known)] = logs
        self.grams = [dict(zip(keys, map(tuple, logs.tolist()))) for keys, logs in model["grams"]]
        self.forget()

    def forget(self) -> None:
        self.row = {word: i for i, word in enumerate(self.known)}

    def unseen(self, word: str) -> list[float]:
        for size in range(len(self.grams), 0, -1):
            table = self.grams[size - 1]
            found = [v for g in grams_of(word, size) if (v := table.get(g)) is not None]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [0.0] * len(self.langs)

    def indexes(self, words: list[str]) -> list[int]:
        """The rows of the words; unseen ones get one."""
        at = [*map(self.row.get, words)]
        if None not in at:
            return at
        new = dict.fromkeys(w for w, i in zip(words, at) if i is None)
        if len(self.row) + len(new) > len(self.rows):
            self.forget()
            new = dict.fromkeys(w for w in words if w not in self.row)
        if short := max(0, len(self.row) + len(new) - len(self.rows)):
            self.rows = np.concatenate([self.rows, np.zeros((short, len(self.langs)), np.float32)])
        first = len(self.row)
        self.rows[first : first + len(new)] = [*map(self.unseen, new)]
        self.row.update(zip(new, range(first, first + len(new))))
        return [*map(self.row.__getitem__, words)]

    def text(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return "und", 0.0
        total = self.rows[self.indexes(words)].sum(axis=0, dtype=np.float64)
        # a posterior of a text as if it had the square root of its words: those of a text aren't independent
        z = (total - total.max()) / math.sqrt(len(words))
        k = int(total.argmax())
        return self.langs[k], float(1 / np.exp(z).sum())


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """A row per document: doc_id, lang_pred, score."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # of bounded size: words and n-grams kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            said = [*map(scorer.text, batch.column("text").to_pylist())]
            more = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            rest = [name for name in batch.schema.names if name not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *more], [*rest, "lang_pred", "score"])

    rest = documents.drop("lang_pred", "score")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rest.mapInArrow(run, schema)


def confident(documents: DataFrame, model: dict, least: float) -> DataFrame:
    """The rows of ``documents`` whose text has a language with a score of ``least`` or more."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            said = map(scorer.text, batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in said], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
