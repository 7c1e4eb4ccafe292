"""Typed filters, seeded samples, allocation and pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.functions import keys, text


@dataclass(frozen=True)
class Criteria:
    """Conditions that all have to hold; those left out are not part of the plan."""

    text: str = "text"
    words_min: int | None = None
    words_max: int | None = None
    date_column: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    one_of: dict[str, tuple] = field(default_factory=dict)
    #: flag column -> wanted: True, False, or "unknown" for null
    flags: dict[str, bool | str] = field(default_factory=dict)
    keywords_any: tuple[str, ...] = ()
    keywords_all: tuple[str, ...] = ()

    def __post_init__(self):
        if self.words_min is not None and self.words_max is not None and self.words_min > self.words_max:
            raise ValueError("words_min is over words_max")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from is after date_to")

    def conditions(self) -> list[Column]:
        c, out = F.col(self.text), []
        if self.words_min is not None:
            out.append(text.words(c) >= self.words_min)
        if self.words_max is not None:
            out.append(text.words(c) <= self.words_max)
        if self.date_column and self.date_from:
            out.append(F.col(self.date_column) >= F.lit(self.date_from).cast("date"))
        if self.date_column and self.date_to:
            out.append(F.col(self.date_column) <= F.lit(self.date_to).cast("date"))
        out += [F.col(k).isin(*v) for k, v in self.one_of.items()]
        for k, v in self.flags.items():
            out.append(F.col(k).isNull() if v == "unknown" else F.col(k).eqNullSafe(F.lit(v)))
        like = lambda w: c.ilike("%" + w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")
        if self.keywords_any:
            out.append(reduce(or_, map(like, self.keywords_any)))
        if self.keywords_all:
            out.append(reduce(and_, map(like, self.keywords_all)))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(DataFrame.filter, self.conditions(), df)


def not_true(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def without(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on), on, "left_anti")


def in_and_out(df: DataFrame, on: str, ids: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Explicit ids override both sets."""
    if ids is not None:
        return df.join(ids.select(on).distinct(), on, "left_semi")
    if include is not None:
        df = df.join(include.select(on).distinct(), on, "left_semi")
    return df if exclude is None else without(df, exclude, on)


def seeded_sample(df: DataFrame, key: str, seed: str, n: int, how: str = "md5") -> DataFrame:
    """The first ``n`` rows in seeded order, ties by key."""
    return df.orderBy(keys.seeded(F.col(key), seed, how), F.col(key)).limit(n)


def two_seeded_samples(df: DataFrame, run: str, record: str, seed: str, wide: int, n: int) -> DataFrame:
    """``wide`` rows by one hash, and of these ``n`` by another."""
    first = F.md5(F.concat(F.lit(seed), F.col(run).cast("string"), F.col(record).cast("string")))
    second = F.sha2(F.concat_ws(":", F.lit(seed), F.col(run).cast("string"), F.col(record).cast("string")), 256)
    return df.orderBy(first, record).limit(wide).orderBy(second, record).limit(n)


def hamilton(populations: DataFrame, stratum: str, count: str, size: int) -> DataFrame:
    """Largest remainder: (stratum, allocated).  Ties in the remainder go by stratum.  One row a stratum, so one window is enough."""
    total = F.sum(count).over(W.partitionBy(F.lit(1)))
    exact = F.col(count) * F.lit(size)
    df = populations.withColumns({"_floor": F.floor(exact / total).cast("long"), "_rest": F.pmod(exact, total)})
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("_rest"), stratum))
    left = F.lit(size) - F.sum("_floor").over(W.partitionBy(F.lit(1)))
    return df.select(stratum, (F.col("_floor") + (rank <= left).cast("long")).alias("allocated"))


def stratified_sample(df: DataFrame, key: str, stratum: str, allocation: DataFrame, seed: str) -> DataFrame:
    """Of each stratum the allocated number of rows in seeded order, with ``sample_rank``.

    The largest allocation is looked up first: as a number in the plan it lets every task keep its own first rows of each stratum and shuffle
    only these (up to ``spark.sql.window.group.limit.threshold``, 1,000 by default), so no task sorts a whole stratum.
    """
    most = allocation.agg(F.coalesce(F.max("allocated"), F.lit(0))).first()[0]
    ranked = df.withColumn("sample_rank", F.row_number().over(W.partitionBy(stratum).orderBy(keys.seeded(F.col(key), seed, "sha256"), key))).filter(F.col("sample_rank") <= most)
    return ranked.join(allocation, stratum).filter("sample_rank <= allocated").drop("allocated")


def systematic_sample(df: DataFrame, order: str, k: int) -> DataFrame:
    """``k`` rows spread evenly in ``order``: those at bround(i * (n - 1) / (k - 1)), or the middle one, at n // 2, if ``k`` is 1; all if
    they are no more than ``k``.

    Rows are numbered without one task taking them all: see ``ordered.numbered``.
    """
    from rostrum.operators.ordered import numbered

    if k < 1:
        raise ValueError("a sample has at least one row")
    ranked = numbered(df, [order], "_n")
    n = df.count()
    if n <= k:
        return ranked.drop("_n")
    spark = df.sparkSession
    place = (F.bround(F.col("id") * F.lit(n - 1).cast("double") / F.lit(k - 1)).cast("long") if k > 1 else F.lit(n // 2).cast("long")) + 1
    wanted = spark.range(k).select(place.alias("_n")).distinct()
    return ranked.join(F.broadcast(wanted), "_n", "left_semi").drop("_n")


def first_middle_last(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    w = W.partitionBy(group)
    df = df.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)})
    return df.filter(F.col("_n").isin(1) | (F.col("_n") == F.col("_all")) | (F.col("_n") == F.floor(F.col("_all") / 2) + 1)).drop("_n", "_all")


def page(df: DataFrame, order: Iterable, limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(max(1, min(limit, most)))


def page_with_total(df: DataFrame, order: Iterable, limit: int, offset: int = 0) -> DataFrame:
    """A page, each row with the number of all rows.  The count is one aggregate beside the page, not a window over all rows."""
    return page(df, order, limit, offset).withColumn("total", df.agg(F.count("*")).scalar())


def json_contains(value: Column, wanted: object) -> Column:
    """Does JSON, as VARIANT, contain what is wanted: an object every key with what is wanted there, a list something for every item, in any
    order and however often; a scalar an equal one of its kind, with numbers by value.  At the top, a list contains its scalars too."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("NULL"))

    def held(w: object) -> Callable[[Column], Column]:
        return lambda i: inside(i, w)

    def inside(v: Column, w: object) -> Column:
        if isinstance(w, dict):
            own = [inside(F.try_variant_get(v, f"$['{k}']", "variant"), x) for k, x in w.items()]
            return reduce(Column.__and__, own, kind(v).startswith("OBJECT"))
        if isinstance(w, list):
            items = F.try_variant_get(v, "$", "array<variant>")
            own = [F.coalesce(F.exists(items, held(x)), F.lit(False)) for x in w]
            return reduce(Column.__and__, own, kind(v).startswith("ARRAY"))
        if w is None:
            return kind(v) == "VOID"
        if isinstance(w, bool):
            return (kind(v) == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean") == w, F.lit(False))
        if isinstance(w, (int, float)):
            number = kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            return number & F.coalesce(F.try_variant_get(v, "$", "decimal(38,18)") == F.lit(Decimal(str(w))).cast("decimal(38,18)"), F.lit(False))
        return (kind(v) == "STRING") & F.coalesce(F.try_variant_get(v, "$", "string") == w, F.lit(False))

    if isinstance(wanted, (dict, list)):
        return inside(value, wanted)
    return inside(value, wanted) | inside(value, [wanted])


def same_configuration(a: str, b: str, fields: Iterable[str]) -> Column:
    """Do two structs agree in all fields; nulls agree with nulls."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def derived(df: DataFrame, primary: str, secondary: str, domain: str) -> DataFrame:
    """Rows of a first pass that a second one on a domain takes up: it is their primary one or among the secondary."""
    return df.filter(F.coalesce(F.col(primary) == domain, F.lit(False)) | F.coalesce(F.array_contains(secondary, domain), F.lit(False)))


# What a queue of reviews can be asked for, beside a status of the latest review.
QUEUES = ("unreviewed", "reviewed", "flagged_codebook")


def review_queue(current: DataFrame, wanted: str, *, equal: dict[str, object] | None = None, json: dict[str, tuple[str, str]] | None = None, year: tuple[str, int] | None = None, sample: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Predictions with their reviews (``operators.reviews.current_reviews``) that a reviewer asked for.

    ``wanted``: one of ``QUEUES`` or a status of the latest review.  ``equal``: columns by value; ``json``: column and value of each
    path; ``year`` of a date column; ``sample``: a column and the keys of a drawn sample.  What is left out is not part of the plan.
    """
    last = F.col("last_status")
    if wanted in QUEUES:
        df = current.filter({"unreviewed": last.isNull(), "reviewed": last.isNotNull(), "flagged_codebook": F.col("flagged_status").isNotNull()}[wanted])
    else:
        df = current.filter(last == wanted)
    for name, value in (equal or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    for path, (column, value) in (json or {}).items():
        df = df.filter(F.get_json_object(column, f"$.{path}") == value)
    if year is not None:
        if not 1901 <= year[1] <= 2100:
            raise ValueError("a year is from 1901 to 2100")
        df = df.filter(F.year(year[0]) == year[1])
    return df if sample is None else df.join(sample[1].select(sample[0]).distinct(), sample[0], "left_semi")


def preview(df: DataFrame, criteria: Criteria, limit: int | None = None) -> DataFrame:
    """One row: how many rows a batch could take and how many it would."""
    n = F.count("*")
    return criteria.apply(df).agg(n.alias("eligible_count"), (F.least(n, F.lit(limit)) if limit else n).alias("selected_count"))


def sample_holds(sample: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """One row: is the sample of the size, its keys unique, its order gapless from 1."""
    return sample.agg(
        (F.count("*") == size).alias("size_ok"), (F.countDistinct(key) == F.count("*")).alias("unique_ok"),
        ((F.min(order) == 1) & (F.max(order) == F.count("*")) & (F.countDistinct(order) == F.count("*"))).alias("order_ok"),
    )


def policy_status(outcome: Column, non_policy: Column, domain: Column) -> Column:
    """POLICY, NON_POLICY or UNAVAILABLE; a contradiction fails the query."""
    has = F.coalesce(domain, F.lit("")) != ""
    return (
        F.when((outcome == "PREDICTION") & (non_policy == "true") & ~has, "NON_POLICY")
        .when((outcome == "PREDICTION") & (non_policy == "false") & has, "POLICY")
        .when((outcome != "PREDICTION") & (F.coalesce(non_policy, F.lit("")) == "") & ~has, "UNAVAILABLE")
        .otherwise(F.raise_error(F.concat_ws(" ", F.lit("contradictory row:"), outcome, non_policy, domain)))
    )
