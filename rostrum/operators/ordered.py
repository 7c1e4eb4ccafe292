"""Operators on ordered rows: as-of and range joins, forward fill, segments, gaps, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.storage import settled


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in a global order that must be total.

    Rows are sorted over many partitions, counted by partition, and numbered from there.  Only the counts, one a partition, pass
    through the driver.  The sorted rows are kept in the shared folder, so both passes see the same partitions.
    """
    parts = settled(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    upto, starts = 0, {}
    for part, n in sorted(tuple(r) for r in parts.groupBy("_part").count().collect()):
        starts[part], upto = upto, upto + n
    if not starts:
        return df.withColumn(name, F.lit(1).cast("long")).limit(0)
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "_part int, _start long")
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_start") + 1).drop("_part", "_at", "_start")


def prefix_max(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The greatest value of the rows before each, in an order without ties; null for the first.

    As in ``numbered``, rows are sorted over many partitions, and only one number a partition passes through the driver.
    """
    parts = settled(df.orderBy(order).withColumn("_part", F.spark_partition_id()))
    upto, starts = None, []
    for part, most in sorted(tuple(r) for r in parts.groupBy("_part").agg(F.max(value)).collect()):
        starts.append((part, upto))
        upto = most if upto is None else upto if most is None else max(upto, most)
    offsets = df.sparkSession.createDataFrame(starts, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_before", df.schema[value].dataType)]))
    inner = F.max(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.greatest("_before", inner)).drop("_part", "_before")


def previous(df: DataFrame, partition: list[str], order: list, value: Column) -> Column:
    """The last non-null value strictly before the row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))


def asof_before(left: DataFrame, right: DataFrame, by: str, at: str, value: str, out: str) -> DataFrame:
    """For each row of left the value of the latest row of right with the same ``by`` and a smaller ``at``; of several at one time the
    largest value."""
    marked = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(True))
    events = right.select(F.col(by), F.col(at), F.col(value).alias("_v")).withColumn("_left", F.lit(False))
    rows = marked.unionByName(events, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(F.col(at), F.desc("_left"), "_v").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(out, F.last("_v", ignorenulls=True).over(w)).filter("_left").drop("_v", "_left")


def range_join(points: DataFrame, ranges: DataFrame, by: str, at: str, low: str, high: str, bucket: int) -> DataFrame:
    """Points with the ranges [low, high] that hold them.  Both sides are dealt by buckets of ``bucket`` values, so the join is on
    equal keys and a large group is spread."""
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    return points.withColumn("_b", F.floor(F.col(at) / bucket)).join(cut, [by, "_b"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("_b")


def with_headings(df: DataFrame, partition: str, order: list, is_major: Column, is_minor: Column, label: Column) -> DataFrame:
    """Current major and minor heading of each row; a major heading ends the minor one before it."""
    w = W.partitionBy(partition).orderBy(*order)
    df = df.withColumns({"major": F.last(F.when(is_major, label), ignorenulls=True).over(w), "_group": F.sum(is_major.cast("int")).over(w)})
    inner = W.partitionBy(partition, "_group").orderBy(*order)
    return df.withColumn("minor", F.last(F.when(is_minor, label), ignorenulls=True).over(inner)).drop("_group")


def with_boundaries(df: DataFrame, partition: str, order: list, tag: Column, is_speech: Column) -> DataFrame:
    """For speech rows: does something else stand right before it, and what; and the running number of boundaries.

    The first row of a partition has the boundary FILE_START."""
    w = W.partitionBy(partition).orderBy(*order)
    before, before_speech = F.lag(tag).over(w), F.lag(is_speech).over(w)
    reason = F.when(before.isNull(), "FILE_START").when(~before_speech, F.concat(F.upper(before), F.lit("_BOUNDARY")))
    df = df.withColumn("boundary_reason", F.when(is_speech, reason))
    return df.withColumn("segment", F.sum(F.col("boundary_reason").isNotNull().cast("int")).over(w))


def spans_overlap(spans: Column) -> Column:
    """Does a span, in the order given, start before the furthest end so far."""
    return F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("end"), F.lit(False).alias("bad")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end_offset"].cast("long")).alias("end"), (a["bad"] | (s["start_offset"] < a["end"])).alias("bad")),
        lambda a: a["bad"],
    )
