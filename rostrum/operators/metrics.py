"""Scores of labels against predictions: confusion, precision and recall, pairs of models, transitions, costs.

A ratio with denominator 0 is 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CLASS = "__NONE__"


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, 1).otherwise(b))


def scored(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r == 0, 1).otherwise(p + r))}


def binary(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1.  Rows with a null are left out."""
    t = df.select(truth.alias("t"), said.alias("s")).filter("t is not null and s is not null").agg(
        F.count_if(F.col("t") & F.col("s")).alias("tp"), F.count_if(~F.col("t") & F.col("s")).alias("fp"),
        F.count_if(F.col("t") & ~F.col("s")).alias("fn"), F.count_if(~F.col("t") & ~F.col("s")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn)} | scored(tp, fp, fn))


def confusion(df: DataFrame, truth: str, said: str, classes: list[str]) -> DataFrame:
    """Every pair of classes with its count, zero included; predictions may be of no class."""
    grid = [(a, b) for a in classes for b in [*classes, NO_CLASS]]
    pairs = df.sparkSession.createDataFrame(grid, "truth string, said string")
    n = df.groupBy(F.col(truth).alias("truth"), F.coalesce(said, F.lit(NO_CLASS)).alias("said")).agg(F.count("*").alias("n"))
    n = n.filter(F.col("truth").isin(classes) & F.col("said").isin(*classes, NO_CLASS))  # as many as the grid has, at most
    return pairs.join(F.broadcast(n), ["truth", "said"], "left").select("truth", "said", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, truth: str, said: str, classes: list[str]) -> DataFrame:
    """truth class, support, tp, fp, fn and scores; classes without support have zeros."""
    grid = confusion(df, truth, said, classes)
    hit = F.col("truth") == F.col("said")
    by_truth = grid.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    by_said = grid.groupBy(F.col("said").alias("class")).agg(F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp"))
    t = by_truth.join(by_said, "class", "left").withColumns({"fp": F.coalesce("fp", F.lit(0)), "fn": F.col("support") - F.col("tp")})
    return t.withColumns(scored(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(df: DataFrame, truth: str, said: str, classes: list[str]) -> DataFrame:
    """The mean over all classes, those without support included."""
    return per_class(df, truth, said, classes).agg((F.sum("f1") / len(classes)).alias("macro_f1"))


def presence(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """Of YES / NO / UNSURE labels: scores of YES against the rest; ``accuracy`` is agreement in all three."""
    d = df.select(truth.alias("t"), said.alias("s")).filter("t is not null and s is not null")
    return binary(d, F.col("t") == "YES", F.col("s") == "YES").drop("accuracy").crossJoin(
        F.broadcast(d.agg(ratio(F.count_if(F.col("t") == F.col("s")), F.count("*")).alias("accuracy"), F.count("*").alias("n")))
    )


def transition(truth: Column, said: Column) -> Column:
    return F.concat_ws("->", F.coalesce(truth, F.lit("MISSING")), F.coalesce(said, F.lit("MISSING")))


def pair_category(truth: Column, a: Column, b: Column) -> Column:
    ok_a, ok_b = a.eqNullSafe(truth), b.eqNullSafe(truth)
    return (
        F.when(ok_a & ok_b, "both_correct").when(ok_a, "only_a_correct").when(ok_b, "only_b_correct")
        .when(a.eqNullSafe(b), "both_wrong_same").otherwise("both_wrong_different")
    )


def dominated(runs: DataFrame, run: str, quality: str, cost: str) -> DataFrame:
    """Runs with whether another is at least as good and as cheap, and better in one.

    Runs are put in order of cost; the best quality so far, at a lower or at the same cost, decides.  So no pairs are made, and costs
    are sorted over many partitions.
    """
    from rostrum.operators.ordered import prefix_max

    upto = prefix_max(runs.groupBy(cost).agg(F.max(quality).alias("_top")), cost, "_top", "_below")
    return runs.join(upto, cost).select(
        *[runs[c] for c in runs.columns],
        (F.coalesce(F.col("_below") >= F.col(quality), F.lit(False)) | (F.col("_top") > F.col(quality))).alias("dominated"),
    )


def modes(df: DataFrame, group: str, value: str, tie: str = "mixed") -> DataFrame:
    """The most frequent value of each group; ``tie`` if several are."""
    n = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    top = n.groupBy(group).agg(F.max("_n").alias("_top"))
    best = n.join(top, group).filter("_n = _top")
    return best.groupBy(group).agg(F.when(F.count("*") == 1, F.min(value)).otherwise(tie).alias("mode"), F.max("_top").alias("n"))


def costs(results: DataFrame, prices: dict[str, float], per_million: int = 1_000_000) -> DataFrame:
    """One row: tokens and cost.  Reasoning tokens are charged as output; cached input at its own price."""
    from decimal import Decimal

    money = lambda tokens, price: tokens.cast("decimal(20,0)") * F.lit(Decimal(str(price))) / per_million
    s = results.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("status") == "success").alias("valid"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens")],
    )
    cost = money(F.col("input_tokens") - F.col("cached_tokens"), prices["input"]) + money(F.col("cached_tokens"), prices["cached"]) + money(F.col("output_tokens") + F.col("reasoning_tokens"), prices["output"])
    s = s.withColumn("cost", cost.cast("decimal(18,8)"))
    return s.withColumns({f"per_{w}": F.when(F.col(w) > 0, (F.col("cost") / F.col(w)).cast("decimal(18,8)")) for w in ("attempted", "valid")})


def committed(status: Column, reserved: Column, actual: Column) -> Column:
    """Spend that counts: of a collected batch the actual one, of a pending one none, else the larger of both.  Sum it."""
    none = F.lit(0).cast("decimal(18,8)")
    return F.when(status == "COLLECTED", F.coalesce(actual, none)).when(status == "PENDING", none).otherwise(F.greatest(F.coalesce(reserved, none), F.coalesce(actual, none)))


def shares(counts: DataFrame, key: str, n: str, classes: list[str]) -> DataFrame:
    """Every class with count and share, zero included, and a TOTAL row."""
    all_ = counts.sparkSession.createDataFrame([(c,) for c in classes], f"{key} string")
    rows = all_.join(counts.select(key, n), key, "left").select(key, F.coalesce(n, F.lit(0)).alias(n))
    total = rows.agg(F.sum(n).alias("_t"))
    each = rows.crossJoin(F.broadcast(total)).select(key, n, ratio(F.col(n), F.col("_t")).alias("share"))
    return each.union(total.select(F.lit("TOTAL"), F.col("_t"), F.when(F.col("_t") > 0, F.lit(1.0)).otherwise(0.0)))


def gate(metrics: dict[str, Column], least: dict[str, float], most: dict[str, float]) -> Column:
    """All thresholds hold."""
    checks = [metrics[k] >= v for k, v in least.items()] + [metrics[k] <= v for k, v in most.items()]
    return F.forall(F.array(*checks), lambda c: F.coalesce(c, F.lit(False)))
