"""Anomalous ranges, and precision and recall over them (Tatbul et al. 2018)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranges(df: DataFrame, flag: str, keys: Sequence[str] = ("channel",), pos: str = "pos") -> DataFrame:
    """Runs of consecutive positions whose ``flag`` is 1: keys, s and e."""
    on = df.filter(F.col(flag) == 1)
    island = F.col(pos) - F.row_number().over(W.partitionBy(*keys).orderBy(pos))
    return on.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(pos).alias("s"), F.max(pos).alias("e")).drop("_island")


def ranges_chunked(df: DataFrame, flag: str, chunk: int, keys: Sequence[str] = ("channel",), pos: str = "pos") -> DataFrame:
    """As ``ranges`` for very long series: runs within chunks, of which those that touch are then merged."""
    part = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    local = ranges(part, flag, [*keys, "_chunk"], pos)
    w = W.partitionBy(*keys).orderBy("s")
    new = F.when(F.col("s") == F.lag("e").over(w) + 1, 0).otherwise(1)
    run = local.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")


def weight(s: Column, e: Column, a: Column, b: Column, bias: str) -> Column:
    """Weighed share of [s, e] that [a, b] covers, in closed form."""
    n, c = e - s + 1, b - a + 1
    first, last = a - s + 1, b - s + 1
    if bias == "flat":
        return c / n
    if bias == "front":
        return c * ((e - a + 1) + (e - b + 1)) / F.lit(2.0) / (n * (n + 1) / F.lit(2.0))
    if bias == "back":
        return c * (first + last) / F.lit(2.0) / (n * (n + 1) / F.lit(2.0))
    if bias == "middle":
        # Weights rise by one up to the middle and fall again after it.
        below = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda t, i: t + F.least(i, n - i + 1))
        upto = lambda k: F.when(k > 0, below(F.greatest(k, F.lit(1)))).otherwise(F.lit(0.0))
        return (upto(last) - upto(first - 1)) / upto(n)
    raise ValueError(f"unknown bias {bias!r}")


def coverage(of: DataFrame, by: DataFrame, keys: Sequence[str], existence: float = 0.0, bias: str = "front", cardinality: str = "reciprocal", bucket: int = 1024) -> DataFrame:
    """Mean score of the ranges ``of`` (keys, s, e), as they are covered ``by`` others: keys, score and n.

    Overlaps are found by an equi-join on keys and the buckets of positions that ranges touch; a pair is counted in the bucket where
    its overlap begins.
    """
    cells = lambda d: d.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))))
    right = cells(by.select(*keys, "s", "e")).withColumnsRenamed({"s": "s2", "e": "e2"})
    a, b = F.greatest("s", "s2"), F.least("e", "e2")
    pairs = cells(of).join(right, [*keys, "_cell"]).filter((a <= b) & (F.floor(a / bucket) == F.col("_cell")))
    each = pairs.groupBy(*keys, "s", "e").agg(F.sum(weight(F.col("s"), F.col("e"), a, b, bias)).alias("w"), F.count("*").alias("k"))
    factor = F.lit(1.0) if cardinality == "one" else F.lit(1.0) / F.greatest("k", F.lit(1))
    found = of.select(*keys, "s", "e").join(each, [*keys, "s", "e"], "left")
    score = F.when(F.col("k").isNull(), F.lit(0.0)).otherwise(F.lit(existence) + F.lit(1.0 - existence) * F.col("w") * factor)
    return found.groupBy(*keys).agg(F.avg(score).alias("score"), F.count("*").alias("n"))


def range_scores(frame: DataFrame, keys: Sequence[str] = ("channel",), label: str = "label", pred: str = "pred", existence: float = 0.0, bias: str = "front", cardinality: str = "reciprocal") -> DataFrame:
    """Range precision, recall and F1 for each key; F1 is 0 where no point is predicted."""
    true, said = ranges(frame, label, keys), ranges(frame, pred, keys)
    recall = coverage(true, said, keys, existence, bias, cardinality).select(*keys, F.col("score").alias("recall"))
    precision = coverage(said, true, keys, 0.0, bias, cardinality).select(*keys, F.col("score").alias("precision"))
    out = frame.select(*keys).distinct().join(recall, list(keys), "left").join(precision, list(keys), "left").fillna(0.0, ["recall", "precision"])
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r + 1e-6)).otherwise(F.lit(0.0)))
