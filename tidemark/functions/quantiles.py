"""Exact quantiles by narrowing, without a buffer of a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.staging import staged


def quantiles(df: DataFrame, by: Sequence[str], x: str, shares: Sequence[float], out: str = "q", buckets: int = 1024) -> DataFrame:
    """The quantiles of each group as an array (by, out), interpolated as ``percentile`` does it.

    The ranks that are wanted fall into equal parts of a group's range of values, of which only those are read again, in parts of their own; what is left of these is counted by
    value. Each step is an aggregate that Spark combines before it shuffles, so a group of any size needs memory for its counts of buckets and for the values of the last ones only, however the values are
    spread, and is no task of its own. NULLs and NaNs are passed over; a group of these alone has no row.
    """
    if not shares:
        raise ValueError("a share at least")
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    rows = staged(df.select(group.alias("g"), F.col(x).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "quantile-rows")
    ends = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Position i of the ranks belongs to share i // 2: the rank below and the one above.
    ranks = [f(F.lit(float(p)) * (F.col("n") - 1)).cast("long") for p in shares for f in (F.floor, F.ceil)]
    wanted = ends.select("g", F.posexplode(F.array(*ranks)).alias("i", "rank"))
    # Halves, so that the range of very large values is no infinity.
    u = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets
    part = lambda c: F.greatest(F.lit(0), F.least(F.floor(c), F.lit(buckets - 1))).cast("int")
    rows = rows.join(ends.select("g", "lo", "hi"), "g").withColumn("u", F.when(F.col("hi") > F.col("lo"), u).otherwise(F.lit(0.0)))
    rows = rows.withColumn("b1", part(F.col("u"))).withColumn("b2", part((F.col("u") - F.col("b1")) * buckets)).select("g", "v", "b1", "b2")

    def narrowed(rows: DataFrame, wanted: DataFrame, known: list[str], column: str) -> DataFrame:
        """``wanted`` (g, known, i, rank among the rows of these) with the part of ``column`` in which each rank lies, and the rank in there."""
        counts = rows.groupBy("g", *known, column).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("g", *known).orderBy(column).rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
        found = wanted.join(counts, ["g", *known]).filter("rank >= before and rank < upto")
        return found.select("g", *known, column, "i", (F.col("rank") - F.col("before")).alias("rank"))

    first = staged(narrowed(rows, wanted, [], "b1"), "quantile-ranks")
    rows = rows.join(first.select("g", "b1").distinct(), ["g", "b1"])
    second = staged(narrowed(rows, first, ["b1"], "b2"), "quantile-ranks")
    rows = rows.join(second.select("g", "b1", "b2").distinct(), ["g", "b1", "b2"])
    told = narrowed(rows, second, ["b1", "b2"], "v").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("values"))
    told = told.join(ends.select("g", "n"), "g")

    def between(i: int, p: float):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col("values")[2 * i]["v"], F.col("values")[2 * i + 1]["v"]
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return told.select(*(F.col("g").getField(c).alias(c) for c in by), F.array(*(between(i, p) for i, p in enumerate(shares))).alias(out))
