"""Tables about forecast errors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.metrics import mae
from tidemark.functions.quantiles import quantiles
from tidemark.sources.staging import staged


def interval_coverage(df: DataFrame, bands: dict[str, tuple[str, str, float]], by: str = "item_id", y: str = "y") -> DataFrame:
    """Share in per cent of values within each band (name: low, high, expected share), for each item."""
    inside = [(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("int")) * 100).alias(name) for name, (low, high, _) in bands.items()]
    expected = [F.lit(100.0 * share).alias(f"{name}_expected") for name, (_, _, share) in bands.items()]
    return df.groupBy(by).agg(*inside).select("*", *expected)


def error_correlation(residuals: DataFrame, item: str = "item_id", time: str = "ts", residual: str = "residual", pairs: DataFrame | None = None, block: int = 64) -> DataFrame:
    """Pearson correlation of the residuals of each two items (a <= b) over common times, or of the ``pairs`` (a, b) that are wanted.

    Items are dealt into blocks, and every two blocks meet in tasks of their own, each with a slice of time: a matrix of its times and items, from which the sums of all products of two items are single
    matrix products. So a row travels once for each block of items it meets, not once for each item, and what is written are sums for each pair, slice by slice. Values are centred by item before, so that nothing cancels. A pair without a
    common time has no row; one whose values don't vary over its common times has no correlation.
    """
    rows = residuals.select(F.col(item).alias("item"), F.col(time).alias("time"), F.col(residual).cast("double").alias("r")).filter("r is not null")
    if pairs is not None:
        ends = pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct()
        rows = rows.join(ends, "item", "left_semi")
    centre = rows.groupBy("item").agg(F.avg("r").alias("centre"), F.count("*").alias("n"))
    sizes = staged(centre.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(1 << 16)).cast("int")), "correlation-items")
    blocks = max(1, -(-sizes.count() // block))
    rows = rows.join(sizes.select("item", "centre", F.pmod(F.col("part"), F.lit(blocks)).alias("own")), "item").withColumn("r", F.col("r") - F.col("centre"))
    # A slice has about as many times as a matrix of 65,536 values allows; rows of one time are in one slice.
    slices = max(1, int(sizes.agg(F.max("n")).first()[0] or 1) // 1024)
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    dealt = rows.withColumn("_b", F.explode(others)).select("_b.p", "_b.q", F.pmod(F.xxhash64("time"), F.lit(slices)).cast("int").alias("slice"), "item", "own", "time", "r")
    kind = residuals.schema[item].dataType.simpleString()

    def products(group: pd.DataFrame) -> pd.DataFrame:
        times, at = np.unique(group["time"].to_numpy(), return_inverse=True)
        names, of = np.unique(group["item"].to_numpy(), return_inverse=True)
        x, there = np.zeros((len(times), len(names))), np.zeros((len(times), len(names)))
        x[at, of], there[at, of] = group["r"].to_numpy(), 1.0
        square = x * x
        sums = {"n": there.T @ there, "sa": x.T @ there, "sb": there.T @ x, "saa": square.T @ there, "sbb": there.T @ square, "sab": x.T @ x}
        own = np.zeros(len(names), "int64")
        own[of] = group["own"].to_numpy()
        i, j = np.triu_indices(len(names))
        # Two items of one block meet in the task of that block with itself, and in no other.
        met = (sums["n"][i, j] > 0) & ((own[i] != own[j]) | (group["p"].iloc[0] == group["q"].iloc[0]))
        i, j = i[met], j[met]
        return pd.DataFrame({"a": names[i], "b": names[j], **{c: v[i, j] for c, v in sums.items()}})

    found = dealt.groupBy("p", "q", "slice").applyInPandas(products, f"a {kind}, b {kind}, n double, sa double, sb double, saa double, sbb double, sab double")
    if pairs is not None:
        found = found.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_semi")
    total = found.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    n = F.col("n")
    spread = (F.col("saa") - F.col("sa") * F.col("sa") / n) * (F.col("sbb") - F.col("sb") * F.col("sb") / n)
    return total.select("a", "b", F.when(spread > 0, (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(spread)).alias("corr"))


def shuffled_column(df: DataFrame, column: str, by: Sequence[str], pos: str, seed: int) -> DataFrame:
    """``column`` dealt anew within each group, by a seeded order."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(pos))
    drawn = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(F.col(pos), F.lit(seed)), pos))
    values = df.select(*by, drawn.alias("_place"), F.col(column).alias("_value"))
    return df.withColumn("_place", place).join(values, [*by, "_place"]).withColumn(column, F.col("_value")).drop("_place", "_value")


def permutation_importance(df: DataFrame, covariates: Sequence[str], predict: Callable[[DataFrame], DataFrame], repeats: int = 3, seed: int = 42, y: str = "y", pos: str = "pos", by: Sequence[str] = ("item_id",)) -> DataFrame:
    """Mean rise of the absolute error when a covariate is shuffled within its group; ``predict`` adds p. All shuffles go through one prediction."""
    base = predict(df).agg(mae(y, "p").alias("base"))
    copies = None
    for i, name in enumerate(covariates):
        for repeat in range(repeats):
            one = shuffled_column(df, name, by, pos, seed + 1000 * i + repeat)
            one = one.withColumn("covariate", F.lit(name)).withColumn("repeat", F.lit(repeat))
            copies = one if copies is None else copies.unionByName(one)
    errors = predict(copies).groupBy("covariate", "repeat").agg(mae(y, "p").alias("error"))
    return errors.join(F.broadcast(base)).groupBy("covariate").agg(F.avg(F.col("error") - F.col("base")).alias("importance"))


def error_by_hour(df: DataFrame, item: str = "item_id", time: str = "ts", residual: str = "residual") -> DataFrame:
    """Quartiles of the absolute error by item and hour, and the largest and smallest errors within 1.5 interquartile ranges."""
    error = df.select(item, F.hour(time).alias("hour"), F.abs(F.col(residual)).alias("e")).filter("e is not null")
    q = quantiles(error, [item, "hour"], "e", (0.25, 0.5, 0.75))
    q = q.select(item, "hour", q["q"][0].alias("q1"), q["q"][1].alias("median"), q["q"][2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    kept = F.when(F.col("e").between(F.col("q1") - reach, F.col("q3") + reach), F.col("e"))
    return error.join(q, [item, "hour"]).groupBy(item, "hour", "q1", "median", "q3").agg(F.min(kept).alias("low"), F.max(kept).alias("high"))


def histogram(df: DataFrame, bins: int, by: str = "item_id", x: str = "residual") -> DataFrame:
    """Counts in equal bins between the smallest and the largest value of each group; the upper end belongs to the last bin."""
    ends = df.groupBy(by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.floor((F.col(x) - F.col("lo")) / width * bins) + 1, F.lit(bins))).otherwise(1)
    return df.filter(F.col(x).isNotNull()).join(ends, by).groupBy(by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def normal_quantiles(df: DataFrame, by: str = "item_id", x: str = "residual", points: int = 199) -> DataFrame:
    """Quantiles of each group beside those of a normal distribution of the same deviation."""
    shares = [i / (points + 1) for i in range(1, points + 1)]
    normal = F.array(*[F.lit(NormalDist().inv_cdf(s)) for s in shares])
    q = quantiles(df, [by], x, shares).join(df.groupBy(by).agg(F.stddev_pop(x).alias("deviation")), by)
    each = q.select(by, "deviation", F.posexplode(F.arrays_zip(F.col("q").alias("observed"), normal.alias("z"))).alias("i", "pair"))
    return each.select(by, (F.col("i") + 1).alias("i"), F.col("pair.observed").alias("observed"), (F.col("pair.z") * F.col("deviation")).alias("normal"))


def context(train: DataFrame, forecast: DataFrame, tail: int, item: str = "item_id", pos: str = "pos") -> DataFrame:
    """The end of the training part and the forecast with its bands as one frame, told apart by ``role``."""
    last = train.groupBy(item).agg(F.max(pos).alias("_last"))
    kept = train.join(last, item).filter(F.col(pos) > F.col("_last") - tail).drop("_last").withColumn("role", F.lit("train"))
    return kept.unionByName(forecast.withColumn("role", F.lit("forecast")), allowMissingColumns=True)
