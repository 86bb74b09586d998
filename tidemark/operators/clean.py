"""Cleaning and scaling of long panels (item, pos, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outlier_statistics(df: DataFrame, item: str, x: str) -> DataFrame:
    """Mean and sample standard deviation of each item."""
    return df.groupBy(item).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))


def mask_outliers(df: DataFrame, max_std: float, item: str = "item_id", x: str = "x", statistics: DataFrame | None = None) -> DataFrame:
    """x is NULL where it lies more than ``max_std`` deviations from its item's mean; items without variance stay as they are.

    The statistics are those of the frame, or given ones (such as those of the training part).
    """
    statistics = outlier_statistics(df, item, x) if statistics is None else statistics
    far = (F.col("_std") > 0) & (F.abs((F.col(x) - F.col("_mean")) / F.col("_std")) > max_std)
    out = df.join(statistics, item)
    return out.withColumn(x, F.when(~F.coalesce(far, F.lit(False)), F.col(x))).drop("_mean", "_std")


def next_value(x: str, part: WindowSpec, pos: str) -> Column:
    """The first value from a row on, as the last one up to it when read backwards: a frame that grows, which Spark carries from row to row. One that shrinks it would go through for each row anew."""
    return F.last(x, ignorenulls=True).over(part.orderBy(F.col(pos).desc()).rowsBetween(W.unboundedPreceding, 0))


def fill(df: DataFrame, item: str = "item_id", pos: str = "pos", x: str = "x", backfill: bool = True) -> DataFrame:
    """The last value before, and where there is none the first one after."""
    w = W.partitionBy(item).orderBy(pos)
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if not backfill:
        return df.withColumn(x, before)
    return df.withColumns({x: F.coalesce(before, next_value(x, W.partitionBy(item), pos))})


def fill_chunked(df: DataFrame, chunk: int, item: str = "item_id", pos: str = "pos", x: str = "x") -> DataFrame:
    """As ``fill``, for series too long for one task: chunks are filled on their own, and what is missing at
    their edges comes from a table with one row for each chunk."""
    part = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    value = F.struct(F.col(pos).alias("p"), F.col(x).alias("v"))
    seen = F.when(F.col(x).isNotNull(), value)
    edges = part.groupBy(item, "_chunk").agg(F.max(seen).alias("_tail"), F.min(seen).alias("_head"))
    w = W.partitionBy(item).orderBy("_chunk")
    carried = edges.select(
        item, "_chunk",
        F.last("_tail.v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_head.v", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    local = W.partitionBy(item, "_chunk").orderBy(pos)
    before = F.last(x, ignorenulls=True).over(local.rowsBetween(W.unboundedPreceding, 0))
    after = next_value(x, W.partitionBy(item, "_chunk"), pos)
    out = part.join(carried, [item, "_chunk"])
    return out.withColumn(x, F.coalesce(before, "_before", after, "_after")).drop("_chunk", "_before", "_after")


def zero_fill(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0, list(columns))


def fit_scaler(df: DataFrame, item: str = "item_id", x: str = "x") -> DataFrame:
    """Mean and population deviation of each item; a deviation of zero counts as one."""
    deviation = F.stddev_pop(x)
    return df.groupBy(item).agg(F.avg(x).alias("mean"), F.when(deviation > 0, deviation).otherwise(1.0).alias("scale"))


def scaled(x: Column | str = "x") -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return (x - F.col("mean")) / F.col("scale")


def transform(df: DataFrame, scaler: DataFrame, item: str = "item_id", x: str = "x") -> DataFrame:
    return df.join(scaler, item).withColumn(x, scaled(x)).drop("mean", "scale")


def inverse(df: DataFrame, scaler: DataFrame, item: str = "item_id", x: str = "x") -> DataFrame:
    return df.join(scaler, item).withColumn(x, F.col(x) * F.col("scale") + F.col("mean")).drop("mean", "scale")


def preprocess(df: DataFrame, mode: str, scaler: DataFrame | None = None, max_std: float | None = 7.0, item: str = "item_id", pos: str = "pos", x: str = "x", statistics: DataFrame | None = None, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Mask outliers, fill, and then fit and apply ("fit"), apply ("transform") or undo ("inverse") the scaler; gives the frame and the scaler."""
    if mode not in ("fit", "transform", "inverse"):
        raise ValueError(f"unknown mode {mode!r}")
    out = df if max_std is None else mask_outliers(df, max_std, item, x, statistics)
    out = fill(out, item, pos, x) if chunk is None else fill_chunked(out, chunk, item, pos, x)
    if mode == "fit":
        scaler = fit_scaler(out, item, x)
    elif scaler is None:
        raise ValueError("a fitted scaler is needed")
    return (inverse if mode == "inverse" else transform)(out, scaler, item, x), scaler
