"""Shaping of series frames: concatenation, panels, slices, splits and futures.

Order is never that of the rows: it comes from a time or position column, with every tie broken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concat_splits(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts one after another, in ``split_rank`` order."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("split_rank", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which must break all ties."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def sorted_by_time(df: DataFrame, *keys: str) -> DataFrame:
    """For a sink only; operators order inside their windows."""
    return df.orderBy(*keys)


def series_columns(df: DataFrame, prefix: str, target: str | None = None) -> list[str]:
    """Columns of a prefix, without the target."""
    return [c for c in df.columns if c.startswith(prefix) and c != target]


def to_panel(df: DataFrame, values: Sequence[str], ids: Sequence[str] = ("ts",), item: str = "item_id", value: str = "target") -> DataFrame:
    """Wide to long: one row for each time and column."""
    return df.unpivot(list(ids), list(values), item, value)


def to_single_panel(df: DataFrame, target: str, name: str, covariates: Sequence[str] = ()) -> DataFrame:
    """One item with its covariates."""
    return df.select(F.lit(name).alias("item_id"), "ts", F.col(target).alias("target"), *covariates)


def to_wide(df: DataFrame, key: str, column: str, value: str, names: Sequence[str], fill: float | None = None) -> DataFrame:
    """Long to wide over declared column names, so that no pass is needed to find them."""
    out = df.groupBy(key).pivot(column, list(names)).agg(F.first(value))
    return out if fill is None else out.fillna(fill, list(names))


def last_position(df: DataFrame, item: str = "item_id", pos: str = "pos") -> DataFrame:
    return df.groupBy(item).agg(F.max(pos).alias("_last"))


def drop_last(df: DataFrame, horizon: int, item: str = "item_id", pos: str = "pos") -> DataFrame:
    """Each item without its last ``horizon`` positions; a small aggregate is joined, nothing is sorted."""
    return df.join(last_position(df, item, pos), item).filter(F.col(pos) <= F.col("_last") - horizon).drop("_last")


def keep_last(df: DataFrame, horizon: int, item: str = "item_id", pos: str = "pos") -> DataFrame:
    return df.join(last_position(df, item, pos), item).filter(F.col(pos) > F.col("_last") - horizon).drop("_last")


def cut_at(df: DataFrame, start: int, skip: int, pos: str = "pos") -> DataFrame:
    """Rows before ``start`` without the first ``skip`` as train, the others as test, in the column ``part``."""
    part = F.when((F.col(pos) < start) & (F.col(pos) >= skip), "train").when(F.col(pos) >= start, "test")
    return df.withColumn("part", part).filter("part is not null")


def without_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def filled_columns(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that have a value somewhere in train, found in one pass."""
    found = train.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if found[c]]


def future_frame(df: DataFrame, horizon: int, step: str, item: str = "item_id") -> DataFrame:
    """The next ``horizon`` times of each item: item, ts and step h from 1."""
    last = df.groupBy(item).agg(F.max("ts").alias("_last"))
    times = F.sequence(F.col("_last") + F.expr(f"interval {step}"), F.col("_last") + F.expr(f"interval {step}") * horizon, F.expr(f"interval {step}"))
    return last.select(item, F.posexplode(times).alias("h", "ts")).withColumn("h", F.col("h") + 1)


def with_known(future: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A future frame with covariates known for its times."""
    return future.join(known, list(keys), "left")


def override(df: DataFrame, column: str, value: Column | float) -> DataFrame:
    """One covariate set to a constant or an expression."""
    return df.withColumn(column, value if isinstance(value, Column) else F.lit(value))


def aligned(model_output: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model output rows with their observations; rows without an output (the first window) are left out."""
    return observed.join(model_output, list(keys))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first ``k`` of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def sample_by_hash(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a hash of their keys: the same rows in every run, and unbiased in time."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
