"""Error metrics as aggregate expressions, and tables of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mae(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def rmse(y: str = "y", p: str = "p") -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def mape(y: str = "y", p: str = "p") -> Column:
    """In per cent, over values that are not next to zero."""
    return F.avg(F.when(F.abs(F.col(y)) > 1e-8, F.abs((F.col(y) - F.col(p)) / F.col(y)))) * 100


def r2(y: str = "y", p: str = "p") -> Column:
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - F.sum(F.pow(F.col(y) - F.col(p), 2)) / total)


def rmsle(y: str = "y", p: str = "p") -> Column:
    """NULL when any value lies at or below -1."""
    both = F.least(F.min(y), F.min(p))
    return F.when(both > -1, F.sqrt(F.avg(F.when((F.col(y) > -1) & (F.col(p) > -1), F.pow(F.log1p(F.col(y)) - F.log1p(F.col(p)), 2)))))


def metrics(y: str = "y", p: str = "p") -> list[Column]:
    return [mae(y, p).alias("mae"), rmse(y, p).alias("rmse"), mape(y, p).alias("mape"), r2(y, p).alias("r2")]


def table(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """mae, rmse, mape and r2, for each group or for all rows; rows without a pair are passed over."""
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(*metrics(y, p))


def macro(by_item: DataFrame) -> DataFrame:
    """The mean of a metric table over its items."""
    return by_item.agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "mape", "r2")])


def seasonal_error(train: DataFrame, season: int, item: str = "item_id", pos: str = "pos", x: str = "x") -> DataFrame:
    """In-sample mean absolute error of the seasonal naive forecast of each item."""
    w = W.partitionBy(item).orderBy(pos)
    return train.withColumn("_d", F.abs(F.col(x) - F.lag(x, season).over(w))).groupBy(item).agg(F.avg("_d").alias("naive_mae"))


def mase(forecast: DataFrame, train: DataFrame, season: int, item: str = "item_id", pos: str = "pos", x: str = "x", y: str = "y", p: str = "p") -> DataFrame:
    """Mean absolute error of each item in units of its seasonal error."""
    errors = forecast.groupBy(item).agg(mae(y, p).alias("mae"))
    return errors.join(seasonal_error(train, season, item, pos, x), item).select(item, (F.col("mae") / F.col("naive_mae")).alias("mase"))


def residual(y: str = "y", p: str = "p") -> Column:
    return F.col(y) - F.col(p)
