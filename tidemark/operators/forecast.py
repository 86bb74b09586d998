"""Forecasters of panels (item_id, pos, ts, x): each gives (item_id, pos, h, mean)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantiles as exact_quantiles
from tidemark.operators import clean, features
from tidemark.operators.boosting import SAMPLE, GBTRegressor
from tidemark.sources.staging import staged


def steps(horizon: int):
    return F.explode(F.sequence(F.lit(1), F.lit(horizon)))


def naive(train: DataFrame, horizon: int) -> DataFrame:
    """The last observed value for every step."""
    last = train.groupBy("item_id").agg(F.max("pos").alias("_last"), F.max_by("x", F.when(F.col("x").isNotNull(), F.col("pos"))).alias("mean"))
    return last.withColumn("h", steps(horizon)).select("item_id", (F.col("_last") + F.col("h")).alias("pos"), "h", "mean")


def seasonal_naive(train: DataFrame, horizon: int, season: int) -> DataFrame:
    """The value one season before, repeated over the horizon."""
    last = train.groupBy("item_id").agg(F.max("pos").alias("_last"))
    tail = train.join(last, "item_id").filter(F.col("pos") > F.col("_last") - season).select("item_id", (F.col("pos") - F.col("_last") + season - 1).alias("_phase"), F.col("x").alias("mean"))
    future = last.withColumn("h", steps(horizon)).withColumn("_phase", F.pmod(F.col("h") - 1, F.lit(season)))
    return future.join(tail, ["item_id", "_phase"], "left").select("item_id", (F.col("_last") + F.col("h")).alias("pos"), "h", "mean")


#: Bounds of the weights of level, trend and season and of the trend's damping, and where the search for them starts.
BOX = np.array(((1e-3, 0.999), (0.0, 0.999), (0.0, 0.999), (0.8, 1.0)))
STARTS = ((0.1, 0.01, 0.1, 1.0), (0.3, 0.05, 0.1, 1.0), (0.5, 0.1, 0.3, 1.0), (0.2, 0.0, 0.05, 1.0))


def smoothed(y: np.ndarray, n: np.ndarray, season: int, weights: np.ndarray, horizon: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Squared one-step errors (tries, items) and forecasts (horizon, tries, items) of additive level, damped trend and season, for many items at once.

    ``y`` is (longest, items), of which an item has the first ``n``; items come by falling length, so that those still running are the first ones. ``weights`` is (4, tries, items).
    """
    use = (season > 1) & (n >= 2 * season)
    alpha, beta, gamma, phi = weights[0], weights[1], weights[2] * use, weights[3]
    first = y[: min(season, len(y))]
    level = np.where(use, first.mean(axis=0), y[0]) + np.zeros(alpha.shape)
    trend, error = np.zeros(alpha.shape), np.zeros(alpha.shape)
    s = np.zeros((season, *alpha.shape))
    s[: len(first)] += ((first - first.mean(axis=0)) * use)[:, None]
    running = np.searchsorted(-n, -np.arange(len(y)), side="left")
    for t, k in enumerate(running):
        a, b, g, value, phase = alpha[:, :k], beta[:, :k], gamma[:, :k], y[t, :k], s[t % season, :, :k]
        damped = phi[:, :k] * trend[:, :k]
        before = level[:, :k] + damped
        error[:, :k] += (value - before - phase) ** 2
        now = a * (value - phase) + (1 - a) * before
        trend[:, :k] = b * (now - level[:, :k]) + (1 - b) * damped
        level[:, :k] = now
        phase[:] = g * (value - now) + (1 - g) * phase
    items, ahead, carried = np.arange(len(n)), np.zeros((horizon, *alpha.shape)), np.zeros(alpha.shape)
    for h in range(horizon):
        carried = (carried + 1) * phi
        ahead[h] = level + carried * trend + s[(n + h) % season, :, items].T
    return error, ahead


def best_weights(y: np.ndarray, n: np.ndarray, season: int, starts=STARTS, rounds: int = 40) -> np.ndarray:
    """Weights (4, items) of small squared error: a simplex search (Nelder and Mead) within ``BOX`` for each item, all items in step, from the best of ``starts``."""
    low, high = BOX[:, :1], BOX[:, 1:]
    items = np.arange(len(n))

    def errors(points: np.ndarray, of: np.ndarray = items) -> np.ndarray:
        return smoothed(y[:, of], n[of], season, np.swapaxes(points, 0, 1))[0]

    begin = np.repeat(np.array(starts, dtype="float64")[:, :, None], len(n), axis=2)
    best = begin[errors(begin).argmin(axis=0), :, items].T
    step = (0.2 * (high - low))[None] * np.eye(4)[:, :, None]
    simplex = np.concatenate((best[None], best + np.where(best + step > high, -step, step)))
    value = errors(simplex)
    for _ in range(rounds):
        order = value.argsort(axis=0, kind="stable")
        value, simplex = np.take_along_axis(value, order, 0), np.take_along_axis(simplex, order[:, None], 0)
        middle = simplex[:-1].mean(axis=0)
        away = middle - simplex[-1]
        tries = np.clip(np.stack([middle + f * away for f in (1, 2, 0.5, -0.5)]), low, high)
        reflected, expanded, outside, inside = found = errors(tries)
        near = np.where(reflected < value[-1], 2, 3)
        take = np.where(reflected < value[0], np.where(expanded < reflected, 1, 0), np.where(reflected < value[-2], 0, near))
        chosen = found[take, items]
        better = chosen < np.minimum(value[-1], np.where(take == 2, reflected, np.inf))
        simplex[-1] = np.where(better, tries[take, :, items].T, simplex[-1])
        value[-1] = np.where(better, chosen, value[-1])
        # Where no try helps, all points move half the way to the best one.
        if len(stuck := np.flatnonzero(~better)):
            simplex[1:, :, stuck] = (simplex[1:, :, stuck] + simplex[:1, :, stuck]) / 2
            value[1:, stuck] = errors(simplex[1:][:, :, stuck], stuck)
    return simplex[value.argmin(axis=0), :, items].T


def alike(lengths: Sequence[int], cells: int = 1 << 22) -> list[slice]:
    """Runs of falling lengths that differ by a factor of two at most and, padded to the longest, hold no more than ``cells`` values."""
    out, at = [], 0
    for i in range(1, len(lengths) + 1):
        if i == len(lengths) or 2 * lengths[i] < lengths[at] or (i + 1 - at) * lengths[at] > cells:
            out.append(slice(at, i))
            at = i
    return out


def per_item(train: DataFrame, horizon: int, fn, *more: str) -> DataFrame:
    """``fn`` from the values of an item in order, and what columns of ``more`` hold for the item, to its forecast; items run in parallel, and an item is one series."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        y = group["x"].ffill().bfill().to_numpy("float64")
        mean = fn(y, *(group[c].iloc[0] for c in more)) if len(y) and not np.isnan(y).any() else np.full(horizon, np.nan)
        h = np.arange(1, horizon + 1)
        return pd.DataFrame({"item_id": group["item_id"].iloc[0], "pos": group["pos"].iloc[-1] + h, "h": h, "mean": mean})

    kind = train.schema["item_id"].dataType.simpleString()
    out = train.select("item_id", "pos", "x", *more).groupBy("item_id").applyInPandas(run, f"item_id {kind}, pos int, h int, mean double")
    return out.withColumn("mean", F.when(~F.isnan("mean"), F.col("mean")))


def ets(train: DataFrame, horizon: int, season: int = 1, starts: Sequence[tuple[float, float, float, float]] = STARTS, rounds: int = 40, together: int = 64) -> DataFrame:
    """Exponential smoothing with a damped trend and the weights that a search within bounds finds for each item. About ``together`` items share a task, which smooths them in step.

    Missing values are filled from before, then from behind; an item without any value has no forecast.
    """
    groups = max(1, -(-train.agg(F.approx_count_distinct("item_id")).first()[0] // together))
    kind = train.schema["item_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        each = [one.sort_values("pos", kind="stable") for _, one in group.groupby("item_id", dropna=False, sort=True)]
        each = sorted(((one["item_id"].iloc[0], int(one["pos"].iloc[-1]), one["x"].ffill().bfill().to_numpy("float64")) for one in each), key=lambda e: -len(e[2]))
        h, parts = np.arange(1, horizon + 1), []
        told = [e for e in each if not np.isnan(e[2]).any()]
        for block in alike([len(e[2]) for e in told]):
            n = np.array([len(e[2]) for e in told[block]])
            y = np.zeros((n[0], len(n)))
            for i, (_, _, values) in enumerate(told[block]):
                y[: n[i], i] = values
            weights = best_weights(y, n, season, starts, rounds)
            ahead = smoothed(y, n, season, weights[:, None], horizon)[1][:, 0]
            parts += [(item, last, ahead[:, i]) for i, (item, last, _) in enumerate(told[block])]
        parts += [(item, last, np.full(horizon, np.nan)) for item, last, values in each if np.isnan(values).any()]
        return pd.concat([pd.DataFrame({"item_id": [item] * horizon, "pos": last + h, "h": h, "mean": mean}) for item, last, mean in parts])

    by = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("_group")
    out = train.select("item_id", "pos", "x", by).groupBy("_group").applyInPandas(run, f"item_id {kind}, pos int, h int, mean double")
    return out.withColumn("mean", F.when(~F.isnan("mean"), F.col("mean")))


def theta(train: DataFrame, horizon: int, season: int = 1, alpha: float = 0.3) -> DataFrame:
    """Deseasonalised simple smoothing with half the linear drift."""

    def one(y: np.ndarray) -> np.ndarray:
        t = np.arange(len(y))
        use = season > 1 and len(y) >= 2 * season
        index = np.array([y[p::season].mean() - y.mean() for p in range(season)]) if use else np.zeros(season)
        flat = y - index[t % season]
        drift = np.polyfit(t, flat, 1)[0] if len(y) > 1 else 0.0
        level = flat[0]
        for v in flat:
            level = alpha * v + (1 - alpha) * level
        h = np.arange(1, horizon + 1)
        return level + 0.5 * drift * (h - 1 + 1 / alpha) + index[(len(y) + h - 1) % season]

    return per_item(train, horizon, one)


#: Calendar fields of the target's time, as ``features.calendar`` names them.
CALENDAR = ("hour", "minute", "dayofweek", "dayofmonth", "month", "weekofyear", "is_weekend")


def direct_origins(df: DataFrame, horizon: int, origins, lags: Sequence[int], season: int) -> DataFrame:
    """Features at each origin, its next values and what its last season has for them as arrays by window, so that nothing is joined once the steps are spelled out."""
    w, last = features.series(), min(horizon, season) - season
    seconds = F.col("ts").cast("timestamp").cast("long")
    held = F.coalesce(F.col("x").cast("double"), F.lit(float("nan")))
    ahead, behind = F.collect_list(held).over(w.rowsBetween(1, horizon)), F.collect_list(held).over(w.rowsBetween(1 - season, last))
    columns = {f"lag_{k}": F.lag("x", k).over(w) for k in lags}
    columns |= {"roll": F.avg("x").over(w.rowsBetween(-season, 0)), "_ts": seconds, "_step": seconds - F.lag(seconds).over(w), "_ahead": ahead, "_behind": behind}
    return df.withColumns(columns).filter(origins)


def direct_rows(df: DataFrame, horizon: int, origins, lags: Sequence[int], season: int) -> DataFrame:
    """Features at each origin with every step of the horizon, the calendar and the value a season before of the target; y where it is known."""
    known = lambda v: F.when(~F.isnan(v), v)
    # A step beyond one season looks so many seasons back that the value is known at the origin.
    step = lambda h: F.struct(
        h.alias("h"), known(F.get("_ahead", h - 1)).alias("y"), known(F.get("_behind", F.size("_behind") - min(horizon, season) + F.pmod(h - 1, F.lit(season)))).alias("season_before")
    )
    at = direct_origins(df, horizon, origins, lags, season).withColumn("_s", F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), step)))
    at = at.withColumn("h", F.col("_s.h")).withColumn("_ts", F.timestamp_seconds(F.col("_ts") + F.col("h") * F.col("_step"))).withColumns(features.calendar("_ts"))
    return at.select("item_id", (F.col("pos") + F.col("h")).alias("pos"), F.col("pos").alias("origin"), "h", *[f"lag_{k}" for k in lags], "roll", *CALENDAR, "_s.y", "_s.season_before")


def direct_short(df: DataFrame, horizon: int, origins, lags: Sequence[int], season: int) -> DataFrame:
    """One row for each origin, from which ``spelled`` makes those of ``direct_rows`` within a task: what all steps share, arrays of what they don't, and the origin's time with its zone and the length of a step."""
    shared = [F.col(c).cast("double").alias(c) for c in (*(f"lag_{k}" for k in lags), "roll")]
    return direct_origins(df, horizon, origins, lags, season).select("_ahead", "_behind", "_ts", "_step", F.current_timezone().alias("_zone"), *shared)


def calendar_of(times: pa.Array) -> np.ndarray:
    """The fields of ``CALENDAR`` (times, fields), in the zone of the times."""
    day = pc.day_of_week(times)
    made = [pc.hour(times), pc.minute(times), day, pc.day(times), pc.month(times), pc.iso_week(times), pc.greater_equal(day, 5)]
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in made])


def zone_is_known(zone: str) -> bool:
    """Whether tasks can tell the time of this zone; Spark knows more names than they do."""
    try:
        calendar_of(pa.array([0], pa.timestamp("s", tz=zone)))
    except pa.ArrowInvalid:
        return False
    return True


def padded(lists: pa.Array, width: int, right: bool = False) -> np.ndarray:
    """Lists of numbers as rows of one array, at its left or right, with NaN for what is missing."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    out, row = np.full((len(n), width), np.nan), np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (np.repeat(width - n, n) if right else 0)
    out[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def spelled_groups(batch: pa.RecordBatch, horizon: int, season: int, rows: int = 10_000) -> Iterator[tuple[np.ndarray, list]]:
    """Blocks of about ``rows`` targets of all steps of some origins with their features in groups, as ``GBTRegressor.spelled_out`` takes them: what an origin's steps share (lags, roll), season_before, what
    a target's time says (calendar) and h. A row that lacks one of them is left out."""
    h, each = np.arange(1, horizon + 1), max(1, rows // horizon)
    for begin in range(0, batch.num_rows, each):
        ahead, behind, at, step, zone, *shared = batch.slice(begin, each).columns
        n = len(ahead)
        shared = np.column_stack([c.to_numpy(zero_copy_only=False) for c in shared])
        before, y = padded(behind, min(horizon, season), right=True)[:, (h - 1) % season], padded(ahead, horizon)
        dated = at.is_valid().to_numpy(zero_copy_only=False) & step.is_valid().to_numpy(zero_copy_only=False)
        told = ~(np.isnan(y) | np.isnan(before) | (np.isnan(shared).any(axis=1) | ~dated)[:, None])
        origin, which = np.nonzero(told)
        at, step = (c.fill_null(0).to_numpy(zero_copy_only=False)[:, None] for c in (at, step))
        of_row, times = pd.factorize((at + h * step)[told])
        calendar = calendar_of(pa.array(times).cast(pa.timestamp("s", tz=zone[0].as_py())))
        yield y[told], [(shared, origin), (before[told][:, None], None), (calendar, of_row), (h[:, None].astype("float64"), which)]


def spelled(batch: pa.RecordBatch, horizon: int, season: int, rows: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of ``spelled_groups`` as features (lags, roll, season_before, calendar, h) of every row, and targets."""
    for y, groups in spelled_groups(batch, horizon, season, rows):
        yield np.column_stack([values if at is None else values[at] for values, at in groups]), y


def direct_tabular(
    train: DataFrame, horizon: int, season: int, lags: Sequence[int] = (0, 1, 2, 4), stride: int = 1, trees: int = 5, depth: int = 4, seed: int = 42, known: DataFrame | None = None
) -> DataFrame:
    """One boosted regression for all items and steps, on what is known at the forecast's origin, the calendar, and covariates known for each step.

    Every origin is trained on; a ``stride`` takes each so many. An item is forecast from its own last position, wherever that is. ``known`` is
    (item_id, pos, known), a vector at every position of history and horizon.
    """
    train = staged(train.select("item_id", "pos", "ts", "x").withColumn("_last", F.max("pos").over(W.partitionBy("item_id"))), "train")
    n = max(train.count(), 1)
    # Every row becomes ``horizon`` wide ones: items are dealt so that a task makes some two millions of those.
    train = train.repartition(max(train.sparkSession.sparkContext.defaultParallelism, -(-n * horizon // 2_000_000)), "item_id")
    inputs = [*[f"lag_{k}" for k in lags], "roll", "season_before", *CALENDAR, "h"]
    assembler = VectorAssembler(inputCols=inputs + ([] if known is None else ["known"]), outputCol="features", handleInvalid="skip")
    with_known = lambda df: df if known is None else df.join(known, ["item_id", "pos"])
    origins = (F.pmod(F.col("_last") - F.col("pos"), F.lit(stride)) == 0) & (F.col("pos") >= season)
    made = lambda df: assembler.transform(with_known(df).filter("y is not null"))
    # Splits are drawn from so many origins and then from their steps, as a draw from all rows would make them all.
    share = lambda part, *by: F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(min(part, 1) * (1 << 30))
    some = direct_rows(train, horizon, origins & share(SAMPLE * stride / n, F.lit(seed), "item_id", "pos"), lags, season)
    some = made(some.filter(share(SAMPLE * stride / (n * horizon) / min(SAMPLE * stride / n, 1), F.lit(seed), "item_id", "origin", "h")))
    boosted = GBTRegressor(featuresCol="features", labelCol="y", predictionCol="mean", maxIter=trees, maxDepth=depth, seed=seed)
    if known is None and zone_is_known(train.sparkSession.conf.get("spark.sql.session.timeZone")):
        # Steps are spelled out where they are packed: Spark moves a row for each origin only.
        n_shared, n = len(lags) + 1, len(inputs)
        groups = [range(n_shared), [n_shared], range(n_shared + 1, n - 1), [n - 1]]
        boosted.spelled_out(direct_short(train, horizon, origins, lags, season), lambda batch: spelled_groups(batch, horizon, season), groups)
    fitted = boosted.drawn_from(some).fit(made(direct_rows(train, horizon, origins, lags, season)))
    future = with_known(direct_rows(train, horizon, F.col("pos") == F.col("_last"), lags, season).drop("y").fillna(0.0, inputs[:-1]))
    return fitted.transform(assembler.transform(future)).select("item_id", "pos", "h", "mean")


def recursive_tabular(train: DataFrame, horizon: int, lags: Sequence[int] = (1, 2, 3, 12, 52), known: DataFrame | None = None) -> DataFrame:
    """One linear one-step regression fitted by Spark on lags, the calendar and covariates, rolled forward by each item on its own forecasts; ``known`` as in ``direct_tabular``."""
    w, train = features.series(), staged(train.select("item_id", "pos", "ts", "x"), "train")
    inputs = [f"lag_{k}" for k in lags]
    assembler = VectorAssembler(inputCols=[*inputs, *CALENDAR] + ([] if known is None else ["known"]), outputCol="features")
    with_known = lambda df: df if known is None else df.join(known, ["item_id", "pos"])
    rows = train.withColumns({f"lag_{k}": F.lag("x", k).over(w) for k in lags} | features.calendar("ts")).dropna()
    model = LinearRegression(featuresCol="features", labelCol="x", regParam=0.01).fit(assembler.transform(with_known(rows)))
    weights, reach = model.coefficients.toArray()[: len(lags)].tolist(), max(lags)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All items of a part in step; an item with fewer values than ``reach`` begins with their mean."""
        h = np.arange(1, horizon + 1)
        for part in parts:
            y = np.empty((len(part), reach + horizon))
            for i, values in enumerate(part["_y"]):
                y[i, :reach] = np.mean(values)
                y[i, reach - len(values) : reach] = values
            rest = np.stack(part["_rest"].to_list()) if len(part) else np.empty((0, horizon))
            for step in range(horizon):
                y[:, reach + step] = sum(w * y[:, reach + step - k] for w, k in zip(weights, lags)) + rest[:, step]
            yield pd.DataFrame({"item_id": part["item_id"].repeat(horizon), "pos": (part["_last"].to_numpy()[:, None] + h).ravel(), "h": np.tile(h, len(part)), "mean": y[:, reach:].ravel()})

    # What calendar, covariates and bias add to each step is the model's prediction where all lags are 0.
    seconds = F.col("ts").cast("timestamp").cast("long")
    last = train.groupBy("item_id").agg(F.max("pos").alias("_last"), F.max(seconds).alias("_at"), ((F.max(seconds) - F.min(seconds)) / F.greatest(F.max("pos") - F.min("pos"), F.lit(1))).alias("_step"))
    future = last.withColumn("h", steps(horizon)).select("item_id", (F.col("_last") + F.col("h")).alias("pos"), F.timestamp_seconds(F.col("_at") + F.col("h") * F.col("_step")).alias("ts"))
    future = with_known(future.withColumns({c: F.lit(0.0) for c in inputs} | features.calendar("ts")))
    rest = model.transform(assembler.transform(future)).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "prediction"))).alias("_rest"))
    # An item's last values are all that its forecast rests on; gaps are filled from before, then from behind.
    held = clean.fill(train.select("item_id", "pos", F.when(~F.isnan("x"), F.col("x")).cast("double").alias("x"))).withColumn("_back", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("pos"))))
    tail = held.filter(F.col("_back") <= reach).groupBy("item_id").agg(F.max("pos").alias("_last"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("x", F.lit(float("nan"))).alias("x")))).alias("_y"))
    kind = train.schema["item_id"].dataType.simpleString()
    each = tail.join(rest, "item_id").select("item_id", "_last", F.col("_y.x").alias("_y"), F.col("_rest.prediction").alias("_rest"))
    return each.mapInPandas(run, f"item_id {kind}, pos int, h int, mean double").withColumn("mean", F.when(~F.isnan("mean"), F.col("mean")))


def ensemble_weights(wide: DataFrame, models: Sequence[str], rounds: int = 10, y: str = "y") -> DataFrame:
    """Greedy selection with replacement by absolute error over validation rows (one column for each model): (model, weight).

    Each round is one aggregate: the error of the picks so far with each model added.
    """
    picks = dict.fromkeys(models, 0)
    for k in range(rounds):
        held = sum((F.col(m) * n for m, n in picks.items() if n), F.lit(0.0))
        tried = wide.agg(*[F.avg(F.abs(F.col(y) - (held + F.col(m)) / (k + 1))).alias(m) for m in models]).first()
        picks[min(models, key=lambda m: (tried[m], m))] += 1
    return wide.sparkSession.createDataFrame([(m, n / rounds) for m, n in picks.items()], "model string, weight double")


def weighted(forecasts: DataFrame, weights: DataFrame, *more: str) -> DataFrame:
    """The weighted mean of forecasts (item_id, pos, model, mean) of each item, position and value of ``more``."""
    return forecasts.join(F.broadcast(weights), "model").groupBy("item_id", "pos", *more).agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"))


QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def with_quantiles(forecast: DataFrame, residuals: DataFrame, bucket: int, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``forecast`` with quantile columns: percentiles of validation residuals (item_id, h, residual) by item and part of the horizon."""
    part = F.floor((F.col("h") - 1) / bucket).alias("_part")
    q = exact_quantiles(residuals.select("item_id", part, "residual"), ["item_id", "_part"], "residual", quantiles, "_q")
    out = forecast.withColumn("_part", F.floor((F.col("h") - 1) / bucket)).join(q, ["item_id", "_part"], "left")
    return out.withColumns({f"q{round(100 * v)}": F.col("mean") + F.col("_q")[i] for i, v in enumerate(quantiles)}).drop("_q", "_part")


def backtest_windows(df: DataFrame, horizon: int, windows: int) -> DataFrame:
    """The panel once for each of the most recent origins (window 1 is the latest), tagged train or validation."""
    last = df.groupBy("item_id").agg(F.max("pos").alias("_last"))
    each = df.join(last, "item_id").withColumn("window", F.explode(F.sequence(F.lit(1), F.lit(windows))))
    origin = F.col("_last") - F.col("window") * horizon
    role = F.when(F.col("pos") <= origin, "train").when(F.col("pos") <= origin + horizon, "validation")
    return each.withColumn("part", role).filter("part is not null").drop("_last")


def against_actual(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    return forecast.join(actual.select("item_id", "pos", F.col("x").alias("actual")), ["item_id", "pos"]).select("item_id", "pos", "actual", F.col("mean").alias("predicted"))


def families(train: DataFrame, horizon: int, season: int, heavy: bool = True, known: DataFrame | None = None) -> DataFrame:
    """All families' forecasts as one frame (item_id, pos, h, mean, model); the tabular ones use ``known``."""
    made = {"SeasonalNaive": seasonal_naive(train, horizon, season), "Naive": naive(train, horizon), "ETS": ets(train, horizon, season), "Theta": theta(train, horizon, season), "RecursiveTabular": recursive_tabular(train, horizon, known=known)}
    if heavy:
        made["DirectTabular"] = direct_tabular(train, horizon, season, known=known)
    out = None
    for name, df in made.items():
        df = df.select("item_id", F.col("pos").cast("int").alias("pos"), F.col("h").cast("int").alias("h"), "mean", F.lit(name).alias("model"))
        out = df if out is None else out.unionByName(df)
    return out


def run_multi(df: DataFrame, horizon: int, season: int, heavy: bool = True, bucket: int = 13, known: DataFrame | None = None, validations: int = 2) -> dict[str, DataFrame]:
    """Every item forecast over its last ``horizon`` positions: forecasts with an ensemble and quantiles, weights, the validation rows and the test frame.

    Weights and quantiles come from the ``validations`` horizons before, each forecast by families that know only what lies before it, so nothing is chosen on what is tested. Every
    family's forecasts are written once.
    """
    if validations < 1:
        raise ValueError("a validation window at least")
    parts = staged(backtest_windows(df, horizon, validations + 1), "windows")
    fit = lambda k, part: parts.filter((F.col("window") == k) & (F.col("part") == part)).select("item_id", "ts", "pos", "x")
    validation = None
    for k in range(2, validations + 2):
        one = families(fit(k, "train"), horizon, season, heavy, known).join(fit(k, "validation").select("item_id", "pos", F.col("x").alias("y")), ["item_id", "pos"]).withColumn("window", F.lit(k))
        validation = one if validation is None else validation.unionByName(one)
    validation = staged(validation, "validation")
    models = sorted(r[0] for r in validation.select("model").distinct().collect())
    wide = staged(validation.groupBy("item_id", "pos", "h", "window", "y").pivot("model", models).agg(F.first("mean")).dropna(), "validation-wide")
    weights = ensemble_weights(wide, models)
    mean = validation.select("item_id", "pos", "h", "window", "y", "model", "mean").join(wide.select("item_id", "pos", "window"), ["item_id", "pos", "window"], "left_semi")
    held = weighted(mean, weights, "h", "window", "y")
    residuals = held.select("item_id", "h", (F.col("y") - F.col("mean")).alias("residual"))
    singles = staged(families(fit(1, "train"), horizon, season, heavy, known), "forecasts")
    together = weighted(singles, weights, "h")
    forecast = staged(with_quantiles(together, residuals, bucket), "ensemble")
    every = singles.unionByName(forecast.select("item_id", "pos", "h", "mean").withColumn("model", F.lit("WeightedEnsemble")))
    return {"forecast": forecast, "models": every, "weights": weights, "validation": validation, "test": fit(1, "validation"), "train": fit(1, "train")}


def run_single(df: DataFrame, item, horizon: int, season: int, heavy: bool = True, most: int = 1024, components: bool = False) -> dict[str, DataFrame]:
    """One item forecast as ``run_multi`` does, with the other series as covariates that are known for the horizon too: ``most`` of them at most, so choose them first in a larger panel.

    With ``components`` a larger panel is turned into its principal components at the item's positions, of which there are no more than positions.
    """
    one, others = df.filter(F.col("item_id") == item), df.filter(F.col("item_id") != item)
    n = others.select("item_id").distinct().limit(most + 1).count()
    if n > most and not components:
        raise ValueError(f"more than {most} other series: choose the covariates")
    known = (principal(one, others, most) if n > most else side_by_side(one, others)) if n else None
    return run_multi(one, horizon, season, heavy, known=known)


def principal(one: DataFrame, others: DataFrame, most: int = 1024) -> DataFrame:
    """At every position of ``one``, a vector of the principal components of what all other series hold there; missing values count as 0, and ``one`` has ``most`` positions at most.

    Products of positions, summed over the series, have the size of the positions squared, whatever the number of series. Vectors of all components have the same products, so a linear model
    of them can be any linear model of the series, and nothing is lost.
    """
    spark = one.sparkSession
    at = [(r.item_id, r.pos) for r in one.select("item_id", "pos").orderBy("pos").limit(most + 1).collect()]
    if len(at) > most:
        raise ValueError(f"more than {most} positions")
    n, place = len(at), {pos: i for i, (_, pos) in enumerate(at)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for part in parts:
            for begin in range(0, len(part), 256):
                block = np.zeros((n, min(256, len(part) - begin)))
                for k, (places, values) in enumerate(zip(part["_at"][begin : begin + 256], part["_x"][begin : begin + 256])):
                    block[places, k] = values
                total += block @ block.T
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    places = F.broadcast(spark.createDataFrame([(pos, i) for pos, i in place.items()], "pos long, _i int"))
    told = others.filter("x is not null and not isnan(x)").join(places, "pos").groupBy("item_id").agg(F.collect_list(F.struct("_i", F.col("x").cast("double").alias("x"))).alias("_all"))
    sums = told.select(F.col("_all._i").alias("_at"), F.col("_all.x").alias("_x")).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    products = np.zeros((n, n))
    products[sums["i"], sums["j"]] = sums["v"]
    size, axes = np.linalg.eigh((products + products.T) / 2)
    kept = np.flatnonzero(size > max(size.max(), 0) * n * np.finfo("float64").eps)[::-1]
    if not len(kept):
        kept = np.array([n - 1])
    axes = axes[:, kept] * np.where(axes[np.abs(axes[:, kept]).argmax(axis=0), kept] < 0, -1, 1)
    values = axes * np.sqrt(np.maximum(size[kept], 0))
    kinds = ", ".join(f"{c} {one.schema[c].dataType.simpleString()}" for c in ("item_id", "pos"))
    rows = spark.createDataFrame([(item, pos, v) for (item, pos), v in zip(at, values.tolist())], f"{kinds}, known array<double>")
    return rows.withColumn("known", array_to_vector("known"))


def side_by_side(one: DataFrame, others: DataFrame) -> DataFrame:
    """At every position of ``one``, a vector of what the other series hold there, in order of their names; missing values count as 0. The caller bounds the number of the others."""
    grid = one.select(F.col("item_id").alias("_one"), "pos").join(F.broadcast(others.select("item_id").distinct()))
    each = grid.join(others.select("item_id", "pos", "x"), ["item_id", "pos"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    held = each.groupBy(F.col("_one").alias("item_id"), "pos").agg(F.array_sort(F.collect_list(F.struct("item_id", "x"))).alias("_all"))
    return held.select("item_id", "pos", array_to_vector(F.col("_all.x")).alias("known"))
