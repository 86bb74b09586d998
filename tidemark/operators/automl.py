"""Regression candidates on feature tables: folds, stacking, leaderboards and the choice of a leader."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from queue import Queue

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.metrics import mae, rmse, rmsle
from tidemark.operators import boosting
from tidemark.sources.staging import scratch, staged


def assembled(df: DataFrame, inputs: Sequence[str], target: str = "y") -> DataFrame:
    """``df`` with its inputs as a vector; rows without a target are left out, missing inputs count as 0."""
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df.filter(F.col(target).isNotNull()).fillna(0.0, list(inputs)))


def candidates(seed: int = 42, trees: int = 5) -> dict[str, Estimator]:
    """Four boosted models, a second boosted family with absolute loss and subsamples, and a random forest."""
    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "p", "seed": seed}
    return {
        "GBM_1": GBTRegressor(maxIter=trees, maxDepth=3, **common), "GBM_2": GBTRegressor(maxIter=trees, maxDepth=4, stepSize=0.2, **common),
        "GBM_3": GBTRegressor(maxIter=trees, maxDepth=5, subsamplingRate=0.8, **common), "GBM_4": GBTRegressor(maxIter=trees, maxDepth=2, stepSize=0.3, **common),
        "XGB_1": GBTRegressor(maxIter=trees, maxDepth=3, lossType="absolute", subsamplingRate=0.7, **common),
        "DRF_1": RandomForestRegressor(numTrees=trees, maxDepth=5, **common),
    }


def fold(folds: int, pos: str = "pos", blocked: int | None = None) -> Column:
    """The fold of a row: its position modulo ``folds``, or contiguous blocks of ``blocked`` positions in turn."""
    return F.pmod(F.col(pos) if blocked is None else F.floor(F.col(pos) / blocked), F.lit(folds)).cast("int")


def fit_together(jobs: Sequence[tuple[Estimator, DataFrame]], at_once: int = 4) -> list[Model]:
    """The fitted models of all jobs, in their order. No more than ``at_once`` are being fitted at a time, each in a scheduler pool of its own, which a session with fair scheduling serves alike."""
    if not jobs:
        return []
    spark = jobs[0][1].sparkSession
    free: Queue[int] = Queue()
    for slot in range(at_once):
        free.put(slot)

    @inheritable_thread_target(spark)
    def fit(job: tuple[Estimator, DataFrame]) -> Model:
        slot = free.get()
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{slot}")
            return job[0].fit(job[1])
        finally:
            free.put(slot)

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(fit, jobs))


def by_fold(df: DataFrame) -> DataFrame:
    """``df`` written once with a folder for each fold, so that fits and predictions read the folds that they want and no others."""
    path = scratch(df.sparkSession, "folds")
    df.write.partitionBy("fold").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def out_of_fold(df: DataFrame, models: dict[str, Estimator], folds: int, key: Sequence[str], at_once: int = 4) -> DataFrame:
    """Predictions of every row by models that were fitted without its fold: key, y, model and p. The source is read once. Trees and forests of all folds grow in shared passes over packed bins; of
    other kinds, up to ``at_once`` fits run side by side."""
    df = by_fold(df)
    trees = [name for name in models if boosting.fits(models[name])]
    alike = len({(models[name].getFeaturesCol(), models[name].getLabelCol()) for name in trees}) == 1
    tasks = [(name, k) for name in (trees if alike else ()) for k in range(folds)]
    fitted = boosting.grown(boosting.packed(df, models[trees[0]], range(folds)), [(models[name], k) for name, k in tasks]) if tasks else []
    others = [(name, k) for name in models if not alike or name not in trees for k in range(folds)]
    fitted += fit_together([(models[name], df.filter(F.col("fold") != k)) for name, k in others], at_once)
    tasks += others
    parts = [m.transform(df.filter(F.col("fold") == k)).select(*key, "y", F.lit(name).alias("model"), "p") for (name, k), m in zip(tasks, fitted)]
    return reduce(DataFrame.unionByName, parts)


def train(df: DataFrame, models: dict[str, Estimator], budget_s: float | None = None, packed: bool = False) -> tuple[dict[str, Model], DataFrame]:
    """Fitted models and a table (model, fit_time, fit_order); where a budget is given, no candidate is begun after it.

    ``packed`` fits trees and forests over bins that are written once, which the first one's time includes; such models can be applied, but not saved.
    """
    began, fitted, times, bins = time.monotonic(), {}, [], {}
    for name, estimator in models.items():
        if fitted and budget_s is not None and time.monotonic() - began > budget_s:
            break
        at = time.monotonic()
        if packed and boosting.fits(estimator):
            columns = estimator.getFeaturesCol(), estimator.getLabelCol()
            bins[columns] = bins.get(columns) or boosting.packed(df, estimator)
            fitted[name] = boosting.grown(bins[columns], [(estimator, None)])[0]
        else:
            fitted[name] = estimator.fit(df)
        times.append((name, time.monotonic() - at, len(times) + 1))
    return fitted, df.sparkSession.createDataFrame(times, "model string, fit_time double, fit_order int")


def train_together(df: DataFrame, models: dict[str, Estimator]) -> dict[str, Model]:
    """The fitted models of trees and forests that read the same columns: all of them grow over the same packed bins, in passes that they share. They can be applied, but not saved."""
    return dict(zip(models, boosting.grown(boosting.packed(df, next(iter(models.values()))), [(m, None) for m in models.values()])))


def predictions(fitted: dict[str, Model], df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Long predictions of all models: key, y, model, p. Models that grew together make theirs in one pass."""
    models = list(fitted.values())
    if len(models) > 1 and all(isinstance(m, boosting.BoostedModel) and m.splits is models[0].splits and m.features == models[0].features for m in models):
        each = F.arrays_zip(F.array(*map(F.lit, fitted)).alias("model"), boosting.predictions_of(models).alias("p"))
        return df.select(*key, "y", F.explode(each).alias("_each")).select(*key, "y", "_each.model", "_each.p")
    return reduce(DataFrame.unionByName, [m.transform(df).select(*key, "y", F.lit(name).alias("model"), "p") for name, m in fitted.items()])


def stack(held: DataFrame, models: Sequence[str], key: Sequence[str]) -> LinearRegression:
    """A linear model of the out-of-fold predictions."""
    wide = held.groupBy(*key, "y").pivot("model", list(models)).agg(F.first("p")).dropna()
    return LinearRegression(featuresCol="features", labelCol="y", predictionCol="p", regParam=1e-4).fit(assembled(wide, models))


def stacked(meta, every: DataFrame, models: Sequence[str], key: Sequence[str]) -> DataFrame:
    wide = every.groupBy(*key, "y").pivot("model", list(models)).agg(F.first("p")).dropna()
    return meta.transform(assembled(wide, models)).select(*key, "y", F.lit("StackedEnsemble_1").alias("model"), "p")


def leaderboard(every: DataFrame) -> DataFrame:
    """mae, rmse, mse, rmsle and mean residual deviance of each model (model, y, p), the best first."""
    mse = F.avg(F.pow(F.col("y") - F.col("p"), 2))
    scores = every.filter("y is not null and p is not null").groupBy("model").agg(mae().alias("mae"), rmse().alias("rmse"), mse.alias("mse"), rmsle().alias("rmsle"), mse.alias("deviance"))
    return scores.orderBy("mae", "model")


def panel_leaderboard(every: DataFrame, naive: DataFrame, validation: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """Negated MASE of each model over items: ``every`` has (item_id, model, y, p), ``naive`` (item_id, naive_mae).

    ``validation`` (as ``every``) adds score_val; ``times`` (model, fit_time, predict_time, fit_order) adds its columns.
    """

    def scores(of: DataFrame, name: str) -> DataFrame:
        errors = of.groupBy("model", "item_id").agg(mae().alias("mae")).join(naive, "item_id")
        return errors.groupBy("model").agg((-F.avg(F.col("mae") / F.col("naive_mae"))).alias(name))

    out = scores(every, "score_test")
    if validation is not None:
        out = out.join(scores(validation, "score_val"), "model", "left")
    if times is not None:
        out = out.join(F.broadcast(times), "model", "left")
    return out.orderBy(F.desc("score_test"), "model")


def timed_predictions(fitted: dict[str, Model], df: DataFrame, key: Sequence[str], times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of all models, each written as it is made, and ``times`` with how long that took (predict_time)."""
    parts, took = [], []
    for name, model in fitted.items():
        began = time.monotonic()
        parts.append(staged(predictions({name: model}, df, key), f"predictions-{name}"))
        took.append((name, time.monotonic() - began))
    return reduce(DataFrame.unionByName, parts), times.join(df.sparkSession.createDataFrame(took, "model string, predict_time double"), "model")


def family(model: str = "model") -> Column:
    return F.split(F.col(model), "_")[0]


def leaders(board: DataFrame) -> DataFrame:
    """The leader and the best model of another family, stacked ensembles aside (role, model, mae)."""
    ranked = board.withColumn("family", family())
    first = ranked.orderBy("mae", "model").limit(1).select(F.lit("leader").alias("role"), "model", "mae", "family")
    other = ranked.join(F.broadcast(first.select(F.col("family").alias("_first"))), F.col("family") != F.col("_first")).filter("family <> 'StackedEnsemble'")
    second = other.orderBy("mae", "model").limit(1).select(F.lit("runner_up").alias("role"), "model", "mae", "family")
    return first.unionByName(second)
