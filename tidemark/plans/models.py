"""Registered queries that forecast, fit, score and explain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import errors, metrics
from tidemark.operators import automl, clean, detect, explain, features, forecast, frames, network
from tidemark.operators.vae import CausalVAE, candidates, search
from tidemark.plans.catalogue import DET, FC, HORIZON, WF, YEAR, detection_frame, filled_weeks, forecast_frame, r, rounded
from tidemark.sources import io
from tidemark.sources.samples import CHANNELS, hourly_events
from tidemark.sources.staging import scratch, setting, staged

FOUND = {}
SQL = {}


def query(sql: str | None = None):
    def add(fn):
        FOUND[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Sinks and state.


@query(f"WITH {DET} SELECT ts, channel, CASE WHEN x < recon - 2 * sigma OR x > recon + 3 * sigma THEN 1 ELSE 0 END AS pred, {r('abs(x - recon)', 'score')}, {r('recon', 'recon')}, {r('sigma', 'sigma')} FROM det")
def a4_write_detection(spark, sf_dir):
    alphas = spark.createDataFrame([(c, 3, 2) for c in CHANNELS], "channel string, alpha_up int, alpha_down int")
    path = scratch(spark, "detection")
    io.write_detection(rounded(detect.detect(detection_frame(spark, sf_dir), alphas), "score", "recon", "sigma"), None, path)
    return spark.read.parquet(f"{path}/detection")


@query(f"WITH {FC} SELECT item_id, pos, {r('y', 'y')}, {r('p', 'p')} FROM fc")
def a5_write_results(spark, sf_dir):
    path = scratch(spark, "results")
    io.write_results({"forecast": rounded(forecast_frame(spark, sf_dir).drop("ts"), "y", "p")}, path)
    return io.read_results(spark, path, ["forecast"])["forecast"]


@query(f"WITH {WF} SELECT item_id, {r('avg(x)', 'mean')}, {r('CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END', 'scale')} FROM wfill GROUP BY 1")
def a6_saved_state(spark, sf_dir):
    path = scratch(spark, "state")
    io.save_state(rounded(clean.fit_scaler(filled_weeks(spark, sf_dir)), "mean", "scale"), path)
    return io.load_state(spark, path)


# The network, over the weekly series of every supplier in two channels: the scaled value and its mean over four weeks.


def network_frame(spark, sf_dir) -> DataFrame:
    df, _ = clean.preprocess(filled_weeks(spark, sf_dir), "fit", max_std=7)
    df = df.withColumn("mean4", F.avg("x").over(features.series().rowsBetween(-3, 0)))
    return staged(df.select(F.col("item_id").alias("series"), F.col("pos").cast("long").alias("pos"), "x", "mean4"), "network")


def small_network(**more) -> CausalVAE:
    settings = {"length": 12, "units": (8, 8, 8), "dilations": (1, 2, 4), "latent": 2, "rate": 5e-3, "epochs": 2, "batch": 64, "seed": 7}
    return CausalVAE.initial(("x", "mean4"), **{**settings, **more})


LOSS = """l AS (SELECT item_id, pos, x, lag(x, 52) OVER (PARTITION BY item_id ORDER BY pos) AS mu, 0.1 * sin(pos) AS lv, 0.2 * cos(pos) AS zm, 0.05 * sin(2 * pos) AS zlv FROM wfill)"""


@query(f"""WITH {WF}, {LOSS} SELECT item_id, {r('avg(0.5 * pow((x - mu) / exp(lv), 2) + lv)', 'reconstruction')}, {r('avg(-0.5 * (1 + zlv - zm * zm - exp(zlv)))', 'kl')}
FROM l WHERE mu IS NOT NULL GROUP BY 1""")
def f4_loss(spark, sf_dir):
    df = filled_weeks(spark, sf_dir).withColumn("mu", F.lag("x", YEAR).over(features.series())).filter("mu is not null")
    df = df.select("item_id", "x", "mu", (0.1 * F.sin("pos")).alias("lv"), (0.2 * F.cos("pos")).alias("zm"), (0.05 * F.sin(2 * F.col("pos"))).alias("zlv"))

    def run(parts):
        for p in parts:
            a, b = network.losses(p["x"].to_numpy(), {"xm": p["mu"].to_numpy(), "xv": p["lv"].to_numpy(), "zm": p["zm"].to_numpy(), "zv": p["zlv"].to_numpy()})
            yield p[["item_id"]].assign(a=a, b=b)

    kind = df.schema["item_id"].dataType.simpleString()
    each = df.mapInPandas(run, f"item_id {kind}, a double, b double")
    return rounded(each.groupBy("item_id").agg(F.avg("a").alias("reconstruction"), F.avg("b").alias("kl")), "reconstruction", "kl")


def split_by_share(df: DataFrame, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """What lies before a share of the last position, and the rest."""
    cut = int(share * df.agg(F.max("pos")).first()[0])
    return df.filter(F.col("pos") < cut), df.filter(F.col("pos") >= cut)


def fitted_network(spark, sf_dir, **more):
    df = network_frame(spark, sf_dir)
    return small_network(**more).fit(*split_by_share(df)), df


@query()
def f5_fit(spark, sf_dir):
    return fitted_network(spark, sf_dir)[0][1]


@query()
def f5_steps(spark, sf_dir):
    """The loss of every step of all groups."""
    df, steps = network_frame(spark, sf_dir), []
    train, held = split_by_share(df)
    small_network().fit(train, held, steps=steps)
    return spark.createDataFrame(steps, "epoch int, step int, windows long, loss double")


@query()
def f7_score(spark, sf_dir):
    (model, _), df = fitted_network(spark, sf_dir, epochs=1)
    return model.score(df, latent=False)


@query()
def f8_latent(spark, sf_dir):
    (model, _), df = fitted_network(spark, sf_dir, epochs=1)
    return model.latent(df).select("series", "pos", F.explode("z").alias("z"))


@query()
def f9_evaluate(spark, sf_dir):
    (model, _), df = fitted_network(spark, sf_dir, epochs=1)
    return model.evaluate(df)


@query()
def f10_search(spark, sf_dir):
    df = network_frame(spark, sf_dir)
    settings = candidates(4, seed=3, lengths=(8, 16, 32), widths=(4, 8, 16))
    return search(*split_by_share(df), ("x", "mean4"), settings, epochs=2, seed=7)


@query()
def g11_detect(spark, sf_dir):
    return detection_bundle(spark, sf_dir, "point")


@query()
def g11_detect_by_ranges(spark, sf_dir):
    return detection_bundle(spark, sf_dir, "range")


def detection_bundle(spark, sf_dir, by: str) -> DataFrame:
    """The network over the five hourly channels, widths chosen on the first two thirds of the hours, and the detector's tables, written and read back."""
    hours = staged(hourly_events(spark, sf_dir), "hours").withColumnRenamed("channel", "item_id")
    scaled, _ = clean.preprocess(hours, "fit", max_std=7)
    wide = scaled.groupBy(F.lit(0).alias("series"), F.col("pos").cast("long").alias("pos")).pivot("item_id", list(CHANNELS)).agg(F.first("x"))
    model, _ = CausalVAE.initial(CHANNELS, length=24, units=(8, 8, 8), dilations=(1, 2, 4), latent=2, rate=5e-3, epochs=3, batch=32, seed=7).fit(*split_by_share(wide, 2 / 3))
    labels = hours.select(F.col("pos").cast("long").alias("pos"), F.col("item_id").alias("channel"), "label", "ts")
    scores = model.score(wide)
    told = staged(scores.drop("z").join(labels, ["pos", "channel"]), "scores")
    alphas = detect.resolved_alphas(told, fitted=detect.fit_alphas(split_by_share(told, 2 / 3)[0], by))
    path = scratch(spark, "bundle")
    io.write_detection(detect.detect(told, alphas), model.latent(wide), path)
    return spark.read.parquet(f"{path}/detection")


# Forecasts.

TRAIN = f"tr AS (SELECT item_id, pos, ts, x, last - {HORIZON} AS cut FROM wlag WHERE pos <= last - {HORIZON})"
STEPS = f"hs AS (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INTEGER) AS h)"


def train_part(spark, sf_dir) -> DataFrame:
    return frames.drop_last(filled_weeks(spark, sf_dir), HORIZON)


@query(f"WITH {FC}, {TRAIN}, {STEPS} SELECT item_id, CAST(pos + h AS INTEGER) AS pos, h, {r('x', 'mean')} FROM tr CROSS JOIN hs WHERE pos = cut")
def h1_naive(spark, sf_dir):
    return rounded(forecast.naive(train_part(spark, sf_dir), HORIZON), "mean")


@query(f"WITH {FC}, {TRAIN}, {STEPS} SELECT item_id, CAST(cut + h AS INTEGER) AS pos, h, {r('x', 'mean')} FROM tr CROSS JOIN hs WHERE pos = cut - {YEAR} + h")
def h2_seasonal_naive(spark, sf_dir):
    return rounded(forecast.seasonal_naive(train_part(spark, sf_dir), HORIZON, YEAR), "mean")


@query()
def h3_ets(spark, sf_dir):
    return forecast.ets(train_part(spark, sf_dir), HORIZON, YEAR)


@query()
def h4_theta(spark, sf_dir):
    return forecast.theta(train_part(spark, sf_dir), HORIZON, YEAR)


@query()
def h5_direct_tabular(spark, sf_dir):
    return forecast.direct_tabular(train_part(spark, sf_dir), HORIZON, YEAR)


@query()
def h6_recursive_tabular(spark, sf_dir):
    return forecast.recursive_tabular(train_part(spark, sf_dir), HORIZON)


@query(f"""WITH {FC}, {TRAIN}, {STEPS}, a AS (SELECT item_id, pos + h AS pos, x AS a FROM tr CROSS JOIN hs WHERE pos = cut), b AS (SELECT item_id, cut + h AS pos, x AS b FROM tr CROSS JOIN hs WHERE pos = cut - {YEAR} + h)
SELECT item_id, CAST(pos AS INTEGER) AS pos, {r('(0.25 * a + 0.75 * b) / (0.25 + 0.75)', 'mean')} FROM a JOIN b USING (item_id, pos)""")
def h7_weighted_ensemble(spark, sf_dir):
    train = train_part(spark, sf_dir)
    both = forecast.naive(train, HORIZON).withColumn("model", F.lit("Naive")).unionByName(forecast.seasonal_naive(train, HORIZON, YEAR).withColumn("model", F.lit("SeasonalNaive")))
    weights = spark.createDataFrame([("Naive", 0.25), ("SeasonalNaive", 0.75)], "model string, weight double")
    return rounded(forecast.weighted(both, weights), "mean")


@query()
def h7_ensemble_selection(spark, sf_dir):
    train = staged(train_part(spark, sf_dir), "train")
    wide = forecast_frame(spark, sf_dir).select("item_id", "pos", "y")
    for name, df in (("Naive", forecast.naive(train, HORIZON)), ("SeasonalNaive", forecast.seasonal_naive(train, HORIZON, YEAR))):
        wide = wide.join(df.select("item_id", "pos", F.col("mean").alias(name)), ["item_id", "pos"])
    return forecast.ensemble_weights(staged(wide, "validation-wide"), ["Naive", "SeasonalNaive"])


@query(f"""WITH {FC}, {TRAIN}, rs AS (SELECT item_id, (pos - (last - {HORIZON}) - 1) // 13 AS part, y - p AS residual FROM (SELECT w.item_id, w.pos, w.x AS y, w.p, w.last FROM wlag w) WHERE pos > last - {HORIZON}),
q AS (SELECT item_id, part, quantile_cont(residual, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM rs GROUP BY 1, 2)
SELECT fc.item_id, fc.pos, {', '.join(r(f'p + q[{i}]', f'q{n}') for i, n in enumerate((10, 25, 50, 75, 90), 1))} FROM fc JOIN wlag USING (item_id, pos) JOIN q ON q.item_id = fc.item_id AND q.part = (fc.pos - (last - {HORIZON}) - 1) // 13""".replace("p + q[", "fc.p + q["))
def h8_quantiles(spark, sf_dir):
    df = forecast_frame(spark, sf_dir)
    first = df.groupBy("item_id").agg(F.min("pos").alias("_first"))
    df = df.join(first, "item_id").withColumn("h", F.col("pos") - F.col("_first") + 1)
    residuals = df.select("item_id", "h", (F.col("y") - F.col("p")).alias("residual"))
    out = forecast.with_quantiles(df.select("item_id", "pos", "h", F.col("p").alias("mean")), residuals, 13)
    names = ["q10", "q25", "q50", "q75", "q90"]
    return rounded(out.select("item_id", "pos", *names), *names)


@query(f"""WITH {FC}, k AS (SELECT CAST(unnest([1, 2]) AS INTEGER) AS "window") SELECT item_id, pos, "window", {r('x', 'x')}, CASE WHEN pos <= last - "window" * {HORIZON} THEN 'train' ELSE 'validation' END AS part
FROM wlag CROSS JOIN k WHERE pos <= last - "window" * {HORIZON} + {HORIZON}""")
def h9_backtest_windows(spark, sf_dir):
    return rounded(forecast.backtest_windows(filled_weeks(spark, sf_dir), HORIZON, 2).drop("ts"), "x")


@query()
def h10_run_single(spark, sf_dir):
    df = staged(filled_weeks(spark, sf_dir), "weeks")
    first = df.agg(F.min("item_id")).first()[0]
    return forecast.run_single(df, first, HORIZON, YEAR, components=True)["forecast"]


@query()
def h11_run_multi(spark, sf_dir):
    return forecast.run_multi(filled_weeks(spark, sf_dir), HORIZON, YEAR)["forecast"]


@query(f"WITH {FC} SELECT item_id, pos, {r('y', 'actual')}, {r('p', 'predicted')} FROM fc")
def h12_forecast_actual(spark, sf_dir):
    made = forecast.seasonal_naive(train_part(spark, sf_dir), HORIZON, YEAR)
    return rounded(forecast.against_actual(made, filled_weeks(spark, sf_dir)), "actual", "predicted")


# Regression.

INPUTS = ["x_lag_1", "x_lag_2", "x_lag_52", "x_roll_mean_12", "month"]


def feature_frame(spark, sf_dir) -> DataFrame:
    w = features.series()
    columns = features.lags("x", (1, 2, 52), w) | features.rolling("x", (12,), w, ("mean",)) | {"month": F.month("ts")}
    return filled_weeks(spark, sf_dir).withColumns(columns).filter("x_lag_52 is not null").withColumnRenamed("x", "y")


def fitted(spark, sf_dir, names=None):
    df = automl.assembled(feature_frame(spark, sf_dir), INPUTS)
    models = automl.candidates(trees=10)
    models = {k: v for k, v in models.items() if names is None or k in names}
    df = staged(df, "features")
    early, late = split_by_share(df, 0.83)
    # A task keeps its rows in memory in a wider form than the files have; small parts keep that the same however large the table is.
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(16 << 20)):
        return automl.train(early, models)[0], late


def fit_query(name: str, model: str) -> None:
    def fn(spark, sf_dir):
        found, test = fitted(spark, sf_dir, {model})
        return automl.predictions(found, test, ["item_id", "pos"])

    fn.__name__ = name
    query()(fn)


for _name, _model in (("i1_gbm", "GBM_1"), ("i2_boosted_variant", "XGB_1"), ("i3_random_forest", "DRF_1")):
    fit_query(_name, _model)


@query()
def i10_batch_prediction(spark, sf_dir):
    """A model that is fitted, saved, loaded and then applied."""
    found, test = fitted(spark, sf_dir, {"GBM_2"})
    path = scratch(spark, "model")
    io.save_model(found["GBM_2"], path)
    return automl.predictions({"GBM_2": io.load_model(spark, path)}, test, ["item_id", "pos"])


@query()
def i4_stacked_ensemble(spark, sf_dir):
    """The meta model is fitted on out-of-fold predictions of the earlier weeks and applied to the later ones, which no model has seen."""
    df = staged(automl.assembled(feature_frame(spark, sf_dir), INPUTS), "features")
    early, late = split_by_share(df, 0.83)
    early = early.withColumn("fold", automl.fold(5))
    models = {k: v for k, v in automl.candidates(trees=5).items() if k in ("GBM_1", "XGB_1", "DRF_1")}
    key = ["item_id", "pos"]
    meta = automl.stack(automl.out_of_fold(early, models, 5, key), sorted(models), key)
    found, _ = automl.train(early, models, packed=True)
    return automl.stacked(meta, automl.predictions(found, late, key), sorted(models), key)


@query()
def i5_cross_validation(spark, sf_dir):
    df = staged(automl.assembled(feature_frame(spark, sf_dir), INPUTS), "features").withColumn("fold", automl.fold(5))
    models = automl.candidates(trees=3)
    return automl.out_of_fold(df, models, 5, ["item_id", "pos"]).groupBy("model").agg(metrics.mae().alias("mae"))


@query()
def i8_fitted_leaderboard(spark, sf_dir):
    """All candidates, fitted on the first three quarters of the weeks, validated up to 83 of 100 and tested after."""
    df = staged(automl.assembled(feature_frame(spark, sf_dir), INPUTS), "features")
    early, later = split_by_share(df, 0.75)
    found, times = automl.train(early, automl.candidates(trees=5), packed=True)
    every, times = automl.timed_predictions(found, later, ["item_id", "pos"], times)
    naive = metrics.seasonal_error(early.select("item_id", "pos", F.col("y").alias("x")), YEAR)
    validation, test = split_by_share(every, 0.83)
    return automl.panel_leaderboard(test, naive, validation, times)


@query()
def i7_fitted_leaders(spark, sf_dir):
    df = staged(automl.assembled(feature_frame(spark, sf_dir), INPUTS), "features")
    early, test = split_by_share(df, 0.83)
    found = automl.train_together(early, automl.candidates(trees=10))
    return automl.leaders(staged(automl.leaderboard(automl.predictions(found, test, ["item_id", "pos"])), "leaderboard"))


@query()
def l10_fitted_importance(spark, sf_dir):
    """Shares of importance and their ranks over the candidates whose error is within five per cent of the best."""
    found, test = fitted(spark, sf_dir)
    near = explain.rashomon(automl.leaderboard(automl.predictions(found, test, ["item_id", "pos"])), 1.05)
    names = [row.model for row in near.select("model").collect()]
    every = reduce(DataFrame.unionByName, [explain.variable_importance(spark, found[n], INPUTS).select(F.lit(n).alias("model"), "variable", F.col("relative").alias("importance")) for n in names])
    return explain.rank_stability(explain.normalised_importance(every))


#: Stand-ins that SQL can state too; their names only follow the pattern of families. ``i7_fitted_leaders``, ``i8_fitted_leaderboard`` and ``l10_fitted_importance`` have fitted models.
BASE = {"GBM_1": "p", "DRF_1": "p1", "GBM_2": "p4", "Mean_1": "pm"}
BOARD_SQL = f"""{FC}, b AS (SELECT item_id, pos, last, x AS y, p, lag(x, 1) OVER w AS p1, avg(x) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p4, avg(x) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS pm FROM wlag WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
e AS ({' UNION ALL '.join(f"SELECT item_id, pos, y, '{m}' AS model, {c} AS p FROM b WHERE pos > last - {HORIZON}" for m, c in BASE.items())}),
board AS (SELECT model, avg(abs(y - p)) AS mae, sqrt(avg(pow(y - p, 2))) AS rmse, avg(pow(y - p, 2)) AS mse, CASE WHEN least(min(y), min(p)) > -1 THEN sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))) END AS rmsle FROM e WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1)"""


def simple_models(spark, sf_dir) -> DataFrame:
    """Predictions that SQL can state too, under the names of model families: a year before, last week, and means."""
    w = features.series()
    df = filled_weeks(spark, sf_dir).withColumns({"p": F.lag("x", YEAR).over(w), "p1": F.lag("x", 1).over(w), "p4": F.avg("x").over(w.rowsBetween(-4, -1)), "pm": F.avg("x").over(w.rowsBetween(-52, -1))})
    df = frames.keep_last(df, HORIZON)
    return reduce(DataFrame.unionByName, [df.select("item_id", "pos", F.col("x").alias("y"), F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in BASE.items()])


@query(f"WITH {BOARD_SQL} SELECT model, {r('mae', 'mae')}, {r('rmse', 'rmse')}, {r('mse', 'mse')}, {r('rmsle', 'rmsle')}, {r('mse', 'deviance')} FROM board")
def i7_leaderboard(spark, sf_dir):
    return rounded(automl.leaderboard(simple_models(spark, sf_dir)), "mae", "rmse", "mse", "rmsle", "deviance")


@query(f"""WITH {BOARD_SQL}, n AS (SELECT item_id, avg(abs(x - p)) AS naive FROM wlag WHERE pos <= last - {HORIZON} GROUP BY 1), t AS (SELECT model, item_id, avg(abs(y - p)) AS mae FROM e GROUP BY 1, 2)
SELECT model, {r('-avg(mae / naive)', 'score_test')} FROM t JOIN n USING (item_id) GROUP BY 1""")
def i8_panel_leaderboard(spark, sf_dir):
    naive = metrics.seasonal_error(train_part(spark, sf_dir), YEAR)
    return rounded(automl.panel_leaderboard(simple_models(spark, sf_dir), naive), "score_test")


@query(f"""WITH {BOARD_SQL}, k AS (SELECT model, mae, split_part(model, '_', 1) AS family, row_number() OVER (ORDER BY mae, model) AS n FROM board), f AS (SELECT * FROM k WHERE n = 1),
s AS (SELECT * FROM k WHERE family <> (SELECT family FROM f) AND family <> 'StackedEnsemble' ORDER BY mae, model LIMIT 1)
SELECT 'leader' AS role, model, {r('mae', 'mae')}, family FROM f UNION ALL SELECT 'runner_up', model, {r('mae', 'mae')}, family FROM s""")
def i9_leaders(spark, sf_dir):
    return rounded(automl.leaders(automl.leaderboard(simple_models(spark, sf_dir))), "mae")


# Errors and explanation that need a model.

FIXED = {"x_lag_1": 0.3, "x_lag_52": 0.4, "x_roll_mean_12": 0.2, "month": 0.01}


def fixed_prediction(df: DataFrame) -> DataFrame:
    """A linear score with fixed coefficients, which SQL can state as well."""
    return df.withColumn("p", explain.linear(FIXED, 0.05))


@query()
def k4_permutation_importance(spark, sf_dir):
    return errors.permutation_importance(feature_frame(spark, sf_dir), ["x_lag_1", "x_lag_52"], fixed_prediction)


@query(f"WITH {BOARD_SQL} SELECT item_id, pos, model, {r('y', 'y')}, {r('p', 'p')} FROM e")
def k10_model_comparison(spark, sf_dir):
    return rounded(simple_models(spark, sf_dir), "y", "p")


@query()
def l1_variable_importance(spark, sf_dir):
    found, _ = fitted(spark, sf_dir, {"GBM_1"})
    return explain.variable_importance(spark, found["GBM_1"], INPUTS)


FEATURES_SQL = f"""{WF}, ft AS (SELECT item_id, pos, x AS y, lag(x, 1) OVER w AS x_lag_1, lag(x, 52) OVER w AS x_lag_52, avg(x) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x_roll_mean_12, month(ts) AS month FROM wfill WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
ff AS (SELECT * FROM ft WHERE x_lag_52 IS NOT NULL)"""
PDP_OF = ("x_lag_1", "x_lag_52")


def pdp_sql(points: int) -> str:
    each = []
    for v in PDP_OF:
        score = " + ".join(f"{w} * {'value' if c == v else c}" for c, w in FIXED.items())
        each.append(f"SELECT '{v}' AS variable, i, value, avg({score} + 0.05) AS m, stddev_samp({score} + 0.05) AS s FROM ff CROSS JOIN (SELECT i, lo + (hi - lo) * i / {points - 1} AS value FROM (SELECT min({v}) AS lo, max({v}) AS hi FROM ff) CROSS JOIN (SELECT CAST(unnest(range({points})) AS INTEGER) AS i)) GROUP BY i, value")
    return " UNION ALL ".join(each)


@query(f"WITH {FEATURES_SQL}, pd AS ({pdp_sql(10)}) SELECT variable, i, {r('value', 'value')}, {r('m', 'mean_p')}, {r('s', 'std_p')} FROM pd")
def l3_partial_dependence(spark, sf_dir):
    df = feature_frame(spark, sf_dir)
    out = explain.partial_dependence(df, explain.grid_of(df, PDP_OF, 10), PDP_OF, fixed_prediction)
    return rounded(out, "value", "mean_p", "std_p")


@query()
def l4_dependence_across_models(spark, sf_dir):
    found, test = fitted(spark, sf_dir, {"GBM_1", "DRF_1"})
    by_model = W.partitionBy("model").orderBy(F.desc("relative"), "variable")
    ranked = [explain.variable_importance(spark, m, INPUTS).withColumn("model", F.lit(n)).withColumn("rank", F.row_number().over(by_model)).filter("rank <= 2").select("variable", "rank") for n, m in found.items()]
    chosen = [row.variable for row in explain.top_union(reduce(DataFrame.unionByName, ranked), 2).collect()]
    df = test.drop("features")
    parts = []
    for name, m in found.items():
        predict = lambda d, m=m: m.transform(automl.assembled(d, INPUTS))
        parts.append(explain.partial_dependence(df, explain.grid_of(df, chosen, 5), chosen, predict).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {FEATURES_SQL}, q AS (SELECT quantile_cont(x_lag_1, [{', '.join(repr(0.02 + 0.96 * i / 14) for i in range(15))}]) AS q FROM ff), g AS (SELECT CAST(unnest(range(15)) AS INTEGER) AS i FROM q)
SELECT 'x_lag_1' AS variable, g.i, {r('(SELECT q FROM q)[g.i + 1]', 'value')}, {r('avg(0.3 * (SELECT q FROM q)[g.i + 1] + 0.4 * x_lag_52 + 0.2 * x_roll_mean_12 + 0.01 * month + 0.05)', 'mean_p')} FROM ff CROSS JOIN g GROUP BY g.i""")
def l5_covariate_dependence(spark, sf_dir):
    df = feature_frame(spark, sf_dir)
    out = explain.partial_dependence(df, explain.quantile_grid(df, ["x_lag_1"]), ["x_lag_1"], fixed_prediction)
    return rounded(out.drop("std_p"), "value", "mean_p")


@query(f"WITH {FEATURES_SQL}, pd AS ({pdp_sql(10)}) SELECT variable, i, {r('(value - min(value) OVER (PARTITION BY variable)) / (max(value) OVER (PARTITION BY variable) - min(value) OVER (PARTITION BY variable) + 1e-12)', 'position')} FROM pd")
def l6_normalised_grid(spark, sf_dir):
    df = feature_frame(spark, sf_dir)
    out = explain.partial_dependence(df, explain.grid_of(df, PDP_OF, 10), PDP_OF, fixed_prediction)
    return rounded(explain.normalised_grid(out).select("variable", "i", "position"), "position")


def shapley_values(spark, sf_dir) -> DataFrame:
    found, test = fitted(spark, sf_dir, {"GBM_1"})
    return explain.shapley(test.drop("features"), found["GBM_1"], INPUTS, ["item_id", "pos"])


@query()
def l7_shapley(spark, sf_dir):
    return shapley_values(spark, sf_dir)


@query()
def l8_shapley_ranking(spark, sf_dir):
    return explain.shapley_ranking(shapley_values(spark, sf_dir))


@query(f"WITH {BOARD_SQL} SELECT model, {r('mae', 'mae')} FROM board WHERE mae <= 1.05 * (SELECT min(mae) FROM board)")
def l9_rashomon(spark, sf_dir):
    return rounded(explain.rashomon(automl.leaderboard(simple_models(spark, sf_dir)), 1.05).select("model", "mae"), "mae")


MODELS = tuple(f"lag{k}" for k in (1, 4, 52))
IMPORTANCE_SQL = f"""{WF}, lg AS (SELECT item_id, pos, x, {', '.join(f'lag(x, {k}) OVER (PARTITION BY item_id ORDER BY pos) AS l{k}' for k in (1, 4, 52))} FROM wfill),
im AS ({' UNION ALL '.join(f"SELECT 'lag{k}' AS model, 'm' || CAST(item_id % 12 AS VARCHAR) AS variable, round(avg(abs(x - l{k})) + 1e-9, 6) AS importance FROM lg GROUP BY 1, 2" for k in (1, 4, 52))})"""


def importance(spark, sf_dir) -> DataFrame:
    """How far lags miss, by groups of suppliers: a stand-in for importance tables of several models."""
    w = features.series()
    df = filled_weeks(spark, sf_dir).withColumns({f"l{k}": F.lag("x", k).over(w) for k in (1, 4, 52)}).withColumn("variable", F.concat(F.lit("m"), (F.col("item_id") % 12).cast("string")))
    parts = [df.groupBy("variable").agg(F.avg(F.abs(F.col("x") - F.col(f"l{k}"))).alias("importance")).select(F.lit(f"lag{k}").alias("model"), "variable", "importance") for k in (1, 4, 52)]
    return rounded(reduce(DataFrame.unionByName, parts), "importance")


@query(f"""WITH {IMPORTANCE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, variable) AS n FROM im), v AS (SELECT DISTINCT variable FROM k WHERE n <= 5)
SELECT variable, {', '.join(f"coalesce(max(CASE WHEN model = '{m}' THEN importance END), 0) AS {m}" for m in MODELS)}, {r('(' + ' + '.join(f"coalesce(max(CASE WHEN model = '{m}' THEN importance END), 0)" for m in MODELS) + ') / 3', 'mean')} FROM im JOIN v USING (variable) GROUP BY 1 ORDER BY mean DESC, variable LIMIT 20""")
def l10_importance_matrix(spark, sf_dir):
    return rounded(explain.importance_matrix(importance(spark, sf_dir), MODELS, each=5), "mean")


@query(f"WITH {IMPORTANCE_SQL} SELECT model, variable, importance, {r('importance / max(importance) OVER (PARTITION BY model)', 'share')} FROM im")
def l11_normalised_importance(spark, sf_dir):
    return rounded(explain.normalised_importance(importance(spark, sf_dir)), "share")


@query(f"""WITH {IMPORTANCE_SQL}, c AS (SELECT model, variable, round(importance, 2) AS importance FROM im)
SELECT model, variable, importance, rank() OVER (PARTITION BY model ORDER BY importance DESC) + (count(*) OVER (PARTITION BY model, importance) - 1) / 2.0::DOUBLE AS rank FROM c""")
def l12_rank_stability(spark, sf_dir):
    coarse = importance(spark, sf_dir).withColumn("importance", F.round("importance", 2))
    return explain.rank_stability(coarse)
