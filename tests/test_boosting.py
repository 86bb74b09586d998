"""Trees over packed bins against Spark's own."""

import numpy as np
import pytest
from pyspark.ml import regression
from pyspark.ml.wrapper import JavaEstimator
from pyspark.sql import functions as F

from tidemark.operators import automl, boosting, forecast


def table(spark, n=600):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, float(a), float(int(3 * b)), 7.0, float(np.sin(3 * a) - 2 * b + rng.normal(0, 0.1))) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return automl.assembled(spark.createDataFrame(rows, "pos int, fold int, a double, b double, c double, y double"), ["a", "b", "c"])


def refused(self, df):
    raise AssertionError("a fit that holds all rows in memory")


@pytest.mark.parametrize("more", [{"maxIter": 3, "maxDepth": 4}, {"maxIter": 3, "maxDepth": 3, "lossType": "absolute", "stepSize": 0.3}])
def test_packed_trees_are_sparks(spark, more):
    df, given = table(spark), {"featuresCol": "features", "labelCol": "y", "predictionCol": "p", "seed": 42, **more}
    want, got = ({r.pos: r.p for r in kind(**given).fit(df).transform(df).collect()} for kind in (regression.GBTRegressor, boosting.GBTRegressor))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_splits_are_sparks():
    assert boosting.splits_of(np.array([3.0, 1.0, 1.0, np.nan, 2.0])).tolist() == [1.5, 2.5] and not len(boosting.splits_of(np.full(4, 7.0)))
    told = boosting.splits_of(np.arange(640.0))
    assert len(told) == 31 and np.allclose(np.diff(told), 20)


def test_direct_tabular_holds_no_rows_in_memory(spark, monkeypatch):
    monkeypatch.setattr(JavaEstimator, "_fit", refused)
    df = spark.createDataFrame([(i, k, float(k % 4 + i)) for i in range(2) for k in range(30)], "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 86400))
    assert forecast.direct_tabular(df, 3, 4).filter("mean is not null").count() == 6


def test_a_sample_without_rows_is_not_the_end(spark):
    df, like = table(spark), boosting.GBTRegressor(featuresCol="features", labelCol="y", predictionCol="p", maxIter=2, maxDepth=2, seed=1)
    want = [r.p for r in like.fit(df).transform(df).orderBy("pos").collect()]
    assert [r.p for r in like.drawn_from(df.limit(0)).fit(df).transform(df).orderBy("pos").collect()] == want
    with pytest.raises(ValueError):
        like.fit(df.limit(0))


def test_folds_hold_no_rows_in_memory(spark, monkeypatch):
    monkeypatch.setattr(JavaEstimator, "_fit", refused)
    df = table(spark)
    models = automl.candidates(trees=2)
    rows = automl.out_of_fold(df, models, 3, ["pos"]).toPandas()
    assert len(rows) == 600 * len(models)
    error = (rows["y"] - rows["p"]).abs().groupby(rows["model"]).mean()
    plain = (rows["y"] - rows["y"].mean()).abs().mean()
    assert set(error.index) == set(models) and (error < 0.9 * plain).all()


def test_packed_training_applies_as_sparks(spark, monkeypatch):
    df = table(spark)
    models = {k: v for k, v in automl.candidates(trees=2).items() if k in ("GBM_1", "GBM_2", "DRF_1")}
    want = {r.pos: r.p for r in models["GBM_2"].fit(df).transform(df).collect()}
    monkeypatch.setattr(JavaEstimator, "_fit", refused)
    found, times = automl.train(df, models, packed=True)
    assert [r.model for r in times.orderBy("fit_order").collect()] == list(models) and times.filter("fit_time > 0").count() == 3
    got = {(r.model, r.pos): r.p for r in automl.predictions(found, df, ["pos"]).collect()}
    assert len(got) == 1800 and all(got[("GBM_2", k)] == pytest.approx(v, abs=1e-9) for k, v in want.items())


@pytest.mark.parametrize("share", [1.0, 0.7, None])
def test_groups_of_features_are_the_features(share):
    """Histograms and predictions of a block by groups are those of its features alone, whether paths are looked up or, with more than 15 tests, walked."""
    rng, n = np.random.default_rng(3), 700
    tables, at = (rng.integers(0, 32, (2, 90)).astype("uint8"), rng.integers(0, 32, (2, 5)).astype("uint8")), (rng.integers(0, 90, n), rng.integers(0, 5, n))
    x = np.stack([tables[0][0][at[0]], rng.integers(0, 32, n).astype("uint8"), tables[1][1][at[1]], tables[0][1][at[0]], tables[1][0][at[1]]])
    y = rng.normal(size=n)
    apart = boosting.Block(y, [([f], None, row) for f, row in enumerate(x)])
    grouped = boosting.Block(y, [([0, 3], tables[0], at[0].astype("uint8")), ([1], None, x[1]), ([4, 2], tables[1], at[1].astype("uint16"))])
    assert all(np.array_equal(grouped[f], x[f]) for f in range(5))
    levels = lambda depth: [(rng.integers(-1 if k else 0, 5, 2**k), rng.integers(3, 28, 2**k)) for k in range(depth)]
    trees = [(levels(d), rng.normal(size=2**d), 0.1) for d in (3, 4, 6)]
    ends, slots = levels(2), np.array([0, 2, 1, 3, 3])
    assert boosting.Paths.of(trees[2][0], trees[2][1]) is None
    found = []
    for block in (apart, grouped):
        for paths in ((), [*(boosting.Paths.of(l, r * v) for l, v, r in trees), boosting.Paths.of(ends, slots)]):
            total = np.zeros((2, 5, 4, 32))
            boosting.add_histogram(total, block, None, trees, ends, slots, False, share, 4, {0, 1, 2, 4}, boosting.poisson(), paths)
            found.append(total)
    node, rest = slots[boosting.leaves(x, ends)], 2 * (y - boosting.predicted(x, trees))
    assert all(np.allclose(f, found[0], rtol=0, atol=1e-9) for f in found) and not found[0][:, 3].any()
    if share == 1:
        assert all(found[0][0, f, k, b] == ((node == k) & (x[f] == b)).sum() and found[0][1, f, k, b] == pytest.approx(rest[(node == k) & (x[f] == b)].sum()) for f in (0, 2, 4) for k in range(4) for b in (0, 7, 31))


def test_a_zone_that_tasks_do_not_know(spark):
    """Spark's own names of offsets are spelled out by Spark: the same forecasts as in a zone of the same time."""
    from tidemark.sources.staging import setting

    df = spark.createDataFrame([(i, k, float(k % 4 + i)) for i in range(2) for k in range(30)], "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 50_000)).cache()
    assert forecast.zone_is_known("Europe/Berlin") and not forecast.zone_is_known("GMT+2")
    found = []
    for zone in ("GMT+2", "Etc/GMT-2"):
        with setting(spark, "spark.sql.session.timeZone", zone):
            found.append([r["mean"] for r in forecast.direct_tabular(df, 3, 4).orderBy("item_id", "h").collect()])
    assert len(found[0]) == 6 and np.allclose(*found, rtol=0, atol=1e-9)


def test_leaders_are_chosen_among_models_that_grow_together(spark, sf_dir, monkeypatch):
    """Models that draw no rows are Spark's, and the query holds no rows in memory."""
    from tidemark.plans import models

    df, every = table(spark), automl.candidates(trees=3)
    want = {k: {r.pos: r.p for r in every[k].fit(df).transform(df).collect()} for k in ("GBM_1", "GBM_2", "GBM_4")}
    monkeypatch.setattr(JavaEstimator, "_fit", refused)
    found = automl.train_together(df, every)
    got = {(r.model, r.pos): r.p for r in automl.predictions(found, df, ["pos"]).collect()}
    assert list(found) == list(every) and len(got) == 600 * len(every)
    for name, model in found.items():
        assert all(got[(name, r.pos)] == r.p for r in model.transform(df).collect())
    assert all(got[(k, pos)] == pytest.approx(p, abs=1e-9) for k, rows in want.items() for pos, p in rows.items())
    told = {r.role: r for r in models.i7_fitted_leaders(spark, sf_dir).collect()}
    assert set(told) == {"leader", "runner_up"} and told["leader"].mae <= told["runner_up"].mae and told["leader"].family != told["runner_up"].family
