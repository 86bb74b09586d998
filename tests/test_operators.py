"""Operators against plain re-statements, and their properties."""

import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions import errors, metrics
from tidemark.functions.quantiles import quantiles
from tidemark.operators import automl, clean, detect, explain, features, forecast, frames, network, ranges, windows
from tidemark.operators.vae import CausalVAE, candidates
from tidemark.sources import io


def panel(spark, n=200, items=2, gaps=0.1, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for item in range(items):
        for pos in range(n):
            gap = rng.random() < gaps
            rows.append((item, pos, None if gap else float(np.sin(pos / 5) + rng.normal() * 0.2)))
    return spark.createDataFrame(rows, "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos") * 300))


def known_schema():
    return StructType([StructField("item_id", IntegerType()), StructField("pos", IntegerType()), StructField("known", VectorUDT())])


def by_item(df, *columns):
    return df.select("item_id", "pos", *columns).toPandas().sort_values(["item_id", "pos"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def gappy(spark):
    return panel(spark).cache()


def test_fill_equals_pandas_and_chunks(spark, gappy):
    plain = by_item(clean.fill(gappy), "x")
    raw = by_item(gappy, "x")
    want = raw.groupby("item_id")["x"].transform(lambda s: s.ffill().bfill())
    assert np.allclose(plain["x"], want)
    for chunk in (7, 50, 1000):
        assert np.allclose(by_item(clean.fill_chunked(gappy, chunk), "x")["x"], want)
    assert np.allclose(by_item(clean.fill(clean.fill(gappy)), "x")["x"], want)
    empty_chunk = gappy.withColumn("x", F.when(~F.col("pos").between(40, 99), F.col("x")))
    assert np.allclose(by_item(clean.fill_chunked(empty_chunk, 20), "x")["x"], by_item(clean.fill(empty_chunk), "x")["x"])


def test_rolling_and_exponential_means_equal_pandas(gappy):
    raw = by_item(gappy, "x")
    df = gappy.withColumns(features.rolling("x", (5,), features.series()))
    got = by_item(df, "x_roll_mean_5", "x_roll_std_5")
    shifted = raw.groupby("item_id")["x"].shift(1)
    roll = shifted.groupby(raw["item_id"]).rolling(5, min_periods=1)
    assert np.allclose(got["x_roll_mean_5"], roll.mean().to_numpy(), equal_nan=True)
    assert np.allclose(got["x_roll_std_5"], roll.std().to_numpy(), equal_nan=True, atol=1e-7)
    for block in (16, 256):
        got = by_item(features.exponential_mean(gappy, 12, block), "x_ewm_12")["x_ewm_12"]
        want = shifted.groupby(raw["item_id"]).transform(lambda s: s.ewm(span=12, ignore_na=False).mean())
        want[shifted.isna() & want.isna()] = np.nan
        assert np.allclose(got, want, equal_nan=True, atol=1e-12)


def test_chunks_with_a_halo_change_nothing(gappy):
    columns = lambda w: features.lags("x", (1, 9), w) | features.rolling("x", (10,), w)
    want = by_item(gappy.withColumns(columns(features.series())), "x_lag_9", "x_roll_max_10")
    for chunk in (10, 33, 500):
        got = by_item(features.over_chunks(gappy, columns, chunk, 10), "x_lag_9", "x_roll_max_10")
        pd.testing.assert_frame_equal(got, want)
    with pytest.raises(ValueError):
        features.with_halo(gappy, 5, 6)


def test_scaler_and_mask(spark, gappy):
    scaled, scaler = clean.preprocess(gappy, "fit", max_std=3)
    values = by_item(scaled, "x")
    assert np.allclose(values.groupby("item_id")["x"].mean(), 0, atol=1e-9) and np.allclose(values.groupby("item_id")["x"].std(ddof=0), 1)
    back = by_item(clean.inverse(scaled, scaler), "x")["x"]
    assert np.allclose(back, by_item(clean.fill(clean.mask_outliers(gappy, 3)), "x")["x"])
    flat = spark.createDataFrame([(1, i, 2.0) for i in range(5)], "item_id int, pos int, x double")
    assert clean.mask_outliers(flat, 0.1).filter("x is null").count() == 0
    assert clean.fit_scaler(flat).first().scale == 1.0
    with pytest.raises(ValueError):
        clean.preprocess(flat, "transform")


def test_windows_over_chunks(gappy):
    def ends(views, rows):
        return pd.DataFrame({"item_id": rows["item_id"], "pos": rows["pos"], "total": np.nansum(views[:, :, 0], axis=1)})

    want = by_item(windows.window_arrays(gappy, 8).withColumn("total", F.aggregate("window", F.lit(0.0), lambda a, v: a + F.when(F.isnan(v), 0.0).otherwise(v))), "total")
    for chunk in (8, 31, 400):
        got = by_item(windows.over_windows(gappy.drop("ts"), ["x"], 8, chunk, ends, "item_id int, pos int, total double", "item_id"), "total")
        assert len(got) == 2 * (200 - 7) and np.allclose(got["total"], want["total"])


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "k int, split_rank int, v string")
    assert sorted(r.v for r in frames.keep_first(df, ["k"], ["split_rank"]).collect()) == ["a", "c"]
    assert frames.sample_by_hash(df, ["k", "v"], 2).count() == 2
    (tmp_path / "a.csv").write_text("when,A,B\n2024-01-01 00:00:00,1,\n2024-01-01 00:05:00,nan,2\n")
    read = io.read_mts(spark, str(tmp_path / "a.csv"), ["A", "B"], "when")
    assert [tuple(r)[1:] for r in read.orderBy("ts").collect()] == [(1.0, None), (None, 2.0)]
    labels = io.read_labels(spark, str(tmp_path / "a.csv"), ["A", "B"], "when")
    assert labels.count() == 4 and io.read_splits(spark, [str(tmp_path / "a.csv")] * 2, ["A", "B"], "when").filter("split_rank = 1").count() == 2
    io.save_state(read, str(tmp_path / "state"))
    assert io.load_state(spark, str(tmp_path / "state")).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["flat", "front", "back", "middle"]))
def test_range_weights(spark, s, n, a, b, bias):
    e = s + n
    a, b = max(s, min(a, b)), min(e, max(a, b))
    if a > b:
        return
    size = e - s + 1
    weight = {"flat": lambda i: 1, "front": lambda i: size - i + 1, "back": lambda i: i, "middle": lambda i: min(i, size - i + 1)}[bias]
    total = sum(weight(i) for i in range(1, size + 1))
    want = sum(weight(i - s + 1) for i in range(a, b + 1)) / total
    got = spark.range(1).select(ranges.weight(*map(F.lit, (s, e, a, b)), bias).alias("w")).first().w
    assert got == pytest.approx(want)


def test_range_scores_are_one_when_right(spark):
    rows = [("a", i, int(3 <= i < 9 or 20 <= i < 22), int(3 <= i < 9 or 20 <= i < 22)) for i in range(30)]
    df = spark.createDataFrame(rows, "channel string, pos int, label int, pred int")
    r = ranges.range_scores(df).first()
    assert r.precision == pytest.approx(1) and r.recall == pytest.approx(1) and r.f1 == pytest.approx(1, abs=1e-5)
    none = ranges.range_scores(df.withColumn("pred", F.lit(0))).first()
    assert (none.precision, none.f1) == (0, 0)


def test_wider_bands_never_add_anomalies(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", i, float(v), 0.0, 1.0, int(abs(v) > 4)) for i, v in enumerate(rng.standard_t(2, 400))], "channel string, pos int, x double, recon double, sigma double, label int")
    counts = {(r.alpha_up, r.alpha_down): r for r in detect.point_f1(detect.confusion(df)).collect()}
    for (u, d), r in counts.items():
        x = np.array([row.x for row in df.collect()])
        assert r.tp + r.fp == ((x > u) | (x < -d)).sum()
        if u < 7:
            assert counts[(u + 1, d)].tp + counts[(u + 1, d)].fp <= r.tp + r.fp
    best = detect.best_alphas(detect.point_f1(detect.confusion(df))).first()
    assert best.f1 == max(r.f1 for r in counts.values())
    hopeless = detect.best_alphas(detect.point_f1(detect.confusion(df.withColumn("label", F.lit(0))))).first()
    assert (hopeless.alpha_up, hopeless.alpha_down, hopeless.f1) == (2, 2, 0)
    told = detect.resolved_alphas(df, fitted=spark.createDataFrame([("a", 5, 4)], "channel string, alpha_up int, alpha_down int"), up=[3.0]).first()
    assert (told.alpha_up, told.alpha_down) == (3.0, 4.0)


@pytest.mark.parametrize("length", [5, 16, 128])
def test_last_step_equals_the_whole_pass(length):
    """Also where windows are shorter than what a step rests on, and with noise."""
    rng = np.random.default_rng(length)
    for dilations in ((1, 2, 4, 8), (1, 1, 3, 7)):
        config = network.Config(channels=3, length=length, units=(4, 5, 6, 4), dilations=dilations, latent=2, seed=1)
        w = {k: v + 0.1 * np.abs(rng.normal(size=v.shape)) for k, v in network.initial(config).items()}
        x = rng.normal(size=(6, length, 3))
        for noise in (0.0, rng.normal(size=(6, length, 2))):
            whole, last = network.forward(w, config, x, noise), network.last_step(w, config, x, noise)
            assert all(np.allclose(whole[k][:, -1], last[k], rtol=0, atol=1e-12) for k in ("xm", "xv", "z"))


def wave(spark, n, items=1, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(str(i), t, float(np.sin(t / 9 + i) + 0.1 * rng.normal()), float(np.cos(t / 9) + 0.1 * rng.normal())) for i in range(items) for t in range(n)]
    return spark.createDataFrame(rows, "series string, pos long, a double, b double")


def plain_epochs(start, rows, length, epochs):
    """A plain loop of Adam over the batches of one group: weights and the loss of every step."""
    config, w = start.config, {k: v.copy() for k, v in start.weights.items()}
    m, v, t, losses = {}, {}, 0, []
    for epoch in range(epochs):
        rng = np.random.default_rng([config.seed, epoch, 0])
        windows = np.stack([rows[i : i + length] for i in range(len(rows) - length + 1)])
        order = rng.permutation(len(windows))
        for at in range(0, len(order), config.batch):
            x = windows[order[at : at + config.batch]]
            loss, g, moments = network.gradients(w, config, x, rng.standard_normal((len(x), length, config.latent)))
            t += 1
            losses.append((epoch, len(x), loss))
            for k in g:
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
                w[k] = w[k] - config.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
            share = min(0.99, (t - 1) / t)
            for k in moments:
                w[k] = share * w[k] + (1 - share) * moments[k]
    return w, losses


def test_training_in_one_group_equals_a_plain_loop(spark):
    """One state of the optimiser lives through all epochs."""
    df = wave(spark, 300)
    start = CausalVAE.initial(("a", "b"), length=12, units=(6, 6, 6), dilations=(1, 2, 4), latent=2, rate=5e-3, epochs=3, min_delta=-1e9, seed=3)
    steps = []
    model, history = start.fit(df.filter("pos < 250"), df.filter("pos >= 250"), groups=1, steps=steps)
    rows = np.array([(r.a, r.b) for r in df.filter("pos < 250").orderBy("pos").collect()])
    wanted, losses = plain_epochs(start, rows, 12, 3)
    assert [(e, n) for e, _, n, _ in steps] == [(e, n) for e, n, _ in losses] and np.allclose([v for *_, v in steps], [v for *_, v in losses], rtol=0, atol=1e-9)
    held = {r.epoch: r.value for r in history.collect() if r.metric == "val_loss"}
    if min(held, key=held.get) == 2:
        assert all(np.allclose(model.weights[k], wanted[k], rtol=0, atol=1e-9) for k in wanted)


def test_training_in_groups_keeps_step(spark):
    """Four groups end where one does after equal steps; groups that have no chunk, or fewer batches, go along."""
    df = wave(spark, 1000, items=4)
    settings = dict(length=12, units=(6, 6, 6), dilations=(1, 2, 4), latent=2, rate=5e-3, epochs=4, min_delta=-1e9, seed=3)
    ends = {}
    for groups in (1, 4):
        steps = []
        start = CausalVAE.initial(("a", "b"), batch=64, **settings)
        start.fit(df.filter("pos < 900"), df.filter("pos >= 900"), chunk=100, groups=groups, steps=steps)
        assert sum(n for e, _, n, _ in steps if e == 0) == 4 * (900 - 11)
        ends[groups] = steps
    last = min(len(ends[1]), len(ends[4]))
    mean = lambda steps: np.mean([v for *_, v in steps[last - 30 : last]])
    # Groups draw other batches, so the two are compared as shares of the loss that both began with.
    assert abs(mean(ends[4]) - mean(ends[1])) < 0.01 * ends[1][0][3]
    steps = []
    CausalVAE.initial(("a", "b"), **{**settings, "epochs": 1}).fit(wave(spark, 150).filter("pos < 100"), wave(spark, 150).filter("pos >= 100"), chunk=1000, groups=4, steps=steps)
    assert sum(n for *_, n, _ in steps) == 89


@pytest.mark.parametrize("groups", [3, 7])
def test_groups_train_one_after_another_in_whole_batches(spark, groups):
    """More groups than cores too: the steps of one loop over the batches of all groups, of which only the last one of an epoch is short."""
    from tidemark.operators.vae import dealt_by_group, mini_batches

    df = wave(spark, 120, items=6)
    start = CausalVAE.initial(("a", "b"), length=12, units=(6, 6, 6), dilations=(1, 2, 4), latent=2, rate=5e-3, batch=50, epochs=1, seed=3)
    steps = []
    model, _ = start.fit(df.filter("pos < 100"), df.filter("pos >= 100"), chunk=40, groups=groups, steps=steps)
    assert [n for *_, n, _ in steps] == [50] * 10 + [6 * 89 - 500]
    rows = dealt_by_group(df.filter("pos < 100"), ["a", "b"], 12, 40, groups, 3).orderBy("draw", "series", "chunk", "pos").collect()
    training, left, losses = network.Training.begin(start.weights), None, []
    order = np.random.default_rng([3, 0]).permutation(groups).tolist()
    for group in order:
        chunks = {}
        for r in rows:
            if r.group == group:
                chunks.setdefault((r.series, r.chunk), []).append((r.a, r.b))
        rng = np.random.default_rng([3, 0, group])
        arrays = [np.array(c) for c in chunks.values()]
        for x in mini_batches(iter(arrays), 12, 50, rng, 10_000, left):
            left = x
            if len(x) == 50 or group == order[-1]:
                loss, g, moments = network.gradients(training.weights, start.config, x, rng.standard_normal((len(x), 12, 2)))
                training.step(start.config, g, moments)
                losses.append(loss)
                left = None
    assert np.allclose([v for *_, v in steps], losses, rtol=0, atol=1e-9)
    assert all(np.allclose(model.weights[k], training.weights[k], rtol=0, atol=1e-9) for k in model.weights)


def test_windows_that_fill_no_batch_go_on_to_the_next_pool():
    from tidemark.operators.vae import mini_batches

    arrays = [np.arange(at, at + 30, dtype="float64").reshape(-1, 1) for at in (0, 100, 200)]
    drawn = list(mini_batches(iter(arrays), 5, 7, np.random.default_rng(1), 30, np.full((3, 5, 1), -1.0)))
    assert [len(d) for d in drawn] == [7] * 11 + [4]
    assert sorted(np.concatenate(drawn)[:, 0, 0]) == [-1.0] * 3 + [float(at + i) for at in (0, 100, 200) for i in range(26)]


def test_groups_take_the_mean_step():
    """Three groups in threads, of which one has fewer batches, against one loop over all of their gradients."""
    import threading

    config = network.Config(channels=2, length=8, units=(4, 4, 4), dilations=(1, 2, 4), latent=2, rate=1e-2, seed=5)
    given = [[np.random.default_rng([g, k]).normal(size=(3 + g + k % 2, 8, 2)) for k in range(4 - g)] for g in range(3)]
    said, meet, ended = {}, threading.Barrier(3), {}

    def group(g):
        def gather(raw):
            said[g] = raw
            meet.wait()
            out = [said[k] for k in range(3)]
            meet.wait()
            return out

        training = network.Training.begin(network.initial(config))
        ended[g] = training, network.synchronous(training, config, iter(given[g]), np.random.default_rng(g), gather)

    threads = [threading.Thread(target=group, args=(g,)) for g in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    plain, rngs = network.Training.begin(network.initial(config)), [np.random.default_rng(g) for g in range(3)]
    for k in range(4):
        found = []
        for g in range(3):
            if k < len(given[g]):
                x = given[g][k]
                loss, grad, moments = network.gradients(plain.weights, config, x, rngs[g].standard_normal((len(x), 8, 2)))
                found.append((len(x), grad, moments))
        n = sum(f[0] for f in found)
        grad = {name: sum(f[0] * f[1][name] for f in found) / n for name in found[0][1]}
        moments = {name: sum(f[0] * f[2][name] for f in found) / n for name in found[0][2] if name.endswith(".mean")}
        for name in list(moments):
            var = name[:-4] + "var"
            moments[var] = sum(f[0] * (f[2][var] + f[2][name] ** 2) for f in found) / n - moments[name] ** 2
        plain.step(config, grad, moments)
    for training, steps in ended.values():
        assert training.steps == 4 and [n for n, _ in steps] == [sum(len(b[k]) for b in given if k < len(b)) for k in range(4)]
        assert all(np.allclose(training.weights[k], plain.weights[k], rtol=0, atol=1e-9) for k in plain.weights)


def test_an_epoch_has_the_same_windows_in_another_order():
    from tidemark.operators.vae import mini_batches

    arrays = [np.arange(at, at + 30, dtype="float64").reshape(-1, 1) for at in (0, 100, 200)]
    drawn = [np.concatenate(list(mini_batches(iter(arrays), 5, 7, np.random.default_rng([1, epoch, 0]), pool)))[:, 0, 0] for epoch in (0, 1) for pool in (35, 10_000)]
    assert all(sorted(d) == sorted(drawn[0]) and len(d) == 78 for d in drawn)
    assert not np.array_equal(drawn[0], drawn[2]) and not np.array_equal(drawn[1], drawn[3])


def test_network_gradients_and_causality():
    config = network.Config(channels=3, length=9, units=(4, 5, 4), dilations=(1, 2, 4), latent=2, seed=1)
    w, rng = network.initial(config), np.random.default_rng(0)
    x, noise = rng.normal(size=(5, 9, 3)), rng.normal(size=(5, 9, 2))
    loss, g, _ = network.gradients(w, config, x, noise)
    for name in ("e0.k", "e1.gain", "zm.k", "zv.b", "d0.k", "d1.shift", "xm.k", "xv.k"):
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        w[name][at] += 1e-6
        up = network.gradients(w, config, x, noise)[0]
        w[name][at] -= 2e-6
        down = network.gradients(w, config, x, noise)[0]
        w[name][at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[name][at], rel=1e-4, abs=1e-7), name
    later = x.copy()
    later[:, 6:] += 1
    a, b = network.forward(w, config, x), network.forward(w, config, later)
    assert np.allclose(a["xm"][:, :6], b["xm"][:, :6]) and not np.allclose(a["xm"][:, 6:], b["xm"][:, 6:])
    assert all(np.array_equal(network.unpacked(network.packed(w), w)[k], w[k]) for k in w)
    with pytest.raises(ValueError):
        network.Config(channels=1, units=(4, 4))


@pytest.mark.parametrize("dilations", [(1, 2, 4), (3, 9, 1)])
def test_steps_that_share_their_arrays_are_steps(dilations):
    """One room for many steps gives the gradients of a room for each, with delays beyond the window too; activations at 0 and far from it are finite."""
    config = network.Config(channels=2, length=7, units=(4, 6, 5), dilations=dilations, latent=2, rate=1e-2, batch=5, seed=2)
    rng = np.random.default_rng(6)
    batches = [rng.normal(size=(n, 7, 2)) * scale for n, scale in ((5, 1), (5, 0), (5, 30), (5, 1), (3, 1))]
    shared, plain, noise = network.Training.begin(network.initial(config)), network.Training.begin(network.initial(config)), np.random.default_rng(1)
    told = network.sequential(shared, config, iter(batches), np.random.default_rng(1))
    for x, (n, loss) in zip(batches, told):
        want, g, moments = network.gradients(plain.weights, config, x, noise.standard_normal((len(x), 7, 2)))
        assert n == len(x) and loss == pytest.approx(want, rel=1e-9)
        room = network.Room(plain.weights, config, len(x))
        assert all(np.shares_memory(room.g[k], room.g_flat) and room.g[k].shape == g[k].shape for k in g) and list(room.g) == [k for k in plain.weights if not network.is_moment(k)]
        plain.step(config, g, moments)
    assert all(np.isfinite(plain.weights[k]).all() and np.allclose(shared.weights[k], plain.weights[k], rtol=0, atol=1e-9) for k in plain.weights)


def test_chunks_go_on_over_parts_and_nulls_are_a_series():
    from tidemark.operators.vae import chunk_arrays

    rows = pd.DataFrame({"series": [None, None, "a", "a", "a", "b"], "chunk": [0, 0, 0, 1, 1, 1], "x": np.arange(6.0)})
    for cut in range(7):
        assert [a.ravel().tolist() for a in chunk_arrays(iter([rows.iloc[:cut], rows.iloc[cut:]]), ["x"])] == [[0, 1], [2], [3, 4], [5]]


def test_training_lowers_the_loss_and_finds_spikes(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, float(np.sin(i / 3) + rng.normal() * 0.05), float(np.cos(i / 3) + rng.normal() * 0.05)) for i in range(1200)]
    df = spark.createDataFrame(rows, "series int, pos long, a double, b double")
    start = CausalVAE.initial(("a", "b"), length=16, units=(8, 8, 8), dilations=(1, 2, 4), latent=2, rate=5e-3, epochs=16, min_delta=1e-4, seed=3)
    model, history = start.fit(df.filter("pos < 900"), df.filter("pos >= 900"), chunk=256, group_rows=600)
    val = [r.value for r in history.filter("metric = 'val_loss'").orderBy("epoch").collect()]
    assert min(val) < val[0] and model.evaluate(df).first().total < start.evaluate(df).first().total
    spiky = df.withColumn("a", F.when(F.col("pos") == 700, F.col("a") + 9).otherwise(F.col("a")))
    scored = model.score(spiky, chunk=200).withColumn("score", detect.score()).filter("channel = 'a'")
    assert scored.count() == 1200 - 15 and scored.orderBy(F.desc("score")).first().pos == 700
    again = start.with_state(model.state(spark))
    assert again.score(df, chunk=300).agg(F.sum("recon")).first()[0] == pytest.approx(model.score(df, chunk=1000).agg(F.sum("recon")).first()[0])
    assert len(candidates(500, 1)) == 108


def test_forecasters(spark):
    season, n = 12, 120
    rows = [(item, i, float(10 * item + 3 * np.sin(2 * np.pi * i / season))) for item in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600))
    train, actual = frames.drop_last(df, season), frames.keep_last(df, season)
    error = {}
    for name, made in {"naive": forecast.naive(train, season), "seasonal": forecast.seasonal_naive(train, season, season), "ets": forecast.ets(train, season, season), "theta": forecast.theta(train, season, season), "recursive": forecast.recursive_tabular(train, season, (1, 2, 12)), "direct": forecast.direct_tabular(train, season, season, stride=3)}.items():
        told = forecast.against_actual(made, actual)
        assert told.count() == 2 * season, name
        error[name] = told.agg(F.avg(F.abs(F.col("actual") - F.col("predicted")))).first()[0]
    assert error["seasonal"] < 1e-9 and error["recursive"] < 1 and error["ets"] < error["naive"] and error["theta"] < error["naive"]
    out = forecast.run_multi(df, season, season, heavy=False)
    weights = {r.model: r.weight for r in out["weights"].collect()}
    assert sum(weights.values()) == pytest.approx(1) and out["forecast"].count() == 2 * season
    assert out["forecast"].filter("q10 > q90").count() == 0


def test_run_multi_is_restated(spark):
    """Two validation windows before the test, each forecast from what lies before it; weights and quantiles from both, on small frames in pandas."""
    season, horizon, rng = 6, 6, np.random.default_rng(8)
    rows = [(item, i, float(item + np.sin(i) + 0.02 * i + rng.normal() * 0.3)) for item in (1, 2, 3) for i in range(150)]
    df = spark.createDataFrame(rows, "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600))
    out = forecast.run_multi(df, horizon, season, heavy=False, bucket=3)
    said = out["validation"].toPandas()
    assert {(k, p) for k, p in zip(said["window"], said["pos"])} == {(2, p) for p in range(138, 144)} | {(3, p) for p in range(132, 138)}
    for k, cut in ((2, 138), (3, 132)):
        alone = forecast.families(df.filter(F.col("pos") < cut), horizon, season, heavy=False).toPandas()
        both = said[said["window"] == k].merge(alone, on=["item_id", "pos", "model"], suffixes=("", "_alone"))
        assert len(both) == len(alone) == 3 * horizon * 5 and np.allclose(both["mean"], both["mean_alone"])
    wide = said.pivot_table(index=["item_id", "window", "pos", "h", "y"], columns="model", values="mean").reset_index()
    models, picks = sorted(said["model"].unique()), []
    for _ in range(10):
        picks.append(min(models, key=lambda m: (float((wide["y"] - sum(wide[p] for p in [*picks, m]) / (len(picks) + 1)).abs().mean()), m)))
    weights = {r.model: r.weight for r in out["weights"].collect()}
    assert weights == {m: picks.count(m) / 10 for m in models}
    wide["residual"] = wide["y"] - sum(wide[m] * w for m, w in weights.items())
    singles = out["models"].toPandas().pivot_table(index=["item_id", "pos", "h"], columns="model", values="mean").reset_index()
    told = out["forecast"].toPandas().merge(singles, on=["item_id", "pos", "h"])
    assert len(told) == 3 * horizon and np.allclose(told["mean"], sum(told[m] * w for m, w in weights.items())) and np.allclose(told["mean"], told["WeightedEnsemble"])
    for r in told.itertuples():
        mine = wide[(wide["item_id"] == r.item_id) & ((wide["h"] - 1) // 3 == (r.h - 1) // 3)]["residual"]
        assert len(mine) == 6 and np.allclose([r.q10, r.q50, r.q90], r.mean + np.quantile(mine, [0.1, 0.5, 0.9]))
    with pytest.raises(ValueError):
        forecast.run_single(df, 1, horizon, season, most=1)


def test_direct_rows_are_restated(spark):
    """Targets and seasonal values by position, on gaps, before the first season and beyond the end."""
    rng = np.random.default_rng(3)
    x = {(i, p): (None if rng.random() < 0.2 else float(rng.normal())) for i in (1, 2) for p in range(40)}
    df = spark.createDataFrame([(i, p, v) for (i, p), v in x.items()], "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600))
    season, horizon = 5, 12
    got = forecast.direct_rows(df, horizon, F.col("pos") >= 2, (0, 1), season).collect()
    assert len(got) == 2 * 38 * horizon
    for r in got:
        assert r.pos == r.origin + r.h and r.y == x.get((r.item_id, r.pos)) and r.lag_1 == x[r.item_id, r.origin - 1]
        assert r.season_before == x.get((r.item_id, r.pos - -(-r.h // season) * season)) and r.hour == r.pos % 24


@pytest.mark.parametrize("zone", ["UTC", "America/St_Johns"])
def test_spelled_out_steps_are_the_direct_rows(spark, zone):
    """On gaps, an item with fewer positions than a season, NaN, steps beyond a season, and times of another zone."""
    from tidemark.sources.staging import setting

    rng, season, horizon = np.random.default_rng(4), 5, 12
    x = [(i, p, None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(rng.normal())) for i, n in ((1, 40), (2, 90), (3, 3)) for p in range(n)]
    df = spark.createDataFrame(x, "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(1_600_000_000 + F.col("pos") * 4321)).repartition(2, "item_id")
    names = ["lag_0", "lag_1", "roll", "season_before", *forecast.CALENDAR, "h", "y"]
    with setting(spark, "spark.sql.session.timeZone", zone):
        wanted = np.array(forecast.direct_rows(df, horizon, F.col("pos") >= 2, (0, 1), season).select(*(F.col(c).cast("double") for c in names)).toPandas().astype("float64"))
        short = forecast.direct_short(df, horizon, F.col("pos") >= 2, (0, 1), season)
        assert short.count() == 38 + 88 + 1
        blocks = [np.column_stack(b) for batch in short.toArrow().combine_chunks().to_batches() for b in forecast.spelled(batch, horizon, season, rows=100)]
    wanted = wanted[~np.isnan(wanted).any(axis=1)]
    assert sorted(map(tuple, np.concatenate(blocks).tolist())) == sorted(map(tuple, wanted.tolist())) and len(wanted) > 500 and max(map(len, blocks)) <= 100


def test_direct_tabular_trains_on_every_origin_with_calendar_and_covariates(spark, monkeypatch):
    fitted_on = []
    fit = forecast.GBTRegressor.fit
    monkeypatch.setattr(forecast.GBTRegressor, "fit", lambda self, df: fitted_on.append(df) or fit(self, df))
    season, n, horizon = 4, 40, 3
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(n)], "pos int, x double").withColumn("item_id", F.lit(1)).withColumn("ts", F.timestamp_seconds(F.col("pos") * 86400))
    assert forecast.direct_tabular(df, horizon, season).count() == horizon
    assert fitted_on[0].count() == sum(min(horizon, n - 1 - origin) for origin in range(season, n))
    one = fitted_on[0].filter("origin = 10 and h = 3").first()
    assert (one.pos, one.dayofmonth, one.month, one.dayofweek, one.is_weekend) == (13, 14, 1, 2, 0) and set(forecast.CALENDAR) <= set(fitted_on[0].columns)
    # Noise that only a covariate tells.
    noise = np.random.default_rng(3).integers(0, 2, n + horizon).tolist()
    known = spark.createDataFrame([(1, i, Vectors.dense(float(v))) for i, v in enumerate(noise)], known_schema())
    told = spark.createDataFrame([(i, 10.0 * v) for i, v in enumerate(noise[:n])], "pos int, x double").withColumn("item_id", F.lit(1)).withColumn("ts", F.timestamp_seconds(F.col("pos") * 86400))
    for made in (forecast.direct_tabular(told, horizon, season, known=known), forecast.recursive_tabular(told, horizon, (1, 2), known=known)):
        assert [r.mean for r in made.orderBy("h").collect()] == pytest.approx([10.0 * v for v in noise[n:]], abs=1.5)


def test_run_single_knows_the_other_series(spark):
    rng, season, n = np.random.default_rng(5), 4, 120
    noise = rng.normal(size=n)
    rows = [(item, i, float(v)) for i in range(n) for item, v in ((1, 10 * noise[i]), (2, noise[i]), (3, rng.normal()))]
    df = spark.createDataFrame(rows, "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 86400))
    out = forecast.run_single(df, 1, season, season)
    assert {r.model for r in out["weights"].collect()} == {"SeasonalNaive", "Naive", "ETS", "Theta", "RecursiveTabular", "DirectTabular"}
    made = {r.pos: r.mean for r in out["models"].filter("model = 'RecursiveTabular'").collect()}
    assert [made[i] for i in range(n - season, n)] == pytest.approx((10 * noise[n - season :]).tolist(), abs=1.0)
    assert out["forecast"].count() == season


def test_shuffle_keeps_the_values(gappy):
    dealt = errors.shuffled_column(gappy.dropna(), "x", ["item_id"], "pos", 1)
    for item in (0, 1):
        a = sorted(r.x for r in dealt.filter(F.col("item_id") == item).collect())
        assert a == sorted(r.x for r in gappy.dropna().filter(F.col("item_id") == item).collect())


def test_metrics_null_cases(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 2.0)], "item_id int, y double, p double")
    r = metrics.table(df).first()
    assert r.mape is None and r.r2 is None and r.mae == 1.5


def test_shapley_adds_up(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)]
    df = spark.createDataFrame(rows, "pos int, a double, b double, c double").withColumn("y", F.col("a") * 2 + F.when(F.col("b") > 0, 1.0).otherwise(0.0))
    table = automl.assembled(df, ["a", "b", "c"])
    fitted, _ = automl.train(table, {k: v for k, v in automl.candidates(trees=4).items() if k in ("GBM_1", "DRF_1")})
    for name, mean in (("GBM_1", False), ("DRF_1", True)):
        values = explain.shapley(df, fitted[name], ["a", "b", "c"], ["pos"], mean_of_trees=mean)
        total = values.groupBy("pos", "expected").agg(F.sum("contribution").alias("s")).select("pos", (F.col("s") + F.col("expected")).alias("told"))
        worst = fitted[name].transform(table).join(total, "pos").agg(F.max(F.abs(F.col("p") - F.col("told")))).first()[0]
        assert worst < 1e-8
    assert explain.shapley_ranking(values).first().variable == "a"


def test_every_candidate_is_trained_however_long_it_takes(spark, monkeypatch):
    clock = iter(1000.0 * i for i in range(1000))
    monkeypatch.setattr(automl.time, "monotonic", lambda: next(clock))
    table = automl.assembled(spark.createDataFrame([(float(i), float(i % 3)) for i in range(20)], "y double, a double"), ["a"])
    models = {k: v for k, v in automl.candidates(trees=1).items() if k in ("GBM_1", "DRF_1")}
    fitted, times = automl.train(table, models)
    assert set(fitted) == {"GBM_1", "DRF_1"} and times.count() == 2
    assert len(automl.train(table, models, budget_s=300.0)[0]) == 1


def test_rank_ties(spark):
    df = spark.createDataFrame([("m", "a", 2.0), ("m", "b", 1.0), ("m", "c", 1.0)], "model string, variable string, importance double")
    assert {r.variable: r.rank for r in explain.rank_stability(df).collect()} == {"a": 1.0, "b": 2.5, "c": 2.5}


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.scorer import score_stream

    rng = np.random.default_rng(4)
    rows = [(s, i, float(rng.normal()), float(rng.normal())) for s in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "series int, pos long, a double, b double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos") * 300))
    model = CausalVAE.initial(("a", "b"), length=8, units=(4, 4, 4), dilations=(1, 2, 4), latent=2, seed=5)
    alphas = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "channel string, alpha_up int, alpha_down int")
    for k in range(3):
        df.filter((F.col("pos") >= 20 * k) & (F.col("pos") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = score_stream(source, model, alphas).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    streamed = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["series", "ts", "channel"]).reset_index(drop=True)
    batch = detect.detect(model.score(df.drop("ts"), chunk=30), alphas).toPandas().sort_values(["series", "pos", "channel"]).reset_index(drop=True)
    assert len(streamed) == len(batch) and np.allclose(streamed["recon"], batch["recon"]) and (streamed["pred"] == batch["pred"]).all()


def panel_of(spark, lengths, fn, start="2020-01-06"):
    first = datetime.datetime.fromisoformat(start)
    rows = [(i, p, first + datetime.timedelta(days=7 * p), float(fn(i, p))) for i, n in enumerate(lengths) for p in range(n)]
    return spark.createDataFrame(rows, "item_id long, pos int, ts timestamp, x double")


def test_tabular_forecasters_start_from_each_items_end(spark):
    df = panel_of(spark, (60, 50), lambda i, p: 10 * i + np.sin(p / 2) + 0.01 * p)
    for made in (forecast.direct_tabular(df, 6, 12), forecast.recursive_tabular(df, 6, lags=(1, 2, 3))):
        rows = sorted((r.item_id, r.pos, r.h) for r in made.collect())
        assert rows == [(i, n - 1 + h, h) for i, n in ((0, 60), (1, 50)) for h in range(1, 7)]


def test_direct_forecasts_beyond_a_season_look_back_further(spark):
    rows = forecast.direct_rows(panel_of(spark, (30,), lambda i, p: p), 10, F.col("pos") == 29, (0,), 4).collect()
    assert {r.h: r.season_before for r in rows} == {h: 29 + h - 4 * -(-h // 4) for h in range(1, 11)}


def test_known_covariates_lower_the_error(spark):
    rng = np.random.default_rng(3)
    drive = rng.normal(size=90)
    df = panel_of(spark, (80,), lambda i, p: drive[p])
    known = spark.createDataFrame([(0, p, [float(drive[p])]) for p in range(90)], "item_id long, pos int, v array<double>").select("item_id", "pos", array_to_vector("v").alias("known"))
    error = lambda made: np.mean([abs(r["mean"] - drive[r.pos]) for r in made.collect()])
    for fit in (lambda **k: forecast.direct_tabular(df, 8, 4, **k), lambda **k: forecast.recursive_tabular(df, 8, lags=(1, 2), **k)):
        assert error(fit(known=known)) < 0.6 * error(fit())


def test_future_frame_takes_known_covariates(spark):
    df = panel_of(spark, (5,), lambda i, p: p)
    future = frames.future_frame(df, 3, "7 days")
    known = future.filter("h < 3").select("item_id", "ts", (F.col("h") * 2).alias("price"))
    assert sorted((r.h, r.price) for r in frames.with_known(future, known, ["item_id", "ts"]).collect()) == [(1, 2), (2, 4), (3, None)]


def test_models_are_saved_and_loaded(spark, tmp_path):
    df = automl.assembled(spark.createDataFrame([(float(k), float(3 * k)) for k in range(40)], "a double, y double").withColumn("item_id", F.lit(0)), ["a"])
    found, _ = automl.train(df, {k: v for k, v in automl.candidates(trees=2).items() if k in ("GBM_1", "DRF_1")})
    for name, model in found.items():
        io.save_model(model, f"file://{tmp_path}/{name}")
        again = io.load_model(spark, f"file://{tmp_path}/{name}")
        assert type(again) is type(model)
        assert [r.p for r in again.transform(df).collect()] == [r.p for r in model.transform(df).collect()]


def test_search_varies_what_it_searches():
    found = candidates(20, seed=1)
    for key in ("length", "units", "batch", "latent", "rate"):
        assert len({str(c[key]) for c in found}) > 1


def test_alphas_are_chosen_by_points_or_ranges(spark):
    rows = [("a", p, 5.0 if 10 <= p < 14 else 0.5 * (-1) ** p, 0.0, 1.0, int(10 <= p < 14)) for p in range(40)]
    df = spark.createDataFrame(rows, "channel string, pos int, x double, recon double, sigma double, label int")
    for by in ("point", "range"):
        best = detect.fit_alphas(df, by).first()
        assert best.f1 > 0.99 and (best.alpha_up, best.alpha_down) == (2, 2)


@pytest.mark.parametrize("chunk", [7, 16, 1000])
def test_range_search_equals_the_scores_of_each_pair_of_widths(spark, chunk):
    """Runs and true ranges that go on over the borders of chunks, series that are outside throughout, and channels without labels or predictions."""
    rng = np.random.default_rng(chunk)
    rows = []
    for channel in ("noisy", "blocks", "always", "quiet", "unlabelled"):
        level = 0.0
        for pos in range(150):
            level = level if rng.random() < 0.8 else rng.choice([0.0, 2.5, -3.5, 6.5, -7.5])
            x = {"noisy": rng.normal() * 3, "blocks": level, "always": 9.0, "quiet": 0.0, "unlabelled": level}[channel]
            label = int(channel != "unlabelled" and (pos // 11) % 3 == 0)
            rows.append((channel, pos, None if rng.random() < 0.03 else float(x), 0.0, 1.0, label))
    df = spark.createDataFrame(rows, "channel string, pos int, x double, recon double, sigma double, label int")
    got = {(r.channel, r.alpha_up, r.alpha_down): (r.recall, r.precision, r.f1) for r in detect.range_f1(df, chunk=chunk).collect()}
    tried = df.join(detect.alpha_grid(spark)).withColumn("pred", F.coalesce(detect.outside(F.col("alpha_up"), F.col("alpha_down")).cast("int"), F.lit(0)))
    wanted = {(r.channel, r.alpha_up, r.alpha_down): (r.recall, r.precision, r.f1) for r in ranges.range_scores(tried, ("channel", "alpha_up", "alpha_down")).collect()}
    assert got.keys() == wanted.keys() and len(got) == 180
    assert {k: (got[k], v) for k, v in wanted.items() if not np.allclose(got[k], v, rtol=0, atol=1e-12)} == {}


def test_fill_of_a_long_item_is_linear(spark):
    """Two hundred thousand rows of one item, of which only the last has a value."""
    df = spark.range(200_000).select(F.lit(1).alias("item_id"), F.col("id").alias("pos"), F.when(F.col("id") == 199_999, F.lit(5.0)).alias("x"))
    import time

    began = time.perf_counter()
    assert clean.fill(df).filter("x = 5").count() == 200_000
    assert clean.fill_chunked(df, 150_000).filter("x = 5").count() == 200_000
    assert time.perf_counter() - began < 60


def test_rolling_blocks_equal_frames(spark, gappy):
    """Also in the first windows, on gaps, on large levels with small steps, and where a window is a block or longer than the item."""
    sizes = (1, 2, 7, 50, 300)
    for df in (gappy, gappy.withColumn("x", F.col("x") * 1e-3 + 1e6), gappy.withColumn("x", F.lit(None).cast("double"))):
        names = list(features.rolling("x", sizes, features.series()))
        got = by_item(features.rolling_blocks(df, "x", sizes), *names)
        wanted = by_item(df.withColumns(features.rolling("x", sizes, features.series())), *names)
        for name in names:
            assert np.allclose(got[name].astype(float), wanted[name].astype(float), equal_nan=True, rtol=1e-9, atol=1e-9), name


def test_rolling_blocks_do_not_grow_with_the_window(spark):
    import time

    df = spark.range(300_000).select(F.lit(1).alias("item_id"), F.col("id").alias("pos"), F.sin("id").alias("x"))
    took = {}
    for n in (10, 100, 20_000):
        began = time.perf_counter()
        features.rolling_blocks(df, "x", (n,)).agg(F.sum(f"x_roll_max_{n}"), F.sum(f"x_roll_std_{n}")).collect()
        took[n] = time.perf_counter() - began
    assert took[20_000] < 4 * took[100] + 2


def test_quantiles_equal_percentiles(spark):
    """Ties, one value, wide and huge ranges, gaps, groups without values, a null group, and no groups at all."""
    rng = np.random.default_rng(4)
    rows = [("normal", float(v)) for v in rng.normal(size=997)] + [("ties", float(v)) for v in rng.integers(0, 4, 400)] + [("one", 7.5), ("none", None), (None, 1.0), (None, 4.0), ("normal", None)]
    rows += [("tails", float(v)) for v in np.concatenate([rng.normal(size=500) * 1e-9, [1e300, -1e308, 1.7e308]])] + [("same", 3.0)] * 50
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = (0.0, 0.02, 0.25, 0.5, 0.9, 0.98, 1.0)
    percentiles = F.percentile("x", F.array(*map(F.lit, shares))).alias("q")
    for buckets in (2, 16, 1024):
        got = {r.g: r.q for r in quantiles(df, ["g"], "x", shares, buckets=buckets).collect()}
        wanted = {r.g: r.q for r in df.groupBy("g").agg(percentiles).collect() if r.q}
        assert got.keys() == wanted.keys() and all(np.allclose(got[g], wanted[g], rtol=1e-12, atol=0) for g in wanted)
    assert np.allclose(quantiles(df, [], "x", shares).first().q, df.agg(percentiles).first().q, rtol=1e-12)
    assert quantiles(df.limit(0), ["g"], "x", shares).isEmpty()


def test_error_correlation_equals_pandas(spark):
    """Many small blocks, gaps, large levels, an item that never varies, two that never meet, and wanted pairs only."""
    rng = np.random.default_rng(9)
    common = rng.normal(size=200)
    rows = [(i, t, float(1e5 * i + common[t] * (i % 3) + rng.normal())) for i in range(9) for t in range(200) if rng.random() < 0.7]
    rows += [(20, t, 4.0) for t in range(50)] + [(21, t, float(t % 5)) for t in range(500, 530)] + [(22, 3, None)]
    df = spark.createDataFrame(rows, "item_id int, ts int, residual double").repartition(4)
    wide = pd.DataFrame(rows, columns=["item", "t", "r"]).dropna().pivot(index="t", columns="item", values="r")
    wanted = {}
    for a in wide.columns:
        for b in wide.columns:
            both = wide[[a, b]].dropna() if a != b else wide[[a]].dropna()
            if a <= b and len(both):
                x, y = both[a].to_numpy(), both[b].to_numpy() if a != b else both[a].to_numpy()
                wanted[a, b] = None if np.ptp(x) == 0 or np.ptp(y) == 0 else float(np.corrcoef(x, y)[0, 1])
    for block in (2, 64):
        got = {(r.a, r.b): r["corr"] for r in errors.error_correlation(df, block=block).collect()}
        assert got.keys() == wanted.keys()
        assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in wanted.items())
    some = spark.createDataFrame([(5, 2), (1, 1)], "a int, b int")
    assert {(r.a, r.b) for r in errors.error_correlation(df, pairs=some).collect()} == {(2, 5), (1, 1)}


def one_by_one(y, season, alpha, beta, gamma, phi, horizon):
    """Additive smoothing of one series with plain numbers: squared error and forecast."""
    use = season > 1 and len(y) >= 2 * season
    level = sum(y[:season]) / season if use else y[0]
    s, trend, error = [v - level for v in y[:season]] if use else [0.0] * season, 0.0, 0.0
    for t, v in enumerate(y):
        at = t % season
        guess = level + phi * trend
        error += (v - guess - s[at]) ** 2
        now = alpha * (v - s[at]) + (1 - alpha) * guess
        trend = beta * (now - level) + (1 - beta) * phi * trend
        level = now
        if use:
            s[at] = gamma * (v - now) + (1 - gamma) * s[at]
    return error, [level + sum(phi**j for j in range(1, h + 1)) * trend + s[(len(y) + h - 1) % season] for h in range(1, horizon + 1)]


def ragged(seed=3, items=14):
    rng = np.random.default_rng(seed)
    n = np.sort(rng.integers(3, 70, items))[::-1].copy()
    y = np.zeros((n[0], items))
    for i, k in enumerate(n):
        t = np.arange(k)
        y[:k, i] = 5 + 0.1 * i * t + 2 * np.sin(2 * np.pi * t / 6) + rng.normal(0, 0.7, k)
    return y, n


def test_smoothing_in_step_equals_one_by_one():
    y, n = ragged()
    weights = np.random.default_rng(5).uniform(0.8, 0.99, (4, 3, len(n)))
    error, ahead = forecast.smoothed(y, n, 6, weights, 9)
    for i, k in enumerate(n):
        for j in range(3):
            want, path = one_by_one(y[:k, i].tolist(), 6, *weights[:, j, i], 9)
            assert error[j, i] == pytest.approx(want, rel=1e-9) and ahead[:, j, i] == pytest.approx(path, rel=1e-9)


def test_smoothing_search_against_a_dense_grid():
    y, n = ragged(items=10)
    found = forecast.smoothed(y, n, 6, forecast.best_weights(y, n, 6)[:, None])[0][0]
    at = lambda points: forecast.smoothed(y, n, 6, np.repeat(np.array(points).T[:, :, None], len(n), axis=2))[0].min(axis=0)
    starts = at(forecast.STARTS)
    dense = at([(a, b, g, p) for a in np.linspace(0.001, 0.999, 9) for b in np.linspace(0, 0.999, 7) for g in np.linspace(0, 0.999, 7) for p in (0.8, 0.9, 1.0)])
    assert (found <= starts + 1e-12).all() and np.median(found / dense) < 1.01


def test_smoothing_of_odd_items(spark):
    """Items of one value, without values, with gaps and without an id; blocks of like length only."""
    rows = [(1, 0, 4.0), (2, 0, None), (2, 1, None), (None, 0, 1.0), (None, 1, 2.0)] + [(3, k, None if k % 5 == 1 else float(k)) for k in range(40)]
    out = forecast.ets(spark.createDataFrame(rows, "item_id int, pos int, x double"), 3, 4).collect()
    by = {(r.item_id, r.h): (r.pos, r.mean) for r in out}
    assert len(by) == len(out) == 12 and all(by[(2, h)] == (1 + h, None) for h in (1, 2, 3)) and all(by[(1, h)][1] == pytest.approx(4.0) for h in (1, 2, 3))
    filled = pd.Series([r[2] for r in rows if r[0] == 3]).ffill().to_numpy()
    weights = forecast.best_weights(filled[:, None], np.array([40]), 4)[:, 0]
    assert [by[(3, h)][1] for h in (1, 2, 3)] == pytest.approx(one_by_one(filled.tolist(), 4, *weights, 3)[1])
    assert forecast.ets(spark.createDataFrame([], "item_id int, pos int, x double"), 3, 4).count() == 0
    assert forecast.alike([100, 90, 51, 49, 25], 1 << 20) == [slice(0, 3), slice(3, 5)] and forecast.alike([10] * 5, 20) == [slice(0, 2), slice(2, 4), slice(4, 5)]


def test_folds_side_by_side_equal_one_after_another(spark):
    rng = np.random.default_rng(8)
    data = [(int(i), i % 4, float(a), float(b), float(a - 2 * b + rng.normal(0, 0.1))) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = automl.assembled(spark.createDataFrame(data, "pos int, fold int, a double, b double, y double"), ["a", "b"])
    models = {k: v for k, v in automl.candidates(trees=2).items() if k in ("GBM_1", "DRF_1")}
    part = automl.by_fold(df)
    jobs = [(m, part.filter(F.col("fold") != k)) for m in models.values() for k in range(4)]
    told = lambda m: [r.p for r in m.transform(df).orderBy("pos").collect()]
    assert [told(m) for m in automl.fit_together(jobs, 3)] == [told(m.fit(d)) for m, d in jobs] and automl.fit_together([]) == []
    got = {(r.model, r.pos): r.p for r in automl.out_of_fold(df, models, 4, ["pos"], at_once=3).collect()}
    want = {r.pos: r.p for k in range(4) for r in models["GBM_1"].fit(df.filter(F.col("fold") != k)).transform(df.filter(F.col("fold") == k)).collect()}
    assert len(got) == 600 and all(got[("GBM_1", pos)] == pytest.approx(p, abs=1e-9) for pos, p in want.items())


def test_suppliers_are_dealt_by_rows(spark, sf_dir):
    from tidemark.sources.samples import supplier_weeks

    rows = supplier_weeks(spark, sf_dir).count()
    parts = supplier_weeks(spark, sf_dir, task_rows=rows // 8)
    assert parts.rdd.getNumPartitions() >= 8
    filled = clean.fill(parts)
    assert filled.count() == rows and filled.rdd.getNumPartitions() >= 8


def test_windows_cost_no_call_a_chunk(spark):
    df = panel(spark, n=60, items=3, gaps=0).withColumn("item_id", F.when(F.col("item_id") > 0, F.col("item_id")))
    made = windows.over_windows(df, ["x"], 5, 10, lambda v, rows: pd.DataFrame({"item_id": rows["item_id"], "pos": rows["pos"], "s": v[:, :, 0].sum(axis=1)}), "item_id double, pos int, s double", "item_id")
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    got = {(None if r.item_id is None or r.item_id != r.item_id else r.item_id, r.pos): r.s for r in made.collect()}
    x = {(r.item_id, r.pos): r.x for r in df.collect()}
    assert len(got) == 3 * 56 and all(np.isclose(v, sum(x[item, pos - k] for k in range(5))) for (item, pos), v in got.items())


def test_recursion_reads_the_last_values_only(spark):
    rows = [(i, p, None if (i, p) in ((0, 0), (0, 9), (3, 0), (3, 1)) else float(i + 1 + np.sin(p))) for i, n in ((0, 30), (1, 30), (2, 2), (3, 2)) for p in range(n)]
    df = spark.createDataFrame(rows, "item_id int, pos int, x double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos") * 604_800))
    made = forecast.recursive_tabular(df, 4, lags=(1, 2, 3))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    got = {(r.item_id, r.pos): r["mean"] for r in made.collect()}
    assert set(got) == {(i, n + h) for i, n in ((0, 30), (1, 30), (2, 2), (3, 2)) for h in range(4)}
    assert all((v is None) == (i == 3) for (i, _), v in got.items())


def test_many_series_become_components_with_the_same_products(spark):
    df = panel(spark, n=12, items=30, gaps=0.2)
    one, others = df.filter("item_id = 0"), df.filter("item_id > 0")
    side, whole = ({r.pos: np.array(r.known.toArray()) for r in made.collect()} for made in (forecast.side_by_side(one, others), forecast.principal(one, others)))
    assert sorted(whole) == sorted(side) == list(range(12)) and {len(v) for v in whole.values()} == {12}
    assert all(np.isclose(whole[a] @ whole[b], side[a] @ side[b]) for a in side for b in side)
    with pytest.raises(ValueError):
        forecast.principal(one, others, most=11)


def test_features_are_fitted_in_small_parts(spark, sf_dir, monkeypatch):
    from tidemark.plans import models

    seen = []
    monkeypatch.setattr(models.automl, "train", lambda df, found, **_: (seen.append((spark.conf.get("spark.sql.files.maxPartitionBytes"), df.inputFiles()[0])), (found, None))[1])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    models.fitted(spark, sf_dir, {"GBM_1"})
    assert int(seen[0][0]) == 16 << 20 and "/features-" in seen[0][1] and spark.conf.get("spark.sql.files.maxPartitionBytes") == was
