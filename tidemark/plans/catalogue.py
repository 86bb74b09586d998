"""The registered queries over the sample tables and the SQL they are held against.

Floating results are rounded on both sides as round(v + 1e-9, 6): sums run in another order in another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import errors, metrics
from tidemark.operators import clean, detect, features, frames, ranges, windows
from tidemark.sources import io
from tidemark.sources.staging import scratch
from tidemark.sources.samples import CHANNELS, HOURLY_SQL, WEEKLY_SQL, hourly_events, hourly_wide, supplier_weeks

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Weeks that forecasts reach, and the season of weekly series; hours of a day.
HORIZON, YEAR, DAY = 26, 52, 24


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


def r(expression: str, name: str) -> str:
    return f"round({expression} + 1e-9, 6) AS {name}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(fn: Query) -> Query:
        FOUND[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# Frames that several queries start from, in Spark and in SQL.


def filled_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill(hourly_events(spark, sf_dir), "channel")


def filled_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill(supplier_weeks(spark, sf_dir))


def detection_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's value as reconstruction and the deviation of the residual as sigma."""
    df = filled_hours(spark, sf_dir).withColumn("recon", F.lag("x", DAY).over(features.series("channel"))).filter("recon is not null")
    sigma = df.groupBy("channel").agg(F.stddev_pop(F.col("x") - F.col("recon")).alias("sigma"))
    return df.join(F.broadcast(sigma), "channel")


def forecast_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last weeks of each supplier (y) with the value of a year before (p)."""
    df = filled_weeks(spark, sf_dir).withColumn("p", F.lag("x", YEAR).over(features.series()))
    return frames.keep_last(df, HORIZON).withColumnRenamed("x", "y")


def residual_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_frame(spark, sf_dir).withColumn("residual", metrics.residual())


def hourly_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detection_frame(spark, sf_dir)
    return df.select(F.col("channel").alias("item_id"), "ts", "pos", (F.col("x") - F.col("recon")).alias("residual"))


def filled_sql(name: str, source: str, item: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (x), coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY {item} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(x IGNORE NULLS) OVER (PARTITION BY {item} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM {source})"""


HF = HOURLY_SQL + ",\n" + filled_sql("hfill", "h", "channel")
WF = WEEKLY_SQL + ",\n" + filled_sql("wfill", "w", "item_id")
DET = HF + f""",
hrec AS (SELECT *, lag(x, {DAY}) OVER (PARTITION BY channel ORDER BY pos) AS recon FROM hfill),
sig AS (SELECT channel, stddev_pop(x - recon) AS sigma FROM hrec WHERE recon IS NOT NULL GROUP BY 1),
det AS (SELECT r.*, sigma FROM hrec r JOIN sig USING (channel) WHERE recon IS NOT NULL)"""
FC = WF + f""",
wlag AS (SELECT *, lag(x, {YEAR}) OVER (PARTITION BY item_id ORDER BY pos) AS p, max(pos) OVER (PARTITION BY item_id) AS last FROM wfill),
fc AS (SELECT item_id, ts, pos, x AS y, p FROM wlag WHERE pos > last - {HORIZON})"""
RES = FC + ",\nres AS (SELECT *, y - p AS residual FROM fc)"
HRES = DET + ",\nhres AS (SELECT channel AS item_id, ts, pos, x - recon AS residual FROM det)"


def wide_sql(source: str = "h") -> str:
    return "wide AS (SELECT ts, " + ", ".join(f"max(CASE WHEN channel = '{c}' THEN x END) AS {c}" for c in CHANNELS) + f" FROM {source} GROUP BY ts)"


# Sources.


def written(wide: DataFrame, what: str) -> str:
    """A wide table as a source in CSV, and where it stands."""
    path = scratch(wide.sparkSession, what)
    wide.write.csv(path, header=True)
    return path


@query(f"WITH {HOURLY_SQL} SELECT ts, channel, {r('x', 'x')} FROM h")
def a1_read_mts(spark, sf_dir):
    wide = io.read_mts(spark, written(hourly_wide(spark, sf_dir), "mts"), CHANNELS)
    return rounded(wide.unpivot("ts", list(CHANNELS), "channel", "x"), "x")


@query(f"""WITH {HOURLY_SQL} SELECT ts, channel, {r('x', 'x')}, 0 AS split_rank FROM h WHERE pos <= 480
UNION ALL SELECT ts, channel, {r('x', 'x')}, 1 FROM h WHERE pos BETWEEN 480 AND 600 UNION ALL SELECT ts, channel, {r('x', 'x')}, 2 FROM h WHERE pos >= 600""")
def a2_read_splits(spark, sf_dir):
    parts = split_hours(spark, sf_dir).groupBy("split_rank", "ts").pivot("channel", list(CHANNELS)).agg(F.first("x"))
    paths = [written(parts.filter(F.col("split_rank") == k).drop("split_rank"), f"split-{k}") for k in range(3)]
    wide = io.read_splits(spark, paths, CHANNELS, "ts")
    return rounded(wide.unpivot(["ts", "split_rank"], list(CHANNELS), "channel", "x"), "x")


def split_hours(spark, sf_dir):
    """Train, validation and test hours, overlapping by one at each border."""
    df = hourly_events(spark, sf_dir).select("ts", "channel", "x", "pos")
    return frames.concat_splits([df.filter("pos <= 480"), df.filter("pos between 480 and 600"), df.filter("pos >= 600")])


@query(f"WITH {HOURLY_SQL} SELECT ts, channel, label FROM h")
def a3_read_labels(spark, sf_dir):
    df = hourly_events(spark, sf_dir).groupBy("ts").pivot("channel", list(CHANNELS)).agg(F.first("label"))
    return io.read_labels(spark, written(df, "labels"), CHANNELS)


# Shaping.


@query(SQL["a2_read_splits"])
def b1_concat(spark, sf_dir):
    return a2_read_splits(spark, sf_dir)


@query(f"WITH {HOURLY_SQL} SELECT ts, channel, {r('x', 'x')}, CASE WHEN pos <= 480 THEN 0 WHEN pos <= 600 THEN 1 ELSE 2 END AS split_rank FROM h")
def b2_keep_first(spark, sf_dir):
    return rounded(frames.keep_first(split_hours(spark, sf_dir), ["channel", "ts"], ["split_rank", "pos"]), "x").drop("pos")


@query(f"WITH {WEEKLY_SQL} SELECT item_id, ts, {r('x', 'x')} FROM w ORDER BY ts, item_id")
def b3_sort(spark, sf_dir):
    return frames.sorted_by_time(rounded(supplier_weeks(spark, sf_dir), "x").drop("pos"), "ts", "item_id")


@query(f"WITH {HOURLY_SQL}, {wide_sql()} SELECT ts, {', '.join(r(c, c) for c in CHANNELS if c.startswith('s') or c.startswith('p'))} FROM wide")
def b4_select_series(spark, sf_dir):
    df = hourly_wide(spark, sf_dir)
    kept = [c for p in ("p", "s") for c in frames.series_columns(df, p, target="error")]
    return rounded(df.select("ts", *kept), *kept)


@query(f"WITH {HOURLY_SQL} SELECT ts, channel AS item_id, {r('x', 'target')} FROM h")
def b5_to_panel(spark, sf_dir):
    return rounded(frames.to_panel(hourly_wide(spark, sf_dir), CHANNELS), "target")


@query(f"WITH {HOURLY_SQL}, {wide_sql()} SELECT 'click' AS item_id, ts, {r('click', 'target')}, {r('view', 'view')} FROM wide")
def b6_single_panel(spark, sf_dir):
    return rounded(frames.to_single_panel(hourly_wide(spark, sf_dir), "click", "click", ["view"]), "target", "view")


@query(f"WITH {HOURLY_SQL}, {wide_sql()} SELECT ts, {', '.join(r(f'coalesce({c}, 0)', c) for c in CHANNELS)} FROM wide")
def b7_to_wide(spark, sf_dir):
    return rounded(frames.to_wide(hourly_events(spark, sf_dir), "ts", "channel", "x", CHANNELS, 0.0), *CHANNELS)


@query(f"WITH {WEEKLY_SQL}, l AS (SELECT *, max(pos) OVER (PARTITION BY item_id) AS last FROM w) SELECT item_id, pos, {r('x', 'x')}, CASE WHEN pos > last - {HORIZON} THEN 'test' ELSE 'train' END AS part FROM l")
def b8_time_slice(spark, sf_dir):
    df = rounded(supplier_weeks(spark, sf_dir), "x").drop("ts")
    return frames.drop_last(df, HORIZON).withColumn("part", F.lit("train")).unionByName(frames.keep_last(df, HORIZON).withColumn("part", F.lit("test")))


@query(f"WITH {WEEKLY_SQL} SELECT item_id, pos, {r('x', 'x')}, CASE WHEN pos < 250 THEN 'train' ELSE 'test' END AS part FROM w WHERE pos >= 52")
def b9_train_test_cut(spark, sf_dir):
    return rounded(frames.cut_at(supplier_weeks(spark, sf_dir).drop("ts"), 250, 52), "x")


@query(f"WITH {WEEKLY_SQL} SELECT item_id, pos, {r('x', 'x')} FROM w WHERE x IS NOT NULL")
def b10_drop_null_target(spark, sf_dir):
    return rounded(frames.without_null_target(supplier_weeks(spark, sf_dir).drop("ts"), "x"), "x")


@query(f"WITH {WEEKLY_SQL} SELECT item_id, pos, {r('x', 'x')} FROM w")
def b11_drop_empty_columns(spark, sf_dir):
    df = supplier_weeks(spark, sf_dir).withColumn("century_before", F.lag("x", 100 * YEAR).over(features.series()))
    return rounded(df.select("item_id", "pos", *frames.filled_columns(df, ["x", "century_before"])), "x")


@query(f"WITH {WEEKLY_SQL}, last AS (SELECT item_id, max(ts) AS t FROM w GROUP BY 1) SELECT item_id, CAST(h AS INTEGER) AS h, t + h * INTERVAL 7 DAY AS ts FROM last CROSS JOIN (SELECT unnest(range(1, {HORIZON + 1})) AS h)")
def b12_future_frame(spark, sf_dir):
    return frames.future_frame(supplier_weeks(spark, sf_dir), HORIZON, "7 days")


@query(f"WITH {WEEKLY_SQL}, last AS (SELECT item_id, max(ts) AS t FROM w GROUP BY 1) SELECT item_id, CAST(h AS INTEGER) AS h, CAST(0.5 AS DOUBLE) AS promotion FROM last CROSS JOIN (SELECT unnest(range(1, {HORIZON + 1})) AS h)")
def b13_override(spark, sf_dir):
    future = frames.future_frame(supplier_weeks(spark, sf_dir), HORIZON, "7 days").withColumn("promotion", F.col("h") * 1.0)
    return frames.override(future, "promotion", 0.5).drop("ts")


@query(f"WITH {DET} SELECT channel, pos, {r('x', 'x')}, {r('recon', 'recon')} FROM det")
def b14_align(spark, sf_dir):
    observed = filled_hours(spark, sf_dir)
    made = observed.withColumn("recon", F.lag("x", DAY).over(features.series("channel"))).filter("recon is not null").select("channel", "pos", "recon")
    return rounded(frames.aligned(made, observed.select("channel", "pos", "x"), ["channel", "pos"]), "x", "recon")


@query(f"WITH {WEEKLY_SQL}, k AS (SELECT item_id, pos, {r('x', 'x')}, CAST(row_number() OVER (PARTITION BY item_id ORDER BY x DESC, pos) AS INTEGER) AS rank FROM w WHERE x IS NOT NULL) SELECT * FROM k WHERE rank <= 5")
def b15_top_k(spark, sf_dir):
    df = frames.without_null_target(supplier_weeks(spark, sf_dir).drop("ts"), "x")
    return rounded(frames.top_k_by(df, 5, ["item_id"], [F.desc("x"), "pos"]), "x")


@query(f"WITH {WEEKLY_SQL} SELECT item_id, pos, {r('x', 'x')} FROM w ORDER BY pos, item_id LIMIT 500")
def b16_first_rows(spark, sf_dir):
    return rounded(frames.top_k(supplier_weeks(spark, sf_dir).drop("ts"), 500, "pos", "item_id"), "x")


# Cleaning.

MASK = """st AS (SELECT item_id, avg(x) AS m, stddev_samp(x) AS s FROM w GROUP BY 1),
masked AS (SELECT w.item_id, ts, pos, CASE WHEN s > 0 AND abs((x - m) / s) > 3 THEN NULL ELSE x END AS x FROM w JOIN st USING (item_id))"""


@query(f"WITH {WEEKLY_SQL}, {MASK} SELECT item_id, pos, {r('x', 'x')} FROM masked")
def c1_mask_outliers(spark, sf_dir):
    return rounded(clean.mask_outliers(supplier_weeks(spark, sf_dir), 3), "x").drop("ts")


@query(f"WITH {WF} SELECT item_id, pos, {r('x', 'x')} FROM wfill")
def c2_fill(spark, sf_dir):
    return rounded(filled_weeks(spark, sf_dir), "x").drop("ts")


@query(SQL["c2_fill"])
def p2_fill_chunked(spark, sf_dir):
    return rounded(clean.fill_chunked(supplier_weeks(spark, sf_dir), 64), "x").drop("ts")


@query(f"WITH {WEEKLY_SQL} SELECT item_id, pos, {r('coalesce(x, 0)', 'x')} FROM w")
def c3_zero_fill(spark, sf_dir):
    return rounded(clean.zero_fill(supplier_weeks(spark, sf_dir), "x"), "x").drop("ts")


SCALER = "sc AS (SELECT item_id, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS scale FROM wfill GROUP BY 1)"


@query(f"WITH {WF}, {SCALER} SELECT item_id, {r('mean', 'mean')}, {r('scale', 'scale')} FROM sc")
def c4_fit_scaler(spark, sf_dir):
    return rounded(clean.fit_scaler(filled_weeks(spark, sf_dir)), "mean", "scale")


@query(f"WITH {WF}, {SCALER} SELECT item_id, pos, {r('(x - mean) / scale', 'x')} FROM wfill JOIN sc USING (item_id)")
def c5_transform(spark, sf_dir):
    df = filled_weeks(spark, sf_dir)
    return rounded(clean.transform(df, clean.fit_scaler(df)), "x").drop("ts")


@query(f"WITH {WF} SELECT item_id, pos, {r('x', 'x')} FROM wfill")
def c6_inverse(spark, sf_dir):
    df = filled_weeks(spark, sf_dir)
    scaler = clean.fit_scaler(df)
    return rounded(clean.inverse(clean.transform(df, scaler), scaler), "x").drop("ts")


@query(f"""WITH {WEEKLY_SQL}, {MASK}, {filled_sql('mf', 'masked', 'item_id')},
sc AS (SELECT item_id, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS scale FROM mf GROUP BY 1)
SELECT item_id, pos, {r('(x - mean) / scale', 'x')} FROM mf JOIN sc USING (item_id)""")
def c7_preprocess(spark, sf_dir):
    return rounded(clean.preprocess(supplier_weeks(spark, sf_dir), "fit", max_std=3)[0], "x").drop("ts")


# Windows.


@query(f"""WITH {WF}, a AS (SELECT item_id, pos, list(x) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS l FROM wfill)
SELECT item_id, pos, {r('l[1]', 'first_x')}, {r('list_sum(l)', 'sum_x')}, CAST(len(l) AS INTEGER) AS n FROM a WHERE len(l) = 12""")
def d1_sliding_windows(spark, sf_dir):
    df = windows.window_arrays(filled_weeks(spark, sf_dir), 12)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("item_id", "pos", F.col("window")[0].alias("first_x"), total.alias("sum_x"), F.size("window").alias("n")), "first_x", "sum_x")


@query(SQL["d1_sliding_windows"].replace("CAST(len(l) AS INTEGER) AS n", "CAST(12 AS INTEGER) AS n"))
def p1_windows_chunked(spark, sf_dir):
    import pandas as pd

    def summed(views, rows):
        return pd.DataFrame({"item_id": rows["item_id"], "pos": rows["pos"], "first_x": views[:, 0, 0], "sum_x": views[:, :, 0].sum(axis=1), "n": 12})

    df = windows.over_windows(filled_weeks(spark, sf_dir).drop("ts"), ["x"], 12, 192, summed, "item_id long, pos int, first_x double, sum_x double, n int", "item_id")
    return rounded(df, "first_x", "sum_x")


@query(f"WITH {HF}, n AS (SELECT max(pos) + 1 AS n FROM h) SELECT channel, pos, {r('x', 'x')}, CASE WHEN pos < n - CAST(floor(0.2 * n) AS INTEGER) THEN 'train' ELSE 'validation' END AS part FROM hfill, n")
def d2_holdout(spark, sf_dir):
    df = filled_hours(spark, sf_dir).select("channel", "pos", "x")
    train, validation = windows.holdout(df, 0.2, df.agg(F.max("pos")).first()[0] + 1)
    return rounded(train.withColumn("part", F.lit("train")).unionByName(validation.withColumn("part", F.lit("validation"))), "x")


@query()
def d3_shuffle(spark, sf_dir):
    return windows.shuffled(filled_weeks(spark, sf_dir), ["item_id", "pos"], seed=7, epoch=0)


@query(f"WITH {WF} SELECT item_id, pos, {r('x', 'x')} FROM wfill WHERE pos >= 11")
def d4_last_step(spark, sf_dir):
    import pandas as pd

    def last(views, rows):
        return pd.DataFrame({"item_id": rows["item_id"], "pos": rows["pos"], "x": views[:, -1, 0]})

    return rounded(windows.over_windows(filled_weeks(spark, sf_dir).drop("ts"), ["x"], 12, 192, last, "item_id long, pos int, x double", "item_id"), "x")


# Features.


def weekly_features(spark, sf_dir, columns: dict[str, Column]) -> DataFrame:
    return rounded(filled_weeks(spark, sf_dir).withColumns(columns).select("item_id", "pos", *columns), *columns)


def over(expression: str) -> str:
    return f"{expression} OVER (PARTITION BY item_id ORDER BY pos"


@query(f"""WITH {HOURLY_SQL} SELECT channel, pos, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
CAST(day(ts) AS INTEGER) AS dayofmonth, CAST(month(ts) AS INTEGER) AS month, CAST(week(ts) AS INTEGER) AS weekofyear, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM h""")
def e1_calendar(spark, sf_dir):
    columns = features.calendar()
    return hourly_events(spark, sf_dir).withColumns(columns).select("channel", "pos", *columns)


PHASES = {"hour": ("hour(ts)", 24), "dow": ("(isodow(ts) - 1)", 7), "month": ("month(ts)", 12), "minute_of_day": ("(hour(ts) * 60 + minute(ts))", 1440)}


@query(f"WITH {HOURLY_SQL} SELECT channel, pos, {', '.join(r(f'{f}(2 * pi() * {v} / {n})', f'{k}_{f}') for k, (v, n) in PHASES.items() for f in ('sin', 'cos'))} FROM h")
def e2_cyclic(spark, sf_dir):
    columns = features.cyclic()
    return rounded(hourly_events(spark, sf_dir).withColumns(columns).select("channel", "pos", *columns), *columns)


LAGS, SIZES, DIFFS, SPANS = (1, 2, 3, 6, 12, 24, 52), (6, 12, 24), (1, 6, 24), (6, 12)
OF = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
ROLL = ", ".join(r(over(f"{OF[kind]}(x)") + f" ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", f"x_roll_{kind}_{n}") for n in SIZES for kind in OF)


@query(f"WITH {WF} SELECT item_id, pos, {', '.join(r(over(f'lag(x, {k})') + ')', f'x_lag_{k}') for k in LAGS)} FROM wfill")
def e3_lags(spark, sf_dir):
    return weekly_features(spark, sf_dir, features.lags("x", LAGS, features.series()))


@query(f"WITH {WF} SELECT item_id, pos, {ROLL} FROM wfill")
def e4_rolling(spark, sf_dir):
    names = list(features.rolling("x", SIZES, features.series()))
    return rounded(features.rolling_blocks(filled_weeks(spark, sf_dir), "x", SIZES).select("item_id", "pos", *names), *names)


WIDE = (72, 288)
WIDE_SQL = ", ".join(r(f"{f}(x) OVER (PARTITION BY channel ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", f"x_roll_{kind}_{n}") for n in WIDE for kind, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query(f"WITH {HF} SELECT channel, pos, {WIDE_SQL} FROM hfill")
def e4_wide_windows(spark, sf_dir):
    names = list(features.rolling("x", WIDE, features.series()))
    return rounded(features.rolling_blocks(filled_hours(spark, sf_dir), "x", WIDE, "channel").select("channel", "pos", *names), *names)


@query(SQL["e4_rolling"])
def p1_rolling_chunked(spark, sf_dir):
    df = features.over_chunks(filled_weeks(spark, sf_dir), lambda w: features.rolling("x", SIZES, w), 64, max(SIZES))
    names = list(features.rolling("x", SIZES, features.series()))
    return rounded(df.select("item_id", "pos", *names), *names)


@query(f"WITH {WF} SELECT item_id, pos, {', '.join(r('x - ' + over(f'lag(x, {d})') + ')', f'x_diff_{d}') for d in DIFFS)} FROM wfill")
def e5_differences(spark, sf_dir):
    return weekly_features(spark, sf_dir, features.differences("x", DIFFS, features.series(), shifted=False))


def ewm_sql(span: int) -> str:
    decay = 1 - 2 / (span + 1)
    return f"""e{span} AS (SELECT a.item_id, a.pos, sum(pow({decay!r}, a.pos - 1 - b.pos) * b.x) / sum(CASE WHEN b.x IS NOT NULL THEN pow({decay!r}, a.pos - 1 - b.pos) END) AS v
FROM w a LEFT JOIN w b ON a.item_id = b.item_id AND b.pos < a.pos AND b.pos >= a.pos - 400 GROUP BY 1, 2)"""


@query(f"WITH {WEEKLY_SQL}, {', '.join(map(ewm_sql, SPANS))} SELECT e6.item_id, e6.pos, {r('e6.v', 'x_ewm_6')}, {r('e12.v', 'x_ewm_12')} FROM e6 JOIN e12 ON e6.item_id = e12.item_id AND e6.pos = e12.pos")
def e6_exponential_mean(spark, sf_dir):
    df = supplier_weeks(spark, sf_dir)
    for span in SPANS:
        df = features.exponential_mean(df, span, block=48)
    return rounded(df.select("item_id", "pos", "x_ewm_6", "x_ewm_12"), "x_ewm_6", "x_ewm_12")


def wide_hours(spark, sf_dir) -> DataFrame:
    df = frames.to_wide(filled_hours(spark, sf_dir), "pos", "channel", "x", CHANNELS)
    return df.withColumn("item_id", F.lit(0))


WIDE_POS = "wp AS (SELECT pos, " + ", ".join(f"max(CASE WHEN channel = '{c}' THEN x END) AS {c}" for c in CHANNELS) + " FROM hfill GROUP BY pos)"
EXO = CHANNELS[1:]


@query(f"WITH {HF}, {WIDE_POS} SELECT pos, {', '.join(r(f'lag({c}, {k}) OVER (ORDER BY pos)', f'{c}_lag_{k}') for c in EXO for k in (1, 12, 24))} FROM wp")
def e7_exogenous_lags(spark, sf_dir):
    names = [f"{c}_lag_{k}" for c in EXO for k in (1, 12, 24)]
    lags = lambda w: {k: v for c in EXO for k, v in features.lags(c, (1, 12, 24), w).items()}
    return rounded(features.over_chunks(wide_hours(spark, sf_dir), lags, 96, 24).select("pos", *names), *names)


@query(f"WITH {HF}, {WIDE_POS} SELECT pos, {', '.join(r(f'avg({c}) OVER (ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', f'{c}_roll_mean_{n}') for c in EXO for n in (12, 24))} FROM wp")
def e8_exogenous_rolling(spark, sf_dir):
    names = [f"{c}_roll_mean_{n}" for c in EXO for n in (12, 24)]
    # Every chunk begins with a halo as long as the widest window, so the blocks of a chunk know all that they need.
    out = features.with_halo(wide_hours(spark, sf_dir), 96, 24)
    for c in EXO:
        out = features.rolling_blocks(out, c, (12, 24), ("item_id", "chunk"), kinds=("mean",))
    return rounded(out.filter(~F.col("is_halo")).select("pos", *names), *names)


@query(f"""WITH {WF}, {', '.join(map(ewm_sql, SPANS)).replace('FROM w a LEFT JOIN w b', 'FROM wfill a LEFT JOIN wfill b')},
b AS (SELECT item_id, pos, CAST(month(ts) AS INTEGER) AS month, {', '.join(r(over(f'lag(x, {k})') + ')', f'x_lag_{k}') for k in (1, 12))}, {r(over('avg(x)') + ' ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)', 'x_roll_mean_12')},
{r(over('lag(x, 1)') + ') - ' + over('lag(x, 7)') + ')', 'x_diff_6')} FROM wfill)
SELECT b.*, {r('e6.v', 'x_ewm_6')} FROM b JOIN e6 ON b.item_id = e6.item_id AND b.pos = e6.pos""")
def e9_build_features(spark, sf_dir):
    df = features.build(filled_weeks(spark, sf_dir), "x", steps=(1, 12), sizes=(12,), diffs=(6,), spans=(6,))
    names = ["x_lag_1", "x_lag_12", "x_roll_mean_12", "x_diff_6", "x_ewm_6"]
    return rounded(df.select("item_id", "pos", "month", *names), *names)


# Detection.

ALPHA_SQL = "up AS (SELECT unnest([7, 6, 5, 4, 3, 2]) AS alpha_up), down AS (SELECT unnest([7, 6, 5, 4, 3, 2]) AS alpha_down)"
CONF = f"""{ALPHA_SQL}, pr AS (SELECT channel, pos, label, alpha_up, alpha_down, x < recon - alpha_down * sigma OR x > recon + alpha_up * sigma AS pred FROM det CROSS JOIN up CROSS JOIN down),
cf AS (SELECT channel, alpha_up, alpha_down, count(*) FILTER (pred AND label = 1) AS tp, count(*) FILTER (pred AND label = 0) AS fp, count(*) FILTER (NOT pred AND label = 1) AS fn FROM pr GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cf)"""


def fixed_alphas(spark):
    return spark.createDataFrame([(c, 3, 2) for c in CHANNELS], "channel string, alpha_up int, alpha_down int")


@query(f"WITH {DET} SELECT channel, pos, CASE WHEN x < recon - 2 * sigma OR x > recon + 3 * sigma THEN 1 ELSE 0 END AS pred FROM det")
def g1_band(spark, sf_dir):
    return detect.detect(detection_frame(spark, sf_dir), fixed_alphas(spark)).select("channel", "pos", "pred")


@query(f"WITH {DET} SELECT channel, pos, {r('abs(x - recon)', 'score')} FROM det")
def g2_score(spark, sf_dir):
    return rounded(detection_frame(spark, sf_dir).select("channel", "pos", detect.score().alias("score")), "score")


@query(f"WITH {DET}, {ALPHA_SQL} SELECT channel, alpha_up, alpha_down, count(*) AS n FROM det CROSS JOIN up CROSS JOIN down WHERE x < recon - alpha_down * sigma OR x > recon + alpha_up * sigma GROUP BY 1, 2, 3")
def g4_alpha_grid(spark, sf_dir):
    counts = detect.confusion(detection_frame(spark, sf_dir))
    return counts.select("channel", "alpha_up", "alpha_down", (F.col("tp") + F.col("fp")).alias("n")).filter("n > 0")


@query(f"WITH {DET}, {CONF} SELECT channel, alpha_up, alpha_down, tp, fp, fn, {r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END', 'precision')}, {r('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END', 'recall')}, {r('f1', 'f1')} FROM f")
def g5_point_f1(spark, sf_dir):
    return rounded(detect.point_f1(detect.confusion(detection_frame(spark, sf_dir))), "precision", "recall", "f1")


def islands(name: str, source: str, flag: str) -> str:
    return f"{name} AS (SELECT channel, min(pos) AS s, max(pos) AS e FROM (SELECT channel, pos, pos - row_number() OVER (PARTITION BY channel ORDER BY pos) AS i FROM {source} WHERE {flag} = 1) GROUP BY channel, i)"


@query(f"WITH {DET}, {islands('rg', 'det', 'label')} SELECT * FROM rg")
def g6_ranges(spark, sf_dir):
    return ranges.ranges(detection_frame(spark, sf_dir), "label")


@query(SQL["g6_ranges"])
def p10_ranges_chunked(spark, sf_dir):
    return ranges.ranges_chunked(detection_frame(spark, sf_dir), "label", 50)


PRED = "pd AS (SELECT *, CASE WHEN x < recon - 2 * sigma OR x > recon + 2 * sigma THEN 1 ELSE 0 END AS pred FROM det)"
RANGE = f"{PRED}, {islands('tr', 'pd', 'label')}, {islands('sr', 'pd', 'pred')}"


def coverage_sql(name: str, of: str, by: str) -> str:
    w = "(b - a + 1) * ((e - a + 1) + (e - b + 1)) / 2.0 / ((e - s + 1) * (e - s + 2) / 2.0)"
    return f"""{name} AS (SELECT channel, avg(v) AS score FROM (SELECT channel, s, e, coalesce(sum({w}) / greatest(count(a), 1), 0) AS v FROM
(SELECT o.channel, o.s, o.e, CASE WHEN p.s IS NOT NULL THEN greatest(o.s, p.s) END AS a, CASE WHEN p.s IS NOT NULL THEN least(o.e, p.e) END AS b FROM {of} o LEFT JOIN {by} p ON o.channel = p.channel AND o.s <= p.e AND p.s <= o.e) GROUP BY 1, 2, 3) GROUP BY 1)"""


def predicted(spark, sf_dir):
    df = detection_frame(spark, sf_dir)
    return df.withColumn("pred", detect.outside(F.lit(2), F.lit(2)).cast("int"))


@query(f"WITH {DET}, {RANGE}, {coverage_sql('rc', 'tr', 'sr')} SELECT channel, {r('score', 'recall')} FROM rc")
def g7_range_recall(spark, sf_dir):
    df = predicted(spark, sf_dir)
    out = ranges.coverage(ranges.ranges(df, "label"), ranges.ranges(df, "pred"), ["channel"])
    return rounded(out.select("channel", F.col("score").alias("recall")), "recall")


@query(f"WITH {DET}, {RANGE}, {coverage_sql('pc', 'sr', 'tr')} SELECT channel, {r('score', 'precision')} FROM pc")
def g8_range_precision(spark, sf_dir):
    df = predicted(spark, sf_dir)
    out = ranges.coverage(ranges.ranges(df, "pred"), ranges.ranges(df, "label"), ["channel"])
    return rounded(out.select("channel", F.col("score").alias("precision")), "precision")


@query(f"""WITH {DET}, {RANGE}, {coverage_sql('rc', 'tr', 'sr')}, {coverage_sql('pc', 'sr', 'tr')}, b AS (SELECT DISTINCT channel FROM det),
s AS (SELECT b.channel, coalesce(rc.score, 0) AS re, coalesce(pc.score, 0) AS pr FROM b LEFT JOIN rc USING (channel) LEFT JOIN pc USING (channel))
SELECT channel, {r('re', 'recall')}, {r('pr', 'precision')}, {r('CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re + 1e-6) ELSE 0 END', 'f1')} FROM s""")
def g9_range_f1(spark, sf_dir):
    return rounded(ranges.range_scores(predicted(spark, sf_dir)), "recall", "precision", "f1")


@query(f"WITH {DET}, {CONF}, k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY f1 DESC, alpha_up, alpha_down) AS n FROM f) SELECT channel, alpha_up, alpha_down, {r('f1', 'f1')} FROM k WHERE n = 1")
def g10_best_alpha(spark, sf_dir):
    return rounded(detect.best_alphas(detect.point_f1(detect.confusion(detection_frame(spark, sf_dir)))), "f1")


def covered_by_widths(name: str, of: str, by: str, keys: str) -> str:
    """As ``coverage_sql`` for every pair of widths; ``of`` or ``by`` may be the true ranges, which are the same for all of them."""
    w = "(b - a + 1) * ((e - a + 1) + (e - b + 1)) / 2.0 / ((e - s + 1) * (e - s + 2) / 2.0)"
    return f"""{name} AS (SELECT channel, alpha_up, alpha_down, avg(v) AS score FROM (SELECT channel, alpha_up, alpha_down, s, e, coalesce(sum({w}) / greatest(count(a), 1), 0) AS v FROM
(SELECT o.channel, o.alpha_up, o.alpha_down, o.s, o.e, CASE WHEN p.s IS NOT NULL THEN greatest(o.s, p.s) END AS a, CASE WHEN p.s IS NOT NULL THEN least(o.e, p.e) END AS b
FROM {of} o LEFT JOIN {by} p ON {keys} AND o.s <= p.e AND p.s <= o.e) GROUP BY ALL) GROUP BY ALL)"""


WIDTHS = "o.channel = p.channel AND o.alpha_up = p.alpha_up AND o.alpha_down = p.alpha_down"
SEARCH = f"""{ALPHA_SQL}, pr AS (SELECT channel, pos, label, alpha_up, alpha_down, (x < recon - alpha_down * sigma OR x > recon + alpha_up * sigma)::INT AS pred FROM det CROSS JOIN up CROSS JOIN down),
sr AS (SELECT channel, alpha_up, alpha_down, min(pos) AS s, max(pos) AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY channel, alpha_up, alpha_down ORDER BY pos) AS i FROM pr WHERE pred = 1) GROUP BY channel, alpha_up, alpha_down, i),
{islands('t0', 'det', 'label')}, tr AS (SELECT t0.*, alpha_up, alpha_down FROM t0 CROSS JOIN up CROSS JOIN down),
{covered_by_widths('rc', 'tr', 'sr', WIDTHS)}, {covered_by_widths('pc', 'sr', 'tr', WIDTHS)}, b AS (SELECT DISTINCT channel, alpha_up, alpha_down FROM pr),
s AS (SELECT channel, alpha_up, alpha_down, coalesce(rc.score, 0) AS re, coalesce(pc.score, 0) AS pr FROM b LEFT JOIN rc USING (channel, alpha_up, alpha_down) LEFT JOIN pc USING (channel, alpha_up, alpha_down)),
found AS (SELECT channel, alpha_up, alpha_down, {r('re', 'recall')}, {r('pr', 'precision')}, {r('CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re + 1e-6) ELSE 0 END', 'f1')} FROM s)"""


@query(f"WITH {DET}, {SEARCH} SELECT * FROM found")
def g10_range_search(spark, sf_dir):
    return rounded(detect.range_f1(detection_frame(spark, sf_dir)), "recall", "precision", "f1")


@query(f"WITH {DET}, {SEARCH}, k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY f1 DESC, alpha_up, alpha_down) AS n FROM found) SELECT channel, alpha_up, alpha_down, f1 FROM k WHERE n = 1")
def g10_best_alpha_by_ranges(spark, sf_dir):
    return detect.best_alphas(rounded(detect.range_f1(detection_frame(spark, sf_dir), chunk=100), "f1"))


# Metrics.

PAIR = "pr AS (SELECT * FROM fc WHERE y IS NOT NULL AND p IS NOT NULL)"
METRIC = {"mae": "avg(abs(y - p))", "rmse": "sqrt(avg(pow(y - p, 2)))", "mape": "avg(CASE WHEN abs(y) > 1e-8 THEN abs((y - p) / y) END) * 100", "r2": "CASE WHEN var_pop(y) * count(y) > 0 THEN 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)) END"}


def one_metric(name: str) -> None:
    def fn(spark, sf_dir):
        return rounded(forecast_frame(spark, sf_dir).filter("p is not null").agg(getattr(metrics, name)().alias(name)), name)

    fn.__name__ = {"mae": "j1_mae", "rmse": "j2_rmse", "mape": "j3_mape", "r2": "j4_r2"}[name]
    query(f"WITH {FC}, {PAIR} SELECT {r(METRIC[name], name)} FROM pr")(fn)


for _name in METRIC:
    one_metric(_name)


@query(f"WITH {FC}, {PAIR} SELECT item_id, {', '.join(r(v, k) for k, v in METRIC.items())} FROM pr GROUP BY 1")
def j5_by_item(spark, sf_dir):
    return rounded(metrics.table(forecast_frame(spark, sf_dir), ["item_id"]), *METRIC)


@query(f"WITH {FC}, {PAIR}, t AS (SELECT item_id, {', '.join(f'{v} AS {k}' for k, v in METRIC.items())} FROM pr GROUP BY 1) SELECT {', '.join(r(f'avg({k})', k) for k in METRIC)} FROM t")
def j6_macro(spark, sf_dir):
    return rounded(metrics.macro(metrics.table(forecast_frame(spark, sf_dir), ["item_id"])), *METRIC)


@query(f"""WITH {FC}, d AS (SELECT item_id, avg(abs(x - p)) AS naive FROM wlag WHERE pos <= last - {HORIZON} GROUP BY 1), e AS (SELECT item_id, avg(abs(y - p)) AS mae FROM fc GROUP BY 1)
SELECT item_id, {r('mae / naive', 'mase')} FROM e JOIN d USING (item_id)""")
def j7_mase(spark, sf_dir):
    train = frames.drop_last(filled_weeks(spark, sf_dir), HORIZON)
    return rounded(metrics.mase(forecast_frame(spark, sf_dir), train, YEAR), "mase")


@query(f"WITH {RES} SELECT item_id, pos, {r('residual', 'residual')} FROM res")
def j8_residual(spark, sf_dir):
    return rounded(residual_frame(spark, sf_dir).select("item_id", "pos", "residual"), "residual")


# Errors.


@query(f"WITH {DET} SELECT channel AS item_id, {r('avg(CASE WHEN x BETWEEN recon - 1.2815515655 * sigma AND recon + 1.2815515655 * sigma THEN 1 ELSE 0 END) * 100', 'p80')}, {r('avg(CASE WHEN x BETWEEN recon - 0.6744897502 * sigma AND recon + 0.6744897502 * sigma THEN 1 ELSE 0 END) * 100', 'p50')}, CAST(80 AS DOUBLE) AS p80_expected, CAST(50 AS DOUBLE) AS p50_expected FROM det GROUP BY 1")
def k1_interval_coverage(spark, sf_dir):
    df = detection_frame(spark, sf_dir).withColumnsRenamed({"channel": "item_id", "x": "y"})
    for name, z in (("80", 1.2815515655), ("50", 0.6744897502)):
        df = df.withColumn(f"lo{name}", F.col("recon") - z * F.col("sigma")).withColumn(f"hi{name}", F.col("recon") + z * F.col("sigma"))
    return rounded(errors.interval_coverage(df, {"p80": ("lo80", "hi80", 0.8), "p50": ("lo50", "hi50", 0.5)}), "p80", "p50")


@query(f"WITH {HRES} SELECT a.item_id AS a, b.item_id AS b, {r('corr(a.residual, b.residual)', 'corr')} FROM hres a JOIN hres b ON a.ts = b.ts AND a.item_id <= b.item_id GROUP BY 1, 2")
def k2_error_correlation(spark, sf_dir):
    return rounded(errors.error_correlation(hourly_residuals(spark, sf_dir)), "corr")


@query()
def k3_shuffled_column(spark, sf_dir):
    return errors.shuffled_column(filled_weeks(spark, sf_dir), "x", ["item_id"], "pos", 42)


@query(f"""WITH {HRES}, q AS (SELECT item_id, hour(ts) AS hour, quantile_cont(abs(residual), [0.25, 0.5, 0.75]) AS q FROM hres GROUP BY 1, 2),
k AS (SELECT h.item_id, h.hour, q[1] AS q1, q[2] AS median, q[3] AS q3, e FROM (SELECT item_id, hour(ts) AS hour, abs(residual) AS e FROM hres) h JOIN q ON h.item_id = q.item_id AND h.hour = q.hour)
SELECT item_id, CAST(hour AS INTEGER) AS hour, {r('q1', 'q1')}, {r('median', 'median')}, {r('q3', 'q3')}, {r('min(CASE WHEN e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN e END)', 'low')}, {r('max(CASE WHEN e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN e END)', 'high')} FROM k GROUP BY item_id, hour, q1, median, q3""")
def k5_error_by_hour(spark, sf_dir):
    return rounded(errors.error_by_hour(hourly_residuals(spark, sf_dir)), "q1", "median", "q3", "low", "high")


@query(f"""WITH {RES}, e AS (SELECT item_id, min(residual) AS lo, max(residual) AS hi FROM res GROUP BY 1)
SELECT item_id, CAST(CASE WHEN hi > lo THEN least(floor((residual - lo) / (hi - lo) * 50) + 1, 50) ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM res JOIN e USING (item_id) WHERE residual IS NOT NULL GROUP BY 1, 2""")
def k6_histogram(spark, sf_dir):
    return errors.histogram(residual_frame(spark, sf_dir), 50)


@query(f"WITH {RES} SELECT item_id, pos, {r('p', 'p')}, {r('residual', 'residual')} FROM res ORDER BY pos, item_id LIMIT 2000")
def k7_residual_scatter(spark, sf_dir):
    df = frames.top_k(residual_frame(spark, sf_dir).select("item_id", "pos", "p", "residual"), 2000, "pos", "item_id")
    return rounded(df, "p", "residual")


def _qq_sql() -> str:
    from statistics import NormalDist

    shares = [i / 20 for i in range(1, 20)]
    z = ", ".join(repr(NormalDist().inv_cdf(s)) for s in shares)
    return f"""WITH {RES}, q AS (SELECT item_id, quantile_cont(residual, [{', '.join(map(repr, shares))}]) AS q, stddev_pop(residual) AS d FROM res GROUP BY 1),
u AS (SELECT item_id, d, q, unnest(range(1, 20)) AS i FROM q) SELECT item_id, CAST(i AS INTEGER) AS i, {r('q[i]', 'observed')}, {r(f'([{z}])[i] * d', 'normal')} FROM u"""


@query(_qq_sql())
def k8_normal_quantiles(spark, sf_dir):
    return rounded(errors.normal_quantiles(residual_frame(spark, sf_dir), points=19), "observed", "normal")


@query(f"""WITH {FC} SELECT item_id, pos, {r('x', 'x')}, NULL::DOUBLE AS p, 'train' AS role FROM wlag WHERE pos <= last - {HORIZON} AND pos > last - {HORIZON} - 30
UNION ALL SELECT item_id, pos, {r('y', 'x')}, {r('p', 'p')}, 'forecast' FROM fc""")
def k9_context(spark, sf_dir):
    train = frames.drop_last(filled_weeks(spark, sf_dir), HORIZON).drop("ts")
    forecast = forecast_frame(spark, sf_dir).select("item_id", "pos", F.col("y").alias("x"), "p")
    return rounded(errors.context(train, forecast, 30), "x", "p")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of the hourly event series: the widths that serve each channel best, and what leaves its band."""
    frame = detection_frame(spark, sf_dir)
    best = detect.best_alphas(detect.point_f1(detect.confusion(frame)))
    return detect.detect(frame, best).filter("pred = 1").select("ts", "channel", "x", "recon", "score", "label")


@query(f"""WITH {DET}, {CONF}, k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY f1 DESC, alpha_up, alpha_down) AS n FROM f), b AS (SELECT channel, alpha_up, alpha_down FROM k WHERE n = 1)
SELECT ts, channel, {r('x', 'x')}, {r('recon', 'recon')}, {r('abs(x - recon)', 'score')}, label FROM det JOIN b USING (channel) WHERE x < recon - alpha_down * sigma OR x > recon + alpha_up * sigma""")
def flagship_anomalies(spark, sf_dir):
    return rounded(entry(spark, sf_dir), "x", "recon", "score")


def queries() -> dict[str, Query]:
    from tidemark.plans import models

    return reduce(lambda a, b: {**a, **b}, [FOUND, models.FOUND])


def oracle_sql() -> dict[str, str]:
    from tidemark.plans import models

    return {**SQL, **models.SQL}
