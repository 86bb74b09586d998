"""Bands around reconstructions, their scores, and the choice of their widths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.operators.features import with_halo
from tidemark.sources.staging import staged

#: Widths in deviations that are tried upwards and downwards.
ALPHAS = (7, 6, 5, 4, 3, 2)


def score(x: str = "x", recon: str = "recon") -> Column:
    return F.abs(F.col(x) - F.col(recon))


def outside(up: Column, down: Column, x: str = "x", recon: str = "recon", sigma: str = "sigma") -> Column:
    """Whether x leaves the band of ``down`` deviations below and ``up`` above."""
    return (F.col(x) < F.col(recon) - down * F.col(sigma)) | (F.col(x) > F.col(recon) + up * F.col(sigma))


def detect(frame: DataFrame, alphas: DataFrame, channel: str = "channel") -> DataFrame:
    """``frame`` (channel, x, recon, sigma) with score and pred; ``alphas`` has (channel, alpha_up, alpha_down)."""
    told = frame.join(F.broadcast(alphas.select(channel, "alpha_up", "alpha_down")), channel)
    pred = F.coalesce(outside(F.col("alpha_up"), F.col("alpha_down")).cast("int"), F.lit(0))
    return told.withColumn("score", score()).withColumn("pred", pred).drop("alpha_up", "alpha_down")


def resolved_alphas(channels: DataFrame, fitted: DataFrame | None = None, stored: DataFrame | None = None, up: list[float] | None = None, down: list[float] | None = None) -> DataFrame:
    """Widths by channel, up and down on their own: explicit lists of matching length, else the stored table, else the fitted one."""
    names = [r[0] for r in channels.select("channel").distinct().orderBy("channel").collect()]
    spark = channels.sparkSession
    out = spark.createDataFrame([(n,) for n in names], "channel string")
    for side, given in (("alpha_up", up), ("alpha_down", down)):
        if given is not None and len(given) == len(names):
            table = spark.createDataFrame(list(zip(names, map(float, given))), f"channel string, {side} double")
        else:
            source = stored if stored is not None else fitted
            if source is None:
                raise ValueError(f"no {side}: give a list, a stored table or a fitted one")
            table = source.select("channel", F.col(side).cast("double").alias(side))
        out = out.join(table, "channel")
    return out


def alpha_grid(spark) -> DataFrame:
    return spark.createDataFrame([(u, d) for u in ALPHAS for d in ALPHAS], "alpha_up int, alpha_down int")


def confusion(frame: DataFrame, channel: str = "channel") -> DataFrame:
    """tp, fp and fn for each channel and pair of widths, from one pass over ``frame`` (channel, x, recon, sigma, label).

    Each row counts only by how many widths it exceeds upwards and downwards; the grid meets that small histogram.
    """
    # In terms of the predicate, not of a quotient, so that rounding can't tell the two apart.
    ups = sum((F.coalesce(F.col("x") > F.col("recon") + a * F.col("sigma"), F.lit(False)).cast("int") for a in ALPHAS), F.lit(0))
    downs = sum((F.coalesce(F.col("x") < F.col("recon") - a * F.col("sigma"), F.lit(False)).cast("int") for a in ALPHAS), F.lit(0))
    histogram = frame.groupBy(channel, "label", ups.alias("k_up"), downs.alias("k_down")).agg(F.count("*").alias("n"))
    grid = F.broadcast(alpha_grid(frame.sparkSession))
    low = min(ALPHAS)
    pred = (F.col("k_up") >= F.col("alpha_up") - low + 1) | (F.col("k_down") >= F.col("alpha_down") - low + 1)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    on = F.col("label") == 1
    return histogram.join(grid).groupBy(channel, "alpha_up", "alpha_down").agg(total(pred & on).alias("tp"), total(pred & ~on).alias("fp"), total(~pred & on).alias("fn"))


def point_f1(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1, each 0 where it is undefined."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def best_alphas(scores: DataFrame, channel: str = "channel", f1: str = "f1") -> DataFrame:
    """The widths of largest F1 for each channel; ties go to the smallest width up, then down."""
    rank = F.row_number().over(W.partitionBy(channel).orderBy(F.desc(f1), "alpha_up", "alpha_down"))
    return scores.withColumn("_rank", rank).filter("_rank = 1").select(channel, "alpha_up", "alpha_down", F.col(f1).alias("f1"))


def exceeded(frame: DataFrame, channel: str) -> DataFrame:
    """The rows that are labelled or outside the narrowest band (channel, pos, label, ups, downs), with how many of the widths each exceeds on either side. No other row is ever predicted."""
    count = lambda beyond: sum((F.coalesce(beyond(a), F.lit(False)).cast("int") for a in ALPHAS), F.lit(0))
    ups = count(lambda a: F.col("x") > F.col("recon") + a * F.col("sigma"))
    downs = count(lambda a: F.col("x") < F.col("recon") - a * F.col("sigma"))
    rows = frame.select(F.col(channel).alias("channel"), F.col("pos").cast("long").alias("pos"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), ups.alias("ups"), downs.alias("downs"))
    return rows.filter((F.col("ups") > 0) | (F.col("downs") > 0) | (F.col("label") == 1))


def thresholds() -> list[tuple[int, int]]:
    """Pairs of how many widths a row must exceed, up or down, to be predicted: for each pair of widths in the order of ``alpha_grid``."""
    low = min(ALPHAS)
    return [(u - low + 1, d - low + 1) for u in ALPHAS for d in ALPHAS]


def predicted_runs(rows: DataFrame, chunk: int) -> DataFrame:
    """Runs of predicted rows within chunks, for each pair of widths (channel, k, n, total, s, e, on, on_pos, parts, first_on, last_on).

    A run that ends inside its chunk is scored here and added up (n of them, and the total of their scores); one that touches a border of the chunk is given whole, with the number of
    its labelled rows, the sum of their positions, and in how many parts they lie.
    """
    pairs = thresholds()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        pos, on, ups, downs = (group[c].to_numpy("int64") for c in ("pos", "label", "ups", "downs"))
        begin = pos[0] // chunk * chunk
        out = []
        for k, (up, down) in enumerate(pairs):
            said = (ups >= up) | (downs >= down)
            p, t = pos[said], on[said]
            if not len(p):
                continue
            first = np.flatnonzero(np.concatenate(([True], np.diff(p) > 1)))
            last = np.append(first[1:], len(p)) - 1
            s, e = p[first], p[last]
            starts = t.copy()
            starts[1:] &= ~((t[:-1] == 1) & (np.diff(p) == 1)) & 1
            labelled, places, parts = (np.add.reduceat(v, first) for v in (t, t * p, starts))
            size = e - s + 1
            score = (labelled * (e + 1) - places) / (size * (size + 1) / 2) / np.maximum(parts, 1)
            inner = (s > begin) & (e < begin + chunk - 1)
            out.append((k, int(inner.sum()), float(score[inner].sum()), *[None] * 7))
            out += [(k, 0, 0.0, s[i], e[i], labelled[i], places[i], parts[i], t[first[i]], t[last[i]]) for i in np.flatnonzero(~inner)]
        made = pd.DataFrame(out, columns=["k", "n", "total", "s", "e", "on", "on_pos", "parts", "first_on", "last_on"])
        made.insert(0, "channel", group["channel"].iloc[0])
        return made.astype({c: "Int64" for c in ("s", "e", "on", "on_pos", "parts", "first_on", "last_on")})

    kind = rows.schema["channel"].dataType.simpleString()
    cut = rows.withColumn("chunk", F.floor(F.col("pos") / chunk))
    return cut.groupBy("channel", "chunk").applyInPandas(run, f"channel {kind}, k int, n long, total double, s long, e long, on long, on_pos long, parts long, first_on long, last_on long")


def found_parts(rows: DataFrame, chunk: int) -> DataFrame:
    """For each true range that has a row outside the narrowest band, and each pair of widths, the predicted rows in it: their number, the sum of their positions, and in how many runs they lie (channel, s, e, k, n, places, parts)."""
    pairs = thresholds()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        pos, s, ups, downs = (group[c].to_numpy("int64") for c in ("pos", "s", "ups", "downs"))
        own = ~group["is_halo"].to_numpy()
        # Rows of one range stand side by side; a halo row only tells whether the first own one goes on from it.
        goes_on = np.concatenate(([False], (np.diff(pos) == 1) & (s[1:] == s[:-1])))
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        out = []
        for k, (up, down) in enumerate(pairs):
            said = (ups >= up) | (downs >= down)
            starts = said & ~(goes_on & np.concatenate(([False], said[:-1])))
            n, places, parts = (np.add.reduceat(np.where(own, v, 0), first) for v in (said.astype("int64"), said * pos, starts.astype("int64")))
            out += [(s[i], group["e"].iloc[i], k, n[j], places[j], parts[j]) for j, i in enumerate(first) if n[j]]
        made = pd.DataFrame(out, columns=["s", "e", "k", "n", "places", "parts"])
        made.insert(0, "channel", group["channel"].iloc[0])
        return made

    kind = rows.schema["channel"].dataType.simpleString()
    pieces = with_halo(rows, chunk, 1).groupBy("channel", "chunk").applyInPandas(run, f"channel {kind}, s long, e long, k int, n long, places long, parts long")
    return pieces.groupBy("channel", "s", "e", "k").agg(*(F.sum(c).alias(c) for c in ("n", "places", "parts")))


def range_f1(frame: DataFrame, channel: str = "channel", chunk: int = 65_536) -> DataFrame:
    """Range precision, recall and F1 (front bias, reciprocal cardinality) for each channel and pair of widths; ``frame`` has (channel, pos, x, recon, sigma, label).

    Of all rows, only those that are labelled or outside the narrowest band go further, each of them once; besides these, only the channels' names are read. Overlaps are sums over positions: what a set of predicted rows covers of a range follows from
    their number, the sum of their positions and the number of runs. Runs are found for all pairs of widths within a chunk; those at its borders are then merged.
    """
    spark = frame.sparkSession
    kept = staged(exceeded(frame, channel), "outside-rows")
    rows = kept.filter((F.col("ups") > 0) | (F.col("downs") > 0))
    true = staged(ranges.ranges_chunked(kept.select("channel", "pos", "label"), "label", chunk), "true-ranges")
    # Precision: the mean over predicted runs.
    runs = staged(predicted_runs(rows, chunk), "predicted-runs")
    w = W.partitionBy("channel", "k").orderBy("s")
    touches = F.coalesce(F.col("s") == F.lag("e").over(w) + 1, F.lit(False))
    edge = runs.filter("s is not null").withColumn("touches", touches).withColumn("same", (F.col("touches") & (F.col("first_on") == 1) & (F.lag("last_on").over(w) == 1)).cast("int"))
    edge = edge.withColumn("whole", F.sum((~F.col("touches")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.groupBy("channel", "k", "whole").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("on").alias("on"), F.sum("on_pos").alias("on_pos"), (F.sum("parts") - F.sum("same")).alias("parts"))
    size = F.col("e") - F.col("s") + 1
    share = (F.col("on") * (F.col("e") + 1) - F.col("on_pos")) / (size * (size + 1) / 2) / F.greatest("parts", F.lit(1))
    scored = runs.select("channel", "k", "n", "total").unionByName(edge.select("channel", "k", F.lit(1).cast("long").alias("n"), share.alias("total")))
    precision = scored.groupBy("channel", "k").agg((F.sum("total") / F.sum("n")).alias("precision"))
    # Recall: the mean over true ranges, also over those without any row outside the band.
    cell = lambda c: F.floor(F.col(c) / 1024)
    of = true.withColumn("cell", F.explode(F.sequence(cell("s"), cell("e"))))
    inside = rows.filter("label = 1").withColumn("cell", cell("pos")).join(of, ["channel", "cell"]).filter("pos between s and e").drop("cell", "label")
    parts = found_parts(inside, chunk)
    part_score = (F.col("n") * (F.col("e") + 1) - F.col("places")) / (size * (size + 1) / 2) / F.col("parts")
    recall = parts.groupBy("channel", "k").agg(F.sum(part_score).alias("got"))
    grid = spark.createDataFrame([(k, u, d) for k, (u, d) in enumerate((u, d) for u in ALPHAS for d in ALPHAS)], "k int, alpha_up int, alpha_down int")
    channels = frame.select(F.col(channel).alias("channel")).distinct().join(true.groupBy("channel").agg(F.count("*").alias("of")), "channel", "left").join(F.broadcast(grid))
    out = channels.join(recall, ["channel", "k"], "left").join(precision, ["channel", "k"], "left")
    out = out.select(F.col("channel").alias(channel), "alpha_up", "alpha_down", F.coalesce(F.col("got") / F.col("of"), F.lit(0.0)).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r + 1e-6)).otherwise(F.lit(0.0)))


def fit_alphas(frame: DataFrame, by: str = "point", channel: str = "channel") -> DataFrame:
    """The widths of largest point-wise or range-based F1 for each channel (``by`` is "point" or "range")."""
    if by not in ("point", "range"):
        raise ValueError(f"unknown choice {by!r}")
    return best_alphas(point_f1(confusion(frame, channel)) if by == "point" else range_f1(frame, channel), channel)
