"""Feature columns of panels: calendar, lags, rolling statistics, differences, exponential means.

All expressions of one frame share a window specification, so Catalyst sorts once. A series too long for one task is cut
into chunks that begin with a halo of the rows before them (``with_halo``); exponential means carry a decayed sum from block to block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar(ts: str | Column = "ts") -> dict[str, Column]:
    t = F.col(ts) if isinstance(ts, str) else ts
    day = F.weekday(t)
    return {
        "hour": F.hour(t), "minute": F.minute(t), "dayofweek": day, "dayofmonth": F.dayofmonth(t), "month": F.month(t),
        "weekofyear": F.weekofyear(t), "is_weekend": (day >= 5).cast("int"),
    }


def cyclic(ts: str = "ts") -> dict[str, Column]:
    t = F.col(ts)
    phases = {"hour": (F.hour(t), 24), "dow": (F.weekday(t), 7), "month": (F.month(t), 12), "minute_of_day": (F.hour(t) * 60 + F.minute(t), 1440)}
    return {f"{name}_{f.__name__}": f(2 * F.pi() * v / period) for name, (v, period) in phases.items() for f in (F.sin, F.cos)}


def series(item: str | Sequence[str] = "item_id", pos: str = "pos") -> WindowSpec:
    return W.partitionBy(*([item] if isinstance(item, str) else item)).orderBy(pos)


def lags(x: str, steps: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    return {f"{x}_lag_{k}": F.lag(x, k).over(w) for k in steps}


def rolling(x: str, sizes: Sequence[int], w: WindowSpec, kinds: Sequence[str] = ("mean", "std", "min", "max")) -> dict[str, Column]:
    """Statistics of the ``size`` rows that end one row before; NULLs are passed over, one value is enough (two for std)."""
    of = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return {f"{x}_roll_{kind}_{n}": of[kind](x).over(w.rowsBetween(-n, -1)) for n in sizes for kind in kinds}


def rolling_blocks(df: DataFrame, x: str, sizes: Sequence[int], item: str | Sequence[str] = "item_id", pos: str = "pos", kinds: Sequence[str] = ("mean", "std", "min", "max")) -> DataFrame:
    """``df`` with the columns of ``rolling``, at a cost that doesn't grow with the windows.

    An item is cut into blocks as long as a window, so a window is the end of one block and the beginning of the next. Both are running aggregates, one of them read backwards; the two
    counts, means and squared deviations are put together without a difference of sums, so nothing cancels.
    """
    keys = [item] if isinstance(item, str) else list(item)
    line = W.partitionBy(*keys).orderBy(pos)
    of = {"n": F.count, "mean": F.avg, "var": F.var_pop, "min": F.min, "max": F.max}
    need = [k for k in of if k == "n" or k in kinds or (k in ("mean", "var") and "std" in kinds)]
    out = df.withColumn("_row", F.row_number().over(line) - 1)
    made: dict[str, Column] = {}
    for n in sizes:
        block = W.partitionBy(*keys, f"_block_{n}")
        running = lambda order, block=block: F.struct(*(of[k](x).over(block.orderBy(order).rowsBetween(W.unboundedPreceding, 0)).alias(k) for k in need))
        out = out.withColumn(f"_block_{n}", F.floor(F.col("_row") / n))
        out = out.withColumn(f"_up_{n}", running(F.col(pos))).withColumn(f"_down_{n}", running(F.col(pos).desc()))
    for n in sizes:
        # Where a window is one whole block, the running aggregate of its last row is all of it.
        out = out.withColumn(f"_b_{n}", F.lag(f"_up_{n}", 1).over(line)).withColumn(f"_a_{n}", F.when(F.col("_row") % n != 0, F.lag(f"_down_{n}", n).over(line)))
        a, b = (lambda k, side=side, n=n: F.col(f"_{side}_{n}").getField(k) for side in "ab")
        zero = F.lit(0.0)
        na, nb = F.coalesce(a("n"), F.lit(0)), F.coalesce(b("n"), F.lit(0))
        both = na + nb
        if "mean" in kinds:
            made[f"{x}_roll_mean_{n}"] = F.when(both > 0, (na * F.coalesce(a("mean"), zero) + nb * F.coalesce(b("mean"), zero)) / both)
        if "std" in kinds:
            apart = F.coalesce(F.pow(a("mean") - b("mean"), 2) * na * nb / both, zero)
            made[f"{x}_roll_std_{n}"] = F.when(both > 1, F.sqrt((na * F.coalesce(a("var"), zero) + nb * F.coalesce(b("var"), zero) + apart) / (both - 1)))
        for kind, pick in (("min", F.least), ("max", F.greatest)):
            if kind in kinds:
                made[f"{x}_roll_{kind}_{n}"] = pick(a(kind), b(kind))
    return out.withColumns(made).drop("_row", *(f"_{c}_{n}" for c in ("block", "up", "down", "a", "b") for n in sizes))


def differences(x: str, steps: Sequence[int], w: WindowSpec, shifted: bool = True) -> dict[str, Column]:
    """x less x some rows before. Unshifted ones hold the current value; shifted ones end one row before."""
    if shifted:
        return {f"{x}_diff_{d}": F.lag(x, 1).over(w) - F.lag(x, d + 1).over(w) for d in steps}
    return {f"{x}_diff_{d}": F.col(x) - F.lag(x, d).over(w) for d in steps}


def with_halo(df: DataFrame, chunk: int, halo: int, pos: str = "pos") -> DataFrame:
    """Every row in its chunk, and once more (``is_halo``) in each later chunk whose first rows look back on it."""
    if halo > chunk:
        raise ValueError("a chunk must be as long as the halo")
    own = F.floor(F.col(pos) / chunk)
    copies = F.when(F.pmod(F.col(pos), F.lit(chunk)) >= chunk - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("chunk", F.explode(copies)).withColumn("is_halo", F.col("chunk") > F.col("_own")).drop("_own")


def over_chunks(df: DataFrame, columns, chunk: int, halo: int, item: str = "item_id", pos: str = "pos") -> DataFrame:
    """Window columns over chunks with a halo; ``columns`` maps a window specification to named expressions."""
    part = with_halo(df, chunk, halo, pos)
    w = W.partitionBy(item, "chunk").orderBy(pos)
    return part.withColumns(columns(w)).filter(~F.col("is_halo")).drop("chunk", "is_halo")


def exponential_mean(df: DataFrame, span: int, block: int = 256, item: str = "item_id", pos: str = "pos", x: str = "x", out: str | None = None) -> DataFrame:
    """Adjusted exponentially weighted mean of the rows before, alpha = 2 / (span + 1); gaps go on decaying.

    Within a block of positions, sums of weights relative to the block's start run over a window; earlier blocks come in as decayed totals, as
    many as still matter in double precision. No window is longer than a block.
    """
    out = out or f"{x}_ewm_{span}"
    decay = 1 - 2 / (span + 1)
    block = max(1, min(block, int(600 / -math.log(decay))))
    back = max(1, math.ceil(math.log(1e-17) / (block * math.log(decay))))
    part = df.withColumn("_block", F.floor(F.col(pos) / block).cast("long")).withColumn("_at", F.pmod(F.col(pos), F.lit(block)))
    weight = F.when(F.col(x).isNotNull(), F.pow(F.lit(decay), -F.col("_at")))
    part = part.withColumn("_w", F.coalesce(weight, F.lit(0.0))).withColumn("_wx", F.coalesce(weight * F.col(x), F.lit(0.0)))
    totals = part.groupBy(item, "_block").agg(F.sum("_w").alias("_tw"), F.sum("_wx").alias("_twx"))
    carried = (
        totals.withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(back))))
        .withColumn("_scale", F.pow(F.lit(decay), F.col("_back") * block))
        .groupBy(item, (F.col("_block") + F.col("_back")).alias("_block"))
        .agg(F.sum(F.col("_tw") * F.col("_scale")).alias("_cw"), F.sum(F.col("_twx") * F.col("_scale")).alias("_cwx"))
    )
    w = W.partitionBy(item, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    part = part.join(carried, [item, "_block"], "left")
    num = F.coalesce(F.sum("_wx").over(w), zero) + F.coalesce("_cwx", zero)
    den = F.coalesce(F.sum("_w").over(w), zero) + F.coalesce("_cw", zero)
    return part.withColumn(out, F.when(den > 0, num / den)).drop("_block", "_at", "_w", "_wx", "_cw", "_cwx")


def build(df: DataFrame, target: str, exogenous: Sequence[str] = (), *, steps=(1, 2, 3, 6, 12, 24, 72, 144, 288), sizes=(12, 72, 288), diffs=(1, 12, 288), spans=(12, 72), exo_steps=(1, 12, 288), exo_sizes=(12, 288), shifted: bool = True, item: str = "item_id", pos: str = "pos", ts: str = "ts") -> DataFrame:
    """All features of a target; the exogenous columns of the same row stay in the frame, which makes it a nowcast."""
    w = series(item, pos)
    columns = calendar(ts) | cyclic(ts) | lags(target, steps, w) | differences(target, diffs, w, shifted)
    for name in exogenous:
        columns |= lags(name, exo_steps, w)
    out = rolling_blocks(df.withColumns(columns), target, sizes, item, pos)
    for name in exogenous:
        out = rolling_blocks(out, name, exo_sizes, item, pos, ("mean",))
    for span in spans:
        out = exponential_mean(out, span, item=item, pos=pos, x=target)
    return out
