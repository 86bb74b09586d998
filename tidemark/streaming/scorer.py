"""Scoring of series as they arrive: the network over the last steps of each series, and the bands around it.

Each series keeps its last ``length - 1`` rows as state. Rows older than what a series has already scored are dropped, as
late rows are by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import network
from tidemark.operators.vae import CausalVAE


def score_stream(stream: DataFrame, model: CausalVAE, alphas: DataFrame, delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """Scored rows (series, ts, channel, x, recon, sigma, score, pred) of a stream with ``series``, a time and the model's channels.

    ``alphas`` (channel, alpha_up, alpha_down) has a row for each channel of the model.
    """
    found = {r.channel: (float(r.alpha_up), float(r.alpha_down)) for r in alphas.collect()}
    names, length = list(model.values), model.config.length
    shipped, kind_of = stream.sparkSession.sparkContext.broadcast((*model.plain(), [found[n] for n in names])), network.Config
    columns = ["series", time, "channel", "x", "recon", "sigma", "score", "pred"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settings, weights, bands = shipped.value
        held_at, held = (list(state.get[0]), np.array(state.get[1]).reshape(-1, len(names))) if state.exists else ([], np.zeros((0, len(names))))
        rows = pd.concat(list(parts)).drop_duplicates(time).sort_values(time, kind="stable")
        stamps = rows[time].astype("datetime64[us]").astype("int64").to_numpy()
        fresh = stamps > (held_at[-1] if held_at else -(1 << 62))
        rows, stamps = rows[fresh], stamps[fresh]
        values = np.vstack((held, rows[names].to_numpy("float64")))
        every = np.append(np.array(held_at, "int64"), stamps)
        keep = min(len(values), length - 1)
        state.update((every[len(every) - keep :].tolist(), values[len(values) - keep :].ravel().tolist()))
        if len(values) < length or not len(rows):
            return
        views = np.lib.stride_tricks.sliding_window_view(values, length, axis=0).transpose(0, 2, 1)[-len(rows) :]
        out = network.forward(weights, kind_of(**settings), np.ascontiguousarray(views))
        recon, sigma = out["xm"][:, -1], np.sqrt(np.exp(out["xv"][:, -1]))
        rows = rows.iloc[-len(views) :]
        x = rows[names].to_numpy("float64")
        up, down = np.array(bands).T
        pred = (x < recon - down * sigma) | (x > recon + up * sigma)
        n, m = x.shape
        yield pd.DataFrame({"series": [key[0]] * (n * m), time: np.repeat(rows[time].to_numpy(), m), "channel": names * n, "x": x.ravel(), "recon": recon.ravel(), "sigma": sigma.ravel(), "score": np.abs(x - recon).ravel(), "pred": pred.ravel().astype("int32")})[columns]

    kind = stream.schema["series"].dataType.simpleString()
    watched = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).select("series", time, *names)
    return watched.groupBy("series").applyInPandasWithState(
        run, f"series {kind}, {time} timestamp, channel string, x double, recon double, sigma double, score double, pred int", "stamps array<long>, rows array<double>", "append", GroupStateTimeout.NoTimeout
    )
