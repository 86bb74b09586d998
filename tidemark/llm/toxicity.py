"""Toxicity: a factorisation machine over hashed terms.

Terms are the words of a text and the four- and five-letter beginnings of longer words, each counted once. The linear
part is trained by follow-the-regularised-leader with an L1 penalty, so that most weights stay zero; the pairwise part
holds a short vector for each hashed term, trained by AdaGrad, and scores pairs of terms that mean more together
than alone. Labels come from a bounded sample, dealt into shards; after each round the shards' parameters are averaged.

Defined results: null and empty texts have no terms and get the score of the bias alone; without labels every score
is the sigmoid of 0 (0.5 would call all toxic, so the bias is then set to give 0). Texts are used whole, whatever their length. A document
labelled more than once counts once for each label; repeated rows are scored alike. ``apply`` keeps extra columns, but a column with the name of the
score is replaced. An empty table gives an empty table. Equal scores are equal results: 0.5 itself is predicted toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import extended, id_bucket, map_arrow, summed_blocks, with_columns

#: Words in a worker's memo before it is emptied.
MEMO = 200_000


@dataclass(frozen=True)
class Settings:
    """``max_train`` bounds the labelled documents that the model is fitted on; a shard has ``shard_rows`` of them, or somewhat more. Terms in fewer than
    ``min_docs`` documents of the sample are not learned from: they would let the model know its documents by heart."""

    buckets: int = 1 << 18
    rank: int = 4
    max_train: int = 20_000
    shards: int = 8
    shard_rows: int = 2_500
    min_docs: int = 5
    rounds: int = 2
    epochs: int = 3
    alpha: float = 2.0
    l1: float = 6.0
    l2: float = 0.05
    pair_rate: float = 0.03
    pair_decay: float = 1e-4
    seed: int = 17


class Terms(dict):
    """Hashed terms of a word."""

    def __init__(self, buckets: int):
        self.mask = buckets - 1

    def __missing__(self, word: str) -> tuple[int, ...]:
        named = [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]
        ids = tuple(xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) & self.mask for t in named)
        if len(self) >= MEMO:
            self.clear()
        self[word] = ids
        return ids


def features(text: str | None, terms: Terms) -> np.ndarray:
    """Hashed terms of a whole text, each once."""
    words = set(re.findall(r"\w+", (text or "").lower()))
    return np.unique(np.fromiter(chain.from_iterable(map(terms.__getitem__, words)), "int64"))


@dataclass
class Parameters:
    """Bias, linear weights and pair vectors; their size is set by buckets and rank."""

    bias: float
    linear: np.ndarray
    pairs: np.ndarray

    def score(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        v = self.pairs[at]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[at].sum() + 0.5 * ((s * s).sum() - (v * v).sum()) / len(at))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit_shard(rows: list[tuple[np.ndarray, int]], start: Parameters, s: Settings) -> Parameters:
    """The rows of a shard, in the order given, from averaged parameters."""
    p = Parameters(start.bias, start.linear.astype("float64"), start.pairs.astype("float64"))
    n, z = np.zeros(s.buckets), np.zeros(s.buckets)
    # The leader's state is set so that it gives the weights it starts from.
    z[:] = np.where(p.linear == 0, 0, -p.linear * (1 / s.alpha + s.l2) - np.sign(p.linear) * s.l1)
    squared, bias_squared = np.full(s.buckets, 1e-2), 1.0
    for _ in range(s.epochs):
        for at, y in rows:
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= s.l1, 0, -(zi - np.sign(zi) * s.l1) / ((1 + np.sqrt(ni)) / s.alpha + s.l2))
            p.linear[at] = w
            g = sigmoid(p.score(at)) - y
            bias_squared += g * g
            p.bias -= s.alpha * g / np.sqrt(bias_squared)
            if not len(at):
                continue
            now = ni + g * g
            z[at] = zi + g - (np.sqrt(now) - np.sqrt(ni)) / s.alpha * w
            n[at] = now
            v = p.pairs[at]
            slope = g * (v.sum(axis=0) - v) / len(at) + s.pair_decay * v
            squared[at] += (slope * slope).mean(axis=1)
            p.pairs[at] = v - s.pair_rate * slope / np.sqrt(squared[at])[:, None]
    p.linear = np.where(np.abs(z) <= s.l1, 0, -(z - np.sign(z) * s.l1) / ((1 + np.sqrt(n)) / s.alpha + s.l2))
    return p


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Parameters:
    """Parameters from ``labelled`` (doc_id, text, toxic); rows with a null label are passed over."""
    s, spark = settings, labelled.sparkSession
    rng = np.random.default_rng(s.seed)
    p = Parameters(0.0, np.zeros(s.buckets, "float32"), rng.normal(0, 0.02, (s.buckets, s.rank)).astype("float32"))
    rows = labelled.select("doc_id", "text", "toxic").filter(F.col("toxic").isNotNull())
    there = rows.select("doc_id").count()
    if not there:
        p.bias = -35.0
        return p
    draw = F.xxhash64("doc_id", F.lit(s.seed))
    share = min(1.0, s.max_train / there)
    # The terms of the sample are made once; its size is bounded, and every round reads them again.
    sample = rows.filter(F.pmod(draw, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).withColumn("draw", draw)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(s.buckets)
        for batch in batches:
            found = pa.array([features(t, terms).tolist() for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), found], ["toxic", "draw", "terms"])

    ready = map_arrow(sample.select("doc_id", "text", F.col("toxic").cast("int"), "draw"), terms_of, "toxic int, draw long, terms array<int>")
    shards = max(1, min(s.shards, there // s.shard_rows))
    # A number of partitions that is asked for is kept, so that the shards train side by side.
    ready = ready.withColumn("shard", F.pmod("draw", F.lit(shards))).repartition(4 * shards, "shard").persist()

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, "int64")
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=s.buckets)
        parts = [total[i : i + 1024].tobytes() for i in range(0, len(total), 1024)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    frequent = spark.sparkContext.broadcast(summed_blocks(map_arrow(ready.select("terms"), count_terms, "block int, counts binary"), s.buckets) >= s.min_docs)
    for _ in range(s.rounds):
        # Plain values only: a broadcast is unpickled where this package need not be.
        shipped, kind = spark.sparkContext.broadcast((p.bias, p.linear, p.pairs)), Parameters

        def train(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("draw", kind="stable")
            rows = [(np.asarray(t, "int64"), int(y)) for t, y in zip(group["terms"], group["toxic"])]
            q = fit_shard([(t[frequent.value[t]], y) for t, y in rows], kind(*shipped.value), s)
            return pd.DataFrame({"n": [len(group)], "bias": [q.bias], "linear": [q.linear.astype("float32").tobytes()], "pairs": [q.pairs.astype("float32").tobytes()]})

        parts = ready.groupBy("shard").applyInPandas(train, "n long, bias double, linear binary, pairs binary")
        p, whole = Parameters(0.0, np.zeros(s.buckets, "float32"), np.zeros((s.buckets, s.rank), "float32")), 0
        for r in parts.toLocalIterator():
            whole += r.n
            p.bias += r.n * r.bias
            p.linear += np.frombuffer(r.linear, "float32") * r.n
            p.pairs += np.frombuffer(r.pairs, "float32").reshape(s.buckets, s.rank) * r.n
        p = Parameters(p.bias / whole, p.linear / whole, p.pairs / whole)
        shipped.unpersist()
    ready.unpersist()
    return p


def apply(docs: DataFrame, parameters: Parameters, settings: Settings = Settings(), text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    shipped, kind = docs.sparkSession.sparkContext.broadcast((parameters.bias, parameters.linear, parameters.pairs)), Parameters
    at, buckets = docs.columns.index(text), settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, terms = kind(*shipped.value), Terms(buckets)
        for batch in batches:
            scores = pa.array([sigmoid(p.score(features(t, terms))) for t in batch.column(at).to_pylist()], pa.float64())
            yield with_columns(batch, {score: scores})

    return map_arrow(docs, run, extended(docs.schema, f"`{score}` double"))


def op2(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score of each document; labels are learned where crc32 of the id modulo 5 is not 0."""
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    texts = docs.select("doc_id", "text")
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out).select("doc_id", "toxic")
    scored = apply(texts, fit(texts.join(known, "doc_id"), settings), settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
