"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed. Document frequencies come from every document that may be
learned from. The weights are trained by follow-the-regularised-leader with an elastic-net penalty on a bounded
sample, dealt into shards whose weights are averaged, and a temperature is then fitted on a second bounded sample.

Defined results: a null text or one without a letter gives ``und`` with score 0, as do all texts when nothing can be
learned (no labelled text). Texts are used whole, whatever their length. Ties between languages go to the first in alphabetical
order. Repeated rows are scored alike. ``LanguageModel.apply`` keeps extra columns, but a column with the name of one that it adds is replaced. An empty
table gives an empty table. Every language of the labels is learned; weights take four bytes for each language and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import extended, id_bucket, map_arrow, summed_blocks, with_columns


@dataclass(frozen=True)
class Settings:
    """``max_train`` and ``max_calibration`` bound the samples of documents that weights and temperature are fitted on."""

    buckets: int = 1 << 15
    max_train: int = 8000
    max_calibration: int = 2000
    shards: int = 8
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None, letters: np.ndarray, buckets: int) -> np.ndarray | None:
    """Counts of hashed n-grams; what is no letter counts as a blank. None if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "uint32")
    known = letters[points]
    if not known.any():
        return None
    a = np.concatenate(([32], np.where(known, points, 32), [32])).astype("uint32")
    one = a * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (a[1:] * np.uint32(0x85EBCA6B) + np.uint32(1))
    three = two[:-1] ^ (a[2:] * np.uint32(0xC2B2AE35) + np.uint32(2))
    h = np.concatenate((one[1:-1], two, three))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return np.bincount(h & np.uint32(buckets - 1), minlength=buckets)


def weighed(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the unit TF-IDF vector, with a constant last feature."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    x /= np.sqrt((x * x).sum()) or 1
    return np.append(at, len(idf)).astype("int32"), np.append(x, 0.1).astype("float32")


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_shard(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, classes: int, s: Settings) -> np.ndarray:
    """FTRL-proximal over the rows of a shard, in the order given."""
    z, n = np.zeros((width, classes), "float32"), np.zeros((width, classes), "float32")

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= s.l1, 0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for at, x, y in rows:
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            was = n[at]
            now = was + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(was)) / s.alpha * w
            n[at] = now
    return weights(slice(None))


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """Fitted weights; their size is set by the buckets and the number of languages, not by the corpus."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    buckets: int

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = weighed(counts, self.idf)
        return x @ self.weights[at]

    def apply(self, docs: DataFrame, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
        """``docs`` with the language and the calibrated probability of each whole text."""
        # Plain values only: a broadcast is unpickled where this package need not be.
        shipped = docs.sparkSession.sparkContext.broadcast((self.languages, self.idf, self.weights, self.temperature, self.buckets))
        column, kind = docs.columns.index(text), LanguageModel

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, letters = kind(*shipped.value), letter_table()
            for batch in batches:
                said = []
                for t in batch.column(column).to_pylist():
                    counts = ngram_counts(t, letters, model.buckets)
                    if counts is None or not model.languages:
                        said.append(("und", 0.0))
                    else:
                        p = softmax(model.logits(counts) / model.temperature)
                        said.append((model.languages[int(p.argmax())], float(p.max())))
                yield with_columns(batch, {lang_pred: pa.array([x[0] for x in said], pa.string()), score: pa.array([x[1] for x in said], pa.float64())})

        return map_arrow(docs, run, extended(docs.schema, f"`{lang_pred}` string, `{score}` double"))


def ngram_frequencies(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram stands, over all of ``docs``, and how many texts have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letter_table(), np.zeros(buckets + 1, "int64")
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts = ngram_counts(t, letters, buckets)
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        yield from blocks(total)

    def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = [total[i : i + 1024].tobytes() for i in range(0, len(total), 1024)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    total = summed_blocks(map_arrow(docs.select("text"), run, "block int, counts binary"), buckets + 1)
    return total[:-1], int(total[-1])


def hashed_share(docs: DataFrame, wanted: int, there: int, seed: int) -> DataFrame:
    """About ``wanted`` of ``there`` rows, chosen by a hash of their id."""
    share = min(1.0, wanted / max(1, there))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20))
    return docs.filter(draw < F.lit(int(share * (1 << 20))))


def fit(learnable: DataFrame, settings: Settings = Settings()) -> LanguageModel:
    """A model of the ``lang`` of ``learnable`` (doc_id, text, lang); rows with a null text or lang are passed over."""
    s = settings
    rows = learnable.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    spark = learnable.sparkSession
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    frequencies, there = ngram_frequencies(rows, s.buckets)
    idf = np.log((1 + there) / (1 + frequencies)) + 1
    width, classes = s.buckets + 1, len(languages)
    model = LanguageModel(languages, idf, np.zeros((width, classes), "float32"), 1.0, s.buckets)
    if not classes or not there:
        return model
    known = spark.sparkContext.broadcast((languages, idf))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        names, idf = known.value
        places = {name: k for k, name in enumerate(names)}
        letters = letter_table()
        group = group.sort_values("draw", kind="stable")
        rows = []
        for t, y in zip(group["text"], group["lang"]):
            counts = ngram_counts(t, letters, s.buckets)
            if counts is not None:
                rows.append((*weighed(counts, idf), places[y]))
        w = fit_shard(rows, width, classes, s)
        return pd.DataFrame({"n": [len(group)], "w": [w.astype("float32").tobytes()]})

    # One row in eleven is kept for the temperature.
    spare = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(11)) == 0
    sample = hashed_share(rows.filter(~spare), s.max_train, there * 10 // 11, 5).withColumn("draw", F.xxhash64("doc_id", F.lit(7)))
    # A number of partitions that is asked for is kept, so that the shards train side by side.
    dealt = sample.withColumn("shard", F.pmod("draw", F.lit(s.shards))).repartition(4 * s.shards, "shard")
    share = 0
    for r in dealt.groupBy("shard").applyInPandas(train, "n long, w binary").toLocalIterator():
        model.weights += np.frombuffer(r.w, "float32").reshape(width, classes) * np.float32(r.n)
        share += r.n
    model.weights /= np.float32(share or 1)
    ready, kind = spark.sparkContext.broadcast((model.languages, model.idf, model.weights, model.temperature, model.buckets)), LanguageModel

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, fitted = letter_table(), kind(*ready.value)
        for batch in batches:
            pairs = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = ngram_counts(t, letters, s.buckets)
                if counts is not None:
                    pairs.append((fitted.logits(counts).tolist(), y))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.list_(pa.float64())), pa.array([p[1] for p in pairs], pa.string())], ["logits", "lang"])

    held = map_arrow(hashed_share(rows.filter(spare), s.max_calibration, there // 11, 6).select("text", "lang"), score, "logits array<double>, lang string").collect()
    places = {name: k for k, name in enumerate(languages)}
    model.temperature = fitted_temperature(np.array([r.logits for r in held]), np.array([places[r.lang] for r in held], int))
    return model


def learnable_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~held_out)


def op6(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Language of each document; learned where crc32 of the id modulo 3 is not 1."""
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    model = fit(learnable_rows(docs, held_out), settings)
    return model.apply(docs.select("doc_id", "text")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
