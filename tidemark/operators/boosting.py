"""Spark's boosted trees and random forests over packed bins: the same candidates for splits, gains and losses, for tables whose tree points would not fit the executors' memory.

Features become bins of one byte, written once in blocks of some thousand rows. Where several of them hang together, a block holds each of their combinations once, and rows name theirs. A level of
a tree is one pass, in which each task gives one histogram by node, feature and bin; fits that are made together share their passes. What reaches the driver has the size of the histograms.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import regression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import setting, staged

#: A feature's bins as combinations of their own, where a group has one feature.
EVERY_BIN = np.arange(1 << 8, dtype="uint8")[None]

#: Bins of a feature, and about how many rows the splits between them are drawn from, as in Spark.
BINS, SAMPLE = 32, 10_000


def splits_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Spark's thresholds of a feature: halfway between all distinct values, or where the counts come closest to equal shares."""
    distinct, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) < bins:
        return middle
    stride, taken = counts.sum() / bins, []
    target, sums = stride, np.cumsum(counts)
    for i in range(1, len(distinct)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            taken.append(i - 1)
            target += stride
    return middle[taken][: bins - 1]


def binned(x: np.ndarray, splits: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (features, rows) of values (rows, features)."""
    return np.stack([np.searchsorted(s, x[:, f], side="left").astype("uint8") for f, s in enumerate(splits)])


class Block:
    """A block of rows: targets, and bins by groups of features, each (features, bins of its combinations, the combination of each row); a group of one feature may give its bins by row, without combinations."""

    def __init__(self, y: np.ndarray, groups: Sequence[tuple[Sequence[int], np.ndarray | None, np.ndarray]]):
        self.y, self.shape = y, (sum(len(features) for features, _, _ in groups), len(y))
        self.groups = [(list(features), EVERY_BIN if table is None else table, rows.astype("intp")) for features, table, rows in groups]
        self.held: dict[int, np.ndarray] = {}

    def __getitem__(self, feature: int) -> np.ndarray:
        if feature not in self.held:
            features, table, rows = next(g for g in self.groups if feature in g[0])
            self.held[feature] = table[features.index(feature)].take(rows)
        return self.held[feature]


@dataclass
class Paths:
    """A tree's levels as a bit for each of its tests, and what its nodes hold by combination of bits: rows look up the tests of a whole group of features at once."""

    tests: dict[int, np.ndarray]
    ends: np.ndarray

    @staticmethod
    def of(levels: Sequence[tuple[np.ndarray, np.ndarray]], values: np.ndarray) -> Paths | None:
        """With the ``values`` of the nodes below ``levels``; None where there are too many tests for a table of all combinations."""
        tests, at = [], None
        if sum((features >= 0).sum() for features, _ in levels) > 15:
            return None
        bits = []
        for features, cuts in levels:
            bits.append(np.full(len(features), -1))
            for node in np.flatnonzero(features >= 0):
                bits[-1][node] = len(tests)
                tests.append((int(features[node]), int(cuts[node]), 1 << len(tests)))
        every = np.arange(1 << len(tests))
        at = np.zeros(len(every), "intp")
        for of_nodes in bits:
            bit = of_nodes[at]
            at = 2 * at + ((bit >= 0) & (every >> np.maximum(bit, 0) & 1))
        # Bins beyond every cut of a feature have all of its bits.
        beyond = {f: np.bitwise_or.reduce([np.where(EVERY_BIN[0] > cut, np.uint16(bit), np.uint16(0)) for g, cut, bit in tests if g == f]) for f in {f for f, _, _ in tests}}
        return Paths(beyond, values[at])

    def look_up(self, x: Block) -> np.ndarray:
        """What the end of its path holds, for each row."""
        bits = None
        for features, table, rows in x.groups:
            if own := [self.tests[f][bins] for f, bins in zip(features, table) if f in self.tests]:
                found = (own[0] if len(own) == 1 else np.bitwise_or.reduce(own)).take(rows)
                bits = found if bits is None else np.bitwise_or(bits, found, out=bits)
        return np.repeat(self.ends, x.shape[1]) if bits is None else self.ends.take(bits)


def leaves(x: np.ndarray | Block, levels: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The node of each row below ``levels``, which hold the feature (or -1) and the last bin to the left of each node."""
    at = np.zeros(x.shape[1], "uint8")
    for features, cuts in levels:
        right = np.zeros(x.shape[1], bool)
        # Plain numbers: with numpy's, bytes would be compared as longs.
        for node, (feature, cut) in enumerate(zip(features.tolist(), cuts.tolist())):
            if feature >= 0:
                beyond = x[feature] > cut
                beyond &= at == node
                right |= beyond
        at += at
        at += right
    return at


def predicted(x: np.ndarray | Block, trees: Sequence[tuple[list, np.ndarray, float]], paths: Sequence[Paths | None] = ()) -> np.ndarray:
    """What ``trees`` say of the rows, by their ``paths`` where these are given."""
    out = np.zeros(x.shape[1])
    for i, (levels, values, rate) in enumerate(trees):
        path = paths[i] if paths else None
        out += (rate * values)[leaves(x, levels)] if path is None else path.look_up(x)
    return out


def poisson() -> np.ndarray:
    """Counts of a Poisson distribution of mean 1, each as often among 65,536 as it is likely."""
    n = np.arange(1, 9)
    return np.searchsorted(np.exp(-1) * np.cumsum(1 / np.cumprod(np.concatenate(([1], n)))), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype("float64")


def add_histogram(total: np.ndarray, x: Block, left_out: np.ndarray | None, trees: list, levels: list, slots: np.ndarray, absolute: bool, share: float | None, seed: int, wanted: set[int], bootstrap: np.ndarray | None = None, paths: Sequence[Paths | None] = ()) -> None:
    """Adds counts and sums (2, features, nodes + 1, bins) of what the next tree has to explain, for the features ``wanted``; rows that are left out, or in a leaf, are in the last node.

    A tree sees a ``share`` of the rows, or with None a bootstrap sample. What it sees depends on the seed, the number of the tree and the block alone.
    """
    y = rest = x.y
    if trees:
        off = y - predicted(x, trees, paths[:-1])
        rest = np.where(off < 0, -1.0, 1.0) if absolute else 2 * off
    node = slots[leaves(x, levels)] if not paths or paths[-1] is None else paths[-1].look_up(x)
    weights = None
    if share is None or share < 1:
        rng = np.random.default_rng([seed & 0x7FFFFFFF, len(trees), zlib.crc32(y.tobytes())])
        if share is None:
            weights = bootstrap[rng.integers(0, 1 << 16, len(y), dtype="uint16")]
            rest = weights * rest
        else:
            node = np.where(rng.random(len(y)) < share, node, slots[-1])
    if left_out is not None:
        node = np.where(left_out, slots[-1], node)
    _, _, nodes, bins = total.shape
    of_nodes = bins * np.arange(nodes)[:, None]
    for features, table, rows in x.groups:
        asked = [(f, i) for i, f in enumerate(features) if f in wanted]
        if not asked:
            continue
        alone = table is EVERY_BIN
        width = bins if alone else table.shape[1]
        key = node * width
        key += rows
        counts, sums = (np.bincount(key, weights=w, minlength=nodes * width) for w in (weights, rest))
        for f, i in asked:
            if alone:
                total[0, f] += counts.reshape(nodes, bins)
                total[1, f] += sums.reshape(nodes, bins)
            else:
                # Combinations become bins only once rows are summed up.
                places = (of_nodes + table[i]).ravel()
                total[0, f] += np.bincount(places, weights=counts, minlength=nodes * bins).reshape(nodes, bins)
                total[1, f] += np.bincount(places, weights=sums, minlength=nodes * bins).reshape(nodes, bins)


@dataclass
class Growing:
    """One fit on its way: finished trees, the levels of the one at hand and the values of its nodes."""

    trees_wanted: int
    depth: int
    rate: float
    absolute: bool
    share: float | None
    seed: int
    without: int
    sizes: list[int]
    tried: int
    trees: list = field(default_factory=list)
    levels: list = field(default_factory=list)
    nodes: list[int] = field(default_factory=lambda: [0])
    values: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        """The place of every node of this level in the histogram; the last entry is for rows that don't count."""
        out = np.full(2 ** len(self.levels) + 1, len(self.nodes), "int64")
        out[self.nodes] = np.arange(len(self.nodes))
        return out

    def shape(self) -> tuple[int, int, int, int]:
        return 2, len(self.sizes), len(self.nodes) + 1, BINS

    def plain(self) -> tuple:
        return self.trees, self.levels, self.slots(), self.absolute, self.share, self.seed, {0, *(f for f, n in enumerate(self.sizes) if n)}

    def grow(self, total: np.ndarray) -> None:
        """Splits the nodes of this level where that gains most, or ends the tree."""
        level = len(self.levels)
        if level == 0:
            n, s = total[0, 0, 0].sum(), total[1, 0, 0].sum()
            if not n:
                raise ValueError("no row to fit")
            self.values = np.array([s / n])
        features, cuts = np.full(2**level, -1), np.zeros(2**level, "int64")
        values, nodes = np.repeat(self.values, 2), []
        told = np.arange(BINS)[None] < np.array(self.sizes)[:, None]
        rng = np.random.default_rng([self.seed & 0x7FFFFFFF, level])
        for slot, node in enumerate(self.nodes):
            counts, sums = total[0, :, slot].cumsum(axis=1), total[1, :, slot].cumsum(axis=1)
            n, s = counts[:, -1:], sums[:, -1:]
            ok = told & (counts > 0) & (counts < n)
            if self.tried < len(self.sizes):
                ok[np.setdiff1d(np.arange(len(self.sizes)), rng.choice(len(self.sizes), self.tried, replace=False))] = False
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, (sums**2 / counts + (s - sums) ** 2 / (n - counts) - s**2 / n) / n, -np.inf)
            f, cut = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, cut] > 1e-14 * (s[f, 0] / n[f, 0]) ** 2:
                features[node], cuts[node] = f, cut
                values[2 * node : 2 * node + 2] = sums[f, cut] / counts[f, cut], (s[f, 0] - sums[f, cut]) / (n[f, 0] - counts[f, cut])
                nodes += [2 * node, 2 * node + 1]
        if nodes:
            self.levels.append((features, cuts))
            self.values, self.nodes = values, nodes
        if not nodes or len(self.levels) == self.depth:
            self.trees.append((self.levels, self.values, self.rate if self.trees else 1.0))
            self.levels, self.nodes, self.values = [], [0], None

    def done(self) -> bool:
        return len(self.trees) == self.trees_wanted


class GBTRegressor(regression.GBTRegressor):
    """Spark's estimator of this name with its parameters, fitted over packed bins."""

    def drawn_from(self, sample: DataFrame) -> GBTRegressor:
        """Takes the splits from ``sample``, a part of the rows that is cheaper to make than one of all rows."""
        self._sample = sample
        return self

    def spelled_out(self, shorter: DataFrame, spell: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, list]]], groups: Sequence[Sequence[int]]) -> GBTRegressor:
        """Takes the rows from ``shorter``, of which ``spell`` makes blocks of the same targets and values as the frame to fit has, by ``groups`` of features: for each of these its combinations of
        values (combinations, features) and the combination of every row, or values of every row and None. The frame to fit is only read for splits."""
        self._shorter = shorter, spell, [list(g) for g in groups]
        return self

    def _fit(self, df: DataFrame) -> BoostedModel:
        return grown(packed(df, self, sample=getattr(self, "_sample", None), shorter=getattr(self, "_shorter", None)), [(self, None)])[0]


def fits(estimator) -> bool:
    """Whether ``grown`` knows all that this estimator asks for."""
    if isinstance(estimator, regression.RandomForestRegressor):
        kind = estimator.getBootstrap() and estimator.getSubsamplingRate() == 1 and estimator.getNumTrees() > 1 and estimator.getFeatureSubsetStrategy() == "auto"
    else:
        kind = isinstance(estimator, regression.GBTRegressor) and estimator.getFeatureSubsetStrategy() == "all" and not estimator.isDefined("validationIndicatorCol")
    return bool(kind) and 1 <= estimator.getMaxDepth() <= 7 and (estimator.getMaxBins(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain(), estimator.getMinWeightFractionPerNode()) == (BINS, 1, 0.0, 0.0) and not estimator.isDefined("weightCol")


@dataclass
class BoostedModel:
    """Trees over bins, and the splits that make them."""

    splits: list[np.ndarray]
    trees: list
    features: str
    prediction: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.prediction, predictions_of([self])[0])


def predictions_of(models: Sequence[BoostedModel]) -> Column:
    """The predictions of models that have their splits and features in common, as one array: a row goes to the task's Python once for all of them."""
    splits, every = models[0].splits, [m.trees for m in models]

    def predict(x: pa.Array) -> pa.Array:
        bins = binned(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(splits)), splits)
        block = Block(np.zeros(bins.shape[1]), [([f], None, row) for f, row in enumerate(bins)])
        paths = [[Paths.of(levels, rate * values) for levels, values, rate in trees] for trees in every]
        found = np.stack([predicted(block, trees, path) for trees, path in zip(every, paths)], axis=1)
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype="int32") * len(every), found.ravel())

    return F.arrow_udf(predict, "array<double>")(vector_to_array(F.col(models[0].features)))


def gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values (rows, features) and folds of a small frame (x, fold)."""
    rows = df.toArrow()
    n = len(rows)
    return (rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))), rows["fold"].to_numpy()


def places(rows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` each row has, in as few bytes as hold that."""
    return rows.astype("uint8" if n <= 1 << 8 else "uint16" if n <= 1 << 16 else "uint32")


def distinct(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, values = pd.factorize(y)
    return values, places(rows, len(values))


def placed(raw: pa.Buffer, n: int) -> np.ndarray:
    """What ``places`` gave."""
    return np.frombuffer(raw, "uint8" if n <= 1 << 8 else "uint16" if n <= 1 << 16 else "uint32")


def blocks_of(batch: pa.RecordBatch, groups: list[list[int]]) -> Iterator[Block]:
    """The blocks of a table that is packed by ``groups``."""
    for i in range(batch.num_rows):
        raw = [column[i].as_buffer() for column in batch.columns]
        y = np.frombuffer(raw[0], "float64")
        each = []
        for features, table, at in zip(groups, raw[2::2], raw[3::2]):
            bins = np.frombuffer(table, "uint8").reshape(len(features), -1) if table.size else None
            each.append((features, bins, np.frombuffer(at, "uint8") if bins is None else placed(at, bins.shape[1])))
        yield Block(y[placed(raw[1], len(y))], each)


@dataclass
class Packed:
    """A table of blocks: bins by the splits of each fold that is left out (-1: none), targets and folds; or, with ``groups`` of features, distinct targets, combinations and which of them the rows have."""

    table: DataFrame
    splits: dict[int, list[np.ndarray]]
    parts: int
    groups: list[list[int]] | None = None


def packed(df: DataFrame, like, folds: Sequence[int | None] = (None,), sample: DataFrame | None = None, shorter: tuple[DataFrame, Callable, list[list[int]]] | None = None) -> Packed:
    """The columns that the estimator ``like`` reads, as bins written once. Splits come from about ``SAMPLE`` rows outside of each of ``folds`` (column fold), or from those of ``sample``, as in Spark. ``shorter`` as in ``GBTRegressor.spelled_out``."""
    keys = sorted({-1 if k is None else k for k in folds})
    fold = (F.col("fold") if keys != [-1] else F.lit(-2)).cast("int").alias("fold")
    x = vector_to_array(F.col(like.getFeaturesCol())).alias("x")
    drawn, of = gathered(sample.select(x, fold)) if sample is not None else ((), ())
    # A sample of that kind may miss the few rows that there are.
    if len(drawn) < SAMPLE // 4:
        n = df.count()
        drawn, of = gathered((df.sample(SAMPLE / n, like.getSeed()) if n > SAMPLE else df).select(x, fold))
    if not len(drawn):
        raise ValueError("no row to fit")
    splits = {k: [splits_of(column) for column in drawn[of != k].T] for k in keys}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held = [binned(values, splits[k]) for k in keys] + [batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype("int32")]
                yield pa.RecordBatch.from_arrays([pa.array([one.tobytes()], pa.binary()) for one in held], names=[*(f"x{i}" for i in range(len(keys))), "y", "fold"])

    rows, spell, groups = shorter if shorter is not None else (None, None, [])

    def pack_spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own = ["y", "y_at", *(f"{c}{i}" for i in range(len(groups)) for c in ("table", "at"))], splits[-1]
        for batch in batches:
            for y, each in spell(batch):
                if len(y):
                    held = [*distinct(y.astype("float64"))]
                    for features, (values, rows) in zip(groups, each):
                        bins = binned(values, [own[f] for f in features])
                        held += [np.zeros(0, "uint8"), bins[0]] if rows is None else [bins, places(rows, len(values))]
                    yield pa.RecordBatch.from_arrays([pa.array([one.tobytes()], pa.binary()) for one in held], names=names)

    if rows is not None:
        table = staged(rows.mapInArrow(pack_spelled, ", ".join(["y binary", "y_at binary", *(f"{c}{i} binary" for i in range(len(groups)) for c in ("table", "at"))])), "bins")
        return Packed(table, splits, table.rdd.getNumPartitions(), groups)
    kinds = ", ".join([*(f"x{i} binary" for i in range(len(keys))), "y binary", "fold binary"])
    blocks = df.select(x, F.col(like.getLabelCol()).cast("double").alias("y"), fold).mapInArrow(pack, kinds)
    table = staged(blocks, "bins")
    return Packed(table, splits, table.rdd.getNumPartitions())


def begun(estimator, without: int, splits: Sequence[np.ndarray]) -> list[Growing]:
    """What has to grow for an estimator: the trees of a forest at once, those of boosting one after another."""
    sizes = [len(s) for s in splits]
    if isinstance(estimator, regression.RandomForestRegressor):
        return [Growing(1, estimator.getMaxDepth(), 1.0, False, None, estimator.getSeed() + i, without, sizes, -(-len(sizes) // 3)) for i in range(estimator.getNumTrees())]
    return [Growing(estimator.getMaxIter(), estimator.getMaxDepth(), estimator.getStepSize(), estimator.getLossType() == "absolute", estimator.getSubsamplingRate(), estimator.getSeed(), without, sizes, len(sizes))]


def grown(held: Packed, jobs: Sequence[tuple[regression.GBTRegressor | regression.RandomForestRegressor, int | None]]) -> list[BoostedModel]:
    """The fitted models of all jobs, each without the rows of a fold or with all (None), in passes that they share."""
    if not all(fits(e) for e, _ in jobs):
        raise ValueError("settings that a fit over packed bins doesn't know")
    spark, keys, groups = held.table.sparkSession, list(held.splits), held.groups
    each = [begun(e, -1 if k is None else k, held.splits[-1 if k is None else k]) for e, k in jobs]
    while active := [g for growing in each for g in growing if not g.done()]:
        needed = [k for k in keys if any(g.without == k for g in active)]
        shipped = spark.sparkContext.broadcast([(g.shape(), needed.index(g.without), g.without, g.plain()) for g in active])

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shipped.value
            totals, bootstrap = [np.zeros(shape) for shape, *_ in asked], poisson()
            paths = [[*(Paths.of(levels, rate * values) for levels, values, rate in trees), Paths.of(levels, slots)] for *_, (trees, levels, slots, *_) in asked]
            for batch in batches:
                if groups is not None:
                    for block in blocks_of(batch, groups):
                        for total, (_, _, _, plain), path in zip(totals, asked, paths):
                            add_histogram(total, block, None, *plain, bootstrap, path)
                    continue
                kinds = [*["uint8"] * (batch.num_columns - 2), "float64", "int32"]
                for i in range(batch.num_rows):
                    *bins, y, of_row = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in enumerate(kinds))
                    blocks = [Block(y, [([f], None, row) for f, row in enumerate(x.reshape(-1, len(y)))]) for x in bins]
                    for total, (_, at, without, plain), path in zip(totals, asked, paths):
                        add_histogram(total, blocks[at], None if without < 0 else of_row == without, *plain, bootstrap, path)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array([t.tobytes() for t in totals], pa.binary())], names=["job", "total"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for job, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    one = np.frombuffer(raw.as_buffer(), "float64")
                    totals[job] = totals[job] + one if job in totals else one
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["job", "total"])

        # A row of the table is a block of rows, so a batch holds few of them.
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "8"):
            blocks = held.table if groups is not None else held.table.select(*[f"x{keys.index(k)}" for k in needed], "y", "fold")
            rows = blocks.mapInArrow(histograms, "job int, total binary")
            if held.parts > 16:
                rows = rows.repartition(len(active), "job").mapInArrow(summed, "job int, total binary")
            totals = [np.zeros(g.shape()) for g in active]
            # Files of one size come in any order, and sums of tasks must not depend on it.
            for r in sorted(rows.collect(), key=lambda r: (r.job, bytes(r.total))):
                totals[r.job] += np.frombuffer(r.total, "float64").reshape(totals[r.job].shape)
        for g, total in zip(active, totals):
            g.grow(total)
        shipped.unpersist()
    models = []
    for (e, k), growing in zip(jobs, each):
        trees = growing[0].trees if len(growing) == 1 else [(levels, values, 1 / len(growing)) for g in growing for levels, values, _ in g.trees]
        models.append(BoostedModel(held.splits[-1 if k is None else k], trees, e.getFeaturesCol(), e.getPredictionCol()))
    return models
