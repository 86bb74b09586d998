"""Explanation of fitted models: importance, partial dependence, Shapley contributions, comparison of model sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantiles


def variable_importance(spark: SparkSession, model, inputs: Sequence[str]) -> DataFrame:
    """relative, scaled and percentage importance of each input; absolute coefficients for a linear model."""
    raw = model.featureImportances if hasattr(model, "featureImportances") else np.abs(model.coefficients.toArray())
    rows = [(name, float(raw[i])) for i, name in enumerate(inputs)]
    top, total = max(v for _, v in rows) or 1.0, sum(v for _, v in rows) or 1.0
    return spark.createDataFrame([(n, v, v / top, v / total) for n, v in rows], "variable string, relative double, scaled double, percentage double")


def grid_of(df: DataFrame, variables: Sequence[str], points: int) -> DataFrame:
    """Equal steps from the smallest to the largest value of each variable: variable, i, value."""
    ends = df.agg(*[f(v).alias(f"{n}_{v}") for v in variables for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"lo_{v}").cast("double").alias("lo"), F.col(f"hi_{v}").cast("double").alias("hi")) for v in variables])
    each = ends.select(F.explode(rows).alias("r")).select("r.*").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return each.select("variable", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / max(1, points - 1)).alias("value"))


def quantile_grid(train: DataFrame, variables: Sequence[str], points: int = 15, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Percentiles of the training part as grid."""
    shares = [low + (high - low) * i / max(1, points - 1) for i in range(points)]
    long = train.select(*(F.col(v).cast("double").alias(v) for v in variables)).unpivot([], list(variables), "variable", "value")
    return quantiles(long, ["variable"], "value", shares).select("variable", F.posexplode("q").alias("i", "value"))


def partial_dependence(df: DataFrame, grid: DataFrame, variables: Sequence[str], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean and deviation of the prediction p while one variable takes each value of its grid, all in one job.

    The grid has a fixed number of points for each variable, so the rows are copied that many times and no more.
    """
    copies = df.join(F.broadcast(grid))
    copies = copies.withColumns({v: F.when(F.col("variable") == v, F.col("value")).otherwise(F.col(v).cast("double")) for v in variables})
    return predict(copies).groupBy("variable", "i", "value").agg(F.avg("p").alias("mean_p"), F.stddev_samp("p").alias("std_p"))


def top_union(importance: DataFrame, n: int) -> DataFrame:
    """Variables of several models' rankings (model, variable, rank): first by best rank, each once."""
    return importance.groupBy("variable").agg(F.min("rank").alias("rank")).orderBy("rank", "variable").limit(n)


def normalised_grid(pdp: DataFrame, by: Sequence[str] = ("variable",), value: str = "value") -> DataFrame:
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return pdp.withColumn("position", (F.col(value) - low) / (high - low + 1e-12))


# Shapley contributions of trees.


def tree_leaves(model) -> list[list[tuple]]:
    """For each tree its leaves: value, cover share, and the path as (feature, low, high, cover share of the branch)."""
    weights = list(model.treeWeights)
    every = []
    for tree, weight in zip(model.trees, weights):
        leaves: list[tuple] = []

        def walk(node, path: list[tuple], share: float) -> None:
            if node.subtreeDepth() == 0:
                leaves.append((float(node.prediction()) * weight, share, list(path)))
                return
            split, count = node.split(), node.impurityStats().rawCount()
            feature, threshold = split.featureIndex(), split.threshold()
            for child, low, high in ((node.leftChild(), -np.inf, threshold), (node.rightChild(), threshold, np.inf)):
                part = child.impurityStats().rawCount() / count
                walk(child, [*path, (feature, low, high, part)], share * part)

        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), [], 1.0)
        every.append(leaves)
    return every


def contributions(trees: list[list[tuple]], x: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of the rows of ``x``, and the expected prediction.

    For a leaf, features on its path either agree with the row (weight 1 or 0) or are averaged out (their share of cover). The Shapley
    sum over subsets is that of a polynomial's coefficients, multiplied out feature by feature for all rows at once.
    """
    out, expected = np.zeros(x.shape), 0.0
    for leaves in trees:
        for value, share, path in leaves:
            expected += scale * value * share
            zero: dict[int, float] = {}
            one: dict[int, np.ndarray] = {}
            for feature, low, high, part in path:
                zero[feature] = zero.get(feature, 1.0) * part
                inside = (x[:, feature] > low) & (x[:, feature] <= high)
                one[feature] = inside if feature not in one else one[feature] & inside
            features, m = list(zero), len(zero)
            for j in features:
                coefficients = [np.ones(len(x))]
                for k in features:
                    if k != j:
                        grown = [c * zero[k] for c in coefficients] + [np.zeros(len(x))]
                        for i, c in enumerate(coefficients):
                            grown[i + 1] = grown[i + 1] + c * one[k]
                        coefficients = grown
                weight = sum(c * (factorial(s) * factorial(m - s - 1) / factorial(m)) for s, c in enumerate(coefficients))
                out[:, j] += scale * value * (one[j] - zero[j]) * weight
    return out, expected


def shapley(df: DataFrame, model, inputs: Sequence[str], key: Sequence[str], mean_of_trees: bool = False) -> DataFrame:
    """Long contributions (key, variable, contribution) of each row and input, and the bias as expected in every row."""
    trees = tree_leaves(model)
    scale = 1 / sum(model.treeWeights) if mean_of_trees else 1.0
    shipped = df.sparkSession.sparkContext.broadcast(trees)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values, bias = contributions(shipped.value, part[list(inputs)].to_numpy("float64"), scale)
            made = pd.DataFrame(values, columns=list(inputs))
            for k in key:
                made[k] = part[k].to_numpy()
            made["expected"] = bias
            yield made.melt(id_vars=[*key, "expected"], var_name="variable", value_name="contribution")[[*key, "expected", "variable", "contribution"]]

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, *inputs).fillna(0.0, list(inputs)).mapInPandas(run, f"{kinds}, expected double, variable string, contribution double")


def shapley_ranking(values: DataFrame, n: int = 20) -> DataFrame:
    return values.groupBy("variable").agg(F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "variable").limit(n)


# Comparison of models.


def rashomon(board: DataFrame, factor: float = 4.0, score: str = "mae") -> DataFrame:
    """Models whose error is at most ``factor`` times the best."""
    return board.join(F.broadcast(board.agg(F.min(score).alias("_best")))).filter(F.col(score) <= F.col("_best") * factor).drop("_best")


def importance_matrix(importance: DataFrame, models: Sequence[str], each: int = 15, top: int = 20) -> DataFrame:
    """Importance by variable (rows) and model (columns) of what ranks high in any model, missing as 0, by descending mean."""
    w = W.partitionBy("model").orderBy(F.desc("importance"), "variable")
    high = importance.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each).select("variable").distinct()
    wide = importance.join(high, "variable", "left_semi").groupBy("variable").pivot("model", list(models)).agg(F.first("importance")).fillna(0.0, list(models))
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    return wide.withColumn("mean", mean).orderBy(F.desc("mean"), "variable").limit(top)


def normalised_importance(importance: DataFrame) -> DataFrame:
    return importance.withColumn("share", F.col("importance") / F.max("importance").over(W.partitionBy("model")))


def rank_stability(importance: DataFrame) -> DataFrame:
    """Descending rank of each variable in its model; ties share the mean of their ranks."""
    w = W.partitionBy("model").orderBy(F.desc("importance"))
    ties = F.count("*").over(W.partitionBy("model", "importance"))
    return importance.withColumn("rank", F.rank().over(w) + (ties - 1) / F.lit(2.0))


def linear(coefficients: dict[str, float], bias: float = 0.0) -> Column:
    """A fixed linear score as an expression."""
    return sum((F.col(c) * v for c, v in coefficients.items()), F.lit(bias))
