"""Reading and writing of series, labels, results and fitted parameters.

Schemas are declared, never inferred: a time column and value columns. NaN in a source becomes NULL at once, since Spark's
averages and maxima would otherwise carry it along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def without_nan(df: DataFrame) -> DataFrame:
    """Floating-point columns with NULL in place of NaN."""
    real = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns])


def read_mts(spark: SparkSession, path: str, values: Sequence[str], time_col: str = "ts", kind: str = "csv") -> DataFrame:
    """A wide table whose first column is the time: ``ts`` and the value columns as doubles."""
    if kind == "csv":
        schema = StructType.fromDDL(", ".join([f"`{time_col}` string", *(f"`{v}` double" for v in values)]))
        raw = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    else:
        raw = spark.read.format(kind).load(path)
    return without_nan(raw.select(F.col(time_col).cast("timestamp").alias("ts"), *[F.col(v).cast("double").alias(v) for v in values]))


def read_splits(spark: SparkSession, paths: Sequence[str], values: Sequence[str], time_col: str = "time", kind: str = "csv") -> DataFrame:
    """Train, validation and test parts in this order, tagged by ``split_rank``."""
    parts = [read_mts(spark, p, values, time_col, kind).withColumn("split_rank", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_labels(spark: SparkSession, path: str, values: Sequence[str], time_col: str = "ts", kind: str = "csv") -> DataFrame:
    """A wide table of 0/1 labels as (ts, channel, label)."""
    wide = read_mts(spark, path, values, time_col, kind)
    return wide.unpivot("ts", list(values), "channel", "label").withColumn("label", F.col("label").cast("int"))


def write_detection(frame: DataFrame, latent: DataFrame | None, path: str, kind: str = "parquet") -> None:
    """The detector's tables: one long table (ts, channel, pred, score, recon, sigma), and the latent series."""
    frame.select("ts", "channel", "pred", "score", "recon", "sigma").write.format(kind).mode("overwrite").save(f"{path}/detection")
    if latent is not None:
        latent.write.format("parquet").mode("overwrite").save(f"{path}/latent")


def write_results(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Named result tables (forecasts, metrics, leaderboards, ...), each in a folder of its name."""
    for name, df in tables.items():
        df.write.format(kind).mode("overwrite").save(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, names: Sequence[str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {name: spark.read.format(kind).load(f"{path}/{name}") for name in names}


def save_state(state: DataFrame, path: str) -> None:
    """Fitted parameters (scalers, alphas, network weights) as a parquet table."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    """A fitted Spark model (or pipeline of them) with its settings."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """What ``save_model`` wrote, as the class that it was."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
