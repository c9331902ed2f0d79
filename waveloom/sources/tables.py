"""Sources and sinks: signals, histories, parameter tables."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(patient_id, lead, samples) of files of (lead, samples), one file per person: the name of the file
    is the person."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(path)
    person = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return df.select(person.alias("patient_id"), "lead", F.col("samples").cast("array<float>").alias("samples"))


def write_history(history: DataFrame, path: str) -> None:
    """A row per epoch, as CSV with a header."""
    history.write.mode("append").option("header", True).csv(path)


def read_history(spark: SparkSession, path: str, schema: str = "epoch int, loss double, val_loss double") -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def save_parameters(codebooks: list[DataFrame], config, path: str) -> None:
    """A checkpoint: codebooks as a table by level, the configuration as JSON beside them."""
    spark = codebooks[0].sparkSession
    table = None
    for level, codebook in enumerate(codebooks, 1):
        rows = codebook.select(F.lit(level).alias("level"), "code", "vec")
        table = rows if table is None else table.unionByName(rows)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
    spark.createDataFrame([(json.dumps(asdict(config)),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")


def load_parameters(spark: SparkSession, path: str, kind: type):
    """(codebooks, config) of a checkpoint."""
    values = json.loads(spark.read.parquet(f"{path}/config").first().config)
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    table = spark.read.parquet(f"{path}/codebooks")
    levels = sorted(r.level for r in table.select("level").distinct().collect())  # a row per level
    return [table.where(F.col("level") == n).select("code", "vec") for n in levels], kind(**values)


def save_weights(spark: SparkSession, weights, path: str) -> None:
    """Encoder and decoder: a row per parameter (name, shape, numbers)."""
    rows = [(name, [int(n) for n in v.shape], [float(x) for x in v.ravel()]) for name, v in sorted(weights.values.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


def load_weights(spark: SparkSession, path: str):
    """The reverse; parameters are as many as the model has, whatever the data."""
    import numpy as np

    from waveloom.operators.nn import Weights

    return Weights({r.name: np.array(r.numbers).reshape(r.shape) for r in spark.read.parquet(f"{path}/weights").collect()})
