"""Batches of an epoch: dealt to tasks that step through all of them together, or written once so that a step reads its
own files only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.sources import shared

#: Folders of an epoch. With more batches than that a folder holds a run of them, in order within its files, and a step
#: skips row groups by their least and greatest batch.
FOLDERS = 1000


@dataclass(frozen=True)
class Batches:
    """Full batches of ``size`` rows; the remainder is dropped."""

    path: str
    schema: T.StructType
    size: int
    total: int
    run: int

    def read(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/folder={batch // self.run}").where(F.col("batch_id") == batch)

    def delete(self, spark: SparkSession) -> None:
        shared.delete(spark, self.path)


def write_batches(placed: DataFrame, rows: int, size: int, tasks: int | None = None, place: str = "place") -> Batches:
    """``placed`` (rows with their place from 0 in the epoch's order) by batch, in one shuffle. rows: how many there are.
    A batch is dealt over ``tasks`` files, as many tasks read it."""
    spark, total = placed.sparkSession, rows // size
    if total < 1:
        raise ValueError("fewer rows than a batch")
    run = -(-total // FOLDERS)
    tasks = max(1, min(tasks or spark.sparkContext.defaultParallelism, size))
    numbered = placed.where(F.col(place) < total * size).withColumn("batch_id", F.expr(f"{place} div {size}"))
    cut = numbered.withColumn("folder", F.expr(f"batch_id div {run}")).withColumn("_file", F.expr(f"cast({place} % {tasks} as int)"))
    dealt = cut.repartition("folder", "_file").sortWithinPartitions("folder", "batch_id", place).drop("_file")
    path = shared.fresh_path(spark, "batches")
    dealt.write.partitionBy("folder").parquet(path)
    return Batches(path, T.StructType([f for f in dealt.schema.fields if f.name != "folder"]), size, total, run)


def deal_batches(placed: DataFrame, rows: int, size: int, tasks: int, place: str = "place") -> DataFrame:
    """``placed`` (rows with their place from 0 in the epoch's order) with batch_id, in ``tasks`` partitions: each has its
    share of every full batch, batch after batch; the remainder is dropped."""
    numbered = placed.where(F.col(place) < rows // size * size).withColumn("batch_id", F.expr(f"{place} div {size}"))
    return numbered.repartitionById(tasks, F.expr(f"cast({place} % {tasks} as int)")).sortWithinPartitions("batch_id", place)
