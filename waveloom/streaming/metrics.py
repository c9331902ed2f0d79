"""Running metrics of a stream of reconstructions, reset at every epoch.

The state of a metric is a sum that merges: every micro-batch adds its partial sums by (epoch, batch) and by code as a
small table of its own, written under the micro-batch's number, so one that is run again after a failure replaces
itself. What the metrics are at any time is read off the sums of all tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waveloom.functions.columns import dot, squared_distance
from waveloom.operators import stats

SCHEMA = "epoch long, batch_id long, metric string, level int, code int, value double, weight double"
CODES = "codes"


def base_metrics() -> dict[str, tuple[Column, Column]]:
    """(value, weight) of a row for each metric: the metric is the sum of values by the sum of weights."""
    norm = F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("y"), F.col("y")))
    return {"mse": (squared_distance(F.col("x"), F.col("y")), F.size("x").cast("double")), "cosine": (F.when(norm > 0, dot(F.col("x"), F.col("y")) / norm).otherwise(0.0), F.lit(1.0))}


def partial_sums(rows: DataFrame, extra: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Sums of rows (epoch, batch_id, x, y, codes) in the form of SCHEMA: metrics by batch, and the number of each code by
    batch and level. Summed map-side, a row per batch and metric or code."""
    metrics = base_metrics() | (extra or {})
    values = [F.struct(F.lit(n).alias("metric"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("code"), v.cast("double").alias("value"), w.cast("double").alias("weight")) for n, (v, w) in metrics.items()]
    codes = F.transform("codes", lambda c, i: F.struct(F.lit(CODES).alias("metric"), (i + 1).alias("level"), c.cast("int").alias("code"), F.lit(1.0).alias("value"), F.lit(1.0).alias("weight")))
    each = rows.select(F.col("epoch").cast("long").alias("epoch"), F.col("batch_id").cast("long").alias("batch_id"), F.explode(F.concat(F.array(*values), codes)).alias("m")).select("epoch", "batch_id", "m.*")
    return each.groupBy("epoch", "batch_id", "metric", "level", "code").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))


def accumulate(stream: DataFrame, path: str, checkpoint: str, extra: dict[str, tuple[Column, Column]] | None = None, **trigger) -> StreamingQuery:
    """Begin to add a stream of rows (epoch, batch_id, x, y, codes) to the state under ``path``."""

    def add(rows: DataFrame, number: int) -> None:
        partial_sums(rows, extra).write.mode("overwrite").parquet(f"{path}/micro={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/micro=*")


def metrics(sums: DataFrame, sizes: list[int]) -> DataFrame:
    """(epoch, metric, level, value) of sums in the form of SCHEMA. Metrics of reconstructions are means over the epoch's
    rows (level is null); entropy, perplexity and usage are means over its batches, by level. sizes: codes of each level."""
    rows = sums.where(F.col("metric") != CODES).groupBy("epoch", "metric").agg((F.sum("value") / F.sum("weight")).alias("value"))
    counts = sums.where(F.col("metric") == CODES).groupBy("epoch", "batch_id", "level", "code").agg(F.sum("value").alias("n"))
    size = F.element_at(F.array(*[F.lit(k) for k in sizes]), F.col("level"))
    by_batch = stats.histogram_stats(counts, size, "epoch", "level", "batch_id")
    names = ("entropy_bits", "perplexity", "usage")
    means = by_batch.groupBy("epoch", "level").agg(*[F.avg(n).alias(n) for n in names])
    long = means.select("epoch", "level", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("epoch", "m.metric", "level", "m.value")
    return rows.select("epoch", "metric", F.lit(None).cast("int").alias("level"), "value").unionByName(long)
