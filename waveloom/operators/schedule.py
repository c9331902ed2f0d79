"""Schedules over an epoch column, and what a training history (epoch, loss, val_loss) says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions.columns import anneal, cosine_decay


def temperatures(df: DataFrame, start: float, end: float, epochs: int, mode: str = "cosine") -> DataFrame:
    return df.withColumn("temperature", anneal(F.col("epoch"), start, end, epochs, mode))


def learning_rates(df: DataFrame, start: float, steps: int) -> DataFrame:
    return df.withColumn("rate", cosine_decay(F.col("step"), start, steps))


#: Epochs of a run that are taken in order by one task; runs of any length are as many such stretches.
STRETCH = 4096


def before_in_run(history: DataFrame, value: Column, name: str, run: str, lowest: bool = True) -> DataFrame:
    """``history`` with the least (or greatest) ``value`` of the epochs of its run before each: those of its own stretch
    by a window, those of the stretches before by a window over one row a stretch."""
    pick, join = (F.min, F.least) if lowest else (F.max, F.greatest)
    cut = history.withColumn("_value", value).withColumn("_stretch", F.expr(f"epoch div {STRETCH}"))
    whole = cut.groupBy(run, "_stretch").agg(pick("_value").alias("_all"))
    ahead = Window.partitionBy(run).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.select(F.col(run).alias("_run"), F.col("_stretch").alias("_of"), pick("_all").over(ahead).alias("_earlier"))
    within = pick("_value").over(Window.partitionBy(run, "_stretch").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    joined = cut.withColumn("_within", within).join(earlier, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_stretch") == F.col("_of")))
    return joined.withColumn(name, join("_within", "_earlier")).drop("_value", "_stretch", "_within", "_run", "_of", "_earlier")


def early_stopping(history: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch) of histories (run, epoch, val_loss): training stops once
    ``patience`` epochs in a row are no better than the best before them; stop_epoch is null if none is."""
    marked = before_in_run(history, F.col("val_loss"), "before", run)
    better = F.when(F.col("before").isNull() | (F.col("val_loss") < F.col("before")), F.col("epoch"))
    last = before_in_run(marked.withColumn("better", better), F.col("better"), "last_before", run, lowest=False).withColumn("last_better", F.coalesce("better", "last_before"))
    stop = last.groupBy(run).agg(F.min(F.when(F.col("epoch") - F.col("last_better") >= patience, F.col("epoch"))).alias("stop_epoch"))
    seen = history.join(stop, run).where("stop_epoch is null or epoch <= stop_epoch")
    best = seen.groupBy(run).agg(F.min(F.struct("val_loss", "epoch")).alias("b"), F.first("stop_epoch").alias("stop_epoch"))
    return best.select(run, F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("best_loss"), "stop_epoch")


def checkpoints(history: DataFrame, run: str = "run") -> DataFrame:
    """(run, epoch, val_loss) of the epochs that a best-only checkpoint writes."""
    return before_in_run(history, F.col("val_loss"), "before", run).where("before is null or val_loss < before").select(run, "epoch", "val_loss")


def best_checkpoint(history: DataFrame, run: str = "run") -> DataFrame:
    """(run, epoch, val_loss) of the lowest loss, the first of equals."""
    best = history.groupBy(run).agg(F.min(F.struct("val_loss", "epoch")).alias("b"))
    return best.select(run, F.col("b.epoch").alias("epoch"), F.col("b.val_loss").alias("val_loss"))
