"""Distortion and rate of reconstructions (x, y arrays of the same length)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions.columns import dot, squared_distance, total


def mse() -> Column:
    return F.sum(squared_distance(F.col("x"), F.col("y"))) / F.sum(F.size("x"))


def weighted_mse(weight: Column) -> Column:
    return F.sum(weight * squared_distance(F.col("x"), F.col("y")) / F.size("x")) / F.sum(weight)


def cosine() -> Column:
    """Mean over rows of the cosine of x and y; 0 where one of them is 0."""
    norm = F.sqrt(dot(F.col("x"), F.col("x"))) * F.sqrt(dot(F.col("y"), F.col("y")))
    return F.avg(F.when(norm > 0, dot(F.col("x"), F.col("y")) / norm).otherwise(0.0))


def _steps(v: Column) -> Column:
    n = F.size(v) - 1
    return F.zip_with(F.slice(v, 2, n), F.slice(v, 1, n), lambda b, a: b - a)


def derivative_loss(weight: float = 0.2) -> Column:
    """weight times the mean absolute difference of first differences."""
    gaps = F.zip_with(_steps(F.col("x")), _steps(F.col("y")), lambda a, b: F.abs(a - b))
    return F.lit(weight) * F.sum(total(gaps)) / F.sum(F.size("x") - 1)


def prd_percent() -> Column:
    """100 sqrt(mse), without division by the signal's energy."""
    return 100 * F.sqrt(mse())


def prd_normalised() -> Column:
    """100 sqrt(sum of squared errors / energy of x)."""
    return 100 * F.sqrt(F.sum(squared_distance(F.col("x"), F.col("y"))) / F.sum(dot(F.col("x"), F.col("x"))))


def total_loss(recon: DataFrame, extra: Sequence[Callable[[], Column]] = (), layers: Sequence[Column] = ()) -> DataFrame:
    """One row: reconstruction loss, extra losses and layer losses, and their sum, in one aggregation of (x, y, ...).
    layers: aggregates over the same rows."""
    df = recon.agg(mse().alias("recon"), sum((f() for f in extra), F.lit(0.0)).alias("extra"), sum(layers, F.lit(0.0)).alias("layer"))
    return df.withColumn("loss", F.col("recon") + F.col("extra") + F.col("layer"))


def contrastive_loss(pairs: DataFrame, temperature: float = 0.1) -> DataFrame:
    """SimCLR within batches: pairs (batch_id, item, a, b) of two unit views; a bounded batch is joined
    with itself, never one with another."""
    both = pairs.select("batch_id", (F.col("item") * 2).alias("i"), F.col("a").alias("v")).unionByName(pairs.select("batch_id", (F.col("item") * 2 + 1).alias("i"), F.col("b").alias("v")))
    left, right = both.alias("l"), both.alias("r")
    joined = left.join(right, (F.col("l.batch_id") == F.col("r.batch_id")) & (F.col("l.i") != F.col("r.i")))
    s = dot(F.col("l.v"), F.col("r.v")) / temperature
    partner = F.floor(F.col("l.i") / 2) == F.floor(F.col("r.i") / 2)
    per = joined.groupBy(F.col("l.batch_id"), F.col("l.i")).agg((F.ln(F.sum(F.exp(s))) - F.max(F.when(partner, s))).alias("loss"))
    return per.agg(F.avg("loss").alias("loss"))


def rate_report(levels: int, codes: int, tokens_per_frame: int, frame_samples: int, rate_hz: float, sample_bits: int = 16) -> dict[str, float]:
    """Fixed-length rate of a frame: bits, bits a second, and the ratio to plain samples."""
    bits = tokens_per_frame * levels * max(1, (codes - 1).bit_length())
    return {"bits_per_frame": float(bits), "bits_per_second": bits / (frame_samples / rate_hz), "ratio": frame_samples * sample_bits / bits}
