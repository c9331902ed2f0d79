"""Statistics of codes: histogram, entropy, perplexity, usage; by batch, then averaged, or over all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions.columns import EPSILON, entropy

LN2 = math.log(2)


def histogram(codes: DataFrame, *by: str) -> DataFrame:
    """(by, code, n): counted map-side, a row per code."""
    return codes.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))


def code_stats(codes: DataFrame, sizes: int | Column, *by: str) -> DataFrame:
    """(by, entropy_bits, perplexity, usage) per group. sizes: the number of codes there are."""
    return histogram_stats(histogram(codes, *by), sizes, *by)


def histogram_stats(counts: DataFrame, sizes: int | Column, *by: str) -> DataFrame:
    """The same of histograms (by, code, n)."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n_all")) if by else counts.agg(F.sum("n").alias("n_all"))
    joined = counts.join(totals, list(by)) if by else counts.join(F.broadcast(totals))
    p = F.col("n") / F.col("n_all")
    bits = -F.sum(p * F.ln(p + EPSILON)) / LN2
    grouped = joined.groupBy(*by).agg(bits.alias("entropy_bits"), F.count(F.lit(1)).alias("used"))
    size = F.lit(sizes) if isinstance(sizes, int) else sizes
    return grouped.select(*by, "entropy_bits", F.exp(F.col("entropy_bits") * LN2).alias("perplexity"), (F.col("used") / size).alias("usage"))


def batch_mean(codes: DataFrame, sizes: int | Column, *by: str, batch: str = "batch_id") -> DataFrame:
    """Means over batches of each batch's statistics, every batch with one weight."""
    per = code_stats(codes, sizes, *by, batch)
    means = [F.avg(c).alias(c) for c in ("entropy_bits", "perplexity", "usage")]
    return per.groupBy(*by).agg(*means) if by else per.agg(*means)


def kl_bits(posteriors: DataFrame, codes: int, *by: str) -> DataFrame:
    """(by, kl_bits): log2 of the codes less the mean token entropy in bits."""
    value = (F.lit(math.log(codes)) - F.avg(entropy(F.col("p")))) / LN2
    return posteriors.groupBy(*by).agg(value.alias("kl_bits")) if by else posteriors.agg(value.alias("kl_bits"))
