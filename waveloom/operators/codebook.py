"""Codebooks: tables (code, vec), a few thousand numbers that fit a broadcast row."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.functions.columns import hash_uniform, squared_distance

#: Numbers that a codebook may hold: 32 MB as doubles.
MOST_NUMBERS = 4_000_000


def uniform_rows(codes: DataFrame, dim: int, bound: float, seed: int = 42, level: int = 1) -> DataFrame:
    """``codes`` (code) with vec: uniform in +-bound, from hashes of seed, level, code and place."""
    value = lambda d: (hash_uniform(seed, level, F.col("code"), d) * 2 - 1) * bound
    return codes.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value))


def uniform_init(spark: SparkSession, codes: int, dim: int, seed: int = 42, level: int = 1, bound: float | None = None) -> DataFrame:
    """(code, vec) of ``codes`` codes: uniform in +-bound (+-1 / codes)."""
    return uniform_rows(spark.range(codes).select(F.col("id").cast("int").alias("code")), dim, 1.0 / codes if bound is None else bound, seed, level)


def from_tokens(tokens: DataFrame, first: int, codes: int, scale: float = 1.0) -> DataFrame:
    """(code, vec) from ``codes`` tokens on from number ``first``."""
    picked = tokens.where((F.col("tok") >= first) & (F.col("tok") < first + codes))
    return picked.select((F.col("tok") - first).cast("int").alias("code"), F.transform("z", lambda v: v * scale).alias("vec"))


def as_row(codebook: DataFrame, name: str = "codebook") -> DataFrame:
    """One row with the vectors in code order, to be broadcast; fails beyond MOST_NUMBERS."""
    held = codebook.agg(F.sort_array(F.collect_list(F.struct("code", "vec"))).alias("held"))
    size = F.size("held") * F.size(F.col("held")[0]["vec"])
    vectors = F.transform("held", lambda h: h["vec"])
    return held.select(F.when(size > MOST_NUMBERS, F.raise_error(F.lit("the codebook is too large to broadcast"))).otherwise(vectors).alias(name))


def attach(df: DataFrame, **codebooks: DataFrame) -> DataFrame:
    """``df`` with each codebook as a column: one broadcast row each, no shuffle."""
    for name, table in codebooks.items():
        df = df.join(F.broadcast(as_row(table, name)))
    return df


def as_array(codebook: DataFrame) -> np.ndarray:
    """The vectors in code order, as many as a broadcast row may hold."""
    return np.array(as_row(codebook).first().codebook)


def gradient(assigned: DataFrame, codebook: DataFrame, dim: int) -> DataFrame:
    """(code, dim, e, grad) of the codebook loss: 2 / (N D) (n e - sum of tokens), from one grouping of
    (z, code) rows by code and dimension."""
    n = assigned.agg(F.count(F.lit(1)).alias("n_all"))
    sums = assigned.select("code", F.posexplode("z").alias("dim", "v")).groupBy("code", "dim").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    cells = codebook.select("code", F.posexplode("vec").alias("dim", "e"))
    grad = F.lit(2.0) / (F.col("n_all") * dim) * (F.coalesce("n", F.lit(0)) * F.col("e") - F.coalesce("s", F.lit(0.0)))
    return cells.join(sums, ["code", "dim"], "left").join(F.broadcast(n)).select("code", "dim", "e", grad.alias("grad"))


def sgd_step(assigned: DataFrame, codebook: DataFrame, dim: int, rate: float) -> DataFrame:
    """The codebook after one step down its gradient."""
    moved = gradient(assigned, codebook, dim).select("code", F.struct("dim", (F.col("e") - F.lit(rate) * F.col("grad")).alias("e")).alias("cell"))
    return moved.groupBy("code").agg(F.transform(F.sort_array(F.collect_list("cell")), lambda c: c["e"]).alias("vec"))


def adam_step(state: DataFrame, gradients: DataFrame, step: int, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, epsilon: float = 1e-7, keys: tuple[str, ...] = ("code", "dim")) -> DataFrame:
    """One Adam update of (keys, e, m, v) by (keys, grad)."""
    joined = state.join(gradients.select(*keys, "grad"), list(keys))
    m = F.col("m") * b1 + F.col("grad") * (1 - b1)
    v = F.col("v") * b2 + F.col("grad") * F.col("grad") * (1 - b2)
    alpha = rate * math.sqrt(1 - b2**step) / (1 - b1**step)
    return joined.select(*keys, (F.col("e") - alpha * m / (F.sqrt(v) + epsilon)).alias("e"), m.alias("m"), v.alias("v"))


def kmeans_init(tokens: DataFrame, codes: int, seed: int = 42) -> DataFrame:
    """(code, vec) by k-means, an initialisation that looks at the data."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=codes, seed=seed, featuresCol="features").fit(tokens.select(array_to_vector("z").alias("features")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return tokens.sparkSession.createDataFrame(rows, "code int, vec array<double>")


def nearest_codes(codebook: DataFrame) -> DataFrame:
    """(code, other, dist): each codeword's nearest other codeword, to find collapsed codes."""
    a, b = codebook.alias("a"), codebook.alias("b")
    joined = a.join(F.broadcast(b), F.col("a.code") != F.col("b.code"))
    best = F.min(F.struct(squared_distance(F.col("a.vec"), F.col("b.vec")).alias("dist"), F.col("b.code").alias("other")))
    return joined.groupBy(F.col("a.code").alias("code")).agg(best.alias("m")).select("code", "m.other", "m.dist")
