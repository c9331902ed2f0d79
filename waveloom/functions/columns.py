"""Column expressions over vectors held as ``array<double>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added inside logarithms of probabilities.
EPSILON = 1e-10


def hash_uniform(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons: the same on any partitioning."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def hash_normal(*parts) -> Column:
    """A standard normal number from two hashes of the parts, by Box and Muller's transform."""
    return F.sqrt(-2 * F.ln(1 - hash_uniform(*parts, "radius"))) * F.cos(F.lit(2 * math.pi) * hash_uniform(*parts, "angle"))


#: Terms of the series of the error function, and where it is 1 in doubles.
ERF_TERMS, ERF_END = 120, 6.0


def erf(x: Column) -> Column:
    """The error function: exp(-x^2) times the sum of x^(2n+1) / gamma(n + 3/2), whose terms have one sign, so nothing
    cancels."""
    terms = F.array(*[F.lit(math.exp(-math.lgamma(n + 1.5))) for n in range(ERF_TERMS, -1, -1)])
    series = F.aggregate(terms, F.lit(0.0), lambda a, c: a * (x * x) + c)
    return F.when(F.abs(x) >= ERF_END, F.signum(x)).otherwise(F.exp(-x * x) * x * series)


def gelu(x: Column) -> Column:
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def checked(z: Column, dim: int) -> Column:
    """``z``, or an error if it has another length or a null: a padded distance would be null and win."""
    bad = z.isNull() | (F.size(z) != dim) | F.exists(z, lambda v: v.isNull())
    return F.when(bad, F.raise_error(F.lit(f"a vector is not of {dim} numbers"))).otherwise(z)


def nearest(z: Column, codebook: Column) -> Column:
    """struct(dist, code, vec) of the nearest codeword; of equals the first."""
    return F.array_min(F.transform(codebook, lambda e, i: F.struct(squared_distance(z, e).alias("dist"), i.alias("code"), e.alias("vec"))))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    scaled = F.transform(logits, lambda v: v / F.lit(temperature))
    powers = lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(F.array(powers(scaled)), lambda e: F.transform(e, lambda v: v / total(e)))[0]


def entropy(p: Column) -> Column:
    """In nats."""
    return -total(F.transform(p, lambda v: v * F.ln(v + EPSILON)))


def layer_norm(x: Column, epsilon: float) -> Column:
    """(x - mean) / sqrt(population variance + epsilon)."""
    mean = lambda v: total(v) / F.size(v)
    centred = F.transform(F.array(mean(x)), lambda m: F.transform(x, lambda v: v - m))[0]
    return F.transform(F.array(F.sqrt(mean(F.transform(centred, lambda v: v * v)) + epsilon)), lambda s: F.transform(centred, lambda v: v / s))[0]


def cosine_decay(step: Column, start: float, steps: int) -> Column:
    t = F.least(step, F.lit(steps)) / F.lit(float(max(1, steps)))
    return F.lit(0.5 * start) * (1 + F.cos(F.lit(math.pi) * t))


def anneal(epoch: Column, start: float, end: float, epochs: int, mode: str = "cosine") -> Column:
    """Temperature of an epoch: cosine or exponential from start to end, then constant."""
    if mode not in ("cosine", "exp") or start <= 0:
        raise ValueError("mode is cosine or exp, start above 0")
    t = F.least(epoch, F.lit(epochs)) / F.lit(float(max(1, epochs)))
    if mode == "cosine":
        return F.lit(end) + F.lit(0.5 * (start - end)) * (1 + F.cos(F.lit(math.pi) * t))
    return F.lit(start) * F.pow(F.lit(end / start), t)
