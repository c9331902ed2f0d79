"""Signals: series of samples per source, cut into frames, split, shuffled, batched, normalised, cropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions.columns import hash_normal, hash_uniform, layer_norm
from waveloom.operators.ranking import hash_rank


def split_sources(sources: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """(id, rank, split): sources in hash order, 80 / 10 / 10 hundredths cut by truncation."""
    ids = sources.select(id_col).distinct()
    ranked = hash_rank(ids, F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), id_col)
    n = ids.agg(F.count(F.lit(1)).alias("_n"))
    cut = lambda share: (F.col("_n") * share).cast("int")
    split = F.when(F.col("rank") < cut(0.8), "train").when(F.col("rank") < cut(0.9), "val").otherwise("test")
    return ranked.join(F.broadcast(n)).select(id_col, "rank", split.alias("split"))


def shuffle_order(df: DataFrame, *keys: str, seed: int = 42, epoch: int = 0, total: str | None = None) -> DataFrame:
    """``df`` with its place in the shuffled order of an epoch, and the number of rows as ``total`` if asked for."""
    return hash_rank(df, F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(k).cast("string") for k in keys]), *keys, name="place", total=total)


def frames(series: DataFrame, source: str, order: list[str], value: str, length: int, span: Column | None = None) -> DataFrame:
    """(source, frame, samples): each source's samples in order, cut every ``length``; the last may be
    short. span: a coarser column that never falls along the order, such as the day of a time. Samples are then numbered
    within their source and span and moved on by the counts of the spans before, so that no task holds a whole source;
    without it they are numbered by a window within their source."""
    kept = series.select(source, *order, F.col(value).cast("double").alias("x"), *([span.alias("_span")] if span is not None else []))
    by = [source] if span is None else [source, "_span"]
    placed = kept.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    if span is not None:
        # the counts are those of the numbered rows, with all their columns, so that both sides read one shuffle
        counts = placed.groupBy(*by).agg(F.max(F.struct("at", "x", *order)).alias("_last"))
        ahead = F.sum(F.col("_last.at") + 1).over(Window.partitionBy(source).orderBy("_span")) - F.col("_last.at") - 1
        first = counts.select(F.col(source).alias("_source"), F.col("_span").alias("_of"), ahead.alias("_first"))
        joined = placed.join(first, F.col(source).eqNullSafe(F.col("_source")) & F.col("_span").eqNullSafe(F.col("_of")))
        placed = joined.select(source, "x", (F.col("_first") + F.col("at")).alias("at"))
    cut = placed.withColumn("frame", F.expr(f"cast(at div {length} as int)"))
    held = cut.groupBy(source, "frame").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("held"))
    return held.select(source, "frame", F.transform("held", lambda h: h["x"]).alias("samples"))


def batches(df: DataFrame, size: int, place: str = "place", total: str | None = None) -> DataFrame:
    """Full batches of rows by place; the remainder is dropped, as nothing else fills it. total: a column with the number
    of rows, if places have no gaps; then a row tells by itself whether its batch is full."""
    numbered = df.withColumn("batch_id", F.expr(f"{place} div {size}"))
    if total:
        return numbered.where(F.col("batch_id") < F.expr(f"{total} div {size}")).drop(total)
    full = numbered.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select("batch_id")
    return numbered.join(full, "batch_id", "left_semi")


def normalise(samples: Column, epsilon: float = 1e-3) -> Column:
    return layer_norm(samples, epsilon)


def crop(samples: Column, length: int, *key, seed: int = 42, deterministic: bool = False) -> Column:
    """``length`` samples from a place that a hash of the key picks, or from the middle; of fewer samples,
    all."""
    room = F.greatest(F.size(samples) - length + 1, F.lit(1))
    at = F.floor((room - 1) / 2) if deterministic else F.floor(hash_uniform(seed, *key) * room)
    return F.slice(samples, at.cast("int") + 1, length)


def time_axis(df: DataFrame, samples: str = "samples", rate: float = 500.0) -> DataFrame:
    """A row per sample: pos, seconds, x."""
    keep = [c for c in df.columns if c != samples]
    return df.select(*keep, F.posexplode(samples).alias("pos", "x")).withColumn("seconds", F.col("pos") / F.lit(rate))


def pairs(df: DataFrame, column: str = "samples") -> DataFrame:
    """(input, target) of an autoencoder: the same column twice."""
    return df.withColumnRenamed(column, "x").withColumn("y", F.col("x"))


def add_noise(samples: Column, amplitude: float, *key, seed: int = 42) -> Column:
    """Augmenter: uniform noise of +-amplitude from a hash of key and place."""
    return F.transform(samples, lambda v, i: v + (hash_uniform(seed, *key, i) * 2 - 1) * amplitude)


def add_sine(samples: Column, amplitude: float, hertz: float, rate: float = 500.0) -> Column:
    """Augmenter: baseline wander or powerline hum."""
    return F.transform(samples, lambda v, i: v + F.lit(amplitude) * F.sin(i * (6.283185307179586 * hertz / rate)))


def scale_amplitude(samples: Column, spread: float, *key, seed: int = 42) -> Column:
    """Augmenter: one factor around 1 for the frame."""
    return F.transform(samples, lambda v: v * (1 + (hash_uniform(seed, *key) * 2 - 1) * spread))


def cut_out(samples: Column, length: int, *key, seed: int = 42) -> Column:
    """Augmenter: zeros over a stretch."""
    at = F.floor(hash_uniform(seed, *key) * (F.size(samples) - length + 1))
    return F.transform(samples, lambda v, i: F.when((i >= at) & (i < at + length), 0.0).otherwise(v))


# ------------------------------------------------------------------ augmenters whose parameters are drawn for each frame


def drawn(bounds: tuple[float, float], *parts, seed: int = 42) -> Column:
    """A number between the bounds, by a hash."""
    return F.lit(bounds[0]) + hash_uniform(seed, *parts) * (bounds[1] - bounds[0])


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once for the row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def curve(size: Column, point, frequency: Column, rate: float) -> Column:
    """``size`` numbers of a curve through control points at a frequency, straight between them. point(j): the j-th."""
    last = F.floor((size - 1) * frequency / rate).cast("int") + 1
    points = F.transform(F.sequence(F.lit(0), last), point)

    def at(i, held):
        place = i * frequency / F.lit(rate)
        j = F.floor(place).cast("int")
        return F.get(held, j) + (F.get(held, j + 1) - F.get(held, j)) * (place - j)

    return _once(points, lambda held: F.transform(F.sequence(F.lit(0), size - 1), lambda i: at(i, held)))


def warp_amplitude(samples: Column, amplitude: tuple[float, float], frequency: tuple[float, float], rate: float, *key, seed: int = 42) -> Column:
    """Augmenter: factors between the bounds at control points of a drawn frequency, interpolated over the frame."""
    factors = curve(F.size(samples), lambda j: drawn(amplitude, *key, "factor", j, seed=seed), drawn(frequency, *key, "frequency", seed=seed), rate)
    return F.zip_with(samples, factors, lambda v, a: v * a)


def add_wander(samples: Column, amplitude: tuple[float, float], frequency: tuple[float, float], rate: float, *key, seed: int = 42) -> Column:
    """Augmenter: baseline wander, a curve through points of +-1 at a drawn frequency, by a drawn amplitude."""
    noise = curve(F.size(samples), lambda j: drawn((-1.0, 1.0), *key, "point", j, seed=seed), drawn(frequency, *key, "frequency", seed=seed), rate)
    return _once(drawn(amplitude, *key, "amplitude", seed=seed), lambda a: F.zip_with(samples, noise, lambda v, n: v + a * n))


def add_random_sine(samples: Column, amplitude: tuple[float, float], frequency: tuple[float, float], rate: float, *key, seed: int = 42) -> Column:
    """Augmenter: hum of a drawn amplitude, frequency and phase."""
    wave = F.struct(drawn(amplitude, *key, "amplitude", seed=seed).alias("a"), drawn(frequency, *key, "frequency", seed=seed).alias("f"), hash_uniform(seed, *key, "phase").alias("p"))
    return _once(wave, lambda w: F.transform(samples, lambda v, i: v + w["a"] * F.sin(F.lit(2 * math.pi) * (i * w["f"] / rate + w["p"]))))


def add_gaussian_noise(samples: Column, deviation: tuple[float, float], *key, seed: int = 42) -> Column:
    """Augmenter: normal noise, its standard deviation drawn for the frame."""
    return _once(drawn(deviation, *key, "deviation", seed=seed), lambda d: F.transform(samples, lambda v, i: v + d * hash_normal(seed, *key, i)))


def add_background(frames: DataFrame, noises: DataFrame, amplitude: tuple[float, float], picks: int, *key: str, seed: int = 42, samples: str = "samples") -> DataFrame:
    """Augmenter: to each frame ``picks`` series of ``noises`` (place, samples), each from a drawn place on, as loud as an
    amplitude that is drawn too; a series that ends begins anew. Places are 0 to n - 1, as of :func:`shuffle_order`.
    A frame knows its picks by hashes and finds them by an equi-join; noises that frames share are read by the tasks that
    need them, and are broadcast only where Spark finds them small. No noises leave the frames as they are."""
    keys = [F.col(k) for k in key]
    n = noises.agg(F.count(F.lit(1)).alias("_n"))
    out = frames.join(F.broadcast(n))
    for i in range(picks):
        pick = F.floor(hash_uniform(seed, *keys, "pick", i) * F.col("_n")).cast("long")
        own = noises.select(F.col("place").alias("_place"), F.col(samples).alias("_noise"))
        out = out.withColumn("_pick", pick).join(own, F.col("_pick") == F.col("_place"), "left")
        size = F.size("_noise")
        begin = F.floor(hash_uniform(seed, *keys, "begin", i) * size).cast("int")
        mixed = _once(F.struct(drawn(amplitude, *keys, "amplitude", i, seed=seed).alias("a"), begin.alias("b")), lambda w: F.transform(samples, lambda v, t: v + w["a"] * F.get("_noise", (w["b"] + t) % size)))
        out = out.withColumn(samples, F.when(size > 0, mixed).otherwise(F.col(samples))).drop("_pick", "_place", "_noise")
    return out.drop("_n")
