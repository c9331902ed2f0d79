"""Codec plans: frames to latents to codes and back, with the wrappers' losses and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions.columns import hash_uniform
from waveloom.operators import backprop, nn, quality, quantize, stats
from waveloom.operators.codebook import as_array, attach


@dataclass
class RVQCodec:
    """Encoder, residual quantizer, decoder."""

    config: quantize.RVQConfig
    weights: nn.Weights
    codebooks: list[DataFrame]

    def encode(self, frames: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, pos, z, codes, dists, y)."""
        return quantize.rvq_encode(nn.encode_frames(frames, self.weights, keys), self.codebooks, self.config.embedding_dim)

    def decode(self, codes: DataFrame, keys: list[str], levels: int | None = None) -> DataFrame:
        """(keys, samples) of (keys, pos, codes)."""
        return nn.decode_frames(quantize.rvq_decode(codes.select(*keys, "pos", "codes"), self.codebooks, levels), self.weights, keys)

    def round_trip(self, frames: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, x, y): frames and their reconstructions. A frame is encoded, quantized and decoded where it stands."""
        books = {f"codebook{i}": as_array(b) for i, b in enumerate(self.codebooks, 1)}
        return rebuilt(frames, keys, nn.Weights(self.weights.values | books), backprop.Residual(self.config))


def rebuilt(frames: DataFrame, keys: list[str], weights: nn.Weights, bottleneck: backprop.Bottleneck, noise: Column | None = None) -> DataFrame:
    """(keys, x, y) of frames (keys, samples) in one pass without a shuffle. noise: an array of numbers per token."""
    shared, noisy = frames.sparkSession.sparkContext.broadcast(weights), noise is not None

    def run(batches):
        w = shared.value

        def through(x, more):
            z = nn.encode(x, w)
            return nn.decode(bottleneck.forward(z, w, {}, z.shape[0] * z.shape[1], more)[0], w)

        for batch in batches:
            if batch.num_rows:
                x = nn.stacked(batch.column("x"))
                more = nn.stacked(batch.column("_noise"), 2) if noisy else None
                n = max(1, nn.NUMBERS // max(1, x.shape[1]))
                y = np.concatenate([through(x[i : i + n], None if more is None else more[i : i + n]) for i in range(0, len(x), n)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("x"), nn.nested(y)], [*keys, "x", "y"])

    held = frames.select(*keys, F.col("samples").alias("x"), *([noise.alias("_noise")] if noisy else []))
    return held.mapInArrow(run, nn.fields(held, [*keys, "x"]) + ", y array<double>")


def vq_codec(config: quantize.VQConfig, weights: nn.Weights, codebook: DataFrame) -> RVQCodec:
    """One level is the plain quantizer."""
    return RVQCodec(quantize.RVQConfig(1, config.num_embeddings, config.embedding_dim, config.beta), weights, [codebook])


@dataclass
class GumbelCodec:
    """Encoder, Gumbel-softmax bottleneck, decoder."""

    config: quantize.GSConfig
    weights: nn.Weights
    projection: DataFrame | None
    embedding: DataFrame
    bias: Callable[[Column], Column] | None = None

    def bottleneck(self, tokens: DataFrame, noise_seed: int | None = None) -> DataFrame:
        """tokens (…, tok, z) with p, code and y."""
        c = self.config
        scored = tokens.withColumn("logits", F.col("z")) if c.input_is_logits else quantize.logits(tokens, self.projection, self.bias if c.use_bias else None)
        soft = quantize.posteriors(scored, c.temperature, noise_seed)
        held = attach(soft, _emb=self.embedding)
        y = quantize.expected_embedding(F.col("p"), F.col("_emb"), c.embedding_dim)
        return held.withColumn("code", quantize.hard_index(F.col("p"))).withColumn("y", y).drop("_emb", "logits")

    def round_trip(self, frames: DataFrame, keys: list[str], noise_seed: int | None = None) -> DataFrame:
        """(keys, x, y), a frame where it stands. With a seed noise is added, by hashes of frame, place and code."""
        c, values = self.config, {"embedding": as_array(self.embedding)}
        if not c.input_is_logits:
            values["projection"] = as_array(self.projection).T
            codes = F.sequence(F.lit(0), F.lit(c.num_embeddings - 1))
            bias = F.transform(codes, self.bias) if self.bias and c.use_bias else F.transform(codes, lambda k: F.lit(0.0))
            values["bias"] = np.array(frames.sparkSession.range(1).select(bias.alias("b")).first().b)
        noise = None
        if noise_seed is not None:
            draw = lambda pos: F.transform(F.sequence(F.lit(0), F.lit(c.num_embeddings - 1)), lambda k: quantize.gumbel(hash_uniform(noise_seed, *map(F.col, keys), pos, k)))
            noise = F.transform(F.sequence(F.lit(0), F.expr("cast(size(samples) div 16 as int)") - 1), draw)
        return rebuilt(frames, keys, nn.Weights(self.weights.values | values), backprop.Gumbel(c), noise)


@dataclass
class Training:
    """What a wrapper is compiled with: a base loss, extra losses and metrics as column builders."""

    extra_losses: list[Callable[[], Column]] = field(default_factory=list)
    extra_metrics: dict[str, Callable[[], Column]] = field(default_factory=dict)
    metrics: dict[str, Callable[[], Column]] = field(default_factory=lambda: {"mse": quality.mse, "cosine": quality.cosine})

    def loss(self, recon: DataFrame, *layer_losses: Column) -> DataFrame:
        """recon: (x, y) and what the layer losses, aggregates over the same rows, are made of."""
        return quality.total_loss(recon, self.extra_losses, layer_losses)

    def evaluate(self, recon: DataFrame) -> DataFrame:
        """(metric, value) rows."""
        built = {**self.metrics, **self.extra_metrics}
        row = recon.agg(*[f().alias(n) for n, f in built.items()])
        return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in built])).alias("m")).select("m.*")


def fit_codebook(tokens: DataFrame, codebook: DataFrame, dim: int, rate: float, steps: int, on_step: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """The codebook after gradient steps over all tokens; each step is one grouping, and the small codebook
    is brought to rows of its own between steps so that plans stay short."""
    from waveloom.operators.codebook import sgd_step

    spark = tokens.sparkSession
    for step in range(steps):
        moved = sgd_step(quantize.assign(tokens, codebook, dim).select("z", "code"), codebook, dim, rate)
        codebook = spark.createDataFrame([(r.code, list(r.vec)) for r in moved.collect()], "code int, vec array<double>")
        if on_step:
            on_step(step, codebook)
    return codebook


def level_metrics(encoded: DataFrame, config: quantize.RVQConfig) -> tuple[DataFrame, DataFrame]:
    """Per level and over all: statistics of (batch_id, codes) as means of batches; bits add up over levels,
    perplexity and usage are means."""
    rows = quantize.level_rows(encoded)
    per = stats.batch_mean(rows, _sizes(config), "level")
    return per, per.agg(F.sum("entropy_bits").alias("entropy_bits"), F.avg("perplexity").alias("perplexity"), F.avg("usage").alias("usage"))


def _sizes(config: quantize.RVQConfig) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in config.num_embeddings]), F.col("level"))
