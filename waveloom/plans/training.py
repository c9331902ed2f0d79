"""Fitting codebooks, the Gumbel bottleneck and whole autoencoders in epochs of shuffled batches.

An epoch is one barrier stage: its tasks hold their shares of every batch (:mod:`waveloom.sources.batches`) and step
through them side by side. What they sum is as large as the model, and so are parameters and Adam's moments, which come
back to the driver with the epoch's end. With a checkpoint folder a fit that was ended goes on behind its last whole epoch.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.functions.columns import anneal, cosine_decay
from waveloom.operators import backprop, gradients, nn, quantize, signals
from waveloom.operators.codebook import as_array, attach
from waveloom.sources import checkpoints
from waveloom.sources.batches import deal_batches

Arrays = dict[str, np.ndarray]
#: Prefixes of parameters and moments where they are held together.
KINDS = ("value:", "first:", "second:")


@dataclass(frozen=True)
class FitConfig:
    epochs: int
    batch_size: int
    rate: float = 1e-3
    patience: int | None = None
    beta: float = 0.25
    seed: int = 42
    #: (start, end, epochs, mode) of the temperature; it is logged, and the Gumbel bottleneck uses it.
    annealing: tuple[float, float, int, str] | None = None
    #: Whether the rate falls to 0 over all steps, by a cosine; else it stays.
    decay: bool = False
    #: Tasks of a batch, at most as many as cores, which it is if not given.
    tasks: int | None = None

    def __post_init__(self):
        if self.epochs < 1 or self.batch_size < 1 or self.rate <= 0:
            raise ValueError("epochs, batch_size and rate are above 0")

    def temperatures(self, spark: SparkSession) -> list[float | None]:
        """Of every epoch: a row each."""
        if self.annealing is None:
            return [None] * self.epochs
        rows = spark.range(self.epochs).select("id", anneal(F.col("id"), *self.annealing).alias("t")).orderBy("id").collect()
        return [r.t for r in rows]

    def rates(self, spark: SparkSession, epoch: int, steps: int) -> list[float]:
        """Of every step of an epoch."""
        if not self.decay:
            return [self.rate] * steps
        rows = spark.range(epoch * steps, (epoch + 1) * steps).select("id", cosine_decay(F.col("id"), self.rate, self.epochs * steps).alias("r")).orderBy("id").collect()
        return [r.r for r in rows]


@dataclass
class Fitted:
    """The best epoch's parameters, and (epoch, loss, val_loss, temperature, perplexity, usage) of every epoch that ran;
    perplexity and usage are means over batches and levels, as the loss is a mean over batches."""

    parameters: Arrays
    best_epoch: int = -1
    history: list[tuple] = field(default_factory=list)
    spark: SparkSession | None = None

    def table(self, name: str) -> DataFrame:
        """A parameter's rows as (code, vec)."""
        rows = [(i, [float(x) for x in np.atleast_1d(v)]) for i, v in enumerate(self.parameters[name])]
        return self.spark.createDataFrame(rows, "code int, vec array<double>")

    @property
    def codebooks(self) -> list[DataFrame]:
        return [self.table(n) for n in sorted(self.parameters) if n.startswith("codebook")]

    @property
    def codebook(self) -> DataFrame:
        return self.codebooks[0]

    def history_frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "epoch int, loss double, val_loss double, temperature double, perplexity double, usage double")


#: What a task's share of a batch gives: kernel(rows, parameters, size, temperature, learn) has the loss, code counts by
#: level as counts0, counts1, ..., and gradients, all divided by the batch's ``size``, so that shares add up to the batch.
Kernel = Callable[[pa.RecordBatch, Arrays, int, float | None, bool], Arrays]


def statistics(counts: list[np.ndarray]) -> tuple[float, float]:
    """(perplexity, usage) of code counts, means over levels."""
    shares = [c / max(1, c.sum()) for c in counts]
    perplexity = [math.exp(-float((p * np.log(p + 1e-10)).sum())) for p in shares]
    return sum(perplexity) / len(shares), sum(float((p > 0).mean()) for p in shares) / len(shares)


def adam(parameters: Arrays, moments: tuple[Arrays, Arrays], change: Arrays, step: int, rate: float, b1: float = 0.9, b2: float = 0.999, epsilon: float = 1e-7) -> None:
    """One update in place. Parameters without a gradient stay."""
    first, second = moments
    scale = rate * math.sqrt(1 - b2**step) / (1 - b1**step)
    for name, g in change.items():
        first[name] = b1 * first[name] + (1 - b1) * g
        second[name] = b2 * second[name] + (1 - b2) * g * g
        parameters[name] = parameters[name] - scale * first[name] / (np.sqrt(second[name]) + epsilon)


def _epoch(dealt: DataFrame, kernel: Kernel, sizes: list[int], parameters: Arrays, moments: tuple[Arrays, Arrays], config: FitConfig, rates: list[float], steps: int, temperature: float | None) -> tuple[Arrays, tuple[Arrays, Arrays], np.ndarray]:
    """All steps of an epoch in one stage: its tasks hold their shares of every batch and run side by side. Each computes
    on its share, the shares' sums are added up between the tasks, and each makes the same update. Gives the
    parameters, moments and the sums over batches of loss, perplexity and usage."""
    shapes = {"loss": (1,)} | {f"counts{i}": (k,) for i, k in enumerate(sizes)} | {n: a.shape for n, a in parameters.items()}
    ends = np.cumsum([0, *(math.prod(s) for s in shapes.values())])
    place = {n: slice(a, b) for n, a, b in zip(shapes, ends, ends[1:], strict=False)}
    shared, secret = dealt.sparkSession.sparkContext.broadcast((parameters, moments, rates)), secrets.token_bytes(32)

    def run(batches):
        now, (first, second), paces = shared.value
        now, held = dict(now), (dict(first), dict(second))
        context, at, sums, found = BarrierTaskContext.get(), 0, np.zeros(ends[-1]), np.zeros(3)
        meeting = gradients.Meeting(context, secret)

        def end():
            whole = meeting.total(sums)
            total = {n: whole[place[n]].reshape(shape) for n, shape in shapes.items()}
            found[:] += (total["loss"][0], *statistics([total[f"counts{i}"] for i in range(len(sizes))]))
            adam(now, held, {n: total[n] for n in now}, steps + at + 1, paces[at])
            sums[:] = 0

        for batch in batches:
            ids = batch.column("batch_id").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while b > a and at < ids[a]:
                    end()
                    at += 1
                for name, value in kernel(batch.slice(a, b - a), now, config.batch_size, temperature, True).items() if b > a else ():
                    sums[place[name]] += value.ravel()
        while at < len(paces):
            end()
            at += 1
        meeting.close()
        if context.partitionId() == 0:
            yield gradients.pieces({kind + n: v for kind, arrays in zip(KINDS, (now, *held), strict=True) for n, v in arrays.items()} | {"found": found})

    rows = dealt.mapInArrow(run, gradients.FIELDS, barrier=True).collect()  # as large as the model
    shared.destroy()
    out = gradients.joined(rows, {kind + n: a.shape for kind in KINDS for n, a in parameters.items()} | {"found": (3,)})
    return _part(out, KINDS[0]), (_part(out, KINDS[1]), _part(out, KINDS[2])), out["found"]


def _loss(rows: DataFrame, kernel: Kernel, parameters: Arrays, size: int, temperature: float | None) -> float:
    """Of a table of ``size`` rows, without an update."""
    shared = rows.sparkSession.sparkContext.broadcast(parameters)
    run = lambda batches: ({"loss": kernel(b, shared.value, size, temperature, False)["loss"]} for b in batches)
    found = gradients.total(rows, run, {"loss": (1,)})
    shared.destroy()
    return float(found["loss"][0])


def run_epochs(
    data: DataFrame, keys: list[str], parameters: Arrays, config: FitConfig, kernel: Kernel, sizes: list[int], validation: DataFrame | None = None,
    prepare: Callable[[DataFrame, int], DataFrame] | None = None, ready: Callable[[DataFrame, int | None], DataFrame] | None = None, on_epoch: Callable[[int, dict], None] | None = None, checkpoint: str | None = None,
) -> Fitted:
    """The loop that all fits share. kernel: see above; sizes: codes by level. Without validation rows the training loss
    counts. prepare(rows, epoch) is applied to the rows of an epoch before they are dealt (cropping, augmenting), and
    ready(rows, epoch), or of validation rows ready(rows, None), where the kernel gets them. checkpoint: a folder; a fit that
    finds whole epochs in it goes on behind the last of them with the parameters, moments and history it had."""
    spark, rows = data.sparkSession, data.count()
    if rows < config.batch_size:
        raise ValueError("fewer rows than a batch")
    parameters = {k: np.array(v, np.float64) for k, v in parameters.items()}
    moments = tuple({k: np.zeros_like(v) for k, v in parameters.items()} for _ in range(2))
    out, best, steps, begin = Fitted(dict(parameters), spark=spark), math.inf, 0, 0
    done = checkpoints.epochs(spark, checkpoint) if checkpoint else []
    if done:
        held, state = checkpoints.restore(spark, checkpoint, done[-1])
        parameters, moments = _part(held, "value:"), (_part(held, "first:"), _part(held, "second:"))
        out.history, out.best_epoch, begin, steps = [tuple(h) for h in state["history"]], state["best_epoch"], done[-1] + 1, state["steps"]
        best = min(h[2] for h in out.history)
        out.parameters = _part(checkpoints.restore(spark, checkpoint, out.best_epoch)[0], "value:")
    temperatures, held_out = config.temperatures(spark), validation.count() if validation is not None else 0
    ready = ready or (lambda df, epoch: df)
    tasks = max(1, min(config.tasks or spark.sparkContext.defaultParallelism, spark.sparkContext.defaultParallelism, config.batch_size))
    for epoch in range(begin, config.epochs):
        if config.patience is not None and out.best_epoch >= 0 and epoch - 1 - out.best_epoch >= config.patience:
            break
        now = temperatures[epoch]
        ordered = signals.shuffle_order(data, *keys, seed=config.seed, epoch=epoch)
        dealt = deal_batches(prepare(ordered, epoch) if prepare else ordered, rows, config.batch_size, tasks)
        total = rows // config.batch_size
        parameters, moments, found = _epoch(ready(dealt, epoch), kernel, sizes, parameters, moments, config, config.rates(spark, epoch, total), steps, now)
        steps += total
        loss, perplexity, usage = (float(x) / total for x in found)
        value = _loss(ready(validation, None), kernel, parameters, held_out, now) if validation is not None else loss
        row = {"epoch": epoch, "loss": loss, "val_loss": value, "temperature": now, "perplexity": perplexity, "usage": usage}
        out.history.append(tuple(row.values()))
        if value < best:
            best, out.best_epoch, out.parameters = value, epoch, {k: v.copy() for k, v in parameters.items()}
        if checkpoint:
            arrays = {kind + k: v for kind, held in zip(KINDS, (parameters, *moments), strict=True) for k, v in held.items()}
            checkpoints.commit(spark, checkpoint, epoch, arrays, {"history": out.history, "best_epoch": out.best_epoch, "steps": steps, "config": asdict(config)})
            checkpoints.keep(spark, checkpoint, {epoch, out.best_epoch})
        if on_epoch:
            on_epoch(epoch, row)
    return out


def _part(arrays: Arrays, prefix: str) -> Arrays:
    return {k[len(prefix) :]: v for k, v in arrays.items() if k.startswith(prefix)}


# ------------------------------------------------------------------ codebooks of all levels


def _flat(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _counts(codes: np.ndarray, sizes: list[int]) -> Arrays:
    return {f"counts{i}": np.bincount(codes[..., i].ravel(), minlength=k).astype(float) for i, k in enumerate(sizes)}


def fit(tokens: DataFrame, codebooks: DataFrame | list[DataFrame], dim: int, config: FitConfig, validation: DataFrame | None = None, on_epoch: Callable[[int, dict], None] | None = None, checkpoint: str | None = None) -> Fitted:
    """Codebooks of all residual levels, jointly, on tokens (tok, z)."""
    books = codebooks if isinstance(codebooks, list) else [codebooks]
    parameters = {f"codebook{i}": as_array(b) for i, b in enumerate(books, 1)}
    names = list(parameters)
    sizes = [len(parameters[n]) for n in names]
    bottleneck = backprop.Residual(quantize.RVQConfig(len(names), tuple(sizes), dim, config.beta))

    def kernel(rows, p, size, temperature, learn):
        _, loss, codes, _ = bottleneck.forward(_flat(rows.column("z")), nn.Weights(p), change := {}, size)
        return change | _counts(codes, sizes) | {"loss": np.array([loss])}

    ready = lambda df, epoch: df.withColumn("z", quantize.checked(F.col("z"), dim))
    return run_epochs(tokens.select("tok", "z"), ["tok"], parameters, config, kernel, sizes, validation, ready=ready, on_epoch=on_epoch, checkpoint=checkpoint)


# ------------------------------------------------------------------ the Gumbel bottleneck alone


def gumbel_soft(tokens: DataFrame, parameters: dict[str, DataFrame], config: quantize.GSConfig, temperature: float, noise_seed: int | None = None) -> DataFrame:
    """tokens (tok, z) with p, and the embedding attached."""
    named = {"_emb": parameters["embedding"]} | ({"_bias": parameters["bias"]} if config.use_bias and not config.input_is_logits else {})
    held = attach(tokens, **named)
    bias: Callable[[Column], Column] | None = (lambda k: F.get(F.get("_bias", k), 0)) if "_bias" in named else None
    scored = held.withColumn("logits", F.col("z")) if config.input_is_logits else quantize.logits(held, parameters["projection"], bias)
    return quantize.posteriors(scored, temperature, noise_seed)


def fit_gumbel(tokens: DataFrame, parameters: dict[str, DataFrame], config: quantize.GSConfig, fitting: FitConfig, validation: DataFrame | None = None, on_epoch: Callable[[int, dict], None] | None = None, checkpoint: str | None = None) -> Fitted:
    """Projection, bias and embedding of the bottleneck, so that expected codewords rebuild tokens (tok, z). Tables
    (code, vec) by name; latents and codewords are of one length. Batches are noisy, by hashes of epoch and token;
    validation is not. The temperature follows the annealing if there is one."""
    if config.input_is_logits:
        raise ValueError("without a projection there is nothing to fit but in an autoencoder")
    held = {n: as_array(t) for n, t in parameters.items()}
    if min([config.temperature] if fitting.annealing is None else fitting.annealing[:2]) <= 0:
        raise ValueError("the temperature is above 0")
    bottleneck, k, dim = backprop.Gumbel(config), config.num_embeddings, config.embedding_dim

    def kernel(rows, p, size, temperature, learn):
        z, turned = _flat(rows.column("z")), {"projection": p["projection"].T, "embedding": p["embedding"]} | ({"bias": p["bias"][:, 0]} if "bias" in p else {})
        noise = _flat(rows.column("noise")) if "noise" in rows.schema.names else None
        y, rate, codes, back = bottleneck.forward(z, nn.Weights(turned), change := {}, size, noise, temperature)
        out = _counts(codes, [k]) | {"loss": np.array([((y - z) ** 2).sum() / (size * dim) + rate])}
        if learn:
            back(2 * (y - z) / (size * dim))
            out |= {n: (g.T if n == "projection" else g).reshape(p[n].shape) for n, g in change.items()}
        return out

    def ready(df, epoch):
        rows = df.withColumn("z", quantize.checked(F.col("z"), dim))
        return rows if epoch is None else rows.withColumn("noise", quantize.gumbel_noise(F.col("tok"), k, fitting.seed + epoch))

    return run_epochs(tokens.select("tok", "z"), ["tok"], held, fitting, kernel, [k], validation, ready=ready, on_epoch=on_epoch, checkpoint=checkpoint)


# ------------------------------------------------------------------ encoder, bottleneck and decoder


def _frame_noise(config: quantize.GSConfig, seed: int, names: list[int], tokens: int) -> np.ndarray:
    """Gumbel noise by frame: the same wherever a frame is computed."""
    draws = np.stack([np.random.Generator(np.random.Philox(key=[seed, n & (1 << 64) - 1])).random((tokens, config.num_embeddings)) for n in names])
    return -np.log(-np.log(draws + 1e-9) + 1e-9)


def fit_autoencoder(
    frames: DataFrame, keys: list[str], weights: nn.Weights, bottleneck: backprop.Bottleneck, tables: dict[str, DataFrame], config: FitConfig, validation: DataFrame | None = None,
    prepare: Callable[[DataFrame, int], DataFrame] | None = None, on_epoch: Callable[[int, dict], None] | None = None, checkpoint: str | None = None,
) -> Fitted:
    """Encoder, bottleneck and decoder on frames (keys, samples) of one length, a multiple of 16: reconstruction loss plus
    the bottleneck's own, by Adam. tables: the bottleneck's parameters as (code, vec), a codebook per level as codebook1,
    codebook2, ..., or projection, bias and embedding. ``Fitted.parameters`` holds the encoder's and the decoder's weights
    under their names besides."""
    parameters = dict(weights.values)
    for name in bottleneck.names():
        a = as_array(tables[name])
        parameters[name] = a.T if name == "projection" else a[:, 0] if name == "bias" else a
    c, noisy = bottleneck.config, isinstance(bottleneck, backprop.Gumbel)
    sizes = [c.num_embeddings] if noisy else list(c.num_embeddings)

    def kernel(rows, p, size, temperature, learn):
        x, w, out = nn.stacked(rows.column("samples")), nn.Weights(p), {}
        names, seeds = (rows.column(n).to_pylist() for n in ("_frame", "_seed"))
        for a in range(0, len(x), part := max(1, nn.NUMBERS // max(1, x.shape[1]))):
            noise = _frame_noise(c, seeds[0], names[a : a + part], x.shape[1] // 16) if noisy and seeds[0] is not None else None
            recon, layer, codes, change = backprop.batch_part(x[a : a + part], w, bottleneck, size, noise, temperature, learn)
            for n, value in ((change if learn else {}) | _counts(codes, sizes) | {"loss": np.array([recon + layer])}).items():
                backprop.add(out, n, value)
        return out

    ready = lambda df, epoch: df.select("samples", F.xxhash64(*keys).alias("_frame"), F.lit(None if epoch is None else config.seed + epoch).cast("long").alias("_seed"), *([] if epoch is None else ["batch_id"]))
    return run_epochs(frames.select(*keys, "samples"), keys, parameters, config, kernel, sizes, validation, prepare, ready, on_epoch, checkpoint)
