"""Convolutional encoder and decoder of frames as numpy kernels in Arrow batches. Arrays are (frames, time,
channels); a two-dimensional model of height 1 is the same computation."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions import columns
from waveloom.functions.columns import layer_norm, total

#: The error function is tabulated by steps of 1 / ERF_STEPS up to ERF_END, beyond which it is 1 in doubles, with its
#: first derivatives.
ERF_STEPS, ERF_END, ERF_TERMS = 32, 6, 9


@lru_cache(1)
def _erf_table() -> np.ndarray:
    """(places, terms): Taylor coefficients of erf at each step; a derivative follows from the two before it."""
    x = np.arange(ERF_STEPS * ERF_END + 1) / ERF_STEPS
    terms = [np.array([math.erf(v) for v in x]), 2 / math.sqrt(math.pi) * np.exp(-x * x)]
    terms.append(-2 * x * terms[1])
    while len(terms) < ERF_TERMS:
        n = len(terms) - 1
        terms.append(-2 * x * terms[n] - 2 * (n - 1) * terms[n - 1])
    return np.stack([t / math.factorial(i) for i, t in enumerate(terms)], 1)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to some units of the last place, by Taylor's series from the nearest step."""
    known = np.nan_to_num(np.abs(x), nan=0.0, posinf=ERF_END)
    table, size = _erf_table(), np.minimum(known, ERF_END)
    at = np.rint(size * ERF_STEPS).astype(np.int64)
    off, out = size - at / ERF_STEPS, table[at, ERF_TERMS - 1]
    for i in range(ERF_TERMS - 2, -1, -1):
        out = out * off + table[at, i]
    return np.where(np.isnan(x), x, np.copysign(out, x))


def same_padding(length: int, width: int, stride: int) -> tuple[int, int]:
    """(left, right) so that ceil(length / stride) windows fit; an odd one goes right."""
    need = max(0, (-(-length // stride) - 1) * stride + width - length)
    return need // 2, need - need // 2


def conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray | None = None, stride: int = 1) -> np.ndarray:
    """kernel: (width, channels in, channels out)."""
    padded = np.pad(x, ((0, 0), same_padding(x.shape[1], len(kernel), stride), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(kernel), axis=1)[:, ::stride]
    out = np.tensordot(windows, kernel, ((3, 2), (0, 1)))
    return out if bias is None else out + bias


def separable_conv(x: np.ndarray, depth: np.ndarray, point: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """depth: (width, channels); point: (channels, channels out)."""
    padded = np.pad(x, ((0, 0), same_padding(x.shape[1], len(depth), 1), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(depth), axis=1)
    out = np.einsum("btck,kc->btc", windows, depth) @ point
    return out if bias is None else out + bias


def channel_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + epsilon) * gamma + beta


def normal_share(x: np.ndarray) -> np.ndarray:
    """Share of the normal distribution below x."""
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * normal_share(x)


def upsample(x: np.ndarray) -> np.ndarray:
    return np.repeat(x, 2, axis=1)


@dataclass(frozen=True)
class Weights:
    """Parameters by name, uniform from a seed until trained ones are given."""

    values: dict[str, np.ndarray]

    @staticmethod
    def draw(base: int = 32, dim: int = 16, seed: int = 42, out: int | None = None) -> Weights:
        """dim: channels of a latent; out: of what the decoder takes, the same if not given."""
        taken = out or dim
        rng, out = np.random.default_rng(seed), {}

        def dense(name, *shape):
            bound = math.sqrt(6 / (math.prod(shape[:-1]) + shape[-1]))
            out[name], out[name + ".b"] = rng.uniform(-bound, bound, shape), np.zeros(shape[-1])

        def norm(name, n):
            out[name + ".g"], out[name + ".s"] = np.ones(n), np.zeros(n)

        before = 1
        for i in range(1, 5):
            dense(f"down{i}", 7, before, base * i)
            norm(f"down{i}.n", base * i)
            before = base * i
        dense("latent", 1, before, dim)
        before = taken
        for i in range(4, 0, -1):
            dense(f"up{i}", 7, before, base * i)
            out[f"up{i}.d"] = rng.uniform(-0.5, 0.5, (5, base * i))
            dense(f"up{i}.p", base * i, base * i)
            before = base * i
        norm("out.n", before)
        dense("out", 1, before, 1)
        return Weights(out)

    def __getitem__(self, name):
        return self.values[name]


def down_block(x: np.ndarray, w: Weights, name: str, stride: int = 2) -> np.ndarray:
    return gelu(channel_norm(conv(x, w[name], w[name + ".b"], stride), w[name + ".n.g"], w[name + ".n.s"]))


def up_block(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    x = gelu(conv(upsample(x), w[name], w[name + ".b"]))
    return separable_conv(x, w[name + ".d"], w[name + ".p"], w[name + ".p.b"])


def encode(x: np.ndarray, w: Weights) -> np.ndarray:
    """(frames, time) to latents (frames, time / 16, dim)."""
    x = x[:, :, None]
    for i in range(1, 5):
        x = down_block(x, w, f"down{i}")
    return conv(x, w["latent"], w["latent.b"])


def decode(z: np.ndarray, w: Weights) -> np.ndarray:
    for i in range(4, 0, -1):
        z = up_block(z, w, f"up{i}")
    return conv(channel_norm(z, w["out.n.g"], w["out.n.s"]), w["out"], w["out.b"])[:, :, 0]


#: Numbers of frames that are computed together: convolutions hold their windows.
NUMBERS = 1 << 16


def _in_parts(run, x: np.ndarray, w: Weights) -> np.ndarray:
    """``run`` on some frames at a time."""
    n = max(1, NUMBERS // max(1, math.prod(x.shape[1:])))
    return np.concatenate([run(x[i : i + n], w) for i in range(0, len(x), n)])


def stacked(column: pa.Array, depth: int = 1) -> np.ndarray:
    """A column of lists (of lists, by depth) as one array over its values; lists of one level are of one length."""
    shape = [len(column)]
    for _ in range(depth):
        sizes = np.diff(np.asarray(column.offsets))
        if column.null_count or len(sizes) and (sizes != sizes[0]).any():
            raise ValueError("frames of one length, without nulls, are asked for")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        column = column.flatten()
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(shape)


def nested(x: np.ndarray) -> pa.Array:
    """The reverse."""
    out = pa.array(np.ascontiguousarray(x, np.float64).ravel())
    for n in x.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, n, dtype=np.int32)), out)
    return out


def fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in names)


def latents(frames: DataFrame, weights: Weights, keys: list[str], samples: str = "samples") -> DataFrame:
    """(keys, latent): a row per frame, the latent as an array of tokens. Frames are of one length, a multiple of 16."""
    shared = frames.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = _in_parts(encode, stacked(batch.column("_samples")), shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), nested(z)], [*keys, "latent"])

    return frames.select(*keys, F.col(samples).alias("_samples")).mapInArrow(run, fields(frames, keys) + ", latent array<array<double>>")


def reconstructions(held: DataFrame, weights: Weights, keys: list[str], latent: str = "latent") -> DataFrame:
    """(keys, samples) of a row per frame (keys, latent)."""
    shared = held.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _in_parts(decode, stacked(batch.column("_latent"), 2), shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), nested(x)], [*keys, "samples"])

    return held.select(*keys, F.col(latent).alias("_latent")).mapInArrow(run, fields(held, keys) + ", samples array<double>")


def encode_frames(frames: DataFrame, weights: Weights, keys: list[str], samples: str = "samples") -> DataFrame:
    """(keys, pos, z): a row per latent token. Frames are of one length, a multiple of 16."""
    return latents(frames, weights, keys, samples).select(*keys, F.posexplode("latent").alias("pos", "z"))


def decode_frames(tokens: DataFrame, weights: Weights, keys: list[str]) -> DataFrame:
    """(keys, samples) of tokens (keys, pos, y): a frame's tokens are gathered, as many as it has."""
    held = tokens.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "y"))), lambda h: h["y"]).alias("latent"))
    return reconstructions(held, weights, keys)


# ------------------------------------------------------------------ the same as columns


def conv_column(x: Column, taps: list[float], stride: int, length: int) -> Column:
    left, right = same_padding(length, len(taps), stride)
    padded = F.concat(F.array_repeat(F.lit(0.0), left), x, F.array_repeat(F.lit(0.0), right))
    kernel = F.array(*[F.lit(t) for t in taps])
    starts = F.sequence(F.lit(1), F.lit(1 + (-(-length // stride) - 1) * stride), F.lit(stride))
    return F.transform(starts, lambda at: total(F.zip_with(F.slice(padded, at, len(taps)), kernel, lambda a, b: a * b)))


def upsample_column(x: Column) -> Column:
    return F.flatten(F.transform(x, lambda v: F.array(v, v)))


def channel_norm_column(x: Column, epsilon: float = 1e-5) -> Column:
    return layer_norm(x, epsilon)


def separable_column(x: Column, taps: list[float], point: list[float], length: int) -> Column:
    """Depthwise taps, then a pointwise weight per output channel: an array per sample."""
    deep = conv_column(x, taps, 1, length)
    return F.transform(deep, lambda v: F.array(*[v * F.lit(p) for p in point]))


def conv_channels(x: Column, kernel: np.ndarray, bias: np.ndarray | None, stride: int, length: int) -> Column:
    """Convolution of an array of samples, each an array of channels: every output is a window's numbers times a row of the
    kernel. kernel: (width, channels in, channels out)."""
    width, before, after = kernel.shape
    left, right = same_padding(length, width, stride)
    zeros = lambda n: F.array_repeat(F.array_repeat(F.lit(0.0), before), n)
    padded = F.concat(zeros(left), x, zeros(right)) if left or right else x
    rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in kernel[:, :, o].ravel()]).alias("k"), F.lit(float(bias[o]) if bias is not None else 0.0).alias("b")) for o in range(after)])
    starts = F.sequence(F.lit(1), F.lit(1 + (-(-length // stride) - 1) * stride), F.lit(stride))
    one = lambda held, k: F.transform(k, lambda r: total(F.zip_with(held, r["k"], lambda a, b: a * b)) + r["b"])
    # what stands in a lambda is computed for each of its calls: input and kernel are bound first
    bound = F.array(F.struct(padded.alias("x"), rows.alias("k")))
    return F.transform(bound, lambda h: F.transform(starts, lambda at: one(F.flatten(F.slice(h["x"], at, width)), h["k"])))[0]


def depth_channels(x: Column, depth: np.ndarray, length: int) -> Column:
    """Every channel's convolution with its own taps. depth: (width, channels)."""
    width, channels = depth.shape
    left, right = same_padding(length, width, 1)
    zeros = lambda n: F.array_repeat(F.array_repeat(F.lit(0.0), channels), n)
    taps = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in depth])
    bound = F.array(F.struct(F.concat(zeros(left), x, zeros(right)).alias("x"), taps.alias("k")))
    add = lambda a, p: F.zip_with(a, F.zip_with(p["v"], p["k"], lambda v, t: v * t), lambda v, t: v + t)
    one = lambda h, at: F.aggregate(F.zip_with(F.slice(h["x"], at, width), h["k"], lambda v, k: F.struct(v.alias("v"), k.alias("k"))), F.array_repeat(F.lit(0.0), channels), add)
    return F.transform(bound, lambda h: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda at: one(h, at)))[0]


def down_block_column(x: Column, w: Weights, name: str, length: int, stride: int = 2) -> Column:
    """:func:`down_block` of an array of samples of channels."""
    gain, shift = (F.array(*[F.lit(float(v)) for v in w[f"{name}.n.{k}"]]) for k in "gs")
    scaled = lambda v: F.zip_with(F.zip_with(layer_norm(v, 1e-5), gain, lambda a, g: a * g), shift, lambda a, s: a + s)
    return F.transform(conv_channels(x, w[name], w[name + ".b"], stride, length), lambda v: F.transform(scaled(v), columns.gelu))


def up_block_column(x: Column, w: Weights, name: str, length: int) -> Column:
    """:func:`up_block` of an array of ``length`` samples of channels: twice as many."""
    wide = F.transform(conv_channels(upsample_column(x), w[name], w[name + ".b"], 1, 2 * length), lambda v: F.transform(v, columns.gelu))
    deep = depth_channels(wide, w[name + ".d"], 2 * length)
    return conv_channels(deep, w[name + ".p"][None], w[name + ".p.b"], 1, 2 * length)
