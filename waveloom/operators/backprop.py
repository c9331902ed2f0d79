"""Reverse mode of the encoder, the bottleneck and the decoder, as numpy kernels on a batch's frames.

Every kernel returns its value and a function from the gradient of the value to that of the input; parameters'
gradients are added to a table by name. Losses are means over a whole batch, of which a task sees some frames: all
sums are divided by the batch's numbers, so tasks' losses and gradients add up to the batch's.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from waveloom.functions.columns import EPSILON
from waveloom.operators import nn
from waveloom.operators.quantize import GSConfig, RVQConfig

Back = Callable[[np.ndarray], np.ndarray]
Gradients = dict[str, np.ndarray]


def add(gradients: Gradients, name: str, value: np.ndarray) -> None:
    gradients[name] = gradients[name] + value if name in gradients else value


def _windows(x: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, int]:
    """(frames, places, channels, width) and the padding on the left."""
    pads = nn.same_padding(x.shape[1], width, stride)
    padded = np.pad(x, ((0, 0), pads, (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[:, ::stride], pads[0]


def _unpadded(taps: list[np.ndarray], length: int, left: int, stride: int) -> np.ndarray:
    """Gradient of a signal from those of its windows' taps: tap t of place i is sample i * stride + t of the padded."""
    n, places, channels = taps[0].shape
    out = np.zeros((n, length + len(taps) + stride + left, channels))
    for t, g in enumerate(taps):
        out[:, t : t + (places - 1) * stride + 1 : stride] += g
    return out[:, left : left + length]


def conv(x: np.ndarray, w: nn.Weights, name: str, gradients: Gradients, stride: int = 1) -> tuple[np.ndarray, Back]:
    kernel = w[name]
    windows, left = _windows(x, len(kernel), stride)
    out = np.tensordot(windows, kernel, ((3, 2), (0, 1))) + w[name + ".b"]

    def back(g):
        add(gradients, name, np.tensordot(windows, g, ((0, 1), (0, 1))).transpose(1, 0, 2))
        add(gradients, name + ".b", g.sum((0, 1)))
        return _unpadded([g @ tap.T for tap in kernel], x.shape[1], left, stride)

    return out, back


def separable(x: np.ndarray, w: nn.Weights, name: str, gradients: Gradients) -> tuple[np.ndarray, Back]:
    depth, point = w[name + ".d"], w[name + ".p"]
    windows, left = _windows(x, len(depth), 1)
    deep = np.einsum("btck,kc->btc", windows, depth)

    def back(g):
        add(gradients, name + ".p", np.tensordot(deep, g, ((0, 1), (0, 1))))
        add(gradients, name + ".p.b", g.sum((0, 1)))
        inner = g @ point.T
        add(gradients, name + ".d", np.einsum("btck,btc->kc", windows, inner))
        return _unpadded([inner * tap for tap in depth], x.shape[1], left, 1)

    return deep @ point + w[name + ".p.b"], back


def channel_norm(x: np.ndarray, w: nn.Weights, name: str, gradients: Gradients, epsilon: float = 1e-5) -> tuple[np.ndarray, Back]:
    centred = x - x.mean(-1, keepdims=True)
    scale = np.sqrt((centred**2).mean(-1, keepdims=True) + epsilon)
    unit = centred / scale

    def back(g):
        add(gradients, name + ".g", (g * unit).sum((0, 1)))
        add(gradients, name + ".s", g.sum((0, 1)))
        inner = g * w[name + ".g"]
        return (inner - inner.mean(-1, keepdims=True) - unit * (inner * unit).mean(-1, keepdims=True)) / scale

    return unit * w[name + ".g"] + w[name + ".s"], back


def gelu(x: np.ndarray) -> tuple[np.ndarray, Back]:
    below = nn.normal_share(x)
    return x * below, lambda g: g * (below + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi))


def upsample(x: np.ndarray) -> tuple[np.ndarray, Back]:
    return nn.upsample(x), lambda g: g[:, ::2] + g[:, 1::2]


def chain(backs: list[Back]) -> Back:
    def back(g):
        for b in reversed(backs):
            g = b(g)
        return g

    return back


def encode(x: np.ndarray, w: nn.Weights, gradients: Gradients) -> tuple[np.ndarray, Back]:
    """(frames, time) to latents; the reverse gives nothing, as frames are data."""
    x, backs = x[:, :, None], []
    for i in range(1, 5):
        for kernel in (lambda v, n=f"down{i}": conv(v, w, n, gradients, 2), lambda v, n=f"down{i}.n": channel_norm(v, w, n, gradients), gelu):
            x, back = kernel(x)
            backs.append(back)
    x, back = conv(x, w, "latent", gradients)
    return x, chain([*backs, back])


def decode(z: np.ndarray, w: nn.Weights, gradients: Gradients) -> tuple[np.ndarray, Back]:
    backs = []
    for i in range(4, 0, -1):
        for kernel in (upsample, lambda v, n=f"up{i}": conv(v, w, n, gradients), gelu, lambda v, n=f"up{i}": separable(v, w, n, gradients)):
            z, back = kernel(z)
            backs.append(back)
    z, back = channel_norm(z, w, "out.n", gradients)
    out, last = conv(z, w, "out", gradients)
    return out[:, :, 0], chain([*backs, back, last, lambda g: g[:, :, None]])


@dataclass(frozen=True)
class Residual:
    """Residual levels with straight-through output: what comes back to the output goes to the latent as it is, and
    the commitment of every level with it; each level's codebook learns from its own residuals only."""

    config: RVQConfig

    def names(self) -> list[str]:
        return [f"codebook{i}" for i in range(1, self.config.num_levels + 1)]

    def forward(self, z: np.ndarray, w: nn.Weights, gradients: Gradients, tokens: int, noise=None, temperature=None) -> tuple[np.ndarray, float, np.ndarray, Back]:
        """(output, layer loss, codes by level, reverse)."""
        rest, y, loss, commitment, codes = z, np.zeros_like(z), 0.0, np.zeros_like(z), []
        scale = 1 / (tokens * z.shape[-1])
        for name in self.names():
            book = w[name]
            found = nearest(rest, book)
            q = book[found]
            error = rest - q
            loss += (1 + self.config.beta) * float((error**2).sum()) * scale
            commitment += 2 * self.config.beta * scale * error
            change = np.zeros(book.shape)
            np.add.at(change, found.ravel(), -2 * scale * error.reshape(-1, z.shape[-1]))
            add(gradients, name, change)
            rest, y = error, y + q
            codes.append(found)
        return y, loss, np.stack(codes, -1), lambda g: g + commitment


def nearest(z: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest codeword of every vector, of equals the first. One matrix product finds the candidates; those
    within rounding of the best are compared by their exact distance."""
    flat = z.reshape(-1, z.shape[-1])
    out = np.empty(len(flat), np.int64)
    squares = (book**2).sum(1)
    for a in range(0, len(flat), 4096):
        part = flat[a : a + 4096]
        score = squares - 2 * (part @ book.T)
        best = score.min(1, keepdims=True)
        slack = 1e-9 * (1 + np.abs(best) + (part**2).sum(1, keepdims=True))
        found = score.argmin(1)
        close = score <= best + slack
        for i in np.flatnonzero(close.sum(1) > 1):
            few = np.flatnonzero(close[i])
            found[i] = few[((part[i] - book[few]) ** 2).sum(1).argmin()]
        out[a : a + 4096] = found
    return out.reshape(z.shape[:-1])


@dataclass(frozen=True)
class Gumbel:
    """The Gumbel-softmax bottleneck. Hard selection hands on the soft value but takes gradients through the one-hot
    code, which has none: then only the rate term reaches the logits. Soft selection hands them through the softmax."""

    config: GSConfig

    def names(self) -> list[str]:
        own = [] if self.config.input_is_logits else ["projection", "bias"] if self.config.use_bias else ["projection"]
        return [*own, "embedding"]

    def forward(self, z: np.ndarray, w: nn.Weights, gradients: Gradients, tokens: int, noise=None, temperature=None) -> tuple[np.ndarray, float, np.ndarray, Back]:
        """noise: added to the logits, as in training. Parameters: projection (latent x codes), bias, embedding."""
        c, tau = self.config, self.config.temperature if temperature is None else temperature
        logits = z if c.input_is_logits else z @ w["projection"] + (w["bias"] if c.use_bias else 0.0)
        scaled = (logits + noise) / tau if noise is not None else logits / (tau := max(tau, 1e-6))
        power = np.exp(scaled - scaled.max(-1, keepdims=True))
        p = power / power.sum(-1, keepdims=True)
        log_p = np.log(p + EPSILON)
        rate = c.kl_weight / (tokens * math.log(2))
        loss = rate * float((p * log_p).sum() + p[..., 0].size * math.log(c.num_embeddings))

        def back(g):
            add(gradients, "embedding", np.tensordot(p, g, (range(p.ndim - 1), range(p.ndim - 1))))
            of_p = rate * (log_p + p / (p + EPSILON))
            if not c.hard:
                of_p = of_p + g @ w["embedding"].T
            of_logits = p * (of_p - (p * of_p).sum(-1, keepdims=True)) / tau
            if c.input_is_logits:
                return of_logits
            add(gradients, "projection", np.tensordot(z, of_logits, (range(z.ndim - 1), range(z.ndim - 1))))
            if c.use_bias:
                add(gradients, "bias", of_logits.reshape(-1, c.num_embeddings).sum(0))
            return of_logits @ w["projection"].T

        return p @ w["embedding"], loss, p.argmax(-1)[..., None], back


Bottleneck = Residual | Gumbel


def batch_part(x: np.ndarray, w: nn.Weights, bottleneck: Bottleneck, frames: int, noise: np.ndarray | None = None, temperature: float | None = None, learn: bool = True) -> tuple[float, float, np.ndarray, Gradients]:
    """(reconstruction loss, layer loss, codes, gradients) of some frames of a batch of ``frames``."""
    gradients: Gradients = {}
    z, back_encoder = encode(x, w, gradients)
    y, layer, codes, back_bottleneck = bottleneck.forward(z, w, gradients, frames * z.shape[1], noise, temperature)
    out, back_decoder = decode(y, w, gradients)
    error = out - x
    scale = 1 / (frames * x.shape[1])
    if learn:
        back_encoder(back_bottleneck(back_decoder(2 * scale * error)))
    return float((error**2).sum()) * scale, layer, codes, gradients
