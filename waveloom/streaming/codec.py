"""The codec on streams: quantizing is a stateless projection; framing keeps a source's open frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from waveloom.operators import quantize


def encode_stream(tokens: DataFrame, codebooks: list[DataFrame], dim: int) -> DataFrame:
    """Codes of a stream of tokens (tok, z): the batch plan as it is."""
    return quantize.rvq_encode(tokens, codebooks, dim)


def frame_stream(samples: DataFrame, length: int) -> DataFrame:
    """(source, frame, samples) of a stream (source string, at long, x double): full frames as they fill.
    State is a source's open frame. Samples of one trigger are put in the order of ``at``; samples that
    arrive in a later trigger than their successors are put behind them."""

    def run(key, pdfs: Iterator[pd.DataFrame], state):
        frame, held = state.get if state.exists else (0, [])
        held = list(held)
        new = pd.concat(list(pdfs)).sort_values("at")
        held += new["x"].tolist()
        rows = []
        while len(held) >= length:
            rows.append((key[0], frame, held[:length]))
            frame, held = frame + 1, held[length:]
        state.update((frame, held))
        yield pd.DataFrame(rows, columns=["source", "frame", "samples"])

    return samples.groupBy("source").applyInPandasWithState(run, "source string, frame long, samples array<double>", "frame long, held array<double>", "append", "NoTimeout")
