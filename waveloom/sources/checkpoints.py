"""Checkpoints of a fit: a folder per epoch with parameters, optimizer moments and the history so far.

A checkpoint is written under a name of its own and renamed when it is whole, so a reader finds all of it or nothing,
and an attempt that dies leaves only a folder that nobody reads. It is as large as the model, whatever the data.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import SparkSession

from waveloom.sources import shared

PREFIX = "epoch-"


def commit(spark: SparkSession, path: str, epoch: int, arrays: dict[str, np.ndarray], state: dict) -> None:
    """Write the checkpoint of an epoch; one that is there already stays as it is."""
    rows = [(name, [int(n) for n in a.shape], [float(x) for x in np.ravel(a)], None) for name, a in sorted(arrays.items())]
    attempt = f"{path}/attempt-{uuid.uuid4().hex[:12]}"
    table = spark.createDataFrame([*rows, ("", [], [], json.dumps(state))], "name string, shape array<int>, numbers array<double>, state string")
    table.coalesce(1).write.parquet(attempt)
    if not shared.rename(spark, attempt, f"{path}/{PREFIX}{epoch:08d}"):
        shared.delete(spark, attempt)


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs that have a whole checkpoint, in order."""
    found = [n for n in shared.names(spark, path) if n.startswith(PREFIX)]
    return [int(n[len(PREFIX) :]) for n in found if shared.exists(spark, f"{path}/{n}/_SUCCESS")]


def restore(spark: SparkSession, path: str, epoch: int) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, state) of an epoch's checkpoint."""
    rows = spark.read.parquet(f"{path}/{PREFIX}{epoch:08d}").collect()
    state = next(json.loads(r.state) for r in rows if r.state is not None)
    return {r.name: np.array(r.numbers).reshape(r.shape) for r in rows if r.state is None}, state


def keep(spark: SparkSession, path: str, wanted: set[int]) -> None:
    """Delete the checkpoints of other epochs."""
    for epoch in epochs(spark, path):
        if epoch not in wanted:
            shared.delete(spark, f"{path}/{PREFIX}{epoch:08d}")
