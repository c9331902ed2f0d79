"""Sums of named arrays over tasks: every task hands on its arrays in pieces, and each piece is summed where it is
dealt to, so a sum of a model's size is spread over the cluster however many tasks there are."""

from __future__ import annotations

import os
import socket
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Row

PIECE = 1 << 14
FIELDS = "name string, piece int, numbers binary"
_NAMES = ["name", "piece", "numbers"]


def pieces(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    cut = [(name, i // PIECE, np.ravel(a)[i : i + PIECE].astype(np.float64).tobytes()) for name, a in sorted(arrays.items()) for i in range(0, a.size, PIECE)]
    return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.string()), pa.array([c[1] for c in cut], pa.int32()), pa.array([c[2] for c in cut], pa.binary())], _NAMES)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for name, piece, numbers in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            new, key = np.frombuffer(numbers, np.float64), (name, piece)
            sums[key] = sums[key] + new if key in sums else new
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], _NAMES)


def total(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]], shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The sum over tasks of the arrays that ``run`` yields from a task's batches. The result has ``shapes``, zeros where
    nothing came."""

    def each(batches):
        own: dict[str, np.ndarray] = {}
        for arrays in run(batches):
            for name, a in arrays.items():
                own[name] = own[name] + a if name in own else a
        if own:
            yield pieces(own)

    # as many numbers as the shapes have come to the driver
    return joined(df.mapInArrow(each, FIELDS).repartition("name", "piece").mapInArrow(_add_up, FIELDS).collect(), shapes)


def joined(rows: list[Row], shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The arrays whose :func:`pieces` are ``rows``."""
    out = {name: np.zeros(int(np.prod(shape))) for name, shape in shapes.items()}
    for r in rows:
        part = np.frombuffer(r.numbers, np.float64)
        out[r.name][r.piece * PIECE : r.piece * PIECE + len(part)] = part
    return {name: a.reshape(shapes[name]) for name, a in out.items()}


class Meeting:
    """Sums over the tasks of a barrier stage while they run: every task hands its numbers to the first one and gets
    the sum of all, in the order of the tasks, so all hold the same to the last bit. Spark's own gathering waits a second
    a call; here it tells only where the first task listens. Connections are closed to those without the secret. If a
    task is lost the others' connections end, and the stage is run anew."""

    def __init__(self, context: BarrierTaskContext, secret: bytes):
        tasks, first = context.getTaskInfos(), context.partitionId() == 0
        listener = Listener(("", 0), backlog=len(tasks), authkey=secret) if first else None
        port = next(p for p in context.allGather(str(listener.address[1]) if listener else "") if p)
        self.others: list[Connection] = []
        self.first: Connection | None = None
        if listener:
            found = {}
            while len(found) < len(tasks) - 1:
                one = _prompt(listener.accept())
                found[int.from_bytes(one.recv_bytes(), "little")] = one
            self.others = [found[k] for k in sorted(found)]
            listener.close()
        else:
            self.first = _prompt(Client((tasks[0].address.rsplit(":", 1)[0], int(port)), authkey=secret))
            self.first.send_bytes(context.partitionId().to_bytes(4, "little"))

    def total(self, numbers: np.ndarray) -> np.ndarray:
        if self.first:
            self.first.send_bytes(numbers.tobytes())
            return np.frombuffer(self.first.recv_bytes(), np.float64)
        for one in self.others:
            numbers = numbers + np.frombuffer(one.recv_bytes(), np.float64)
        held = numbers.tobytes()
        for one in self.others:
            one.send_bytes(held)
        return numbers

    def close(self) -> None:
        for one in (*self.others, self.first):
            if one:
                one.close()


def _prompt(connection: Connection) -> Connection:
    """Small messages go out at once."""
    with socket.socket(fileno=os.dup(connection.fileno())) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return connection
