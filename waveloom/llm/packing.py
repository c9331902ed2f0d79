"""Pattern packing: fit repeat counts of few-document length patterns to the length histogram by
non-negative least squares, round, and pack what is left best fit first.

The histogram has as many bins as a sequence has tokens, whatever the corpus holds, so the fit runs on
the driver over that bounded table. Documents never do: they are ranked among those of their length by
per-task counters and a window over per-task counts, and take their place by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.llm.common import byte_slices, materialize, spread, worker
from waveloom.llm.tokens import crc32, shared_encoder, vocabulary, with_end

#: Texts encoded at a time, in bytes.
SLICE = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE):
    """Slices of a record batch of about ``limit`` bytes of text each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in byte_slices(sizes, limit):
        yield batch.slice(a, b - a)


def length_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer: str, room: int) -> DataFrame:
    """A row per piece of at most ``room`` tokens: id, piece, start, length, ids_crc32, and its task and
    number among that task's pieces of its length."""
    id_type = df.schema[id_col].dataType

    @worker
    def encode(batches):
        encoder, seen, task = shared_encoder(tokenizer, True), np.zeros(room + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                offsets, ids = with_end(*encoder.encode(batch.column("text")))
                ids = ids.astype("<u4")
                sizes = np.diff(offsets)
                n = -(-sizes // room)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(room, sizes[doc] - piece * room)
                begin = offsets[doc] + piece * room
                order = np.argsort(length, kind="stable")
                kinds, first, count = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(first, count) + np.repeat(seen[kinds], count)
                seen[kinds] += count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(offsets[doc] * 0 + piece * room),
                        pa.array(length),
                        pa.array([crc32(ids[a : a + k]) for a, k in zip(begin, length, strict=True)], pa.int64()),
                        pa.array(np.full(len(doc), task), pa.int32()),
                        pa.array(nth),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.IntegerType() if c in ("piece", "task") else T.LongType()) for c in ("piece", "start", "length", "ids_crc32", "task", "nth"))])
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(source, 2000).mapInArrow(encode, schema)  # more texts share more words


#: Patterns of three lengths that the fit sees at most; beyond, every n-th of them is taken.
MOST_TRIPLES = 1 << 15


def patterns_of(lengths: np.ndarray, room: int) -> np.ndarray:
    """Patterns of one, two or three of the lengths (0: none) that fill a sequence exactly. Rows of three,
    descending."""
    there = np.zeros(room + 1, bool)
    there[lengths] = True
    alone = np.array([[room, 0, 0]])[there[room : room + 1]]
    small = lengths[lengths <= room // 2]
    pairs = np.stack([room - small, small, small * 0], 1)[there[room - small]]
    a, b = np.meshgrid(small, lengths[lengths <= room // 3], indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = room - a - b
    ok = (a >= b) & (c >= a) & there[np.clip(c, 0, room)]
    triples = np.unique(np.stack([c[ok], a[ok], b[ok]], 1), axis=0)
    return np.concatenate([alone, pairs, triples[:: -(-len(triples) // MOST_TRIPLES) or 1]]).astype(np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of (pattern lengths used - histogram), by
    projected gradient with momentum. Long lengths weigh more: short ones fill gaps later."""
    bins = len(histogram)
    weight = np.linspace(0.1, 1.0, bins)
    weight[0] = 0.0
    scale = max(histogram.max(), 1)
    target = histogram / scale

    def used(x):
        return sum(np.bincount(patterns[:, j], x, bins) for j in range(3))

    def back(r):
        r = weight**2 * r
        r[0] = 0
        return r[patterns].sum(1)

    v = np.random.default_rng(0).random(len(patterns))
    for _ in range(12):  # the step: one over the largest eigenvalue
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - target) / (1.02 * norm))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x * scale


def best_fit_rest(left: np.ndarray, room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack the lengths that are left, longest first, into the sequence with the least room that holds
    them. Works on counts: (sequences, [(length, times), ...]) per kind of sequence."""
    open_: dict[int, list[list]] = {}  # room left -> [count, contents]
    rooms = np.zeros(room + 1, bool)

    def put(space, count, contents):
        open_.setdefault(space, []).append([count, contents])
        rooms[space] = True

    def grown(contents, length, times):
        return [*contents[:-1], (length, contents[-1][1] + times)] if contents and contents[-1][0] == length else [*contents, (length, times)]

    for length in range(room, 0, -1):
        count = int(left[length])
        while count:
            ahead = rooms[length:]
            at = int(ahead.argmax())
            if ahead[at]:
                space = length + at
                group = open_[space][-1]
                fits = space // length
                if count >= group[0]:
                    times = min(fits, count // group[0])
                    moved, rest = group[0], None
                else:
                    times, moved, rest = 1, count, group[0] - count
                open_[space].pop()
                if rest:
                    open_[space].append([rest, group[1]])
                if not open_[space]:
                    rooms[space] = False
                count -= times * moved
                put(space - times * length, moved, grown(group[1], length, times))
            else:
                times = min(room // length, count)
                moved = count // times
                count -= moved * times
                put(room - times * length, moved, [(length, times)])
    return [(n, contents) for groups in open_.values() for n, contents in groups]


def rounded(patterns: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whole repeats of each pattern within the lengths that are left, which are taken off: the whole part first,
    then one more in the order of the remainders."""
    out, held, kinds = np.zeros(len(patterns), np.int64), left.tolist(), patterns.tolist()

    def take(j: int, most: int) -> None:
        a, b, c = kinds[j]
        n = min([most, *(held[x] // kinds[j].count(x) for x in (a, b, c) if x)])
        if n > 0:
            out[j] += n
            for x in (a, b, c):
                held[x] -= n * (x > 0)

    whole = np.floor(repeats + 1e-6)
    for j in np.argsort(-whole, kind="stable")[: int((whole > 0).sum())].tolist():
        take(j, int(whole[j]))
    rest = repeats - whole
    for j in np.argsort(-rest, kind="stable")[: int((rest > 1e-6).sum())].tolist():
        take(j, 1)
    left[:] = held
    return out


#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)


def plan(histogram: np.ndarray, room: int) -> dict[str, np.ndarray]:
    """Places for all pieces of a length histogram. Of plans that keep a share of the fitted repeats, the largest share
    that needs the fewest sequences. For each length the ranks are cut into runs; a run
    gives each rank the next sequence (or several places of one sequence): arrays length, rank (first of
    the run), sequence (first), offset, times (places of a sequence that the run fills); and sequences, patterned (pieces
    that patterns place)."""
    histogram = histogram.astype(np.int64)
    lengths = np.flatnonzero(histogram)
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    patterned = 0
    if len(lengths):
        patterns = patterns_of(lengths, room)
        repeats = fit_repeats(patterns, histogram)
        least, fewest = -(-int((np.arange(len(histogram)) * histogram).sum()) // room), None
        for share in SHARES:
            left = histogram.copy()
            whole = rounded(patterns, repeats * share, left)
            held = []
            for j in np.flatnonzero(whole):
                kinds, times = np.unique(patterns[j][patterns[j] > 0], return_counts=True)
                held.append((int(whole[j]), list(zip(kinds[::-1].tolist(), times[::-1].tolist(), strict=True))))
            held += best_fit_rest(left, room)
            n = sum(k for k, _ in held)
            if fewest is None or n < fewest:
                groups, fewest, patterned = held, n, int((whole * (patterns > 0).sum(1)).sum())
            if n == least:
                break
    rank, base, rows = np.zeros(room + 1, np.int64), 0, []
    for n, contents in groups:
        offset = 0
        for length, times in contents:
            rows.append((length, rank[length], base, offset, times))
            rank[length] += n * times
            offset += length * times
        base += n
    assert (rank == histogram).all()
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "times"), table.T, strict=True)) | {"sequences": base, "patterned": patterned}


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, room: int = 2048) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id 0; null text counts as empty, so every row has a piece. Only
    documents of more than ``room`` tokens are cut. Places in a sequence are gapless from 0. Repeated
    rows and equal ids are packed like any other rows. An empty table gives an empty result. Extra
    columns are ignored.
    """
    spark = df.sparkSession
    pieces = materialize(length_pieces(df, id_col, text_col, tokenizer or vocabulary("word_bpe_49k.json"), room), "pack-pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(room + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `room` rows
        histogram[length] = n
    places = spark.sparkContext.broadcast(plan(histogram, room))  # runs: a few for each of `room` lengths
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches):
        p = places.value
        step = np.int64(1) << 44
        keys = p["length"] * step + p["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            run = np.searchsorted(keys, length * step + rank, side="right") - 1
            k = rank - p["rank"][run]
            times = p["times"][run]
            sequence, offset = p["sequence"][run] + k // times, p["offset"][run] + k % times * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = T.StructType([*(f for f in ranked.schema.fields if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
