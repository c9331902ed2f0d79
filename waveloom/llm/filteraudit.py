"""How document filters interact: what each removes in every order of application.

A table of documents becomes narrow rows of bits: which filters a document fails, which labels it has. Each task
packs its rows into a bitmap index: a bitset per filter and per label, and for each part a run of bytes of its
own, so a part's bitset is that run. For each of the 32 sets of filters the documents that pass them all are an
AND-NOT of bitsets, and counts are popcounts by part. Counts of tasks are summed; all 120 orders are read off the sums,
as what is left after some filters does not depend on their order.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveloom.llm.common import materialize, spread, worker

# Fixed values of the audit: filters by letter, thresholds, characters.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_HUNDREDTHS, CAPITAL_HUNDREDTHS = 100, 80, 10
CAPITALS = bytes(range(65, 91))
SIGNS = re.compile(rb"[#$%&*|]")
#: Places of the bits of a row: filters, then labels.
GOOD, TOXIC = 5, 6
SETS = 1 << len(FILTERS)
#: Rows that are indexed together, parts that a task sums before it hands them on, and bytes of text split at a time.
ROWS, PARTS, PIECE = 1 << 16, 10_000, 1 << 22
#: A text is frequent if it is this share of all rows or more: there are no more frequent texts than that.
FREQUENT = 1024


def word_counts(data: bytes) -> tuple[int, int]:
    """(words, distinct words) of UTF-8 text; a long one is split in pieces, cut at blanks."""
    if len(data) <= PIECE:
        words = data.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    blank = re.compile(rb"[\x20\x09-\x0D]")
    while at < len(data):
        found = blank.search(data, at + PIECE)
        cut = found.end() if found else len(data)
        words = data[at:cut].split()
        n, at = n + len(words), cut
        seen.update(words)
    return n, len(seen)


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    data = text.encode()
    words, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (words < LEAST_WORDS) | (100 * distinct < DISTINCT_HUNDREDTHS * words) << 1 | (100 * capitals > CAPITAL_HUNDREDTHS * len(text)) << 2 | (SIGNS.search(data) is not None) << 3


def scan_failures(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, bits, high, low) per row: one reading of the texts; high and low are a 128-bit digest."""

    @worker
    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            digests = b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts)
            words = np.frombuffer(digests, "<i8").reshape(-1, 2)
            bits = pa.array([failures(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), bits, pa.array(words[:, 0]), pa.array(words[:, 1])], ["id", "part", "bits", "high", "low"])

    id_type = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text")))
    return rows.mapInArrow(scan, f"id {id_type}, part string, bits int, high long, low long")


def mark_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with the bit of E set where a smaller id has the same text. Smallest ids are counted map-side; texts that
    are at least a 1024th of all rows, so at most 1024, are broadcast, all others joined on their digest."""
    several = rows.groupBy("high", "low").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = materialize(several, "audit-copies")
    total = rows.count()
    copy = F.when(F.col("id") > F.col("least"), F.lit(16)).otherwise(0)
    bits = (F.col("bits").bitwiseOR(copy)).alias("bits")
    frequent = several.where(F.col("n") * FREQUENT >= total).select("high", "low", "least")
    rest = several.where(F.col("n") * FREQUENT < total).select("high", "low", "least")
    marked = rows.join(F.broadcast(frequent), ["high", "low"], "left")
    known = marked.where("least is not null").select("id", "part", bits)
    others = marked.where("least is null").drop("least").join(rest, ["high", "low"], "left").select("id", "part", bits)
    return known.unionByName(others)


def mark_labels(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (id, part, bits) with the bits of the labels. An id that is labelled more than once has a label if any row
    says so; null ids have none."""
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    more = (F.coalesce("good", F.lit(0)) * (1 << GOOD)).bitwiseOR(F.coalesce("toxic", F.lit(0)) * (1 << TOXIC))
    named = rows.where("id is not null").join(of, "id", "left").select("part", F.col("bits").bitwiseOR(more).alias("bits"))
    return named.unionByName(rows.where("id is null").select("part", "bits"))


class BitmapIndex:
    """Bitsets of rows with a part code and bits each. Rows stand in the order of their parts, and every part begins
    at a byte: its bitset is the run of bytes from its start to the next one's. Spare bits are 0 everywhere."""

    def __init__(self, codes: np.ndarray, bits: np.ndarray):
        self.parts, sizes = np.unique(codes, return_counts=True)
        runs = (sizes + 7) // 8
        self.starts = np.cumsum(runs) - runs
        order = np.argsort(codes, kind="stable")
        self._at = np.repeat(self.starts * 8 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))
        self._n = int(runs.sum()) * 8
        self.rows = self._packed(np.ones(len(codes), bool))
        self.planes = [self._packed((bits[order] >> b & 1).astype(bool)) for b in range(TOXIC + 1)]

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        spread_out = np.zeros(self._n, bool)
        spread_out[self._at] = flags
        return np.packbits(spread_out)

    def counts(self) -> np.ndarray:
        """parts x sets x (rows, good, toxic) that fail none of the set's filters."""
        out = np.empty((len(self.parts), SETS, 3), np.int64)
        passing: list[np.ndarray] = [self.rows]
        for chosen in range(SETS):
            if chosen:
                last = chosen.bit_length() - 1
                passing.append(passing[chosen ^ 1 << last] & ~self.planes[last])
            for k, among in enumerate((None, self.planes[GOOD], self.planes[TOXIC])):
                held = passing[chosen] if among is None else passing[chosen] & among
                out[:, chosen, k] = np.add.reduceat(np.bitwise_count(held).astype(np.int64), self.starts)
        return out


def index_counts(rows: DataFrame) -> DataFrame:
    """(part, chosen, rows, good, toxic): documents of a part that fail none of a set of filters (its bits)."""

    @worker
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        held, n = [], 0

        def indexed():
            parts = pa.concat_arrays([b.column("part") for b in held]).dictionary_encode()
            codes, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
            index = BitmapIndex(codes, np.concatenate([b.column("bits").to_numpy() for b in held]))
            for code, counts in zip(index.parts, index.counts(), strict=True):
                name = names[code]
                sums[name] = sums[name] + counts if name in sums else counts

        def out():
            names, table = list(sums), np.stack(list(sums.values())).reshape(-1, 3)
            sums.clear()
            sets = np.tile(np.arange(SETS, dtype=np.int32), len(names))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), SETS), pa.string()), pa.array(sets), *(pa.array(table[:, k]) for k in range(3))], ["part", "chosen", "rows", "good", "toxic"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS:
                indexed()
                held, n = [], 0
                if len(sums) >= PARTS:
                    yield out()
        if held:
            indexed()
        if sums:
            yield out()

    partial = rows.select("part", "bits").mapInArrow(run, "part string, chosen int, rows long, good long, toxic long")
    return partial.groupBy("part", "chosen").agg(*[F.sum(c).alias(c) for c in ("rows", "good", "toxic")])


def order_steps(spark) -> DataFrame:
    """(filter_order, step, filter, before): the 600 steps of all orders; before has the bits of the filters before."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def order_report(counts: DataFrame) -> DataFrame:
    """A row per part, order and step of :func:`index_counts`: one row of 32 counts a part, then its 80 pairs of a filter
    and what came before it, then the steps that are such a pair."""
    cell = F.struct("chosen", "rows", "good", "toxic")
    of = counts.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c).alias("c"))
    kept = lambda chosen, name="rows": F.col("c")[chosen][name]
    every, n = SETS - 1, len(FILTERS)
    shares = []
    for f in range(n):
        sets = [s for s in range(SETS) if not s >> f & 1]
        weight = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
        shares.append(sum((kept(s) - kept(s | 1 << f)) * weight(s) for s in sets))
    pairs = F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(s).alias("before")) for f in range(n) for s in range(SETS) if not s >> f & 1])
    wide = of.select("part", "c", F.array(*shares).alias("shares"), F.explode(pairs).alias("p")).select("*", "p.*")
    this = F.lit(1).cast("int")
    own = F.call_function("shiftleft", this, F.col("filter"))
    after = F.col("before").bitwiseOR(own)
    removed = kept(F.col("before")) - kept(after)
    rows = wide.select(
        "part", "filter", "before",
        kept(after).alias("kept"),
        removed.alias("removed"),
        (kept(F.lit(0)) - kept(own) - removed).alias("redundant"),
        (kept(F.lit(every).bitwiseXOR(own)) - kept(F.lit(every))).alias("unique_fails"),
        (kept(F.col("before"), "good") - kept(after, "good")).alias("good_lost"),
        (kept(F.col("before"), "toxic") - kept(after, "toxic")).alias("toxic_lost"),
        F.col("shares")[F.col("filter")].alias("shapley"),
    )
    steps = F.broadcast(order_steps(counts.sparkSession))
    return rows.join(steps, ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    Documents fail A with fewer than 100 words, B if distinct words are under 80 in 100, C if capitals are over 10 in 100
    characters, D with one of ``#$%&*|``, E if a smaller id has the same text. A null text is empty, a null part is
    ''. Rows that repeat an id and its text are documents of their own, and none of them is smaller than another; a null
    id is neither smaller nor larger than any, and has no label. Labels of unknown ids are ignored, null labels are none.
    Other columns are ignored. A part of one document has its 600 rows, an empty table none.
    """
    rows = materialize(scan_failures(df, id_col, text_col, part_col), "audit-rows")
    marked = mark_labels(mark_copies(rows), labels, id_col)
    return order_report(materialize(index_counts(marked), "audit-counts"))
