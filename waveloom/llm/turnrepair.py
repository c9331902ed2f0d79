"""Repair of conversation structure by a scan of min-plus matrices.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn. A
matrix has a row and a column per state of that grammar (nothing yet, after system, after user, after
assistant); its element is the cheapest way from one to the other, (cost, audit): audit is the string of edits, and of
equal costs the ASCII-least. A turn's matrix holds its edits, times the closure of insertions. Products are associative,
and among equal costs no audit of the same turns is the start of another, so the least audit of a product is the product
of least audits: turns may be multiplied in any grouping.

Rows are put in order by one range shuffle, so a long conversation lies over many partitions. A conversation
that lies within one is repaired where it stands. Others are cut into chunks of bounded size; each chunk becomes
a matrix, and matrices are multiplied in a tree, some neighbours at a time, until a conversation has one. The audit is
then cut at the chunks' ends, each chunk writes its repaired lines, and a digest runs over these, one chunk after the
other. The first of equal turns is found by minima that are counted map-side.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveloom.llm.common import materialize, worker

# Fixed values of the repair: edits with their costs, faults, the grammar's steps.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
STATES = range(4)
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
BLANKS = " \t\n\x0b\x0c\r"
#: Turns and characters of a chunk at most (a longer text is a chunk of its own), and matrices that are multiplied at a time.
CHUNK, CHUNK_CHARS, FAN = 1024, 1 << 22, 32
#: Characters of role and text by which rows are put in order; equal ones stand in the order of a digest.
PREFIX = 32


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


def times(a: list[list], b: list[list]) -> list[list]:
    """Min-plus product; None is no way."""
    out = []
    for row in a:
        held = [None] * 4
        for k in STATES:
            if (left := row[k]) is not None:
                cost, audit = left
                for j, right in enumerate(b[k]):
                    if right is not None:
                        way = (cost + right[0], audit + right[1])
                        if held[j] is None or way < held[j]:
                            held[j] = way
        out.append(held)
    return out


def identity() -> list[list]:
    return [[(0, "") if i == j else None for j in STATES] for i in STATES]


def inserts() -> list[list]:
    """Closure of insertions: one step, and steps upon steps while they lead further."""
    one = [[(COSTS[INSERT], INSERT) if any(STEPS.get((i, r)) == j for r in "ua") else None for j in STATES] for i in STATES]
    out = identity()
    for _ in STATES:
        more = times(out, one)
        out = [[least(out[i][j], more[i][j]) for j in STATES] for i in STATES]
    return out


CLOSURE = inserts()
_turns: dict[tuple[str, int], list[list]] = {}


def turn_matrix(initial: str, fault: int) -> list[list]:
    """Edits of a turn, and what may be inserted behind it. An initial that the grammar lacks cannot be kept."""
    known = _turns.get((initial, fault))
    if known is None:
        edits = [[None] * 4 for _ in STATES]
        extra = TRUNCATED_COST * (fault == TRUNCATED)
        for i in STATES:
            edits[i][i] = (COSTS[DELETE], DELETE)
            if fault in (SOUND, TRUNCATED):
                for edit, role in ((KEEP, initial), (REROLE, "u"), (REROLE, "a")):
                    if (j := STEPS.get((i, role))) is not None:
                        edits[i][j] = least(edits[i][j], (COSTS[edit] + extra, edit))
        known = _turns[initial, fault] = times(edits, CLOSURE)
    return known


@dataclass
class Run:
    """Successive turns of a conversation: the product of their matrices and what else adds up."""

    ways: list[list] = field(default_factory=identity)
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    distinct: int = 0
    first: str | None = None
    last: str | None = None
    illegal: int = 0
    faults: list[int] = field(default_factory=lambda: [0] * 4)
    #: (partition, chunk, turns) of the chunks it is made of.
    chunks: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.ways = times(self.ways, turn_matrix(initial if initial in ("s", "u", "a") else "", fault))
        self.illegal += self.last is not None and self.last + initial not in LEGAL_PAIRS
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.faults[fault] += 1
        self.turns += 1
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def join(self, other: Run) -> None:
        """The run with one that follows it."""
        self.ways = times(self.ways, other.ways)
        self.illegal += other.illegal + (self.last is not None and other.first is not None and self.last + other.first not in LEGAL_PAIRS)
        self.distinct += other.distinct - (self.last_turn is not None and self.last_turn == other.first_turn)
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if other.last_turn is None else other.last_turn
        self.faults = [a + b for a, b in zip(self.faults, other.faults, strict=True)]
        self.turns += other.turns
        self.chunks += other.chunks

    def result(self) -> dict:
        """Counts of the conversation, and the cheapest way from nothing to an end."""
        ways = times(CLOSURE, self.ways)[0]
        cost, audit = min(ways[e] for e in ENDS if ways[e] is not None)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": audit}


def plain_fault(text: str) -> int:
    """Blank, truncated or sound, whatever came before."""
    held = text.rstrip(BLANKS)
    return BLANK if not held else SOUND if held[-1] in ".!?" else TRUNCATED


def repaired_lines(audit: str, turns, kept: int, odd: int) -> list[str]:
    """``role:text`` of the turns of a stretch after its edits. kept: turns that the repaired conversation has
    before it; odd: 1 if it begins with a system turn. Roles alternate, so a turn's place tells its role."""
    out, rows = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit != DELETE:
            if edit != KEEP:
                role = "assistant" if (kept - odd) % 2 else "user"
            out.append(f"{role}:{text}")
            kept += 1
    return out


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): rows after the damage that crc32 of ``conv:turn`` picks. A dropped row stays as a
    mark of its conversation (gone), without its text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv_col), F.lit(":"), word(turn_col))) % 20
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, F.lit("")).when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversation and turn over the partitions and within each. Keys are short whatever the
    texts are. Rows that are equal in all are told apart by their number, so a row that is repeated any number of times
    is dealt over partitions as well."""
    keyed = rows.withColumn("_role", F.substring("role", 1, PREFIX)).withColumn("_text", F.substring("text", 1, PREFIX)).withColumn("_digest", F.md5(F.concat_ws("\0", "role", "text"))).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["conv", "turn", "_role", "_text", "_digest", "_salt"]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "gone")


def _turn_digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


CHUNK_FIELDS = "part int, chunk int, turns array<long>, initials array<string>, faults array<int>, digests array<binary>, roles array<string>, texts array<string>"


def repaired_or_chunks(ordered: DataFrame) -> DataFrame:
    """Rows of two kinds from a stream of turns in order: results of conversations that lie within their
    partition and one chunk (part is null), and chunks of all others."""
    conv = ordered.schema["conv"].dataType
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    names = ["part", "chunk", "turns", "initials", "faults", "digests", "roles", "texts", *COUNTS, "audit", "repaired_sha256"]

    def whole(rows) -> dict:
        run, seen, kept = Run(), set(), []
        for turn, role, text in rows:
            fault = plain_fault(text)
            if fault != BLANK and (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
            run.add(turn, role[:1], fault)
            kept.append((role, text))
        out = run.result()
        lines = repaired_lines(out["audit"], kept, 0, (len(out["audit"]) - out["audit"].count(DELETE)) % 2)
        return out | {"repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

    def chunk_of(rows, number: int) -> dict:
        return {
            "part": TaskContext.get().partitionId(), "chunk": number,
            "turns": [r[0] for r in rows], "initials": [r[1][:1] for r in rows], "faults": [plain_fault(r[2]) for r in rows],
            "digests": [_turn_digest(r[1], r[2]) for r in rows], "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
        }

    @worker
    def run(batches):
        out, rows, chars, number = [], [], 0, 0
        now, ids, held, first, cut = None, None, 0, True, False

        def close(last: bool):
            nonlocal rows, chars, number, held
            if first or cut or last:
                out.append((ids, chunk_of(rows, number)))
                number += 1
            else:
                out.append((ids, whole(rows)))
            held += chars + 100
            rows, chars = [], 0

        def ready():
            nonlocal out, held
            done = pa.RecordBatch.from_arrays([pa.concat_arrays([i for i, _ in out]), *(pa.array([r.get(n) for _, r in out], t) for n, t in zip(names, kinds, strict=True))], ["conv", *names])
            out, held = [], 0
            return done

        for batch in batches:
            convs = batch.column("conv")
            for at, (conv_id, turn, role, text, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone")), strict=True)):
                if ids is None or conv_id != now:
                    if ids is not None:
                        close(False)
                        first = cut = False
                    now, ids = conv_id, convs.slice(at, 1)
                if not gone:
                    if len(rows) >= CHUNK or chars and chars + len(text) > CHUNK_CHARS:
                        cut = True
                        close(False)
                    rows.append((turn, role, text))
                    chars += len(text)
                if held > CHUNK_CHARS:
                    yield ready()
        if ids is not None:
            close(True)
            yield ready()

    return ordered.mapInArrow(run, f"conv {conv.simpleString()}, {CHUNK_FIELDS}, {RESULT}")


RUN_FIELDS = "costs array<long>, audits array<string>, n long, first_turn long, last_turn long, distinct long, first string, last string, illegal long, faults array<long>, chunks array<struct<part:int,chunk:int,turns:long>>"
_RUN_TYPES = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("part", pa.int32()), ("chunk", pa.int32()), ("turns", pa.int64())]))]
_RUN_NAMES = ["costs", "audits", "n", "first_turn", "last_turn", "distinct", "first", "last", "illegal", "faults", "chunks"]


def _run_values(run: Run) -> list:
    flat = [way for row in run.ways for way in row]
    chunks = [dict(zip(("part", "chunk", "turns"), c, strict=True)) for c in run.chunks]
    return [[None if w is None else w[0] for w in flat], [None if w is None else w[1] for w in flat], run.turns, run.first_turn, run.last_turn, run.distinct, run.first, run.last, run.illegal, run.faults, chunks]


def _as_run(row: dict) -> Run:
    flat = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]
    return Run([flat[4 * i : 4 * i + 4] for i in STATES], row["n"], row["first_turn"], row["last_turn"], row["distinct"], row["first"], row["last"], row["illegal"], list(row["faults"]), [(c["part"], c["chunk"], c["turns"]) for c in row["chunks"]])


def chunk_runs(chunks: DataFrame) -> DataFrame:
    """(conv, part, chunk, run): the matrix of every chunk. The first of a conversation's equal turns is the least
    place among them, counted map-side; its chunk gets it back by its own key, which no other chunk has."""
    place = F.struct("part", "chunk", "at")
    turns = chunks.select("conv", "part", "chunk", F.posexplode("digests").alias("at", "digest"))
    firsts = turns.groupBy("conv", "digest").agg(F.min(place).alias("p")).select("p.*").groupBy("part", "chunk").agg(F.collect_list("at").alias("firsts"))
    conv = chunks.schema["conv"].dataType.simpleString()

    @worker
    def run(batches):
        for batch in batches:
            runs = []
            for turns, initials, faults, firsts in zip(*(batch.column(c).to_pylist() for c in ("turns", "initials", "faults", "firsts")), strict=True):
                new, own = set(firsts or ()), Run()
                for at, (turn, initial, fault) in enumerate(zip(turns, initials, faults, strict=True)):
                    own.add(turn, initial, fault if fault == BLANK or at in new else DUPLICATE)
                runs.append(own)
            for own, part, chunk in zip(runs, batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                own.chunks = [(part, chunk, own.turns)]
            columns = list(zip(*map(_run_values, runs), strict=True)) or [()] * len(_RUN_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("chunk"), *(pa.array(list(c), t) for c, t in zip(columns, _RUN_TYPES, strict=True))], ["conv", "part", "chunk", *_RUN_NAMES])

    narrow = chunks.select("conv", "part", "chunk", "turns", "initials", "faults").join(firsts, ["part", "chunk"], "left")
    return narrow.select("conv", "part", "chunk", "turns", "initials", "faults", "firsts").mapInArrow(run, f"conv {conv}, part int, chunk int, {RUN_FIELDS}")


def multiplied(runs: DataFrame, part, chunk) -> DataFrame:
    """One step of the tree: neighbours of a conversation with the same (part, chunk) become one run. They are as many as
    the step takes, and stream past in order."""
    conv = runs.schema["conv"].dataType.simpleString()
    keyed = runs.withColumn("_part", part).withColumn("_chunk", chunk)
    placed = keyed.repartition("conv", "_part", "_chunk").sortWithinPartitions("conv", "_part", "_chunk", "part", "chunk")

    @worker
    def run(batches):
        now, total, head = None, None, None

        def ready():
            return pa.RecordBatch.from_arrays([*head, *(pa.array([v], t) for v, t in zip(_run_values(total), _RUN_TYPES, strict=True))], ["conv", "part", "chunk", *_RUN_NAMES])

        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                key = row["conv"], row["_part"], row["_chunk"]
                if total is not None and key == now:
                    total.join(_as_run(row))
                    continue
                if total is not None:
                    yield ready()
                now, total, head = key, _as_run(row), [batch.column(c).slice(at, 1) for c in ("conv", "_part", "_chunk")]
        if total is not None:
            yield ready()

    return placed.mapInArrow(run, f"conv {conv}, part int, chunk int, {RUN_FIELDS}")


def tree_product(runs: DataFrame) -> DataFrame:
    """One run per conversation: chunks of a partition are multiplied FAN at a time, then partitions."""
    runs = materialize(runs, "repair-runs")
    most = runs.agg(F.max("chunk").alias("chunk"), F.max("part").alias("part")).first()
    for column, left in (("chunk", most.chunk or 0), ("part", most.part or 0)):
        while left:
            left //= FAN
            fewer = F.expr(f"cast({column} div {FAN} as int)")
            # chunks of one number in different partitions stay apart until partitions are taken together
            step = (F.col("part"), fewer) if column == "chunk" else (fewer, F.lit(0))
            runs = materialize(multiplied(runs, *step), "repair-runs")
    return runs


def long_conversations(chunks: DataFrame) -> DataFrame:
    """(conv, results) of conversations in chunks."""
    conv_type = chunks.schema["conv"].dataType
    conv = conv_type.simpleString()
    whole = tree_product(chunk_runs(chunks))

    @worker
    def results(batches):
        names = ["conv", *COUNTS, "audit", "slices"]
        slice_type = pa.list_(pa.struct([("part", pa.int32()), ("chunk", pa.int32()), ("edits", pa.string()), ("kept", pa.int64()), ("odd", pa.int32())]))
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                own = _as_run(row)
                found = own.result()
                edits = np.frombuffer(found["audit"].encode(), np.uint8)
                starts = np.append(np.flatnonzero(edits != ord(INSERT)), len(edits))
                kept = np.concatenate([[0], np.cumsum(edits != ord(DELETE))])
                slices, turns, at = [], 0, 0
                for part, chunk, n in own.chunks:
                    turns += n
                    stop = int(starts[turns])
                    slices.append({"part": part, "chunk": chunk, "edits": found["audit"][at:stop], "kept": int(kept[at]), "odd": int(kept[-1] % 2)})
                    at = stop
                rows.append([*(found[c] for c in COUNTS), found["audit"], slices])
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(list(c), t) for c, t in zip(columns, [*[pa.int64()] * len(COUNTS), pa.string(), slice_type], strict=True))], names)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    found = materialize(whole.mapInArrow(results, f"conv {conv}, {counts}, audit string, slices array<struct<part:int,chunk:int,edits:string,kept:long,odd:int>>"), "repair-long")

    @worker
    def lines(batches):
        for batch in batches:
            texts = [repaired_lines(edits, zip(roles, texts, strict=True), kept, odd) for roles, texts, edits, kept, odd in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "edits", "kept", "odd")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("chunk"), pa.array([len(t) for t in texts], pa.int32()), pa.array(["\n".join(t) for t in texts], pa.string())], ["conv", "part", "chunk", "n", "lines"])

    slices = found.select(F.explode("slices").alias("s")).select("s.*")
    written = chunks.select("conv", "part", "chunk", "roles", "texts").join(slices, ["part", "chunk"]).select("conv", "part", "chunk", "roles", "texts", "edits", "kept", "odd")
    written = written.mapInArrow(lines, f"conv {conv}, part int, chunk int, n int, lines string")
    placed = written.repartition("conv").sortWithinPartitions("conv", "part", "chunk")

    @worker
    def digests(batches):
        now, ids, total, begun = None, None, None, False

        def ready():
            return pa.RecordBatch.from_arrays([ids, pa.array([total.hexdigest()], pa.string())], ["of", "repaired_sha256"])

        for batch in batches:
            convs = batch.column("conv")
            for at, (conv_id, n, text) in enumerate(zip(convs.to_pylist(), batch.column("n").to_pylist(), batch.column("lines").to_pylist(), strict=True)):
                if ids is None or conv_id != now:
                    if ids is not None:
                        yield ready()
                    now, ids, total, begun = conv_id, convs.slice(at, 1), hashlib.sha256(), False
                if n:
                    total.update(("\n" * begun + text).encode())
                    begun = True
        if ids is not None:
            yield ready()

    hashed = placed.mapInArrow(digests, T.StructType([T.StructField("of", conv_type), T.StructField("repaired_sha256", T.StringType())]))
    return found.join(hashed, F.col("conv").eqNullSafe(F.col("of"))).select("conv", *COUNTS, "audit", "repaired_sha256")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv, turn, role, text, gone): gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Turns stand in the order of ``turn``, nulls first; those of one turn by role and text, so repeated rows are
    neighbours. A row's first fault counts: blank, duplicate (role and text stood before), truncated. Roles are told by
    their first character; a role that is empty or begins otherwise than s, u, a cannot be kept. Rows marked gone only
    name their conversation: one without other rows has zeros, an empty audit and the digest of nothing. A null
    conversation is one of its own. An empty table gives an empty result.
    """
    first = materialize(repaired_or_chunks(_ordered(rows)), "repair-turns")
    short = first.where("part is null").select("conv", *COUNTS, "audit", "repaired_sha256")
    return short.unionByName(long_conversations(first.where("part is not null")))


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`repair` of conversations as they are; null roles and texts are one space, other columns are ignored."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"), F.lit(False).alias("gone"))
    return repair(rows).withColumnRenamed("conv", conv_col)


def repair_damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`repair` of conversations after :func:`damage`: a row for every conversation of the table."""
    return repair(damage(df, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv", conv_col)
