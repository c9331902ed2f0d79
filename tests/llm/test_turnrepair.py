import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from waveloom.llm import turnrepair
from waveloom.llm.turnrepair import CLOSURE, STATES, identity, repair_conversations, repair_damaged, times, turn_matrix

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """The cheapest way by a queue of (cost, audit), over places and what the roles so far may go on with."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    go = lambda said, x: next((c for c in ("s", "su", "sua", "u", "ua") if re.fullmatch(c, re.sub(r"^(s?)(ua)+(?=u)", r"\1", said + x)) or re.fullmatch("s(ua)+|(ua)+", said + x) and c == ("sua" if said[:1] == "s" else "ua")), None)
    queue, done = [(0, "", 0, "", [])], set()
    while True:
        cost, audit, at, said, lines = heapq.heappop(queue)
        if (at, said) in done:
            continue
        done.add((at, said))
        if at == len(rows) and said in ("", "sua", "ua"):
            break
        for role in ("user", "assistant"):
            if (to := go(said, role[0])) is not None:
                heapq.heappush(queue, (cost + 3, audit + "I", at, to, [*lines, f"{role}:"]))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, said, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                if role[:1] and (to := go(said, role[:1])) is not None:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, to, [*lines, f"{role}:{text}"]))
                for other in ("user", "assistant"):
                    if (to := go(said, other[0])) is not None:
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, to, [*lines, f"{other}:{text}"]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=repr)


def wanted(conversations):
    return sorted(((conv, *brute(rows)) for conv, rows in conversations.items()), key=repr)


def cheapest(run, end_states=(0, 3)):
    ways = times(CLOSURE, run)[0]
    return min(ways[e] for e in end_states if ways[e] is not None)


def test_matrices_against_all_edits():
    """Every string of edits with up to two insertions at a place, for all conversations of up to two turns and some of three."""
    for n in range(4):
        cases = list(product(product("suax", repeat=n), product((0, 1, 3), repeat=n)))
        for turns, faults in random.Random(1).sample(cases, min(len(cases), 200)):
            run = identity()
            for turn in zip(turns, faults, strict=True):
                run = times(run, turn_matrix(turn[0] if turn[0] in "sua" else "", turn[1]))
            best = None
            edits = [[("D", "", 4)] + ([] if f == 1 else [("K", r, f), ("R", "u", 3 + f), ("R", "a", 3 + f)]) for r, f in zip(turns, faults, strict=True)]
            for chosen in product(*edits):
                for gaps in product(("", "u", "a", "ua", "au"), repeat=n + 1):
                    said = gaps[0] + "".join(c[1] + g for c, g in zip(chosen, gaps[1:], strict=True))
                    if GRAMMAR.match(said):
                        audit = "I" * len(gaps[0]) + "".join(c[0] + "I" * len(g) for c, g in zip(chosen, gaps[1:], strict=True))
                        found = (sum(c[2] for c in chosen) + 3 * sum(map(len, gaps)), audit)
                        best = found if best is None else min(best, found)
            assert cheapest(run) == best, (turns, faults)


def test_products_in_any_grouping():
    rng = random.Random(5)
    for _ in range(60):
        turns = [turn_matrix(rng.choice(["s", "u", "a", ""]), rng.randrange(4)) for _ in range(9)]
        left = turns[0]
        for m in turns[1:]:
            left = times(left, m)
        parts = list(turns)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [times(parts[i], parts[i + 1])]
        assert parts[0] == left
    assert all(times(identity(), CLOSURE)[i] == CLOSURE[i] for i in STATES)


def conversations(rng, n, longest):
    rows = []
    words = ["Yes.", "no", "", " \t", "What? ", "ok!\n", "ünï", None, "a:b.", "x\ny."]
    for conv in range(n):
        for at in range(rng.randrange(1, longest)):
            turn = rng.choice([at, at, at, at, rng.randrange(12), None])
            rows.append((conv if conv else None, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "Sys", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("chunk", [1024, 3])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(turnrepair, "FAN", 2)
    monkeypatch.setattr(turnrepair, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = conversations(rng, 120, 12) + [(500, i // 3, "user" if i % 2 else "assistant", f"turn {i % 40}.") for i in range(300)] + [(501, 4, "user", "again.")] * 50 + [(502, None, "system", "s.")] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, digest string").repartition(5)
    assert rows_of(repair_damaged(df)) == wanted(damaged(rows))
    plain = defaultdict(list)
    for conv, *row in rows:
        plain[conv].append((row[0], *(" " if v is None else v for v in row[1:])))
    assert rows_of(repair_conversations(df)) == wanted(plain)


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)
    assert rows_of(repair_damaged(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair_damaged(df.where("false")).count() == 0 and repair_damaged(df).columns == COLUMNS


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from waveloom.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = rows_of(QUERIES["op12_turn_repair"](spark, SF))
    want = sorted(c.sql(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op12_turn_repair']})").fetchall(), key=repr)
    assert got == want
    assert got == wanted(damaged([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]))
