import re
from itertools import permutations

import numpy as np
import pytest

from waveloom.llm import filteraudit
from waveloom.llm.filteraudit import BitmapIndex, audit_filters, failures

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs: (id, text, lang); filters applied one after the other to lists of documents."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    fails = []
    for i, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = set()
        if len(words) < 100:
            out.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            out.add("C")
        if re.search(r"[#$%&*|]", t):
            out.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            out.add("E")
        fails.append(out)
    rows, orders = [], list(permutations("ABCDE"))
    for part in {lang or "" for _, _, lang in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in orders:
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(gone)
                failing = sum(f in x[1] for x in own)
                unique = sum(x[1] == {f} for x in own)
                steps.append((f, [part, "".join(order), step, len(left), len(gone), failing - len(gone), unique, sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]))
        rows += [(*r, share[f]) for f, r in steps]
    return sorted(rows)


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def test_against_brute_force(spark, edge_docs):
    words = " ".join(f"w{i}" for i in range(120))
    more = [(20, words, "de"), (21, words, "de"), (19, words, None), (21, words, "de"), (None, words, "de"), (22, words + " A" * 40, None), (23, words + " a#", ""), (24, "X" * 200, "fr"), (2, None, "xx")]
    docs = [(r.doc_id, r.text, r.lang) for r in edge_docs.collect()] + more
    labels = [(1, 1, 0), (2, 0, 1), (20, 1, 1), (21, 1, 0), (21, 0, 1), (22, None, None), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 7, 0) for d in docs], "doc_id long, text string, lang string, bits int, least long")
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(audit_filters(df, of)) == brute(docs, labels)
    assert rows_of(audit_filters(df.repartition(7), of)) == brute(docs, labels)


def test_small_batches_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "PIECE", 50)
    assert filteraudit.word_counts(b"a b  a\n" * 40 + b"x" * 90 + b" y") == (122, 4)
    docs = [(i, ("word%d " % (i % 9)) * (i % 130), f"p{i % 37}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    of = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    assert rows_of(audit_filters(df, of)) == brute(docs, [tuple(r) for r in of.collect()])


def test_bitmap_index():
    rng = np.random.default_rng(3)
    codes, bits = rng.integers(0, 5, 1000) * 3, rng.integers(0, 128, 1000)
    index = BitmapIndex(codes, bits)
    assert list(index.parts) == [0, 3, 6, 9, 12] and index.rows.dtype == np.uint8
    for part, counts in zip(index.parts, index.counts(), strict=True):
        of = bits[codes == part]
        for chosen in range(32):
            left = of[of & chosen == 0]
            assert list(counts[chosen]) == [len(left), (left >> 5 & 1).sum(), (left >> 6 & 1).sum()]


def test_empty_and_thresholds(spark, no_docs):
    of = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(no_docs, of).count() == 0 and audit_filters(no_docs, of).columns == COLUMNS
    assert failures(" ".join(f"w{i}" for i in range(100))) == 0
    assert failures("é" * 9 + "A") == 1 and failures("é" * 8 + "AA") == 5 and failures("a|") == 9


def test_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from waveloom.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = rows_of(QUERIES["op11_filter_bitmaps"](spark, SF))
    assert got == sorted(c.sql(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op11_filter_bitmaps']})").fetchall())
