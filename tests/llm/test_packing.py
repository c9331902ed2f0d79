import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waveloom.llm.packing import best_fit_rest, fit_repeats, length_pieces, pack, patterns_of, plan
from waveloom.llm.tokens import vocabulary


def pieces(rows, room):
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k, a, len(ids[a : a + room]), zlib.crc32(ids[a : a + room].tobytes())) for k, a in enumerate(range(0, len(ids), room))]
    return sorted(out)


def check(rows, result, room):
    assert sorted(tuple(r)[:5] for r in result) == pieces(rows, room)
    places = defaultdict(list)
    for r in result:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= room
    return len(places)


@pytest.mark.parametrize("room", [16, 2048])
def test_pieces_and_places(spark, edge_docs, docs, room):
    for df in (edge_docs, docs, edge_docs.union(edge_docs)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        result = pack(df.repartition(5), room=room).collect()
        n, total = check(rows, result, room), sum(r.length for r in result)
        if len(rows) > 100:
            assert n <= 1.03 * -(-total // room) + 1


def test_empty(no_docs):
    assert pack(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(0, 50), max_size=24))
def test_plan_fills_every_rank_once(counts):
    histogram = np.zeros(25, np.int64)
    for k, n in counts.items():
        histogram[k] = n
    p = plan(histogram, 24)
    places = defaultdict(list)
    for length in range(25):
        runs = np.flatnonzero(p["length"] == length)
        for rank in range(histogram[length]):
            j = runs[np.searchsorted(p["rank"][runs], rank, side="right") - 1]
            k, times = rank - p["rank"][j], p["times"][j]
            places[p["sequence"][j] + k // times].append((p["offset"][j] + k % times * length, length))
    assert sorted(places) == list(range(p["sequences"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 24


def test_least_squares_finds_an_exact_mix():
    lengths = np.array([3, 5, 7, 10])
    patterns = patterns_of(lengths, 10)
    histogram = np.zeros(11)
    histogram[[3, 7, 5, 10]] = 40, 40, 20, 6
    x = fit_repeats(patterns, histogram, 3000)
    used = sum(np.bincount(patterns[:, j], x, 11) for j in range(3))[1:]
    assert np.abs(used - histogram[1:]).max() < 0.5 and x.min() >= 0


def test_patterns_place_most_pieces(spark):
    """On a table of documents most pieces that leave room are placed by fitted patterns, in no more
    sequences than the best fit alone needs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    histogram = np.zeros(2049, np.int64)
    for length, n in length_pieces(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"), 2048).groupBy("length").count().collect():
        histogram[length] = n
    p = plan(histogram, 2048)
    open_, full = int(histogram[:2048].sum()), int(histogram[2048])
    assert p["patterned"] - full > 0.6 * open_
    assert p["sequences"] <= sum(n for n, _ in best_fit_rest(histogram.copy(), 2048))


def test_special_tokens_and_words_of_all_kinds(spark):
    texts = ["a<|endoftext|>b <|startoftext|> c", "<|endoftext|>", "İ, É. ÀÉÎ naïve; Straße ﬁ Ǆ e\u0301, don't x_y", "aaaaaaa bananas anananan", "1234 abc123 a.b, c.,"]
    rows = [(i, t) for i, t in enumerate(texts)]
    check(rows, pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 2048)
