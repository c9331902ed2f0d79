import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from waveloom.llm import lmscore
from waveloom.llm.lmscore import BASE, DISCOUNT, TAILS, fit, score, score_held_out, token_slices

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute(docs):
    counts = Counter(w for i, t in docs if not held_out(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    rows = []
    for i, text in docs:
        tokens = tokens_of(text)
        rows.append((i, held_out(i), len(tokens), sum(w in counts for w in tokens), n, sum(math.log10((counts[w] + BASE) / (n + BASE * (v + 1))) for w in tokens)))
    return rows


def same(got, want):
    by = lambda rows: sorted(rows, key=lambda r: repr((r[:5], round(r[5], 6))))
    got, want = by(got), by(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


def rows_of(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def test_counts_against_brute_force(spark, docs, edge_docs):
    for df in (docs, edge_docs.select("doc_id", "text").union(spark.createDataFrame([(None, "the quick new"), (1, "the quick brown fox jumps over the lazy dog"), (4, "")], "doc_id long, text string"))):
        same(rows_of(score_held_out(df)), brute([(r.doc_id, r.text) for r in df.collect()]))


def test_tokens_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "Bc", "déf", "GHIJ", "x" * 30, "\t", "\x0b"], rng.integers(0, 60))).encode() for _ in range(40)] + [b"", b" ", b"lone"]
    whole = [list(token_slices([t])) for t in texts]
    flat = lambda parts, name: np.concatenate([getattr(p, name) for p in parts])
    together = list(token_slices(texts))
    monkeypatch.setattr(lmscore, "SLICE", 20)
    cut = list(token_slices(texts))
    assert len(cut) > len(texts)
    for name in ("word", "tail", "before", "second"):
        want = np.concatenate([flat(p, name) for p in whole])
        assert (flat(together, name) == want).all() and (flat(cut, name) == want).all()
    assert (flat(together, "row") == flat(cut, "row")).all()
    words = [w for t in texts for w in tokens_of(t.decode())]
    assert len(words) == len(flat(cut, "word")) and len(set(words)) == len(set(flat(cut, "word").tolist()))


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    t = next(iter(token_slices([b"the cat sat on the mat and the dog sat on the cat", b"a dog", b""])))
    heads = np.sort(np.unique(t.word)[:3])
    model = lmscore.ClassModel(heads, rng.normal(size=(9, 3 + TAILS)))
    total = np.zeros(model.weights.shape)
    model.add_gradient(t, total)
    for i, k in zip(rng.integers(0, 9, 60), rng.integers(0, 3 + TAILS, 60), strict=True):
        sides = []
        for d in (1e-5, -1e-5):
            w = model.weights.copy()
            w[i, k] += d
            sides.append(lmscore.ClassModel(heads, w).log_probability(t).sum())
        assert abs((sides[0] - sides[1]) / 2e-5 - total[i, k]) < 1e-5
    counts = np.zeros(model.weights.shape)
    model.add_counts(t, counts)
    assert counts[8].sum() == len(t.word) and counts[:8].sum() == 3 * len(t.word)


@pytest.fixture(scope="module")
def fitted(docs):
    return fit(docs)


def test_scores_are_those_of_the_model(spark, docs, fitted):
    """Token by token from the table of counts and the weights."""
    model = fitted
    counts = {r.word: r.n for r in model.vocabulary.collect()}
    heads = set(model.classes.heads.tolist())
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    for r in docs.where("doc_id % 5 = 0").collect():
        total = 0.0
        for t in token_slices([(r.text or "").encode()]):
            total += model.classes.log_probability(t).sum() / math.log(10)
            for word, tail in zip(t.word.tolist(), t.tail.tolist(), strict=True):
                n = counts.get(np.uint64(word).astype(np.int64).item(), 0)
                if word not in heads:
                    total += math.log10((n - DISCOUNT) / model.tail_tokens[tail]) if n else model.unknown()[tail]
        assert abs(total - got[r.doc_id]) < 1e-3 + 1e-6 * abs(total)


def test_probabilities_sum_to_one(fitted):
    model, rng = fitted, np.random.default_rng(1)
    heads = set(model.classes.heads.tolist())
    rows = [(np.int64(r.word).astype(np.uint64), r.tail, r.n) for r in model.vocabulary.collect()]
    words = np.array([w for w, _, _ in rows], np.uint64)
    tails = np.array([t for _, t, _ in rows], np.uint8)
    within = np.array([1.0 if w.item() in heads else (n - DISCOUNT) / model.tail_tokens[t] for w, t, n in rows])
    unseen = np.uint64(12345)
    for _ in range(5):
        before, second = rng.choice(words, 2)
        fill = lambda x, n: np.full(n, x, np.uint64)
        known = lmscore.Tokens(np.zeros(len(words), int), words, tails, fill(before, len(words)), fill(second, len(words)))
        others = lmscore.Tokens(np.zeros(TAILS, int), fill(unseen, TAILS), np.arange(TAILS, dtype=np.uint8), fill(before, TAILS), fill(second, TAILS))
        mass = (np.exp(model.classes.log_probability(known)) * within).sum() + (np.exp(model.classes.log_probability(others)) * 10 ** model.unknown()).sum()
        assert abs(mass - 1) < 1e-5


def test_context_helps_on_held_out_text(spark):
    """Words that follow each other in a fixed way: the model finds it, and text in that order scores above the same
    words in another."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    chain = lambda n: " ".join(words[(k + i) % 40] for k in [int(rng.integers(40))] for i in range(n))
    rows = [(i, chain(80)) for i in range(300)]
    tested = [i for i in range(300, 2000) if held_out(i)][:40]
    mixed = [(i, " ".join(rng.permutation(chain(80).split()))) for i in tested]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string")
    got = {r.doc_id: r for r in score_held_out(df).collect()}
    mean = lambda ids, name: np.mean([got[i][name] for i in ids])
    in_order = [i for i in range(300) if held_out(i)]
    assert mean(in_order, "score") > mean(in_order, "base_score") + 40 and mean(in_order, "score") > mean(tested, "score") + 40


def test_model_beats_unigrams_on_held_out_documents(docs, fitted):
    rows = [r for r in score(docs, fitted).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_and_untrained(spark, no_docs):
    assert score_held_out(no_docs).count() == 0 and score_held_out(no_docs).columns == [*COLUMNS, "score"]
    only = next(i for i in range(100) if held_out(i))
    row = score_held_out(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert row.n_tokens == 3 and row.n_known == row.train_tokens == row.base_score == 0 and math.isfinite(row.score)
