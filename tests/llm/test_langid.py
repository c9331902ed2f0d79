import zlib

import numpy as np
import pytest

from waveloom.llm import langid
from waveloom.llm.langid import BINS, ORDERS, counts_of, gram_counts, identify, identify_held_out, train
from waveloom.llm.shingles import mix


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, identify_held_out(docs).collect()


def test_held_out_accuracy(found):
    docs, result = found
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(result) == len(lang) == len({r.doc_id for r in result})
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in result)
    right = [r.lang_pred == lang[r.doc_id] for r in result if r.held_out]
    assert len(right) > 150 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in result)


def test_counts_against_brute_force():
    texts = ["", "A", "ab, Cd", "é  x", "123", "naïve ÉTÉ"]
    got = gram_counts(texts)
    for text, row in zip(texts, got, strict=True):
        data = bytes(b if 97 <= b <= 122 or b >= 128 else 0 for b in f" {text.lower()} ".encode())
        want = np.zeros(BINS)
        for n in ORDERS:
            for i in range(len(data) - n + 1):
                g = data[i : i + n]
                if all(g[1:-1]) and (n > 2 or g[0] or g[1]):
                    h = np.array([n << 8 * n | int.from_bytes(g, "big")], np.uint64)
                    want[int(mix(h)[0]) >> 64 - BINS.bit_length() + 1] += 1
        assert (row == want).all(), text


def test_mixtures_are_found(spark, found):
    docs, _ = found
    model = train(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars between 3000 and 6000 and text not like '%&&&%'").orderBy("doc_id").collect()}
    rows = [(1, texts["en"][:2000] + "\n" + texts["fr"][:2000]), (2, texts["de"][:3000] + " " + texts["es"][:1000]), (3, texts["es"])]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    top = lambda r: sorted((k for k, v in r.mixture.items() if v > 0.1), key=r.mixture.get, reverse=True)
    assert sorted(top(got[1])) == ["en", "fr"] and abs(got[1].mixture["en"] - got[1].mixture["fr"]) < 0.25
    assert top(got[2]) == ["de", "es"] and got[2].lang_pred == "de" and got[2].score < 0.9
    assert top(got[3]) == ["es"]


def test_edges(spark, edge_docs, no_docs):
    got = {r.doc_id: r for r in identify_held_out(edge_docs).collect()}
    for i in (2, 3, 6, 11):
        assert (got[i].lang_pred, got[i].score, got[i].mixture) == ("und", 0.0, {})
    assert all(r.lang_pred == "en" for i, r in got.items() if i not in (2, 3, 6, 11))
    assert identify_held_out(no_docs).collect() == []
    none = spark.createDataFrame([(1, "text", None), (None, None, "en")], "doc_id long, text string, lang string")
    assert [(r.doc_id, r.held_out, r.lang_pred) for r in identify_held_out(none).collect()] == [(1, False, "und"), (None, False, "und")]


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "the naïve fox été " * 700
    whole = gram_counts([text])
    monkeypatch.setattr(langid, "PART", 97)
    assert (counts_of([text]) == whole).all()
    assert counts_of(["x" * 1000]).sum() > 2900


def test_numerals_are_no_letters_and_many_labels(spark, monkeypatch):
    rows = [(i, f"word{chr(97 + i % 26)} number text", f"l{i:03}") for i in range(300)] + [(1000, "½ ² ① ٣", None), (1001, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df)
    assert len(model.languages) == 300
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert (got[1000].lang_pred, got[1000].score) == ("und", 0.0) and got[1001].lang_pred in model.languages
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 7)
    assert len(train(df).languages) == 7
