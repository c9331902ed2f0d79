import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_ngramjoin import brute as components
from test_packing import check

from waveloom.llm.langid import identify, train
from waveloom.llm.linededup import dedup_lines

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(5000, "1234 !!! 99", "en", "s", 11), (5001, "Это текст на русском языке, которого нет в обучении. " * 5, None, "s", 250), (5002, None, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(junk)
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        before = after

    rows, left = kept["language_id"]
    model = train(docs)
    pred = {r.doc_id: r for r in identify(docs, model).collect()}
    want = {r.doc_id for r in rows if pred[r.doc_id].lang_pred != "und" and sum(pred[r.doc_id].mixture.values()) >= 0.2}
    assert {r.doc_id for r in left} == want and {r.doc_id for r in rows} - want == {5000, 5001, 5002}
    assert {r.doc_id: r.text for r in left} == {r.doc_id: r.text for r in rows if r.doc_id in want}

    rows, left = kept["line_dedup"]
    lines = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows)).collect()}
    assert {r.doc_id: r.text for r in left} == {i: r.text for i, r in lines.items() if not r.dropped or r.text.strip()}
    assert all(r.n_chars == len(r.text) for r in left if lines[r.doc_id].dropped)
    assert sum(len(r.dropped) for r in lines.values()) > 10

    rows, left = kept["ngram_join"]
    of = {i: c for i, _, c in components([(r.doc_id, r.text) for r in rows])}
    assert {r.doc_id for r in left} == {i for i, c in of.items() if i == c}

    rows, left = kept["packing"]
    check([(r.doc_id, r.text) for r in rows], left, 2048)


def test_empty_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_with_null_ids_and_repeated_rows(spark):
    """Rows are judged one by one: null ids come last, equal rows are one document to the line dedup, and one row of
    each group of near copies stays."""
    text = "the house and the garden of my friend are large and green and the river runs by them " * 2
    other = "another text of some words in the same language that is like no other text in here"
    rows = [(None, text), (None, text), (1, text), (1, other), (2, None), (3, ""), (4, "12 34"), (5, other + " x"), (5, other + " x"), (None, "a last one that stands alone under no id at all")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        got[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) if name != "packing" else docs.collect()
    first = sorted([r for r in rows if r[1] and r[1] != "12 34"], key=repr)
    assert got["language_id"] == first
    assert got["line_dedup"] == sorted([(1, text), (1, other), (None, rows[-1][1])], key=repr)
    assert got["ngram_join"] == got["line_dedup"] and len(got["packing"]) == 3
    near = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, near, SF).collect()), key=repr)
    assert kept == sorted([(1, text), (1, other), (2, None), (3, ""), (4, "12 34"), rows[-1]], key=repr)
