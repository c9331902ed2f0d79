import pytest

SF = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties, repeated rows and texts, a long text, odd blanks, other scripts.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, None),
    (3, ""),
    (4, "the  quick\tbrown fox jumps over the lazy dog"),
    (5, "THE quick brown fox jumps over the lazy dog"),
    (6, " \n "),
    (7, "word " * 9000),
    (8, "ünïcödé Ωμέγα 漢字かな 🙂 é"),
    (9, "the quick brown fox jumps over the lazy dog"),
    (10, "<|endoftext|> a,b. c., d\n\ne \n f"),
    (-3, "a"),
    (11, "1234 5678 !!! ???"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Small documents table of edge cases, with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, length int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")
