import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from waveloom.llm.common import open_fs
from waveloom.llm.warc import chunk_rows, read_chunks, record_types, records, write_archives

BIG = "<p>é" + "x" * 300_000 + "</p>"
ROWS = [(1, "http://a/", BIG), (2, "http://b/", None), (3, None, ""), (4, "http://c/\n", "short"), (5, "u", "short"), (7, "u", BIG), (6, "u", BIG), (9, "u", "y" * 100), (8, "u", "y" * 100), (10, "u", "z" * 99), (11, "u", "z" * 99)]


@pytest.fixture
def edge_pages(spark):
    return spark.createDataFrame([(*r, "clash", 3) for r in ROWS], "page_id long, url string, html string, digest string, record long")


def brute(rows):
    ids = defaultdict(list)
    for i, h in rows:
        ids[(h or "").encode()].append(i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        first = min(ids[b])
        again = len(b) >= 100 and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out)


def test_round_trip(edge_pages, pages):
    for df in (edge_pages, pages, pages.union(pages.selectExpr("page_id + 100000", "url", "html"))):
        rows = [(r.page_id, r.html) for r in df.select("page_id", "html").collect()]
        assert sorted(map(tuple, records(read_chunks(write_archives(df))).collect())) == brute(rows)


def test_chunks_carry_running_digests(edge_pages):
    chunks = read_chunks(write_archives(edge_pages), size=1000).where("record_id = 1").orderBy("chunk_no").collect()
    body, digest = BIG.encode(), hashlib.sha256()
    assert len(chunks) == -(-len(body) // 1000)
    for c in chunks:
        digest.update(c.data)
        assert c.digest == digest.hexdigest() and c.n_bytes <= 1000
    assert b"".join(c.data for c in chunks) == body and [c.last for c in chunks] == [False] * (len(chunks) - 1) + [True]


def test_files_are_plain_gzip_archives(edge_pages):
    text = b""
    for r in write_archives(edge_pages).collect():
        filesystem, place = open_fs(r.path)
        with filesystem.open_input_stream(place, compression=None) as f:
            text += gzip.decompress(f.read())
    assert text.count(b"WARC/1.1\r\n") == len(ROWS) and text.count(b"WARC-Type: revisit") == 3


def test_cut_file_fails(edge_pages):
    whole = gzip.compress(b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:\r\nContent-Length: 10\r\n\r\nabc")
    with pytest.raises(EOFError):
        list(chunk_rows(io.BytesIO(whole)))


def test_empty_table_and_null_ids(spark, edge_pages):
    assert records(read_chunks(write_archives(edge_pages.where("false")))).count() == 0
    assert record_types(edge_pages.where("false"), "page_id", "html").count() == 0
    rows = [(None, "u", "h"), (None, "u", "q" * 200), (None, "u", "r" * 200), (5, "u", "r" * 200), (5, "u", "r" * 200), (None, None, None)]
    got = records(read_chunks(write_archives(spark.createDataFrame(rows, "page_id long, url string, html string")))).collect()
    assert sorted((r.record_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.record_id) == [(5, 200, "response", None)] * 2
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in got if not r.record_id) == [(0, "response", None), (1, "response", None), (200, "response", None), (200, "revisit", 5)]


def test_an_id_with_several_payloads(spark):
    """Revisits refer to an id under which several responses stand; each has its own payload's digest."""
    a, b = "a" * 300, "b" * 400
    rows = [(1, "u", a), (1, "u", b), (2, "u", b), (3, "u", a), (3, "u", a)]
    got = records(read_chunks(write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))).collect()
    want = [(1, 300, "response", None), (1, 400, "response", None), (2, 400, "revisit", 1), (3, 300, "revisit", 1), (3, 300, "revisit", 1)]
    assert sorted((r.record_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == want
    assert {(r.payload_bytes, r.payload_digest) for r in got} == {(len(x), hashlib.sha256(x.encode()).hexdigest()) for x in (a, b)}
