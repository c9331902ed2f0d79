import zlib

import numpy as np
from tokenizers import Tokenizer

from waveloom.llm.common import open_fs
from waveloom.llm.sstable import ShardReader, read_shards, write_shards
from waveloom.llm.tokens import vocabulary


def brute(rows):
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_round_trip_against_library(edge_docs, docs):
    for df in (edge_docs, docs, edge_docs.union(edge_docs)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        result = read_shards(write_shards(df), with_ids=True).collect()
        assert sorted(tuple(r) for r in result) == sorted(tuple(b) for b in brute(rows))


def test_lookup_by_binary_search(docs):
    want = {r[0]: r[4] for r in brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    found = {}
    for r in write_shards(docs).collect():
        filesystem, place = open_fs(r.path)
        with filesystem.open_input_file(place) as f:
            reader = ShardReader(f)
            for i in [*want, -5, 10**12]:
                if (ids := reader.get(i)) is not None:
                    found[i] = ids.tolist()
            assert reader.entries == r.entries and reader.n_ids == r.ids
            assert sum(reader.bloom[0:1]) in (0, 1)
    assert found == want


def test_empty_and_null_keys(spark, no_docs):
    assert read_shards(write_shards(no_docs)).collect() == []
    rows = [(None, "b"), (-(1 << 63), "c d"), (None, None), ((1 << 63) - 1, "e"), (None, "a")]
    result = read_shards(write_shards(spark.createDataFrame(rows, "doc_id long, text string")), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in result] == [None, None, None, -(1 << 63), (1 << 63) - 1]
    assert [r.n_tokens for r in result] == [1, 2, 2, 3, 2] and [r.start for r in result] == [0, 1, 3, 5, 8]
    assert result[1].ids != result[2].ids
