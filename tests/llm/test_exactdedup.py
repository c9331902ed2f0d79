import hashlib
import re
from collections import defaultdict

import pytest

from waveloom.llm.exactdedup import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)), key=repr)


@pytest.mark.parametrize("extra", [[], [(1, "the quick brown fox jumps over the lazy dog")], [(None, "a"), (None, "alone")]])
def test_against_brute_force(spark, edge_docs, docs, extra):
    for df in (edge_docs, docs.select("doc_id", "text")):
        df = df.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
        rows = [tuple(r) for r in df.collect()]
        assert sorted(map(tuple, exact_dedup(df).collect()), key=repr) == brute(rows)


def test_empty_and_plan(no_docs, edge_docs):
    assert exact_dedup(no_docs).count() == 0
    assert exact_dedup(edge_docs).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    plan = exact_dedup(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
