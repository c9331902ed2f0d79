"""Every query against its SQL on DuckDB, at the smallest scale."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from waveloom.plans.oracle import ORACLE_SQL  # noqa: E402
from waveloom.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Fits in many steps, and the model at its full size: these are held against numpy in other tests.
ROWS_ONLY = {"codec_full_size", "rvq_fit_history", "gs_fit_history", "autoencoder_fit_history"}


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def test_all_have_sql_but_fits():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY and not set(ORACLE_SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()), key=repr)
    if name in ROWS_ONLY:
        assert got or name == "codec_full_size"  # its frames are longer than the smallest table's series
        return
    relation = tables.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    want = sorted(tables.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    assert {c: kinds[t] for c, t in df.dtypes} == dict(zip(relation.columns, map(str, relation.types), strict=True))


def test_contrastive_loss_of_the_whole_table(spark, tables):
    """The loss in numpy, over every token of the table and not its first 256."""
    np = pytest.importorskip("numpy")
    from waveloom.plans.queries import DIM, tokens

    rows = sorted((r.tok, r.z) for r in tokens(spark, SF).select("tok", "z").collect())
    assert len(rows) == 4 * tables.sql("select count(*) from embeddings").fetchall()[0][0] > 256
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    losses = []
    for b in sorted({t // 32 for t, _ in rows}):
        z = np.array([z for t, z in rows if t // 32 == b])
        v = np.concatenate([unit(z), unit(z + 0.01 * np.arange(DIM))])
        s, n = v @ v.T / 0.1, len(z)
        np.fill_diagonal(s, -np.inf)
        mate = s[np.arange(2 * n), (np.arange(2 * n) + n) % (2 * n)]
        losses.extend(np.log(np.exp(s).sum(1)) - mate)
    assert QUERIES["contrastive_loss_all"](spark, SF).first().loss == pytest.approx(np.mean(losses), abs=2e-6)
