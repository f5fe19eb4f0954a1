"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from silvan.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rounded(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got
        return
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(rounded(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want


def test_a_page_is_the_start_of_a_larger_one(spark):
    from silvan.operators import search
    from silvan.session import read_table

    e = read_table(spark, SF, "embeddings")
    q = search.vector_of(e, "vec_id", 3)
    ids = lambda k: [r["vec_id"] for r in search.top_k(e, q, k).collect()]
    assert ids(20)[:7] == ids(7)
