"""Every core query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest
from atomweft.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_all_oracles_have_a_query():
    assert set(q.oracle_sql()) <= set(q.queries())
    assert len(q.queries()) >= 80
    assert set(q.queries()) == set(q.oracle_sql())


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, con, name, tmp_path):
    out = str(tmp_path / "out")
    q.queries()[name](spark, SF).write.parquet(out)
    want = con.execute(q.oracle_sql()[name]).df()
    got = con.execute(f"SELECT * FROM '{out}/*.parquet'").df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (d[cols].sort_values(cols, ignore_index=True) for d in (want, got))
    for c in cols:
        assert (a[c].isna() == b[c].isna()).all() and (a[c][a[c].notna()] == b[c][b[c].notna()]).all(), c
