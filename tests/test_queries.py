"""Every registered query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans import catalogue, formats, language, linking, training  # noqa: F401  (the others register their queries)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cursor = oracle.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
