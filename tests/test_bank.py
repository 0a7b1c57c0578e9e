"""The query bank against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lexiloom.plans import bank

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", bank.QUERIES)
def test_query(name, spark, duck, tmp_path):
    df = bank.QUERIES[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    got = f"select {', '.join(sorted(df.columns))} from '{tmp_path}/out/*.parquet'"
    if name in bank.ORACLES:
        want = f"select {', '.join(sorted(df.columns))} from ({bank.ORACLES[name]})"
        assert duck.execute(f"select (select count(*) from (({got}) except all ({want}))), (select count(*) from (({want}) except all ({got})))").fetchone() == (0, 0)
    else:
        assert duck.execute(f"select count(*) from ({got})").fetchone()[0] > 0


def test_entry_points_are_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_vector_belongs_to_a_term(spark):
    at = "/root/testdata/sf0.1"  # more vectors than the 500 of the smaller tables
    assert bank.token_vectors(spark, at).count() == spark.read.parquet(f"{at}/embeddings.parquet").count()
