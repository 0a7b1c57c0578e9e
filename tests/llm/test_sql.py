"""The queries of the operators against their SQL in DuckDB, over the smallest tables and over odd texts."""

import os

import duckdb
import pytest

from lexiloom.llm import queries

DATA = "/root/testdata/sf0.001"


def differences(spark, name, folder, out):
    """Rows only in the query's result, rows only in the SQL's, and rows of the result."""
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        if os.path.exists(path := f"{folder}/{table}.parquet"):
            con.execute(f"create view {table} as from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = queries.QUERIES[name](spark, folder)
    df.write.parquet(str(out))
    cols = ", ".join(sorted(df.columns))
    got, want = f"select {cols} from '{out}/*.parquet'", f"select {cols} from ({queries.ORACLES[name]})"
    return con.execute(f"select (select count(*) from (({got}) except all ({want}))), (select count(*) from (({want}) except all ({got}))), (select count(*) from ({got}))").fetchone()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_equal_their_sql(name, spark, tmp_path):
    only_query, only_sql, rows = differences(spark, name, DATA, tmp_path / "out")
    assert (only_query, only_sql) == (0, 0) and rows > 0


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op7_near_dedup", "op8_exact_dedup"])
def test_queries_equal_their_sql_on_odd_texts(name, spark, docs, tmp_path):
    more = spark.createDataFrame([(9001, " ".join(f"w{i}" for i in range(200))), (9002, " ".join(f"w{i}" for i in range(200)) + " and and and and and and and" * 20)], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, name, str(tmp_path), tmp_path / "out")[:2] == (0, 0)
