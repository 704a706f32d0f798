import duckdb
import pandas as pd
import pytest

from palisade.llm import queries

WHERE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{WHERE}/documents.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, WHERE).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    key = ["doc_id"]
    pd.testing.assert_frame_equal(got[order].sort_values(key, ignore_index=True), want[order].sort_values(key, ignore_index=True), check_dtype=False, rtol=1e-12)
