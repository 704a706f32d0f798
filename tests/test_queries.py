import duckdb
import pytest

from palisade import queries as Q

SF = "/root/testdata/sf0.001"
NAMES = ["confusables", "collapse_custom", "boundary_matches", "matches_whitelisted", "whitelist_intervals", "matches_sorted", "preset_matches", "matches_with_metadata", "dictionary_union", "censor_keep_both", "censor_overlaps", "word_suffix", "toxic_confusion", "dictionary_removed", "compiled_rules", "pattern_errors", "transformer_simple", "transformer_stateful", "censor_random_shape", "censor_custom", "character_counts", "character_positions"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
