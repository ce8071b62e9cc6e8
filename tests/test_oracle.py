"""Registered queries against SQL over the same tables.

By default a spread of query families; STARLOOM_ALL_QUERIES=1 runs every query with SQL.
"""
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check_oracle import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
CHOSEN = ["flagship_words_by_language", "s2_csv_scan", "p7_class_subset", "t17_normalize_documents", "a7_describe", "j1_merge_predictions",
          "w2_best_run", "f3_tfidf", "f10_encode_sequences", "m9_near_miss", "e2_classification_report", "r2_stream_log"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()) if os.environ.get("STARLOOM_ALL_QUERIES") else CHOSEN)
def test_query_matches_sql(spark, sql, name):
    got = entry_module.queries()[name](spark, FOLDER).toArrow().to_pandas()
    want = sql.execute(entry_module.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert normal(got).equals(normal(want))


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
