import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = ("src_page_assembly", "src_quarantine", "sink_update_response", "sink_upsert_response", "proj_drop_positional",
         "route_outcome", "filter_similarity_topk", "knn_l2_exact", "bm25_topk", "top5_contexts", "chunk_hierarchical",
         "auto_merge", "stream_upsert_latest", "keyword_subquery")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
