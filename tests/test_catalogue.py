import importlib
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["knn_topk", "knn_batch_filtered", "bm25_phrase", "hybrid_rrf", "mmr", "descendants", "edges_upsert", "ttl_sweep", "metadata_merge", "silhouette", "tfidf_keywords", "stream_progress"])
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    entry = importlib.import_module("__spark_entry__")
    base = duckdb.connect()
    for file in os.listdir(SF):
        base.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    got = entry.queries()[name](spark, SF)
    want = base.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda row: tuple(round(float(x), 6) if isinstance(x, (int, float)) else str(x) for x in row)
    assert sorted(map(plain, got.select(*columns).collect()), key=str) == sorted(map(plain, want.select(*columns).fetchall()), key=str)
