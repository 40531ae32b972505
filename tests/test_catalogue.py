import duckdb
import pytest

from siftline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q03_identifier_split", "q08_chunk_bounds_snapped", "q15_bm25_or", "q16_bm25_and", "q21_diversified_search", "q22_fused_search", "q24_snapshot_diff", "q28_byte_truncation", "q29_markdown", "q31_bm25_web", "q34_synced_search", "q35_synced_postings", "q36_synced_files", "q25_name_status", "q37_path_marks", "q38_followed_index", "q39_listed_tree", "q40_json_answer", "q18_bm25_phrase", "q11_term_df"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "part"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = db.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)
