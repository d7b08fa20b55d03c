from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def rows(frame):
    out = []
    for record in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in record))
    return sorted(out, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["impact_hop1", "bounded_search", "document_changes", "markdown_relations", "alias_trigram_pairs", "cosine_top_k", "case_metrics", "release_gate", "region_edges", "ledger_mutations", "workbook_cells", "csv_rows", "verified_impacts", "flat_export", "alias_candidates", "review_queue_items", "rebuilt_relations", "stale_impacts"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    assert rows(entry.queries()[name](spark, SMALL).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).fetchdf())
