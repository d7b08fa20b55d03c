from __future__ import annotations

import duckdb
import pytest
from test_entry import SMALL, TABLES, rows

import __spark_entry__ as entry
from ripplegraph.plans import tables as t
from ripplegraph.plans import whole_queries


@pytest.mark.parametrize("name", ["impact_trace", "all_impact_report", "all_impact_trace", "report_counts", *whole_queries.QUERIES])
def test_queries_over_all_parts_equal_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    assert rows(entry.queries()[name](spark, SMALL).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).fetchdf())


def test_every_part_has_a_change(spark):
    assert t.flat(spark, SMALL, "changes").count() == t.raw(spark, SMALL, "part").count()
    q = entry.queries()
    reached = q["shared_changed_entities"](spark, SMALL)
    assert reached.select("entity_id").distinct().count() == t.flat(spark, SMALL, "shared_names").where("method <> 'llm'").count()
    assert reached.groupBy("change_id").count().where("count > 1").count() > 0


def test_report_lists_every_pair_that_the_classes_count(spark):
    q = entry.queries()
    report, counts = q["all_impact_report"](spark, SMALL), q["all_impact_classes"](spark, SMALL)
    assert {"artifact_id", "n_paths", "n_evidence"} <= set(report.columns)
    assert report.count() == counts.groupBy().sum("n_links").first()[0] > t.raw(spark, SMALL, "part").count() * 100
