"""Collections in buckets and tables in ranges: results as those of the plain operators, and only the files concerned are opened."""

from __future__ import annotations

import posixpath
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import SMALL, TABLES, rows

from ripplegraph.functions.columns import normal_path
from ripplegraph.operators import freshness, maintain, pages, views
from ripplegraph.plans import stored_queries
from ripplegraph.plans import tables as t
from ripplegraph.sources import bucketed


def _spoil(folder, column: str, kept: set[int]) -> None:
    """Fill the files of all folders but the kept ones with garbage: a query that opens one of them fails."""
    for p in Path(folder, "rows").rglob("*.parquet"):
        if int(str(p).split(f"{column}=")[1].split("/")[0]) not in kept:
            p.write_bytes(b"garbage")
            p.with_name(f".{p.name}.crc").unlink(missing_ok=True)


def _files(folder) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in Path(folder, "rows").rglob("*.parquet")}


def _sorted(df):
    return sorted(map(str, df.collect()))


def _bucket_of(path: str) -> int:
    return int(path.split("_bucket=")[1].split("/")[0])


def test_merge_touches_its_buckets_only(spark, tmp_path):
    place = str(tmp_path / "c")
    rows = spark.range(2000).selectExpr("concat('d', id % 400) as document_id", "id as v", "array(cast(id as string)) as ids").unionByName(spark.sql("select cast(null as string) as document_id, -1L as v, array('x') as ids"))
    rows = rows.unionByName(rows.where("document_id = 'd7'"))  # repeated rows stay
    bucketed.create(rows, "document_id", place, 32)
    assert _sorted(bucketed.read(spark, place)) == _sorted(rows)
    gone = rows.where("document_id in ('d1', 'd2', 'd3')").select("document_id")
    new = spark.createDataFrame([("d1", 9), ("new", 8)], "document_id string, v long")
    expected = _sorted(maintain.replace_by_document(rows, new, gone))
    before = _files(place)
    opened = bucketed.merge(spark, place, new, gone)
    after = _files(place)
    assert 1 <= len(opened) <= 4
    assert {_bucket_of(p) for p, _ in set(before.items()) ^ set(after.items())} == set(opened)
    assert _sorted(bucketed.read(spark, place)) == expected
    bucketed.merge(spark, place, new, gone.unionByName(new.select("document_id")))  # again: the same rows
    assert _sorted(bucketed.read(spark, place)) == expected


def test_empty_collections_and_buckets(spark, tmp_path):
    place, empty = str(tmp_path / "c"), str(tmp_path / "e")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int")
    bucketed.create(rows, "document_id", place, 4)
    bucketed.create(rows.limit(0), "document_id", empty, 4)
    assert bucketed.read(spark, empty).count() == 0
    assert bucketed.merge(spark, place, rows.limit(0), rows.limit(0)) == []
    bucketed.merge(spark, place, rows.limit(0), rows)  # all rows go
    assert bucketed.read(spark, place).count() == 0
    assert all(df.count() == 0 for df in bucketed.unequal(spark, place, empty))
    bucketed.merge(spark, empty, rows, rows)
    assert _sorted(bucketed.read(spark, empty)) == _sorted(rows)
    with pytest.raises(ValueError):
        bucketed.merge(spark, place, rows.selectExpr("document_id", "1 as other"), rows)
    with pytest.raises(ValueError):
        bucketed.create(rows.selectExpr("document_id", "v as _mark"), "document_id", str(tmp_path / "n"))


def test_diff_opens_unequal_buckets_only(spark, tmp_path):
    old = t.relations(spark, SMALL).where("relation_type <> 'CALLS'").repartition(4).persist()
    new = old.where("relation_id not like '%.11'").selectExpr(*[f"CASE WHEN relation_id LIKE '%.17' THEN 'COVERS' ELSE {c} END AS {c}" if c == "relation_type" else c for c in old.columns])
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    bucketed.create(old, "relation_id", a, 128)
    bucketed.create(new, "relation_id", b, 128)
    x, y = bucketed.unequal(spark, a, b)
    expected = _sorted(freshness.relation_changes(old, new))
    assert expected and _sorted(freshness.relation_changes(x, y)) == expected
    bucket = lambda ids: {r[0] for r in ids.selectExpr("cast(pmod(xxhash64(relation_id), 128) as int)").distinct().collect()}
    touched = bucket(freshness.relation_changes(old, new))
    assert len(touched) < len(bucket(old)) / 2
    _spoil(a, "_bucket", touched)
    _spoil(b, "_bucket", touched)
    assert _sorted(freshness.relation_changes(*bucketed.unequal(spark, a, b))) == expected
    # Merging the differences makes the digests agree.
    changed = freshness.relation_changes(x, y)
    bucketed.merge(spark, a, new.join(changed, "relation_id", "left_semi"), changed)
    _spoil(a, "_bucket", set())
    assert bucketed.unequal(spark, a, b)[0].collect() == []


def test_pages_open_their_ranges_only(spark, tmp_path):
    place = str(tmp_path / "p")
    df = spark.range(5000).selectExpr("case when id % 50 = 0 then null else cast(id % 7 as string) end as kind", "cast(id as string) as item_id", "id * 2 as v")
    order = ["kind", "item_id"]
    pages.write(df, order, place, 16)
    assert pages.total(spark, place) == 5000
    for offset, limit in ((0, 10), (95, 10), (2490, 40), (4990, 100), (5000, 5), (7, 0)):
        got = pages.page(spark, place, offset, limit)
        want = views.page(df, order, offset, limit)[0]
        assert got.collect() == want.collect()
    last = views.page(df, order, 0, 130)[0].collect()[-1]
    for step in range(3):
        got = pages.page_after(spark, place, last.asDict(), 130)
        assert got.collect() == views.page(df, order, 130 * (step + 1), 130)[0].collect()
        last = got.collect()[-1]
    assert pages.page_after(spark, place, {"kind": "9", "item_id": ""}, 5).collect() == []
    assert len(pages.page_after(spark, place, {"kind": "3", "item_id": "no such item"}, 5).collect()) == 5
    # One range is enough for a page within it, two for the page after a row of it.
    r = spark.read.parquet(f"{place}/index").orderBy("_range").collect()[5]
    number, next_ = (pages.page(spark, place, r["start"] + 1, 9).collect(), pages.page_after(spark, place, r["last"].asDict(), 9).collect())
    _spoil(place, "_range", {r["_range"]})
    assert pages.page(spark, place, r["start"] + 1, 9).collect() == number == views.page(df, order, r["start"] + 1, 9)[0].collect()
    assert next_ == views.page(df, order, r["start"] + r["n"], 9)[0].collect()


@pytest.mark.parametrize("name", list(stored_queries.QUERIES))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    got = rows(stored_queries.QUERIES[name](spark, SMALL).toPandas())
    assert len(got) > 9 - 5 * (name == "stale_graph_view") and got == rows(db.execute(stored_queries.ORACLE_SQL[name]).fetchdf())


def test_pages_of_an_empty_table(spark, tmp_path):
    place = str(tmp_path / "p")
    pages.write(spark.createDataFrame([], "k string, v int"), ["k"], place, 4)
    assert pages.total(spark, place) == 0 and pages.page(spark, place, 0, 5).collect() == [] and pages.page_after(spark, place, {"k": "a"}, 5).collect() == []


def test_paths_as_posixpath_has_them(spark):
    paths = ["", ".", "/", "//", "///a", "//a/..", "a//b/./c", "a/../..", "../../x", "/../x", "a/b/../../..", "/a/b/../c/", "./", "A/b", "a\\b", "x/..", "../x/../.."]
    got = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string").select("p", normal_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in got} == {p: posixpath.normpath(p) for p in paths} | {None: None}


def test_sources_of_odd_workbooks(spark):
    docs = spark.createDataFrame([("d1", "One", "in/a.xlsx", "file"), ("d2", "Two", "IN/a.xlsx", "file"), ("d3", "None", None, "file")], "document_id string, title string, path string, document_type string")
    books = spark.createDataFrame([("w1", "x/a.xlsx", "in/./a.xlsx", None, 1), ("w2", "y/a.xlsx", "in/a.xlsx", ["hidden"], 2), ("w3", None, None, None, 3)], "workbook_id string, file_path string, original_path string, warnings array<string>, seq int")
    sheets = spark.createDataFrame([("w1",), ("w2",), ("w2",)], "workbook_id string")
    ev = spark.createDataFrame([("d1", ("in/a.xlsx",)), (None, ("x//a.xlsx",)), (None, None)], "document_id string, source_location struct<file string>")
    held = lambda key: spark.createDataFrame([], f"{key} string, source_document_ids array<string>")
    none = spark.createDataFrame([], "document_id string, change_type string, version_number int, resolved_at string")
    out = views.source_list(docs, books, sheets, sheets.limit(0), ev, held("node_id"), held("relation_id"), none, none)
    got = {r["source_id"]: (r["title"], r["status"], r["evidence"], r["sheets"], r["regions"], r["warnings"]) for r in out.collect()}
    assert got == {
        "d1": ("One", "ready", 1, 2, 0, ["hidden"]),
        "d2": ("Two", "indexed", 0, 0, 0, []),
        "d3": ("None", "indexed", 0, 0, 0, []),
        "w1": ("a.xlsx", "ready", 1, 1, 0, []),  # its path went to the later workbook
        "w3": ("", "ready", 0, 0, 0, []),
    }
