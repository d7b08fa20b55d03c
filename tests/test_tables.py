"""The library's tables as Spark makes them against their SQL, over lines with missing keys, repeats and parts that are not there."""

from __future__ import annotations

import re

import duckdb

from ripplegraph.plans import tables as t
from ripplegraph.sources import readers, sinks

LINES = [(1, 1, 7, 3, "A", "F"), (1, 1, 7, 3, "R", "F"), (1, 2, 7, 3, "N", "O"), (2, 1, 8, 3, "A", "O"), (3, 1, 7, 99, "A", "F"), (2, 1, 8, None, "A", "F"), (2, 2, None, 3, "N", "F"), (None, 3, 8, 4, "A", "F"), (4, None, 8, 4, "A", "F")]
LINE = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string"


def _write(spark, folder):
    spark.createDataFrame(LINES, LINE).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(3, "red bolt"), (4, "hot nut"), (4, "hot nut"), (5, "old pin")], "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, 10), (2, 10), (2, None), (4, 11), (9, 12)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")


def test_tables_equal_their_sql(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder)
    db = duckdb.connect()
    for name in ("lineitem", "part", "orders"):
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    sql = {n: t.SQL[n].format(**{x: x for x in t.NAMES}) for n in ("calls", "evidence", "relations")}
    for name, text in sql.items():
        assert sorted(map(repr, map(tuple, t.flat(spark, folder, name).collect()))) == sorted(map(repr, db.execute(text).fetchall()))
    held = {}
    for rel, ev in db.execute(f"select relation_id, evidence_id from ({sql['evidence']}) where relation_id is not null and evidence_id is not null").fetchall():
        held.setdefault(rel, set()).add(ev)
    got = t.relations(spark, folder).collect()
    assert sorted(map(repr, [(r["relation_id"], r["evidence_ids"]) for r in got])) == sorted(repr((x[0], sorted(held.get(x[0], ())))) for x in db.execute(f"{sql['relations']} union all {sql['calls']}").fetchall())


def test_tables_are_told_apart_by_keys(spark, tmp_path):
    """No text that is made of keys is shuffled to find the different rows; relations come from one grouping."""
    folder = str(tmp_path)
    _write(spark, folder)
    for df in (t.flat(spark, folder, "calls"), t.flat(spark, folder, "evidence"), t.relations(spark, folder)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [" in plan and not re.search(r"Aggregate \[(relation_id|evidence_id)", plan)


def test_collections_may_be_compressed(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder)
    r = t.relations(spark, folder)
    sinks.write_collection(r, f"{folder}/plain")
    sinks.write_collection(r, f"{folder}/small", "gzip")
    assert not list(tmp_path.glob("plain/*.gz")) and list(tmp_path.glob("small/*.gz"))
    one, two = (sorted(map(str, readers.read_collection(spark, f"{folder}/{x}", "relations").collect())) for x in ("plain", "small"))
    assert one == two and len(one) == r.count()
