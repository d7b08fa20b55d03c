from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ripplegraph.operators import alias
from ripplegraph.plans import more_queries
from ripplegraph.plans import tables as t

SMALL = "/root/testdata/sf0.001"


def expanded(members, pairs):
    """All pairs of ids that pairs of classes stand for, with their value."""
    by = {}
    for i, c in members:
        by.setdefault(c, []).append(i)
    out = {}
    for x, y, value in pairs:
        for a, b in combinations(sorted(by[x]), 2) if x == y else [(a, b) for a in by[x] for b in by[y]]:
            out[min(a, b), max(a, b)] = value
    return out


def test_classes_of_all_parts_equal_all_pairs(spark):
    e, r, ev = more_queries._all_entities(spark, SMALL), t.relations(spark, SMALL), t.evidence(spark, SMALL)
    q = entry.queries()
    parts = t.raw(spark, SMALL, "part").count()
    rows = lambda name: [tuple(x) for x in q[name](spark, SMALL).collect()]
    members = rows("alias_trigram_members")
    assert len(members) == parts > len({c for _, c in members})
    assert expanded(members, rows("alias_trigram_classes")) == {(x["left"], x["right"]): round(x["score"], 4) for x in alias.trigram_pairs(e).collect()}
    assert expanded(rows("alias_context_members"), rows("alias_context_classes")) == {(x["left"], x["right"]): round(x["score"], 4) for x in alias.context_pairs(e, r).collect()}

    members = rows("alias_class_members")
    assert len(members) == parts
    got = {p: s.split("|") for p, s in expanded(members, rows("alias_class_signals")).items()}
    c = alias.content_classes(e, r)
    got |= {(x["left"], x["right"]): x["signals"] for x in alias.evidence_signals(e, r, ev, c, alias.class_signals(e, r, c)).collect()}
    assert got == {(x["left"], x["right"]): x["signals"] for x in alias.signals(e, r, ev).collect()}


def test_evidence_pairs_of_all_parts(spark):
    lines = {}
    for x in t.raw(spark, SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct().collect():
        lines.setdefault(x[0], []).append(x)
    want = {}
    for rows in lines.values():
        for x in rows:
            for y in rows:
                a, b = f"entity.{x[3]}", f"entity.{y[3]}"
                if a < b and abs(x[1] - y[1]) <= 3:
                    want.setdefault((a, b), set()).update({tuple(x), tuple(y)})
    got = {(x["left"], x["right"]): x["n"] for x in entry.queries()["alias_part_evidence_pairs"](spark, SMALL).collect()}
    assert got == {p: len(s) for p, s in want.items()}


def test_candidates_of_one_hash(spark):
    """A hash of ten digits stands for several pairs once there are millions of them."""
    rows = [("h", "a", "b", "unsure", "r1", ["e1"]), ("h", "c", "d", "unsure", "r2", ["e2"]), ("g", "a", "d", "unsure", "r3", ["e3"])]
    c = spark.createDataFrame(rows, "candidate_id string, entity_a_id string, entity_b_id string, judgement string, reason string, evidence_ids array<string>")
    for some in ("entity_a_id = 'a' and entity_b_id = 'b'", "false", "true"):
        assert sorted(map(tuple, alias.insert_new(c.where(some), c).collect())) == sorted(rows)
    answers = c.withColumn("judgement", F.concat("entity_a_id", "entity_b_id")).withColumn("reason", F.lit("")).withColumn("evidence_ids", F.array_append("evidence_ids", F.lit("nowhere")))
    known = spark.createDataFrame([("e2",)], "evidence_id string")
    got = alias.apply_judgements(c, answers, known).select(c.columns).collect()
    assert sorted(map(tuple, got)) == sorted((*r[:3], r[1] + r[2], *r[4:]) for r in rows)
    assert alias.apply_judgements(c, answers.select("candidate_id", "judgement", "reason", "evidence_ids").where("candidate_id = 'g'"), known).count() == 3
