from __future__ import annotations

from pyspark.sql import functions as F

from ripplegraph.operators import impact, search

R = "relation_id string, relation_type string, source_id string, target_id string, evidence_ids array<string>, polarity string, status string, match_type string"
E = "entity_id string, entity_type string, display_name string, canonical_name string, aliases array<string>, extraction_methods array<string>"
A = "artifact_id string, artifact_type string, display_name string"


def graph(spark):
    entities = spark.createDataFrame([("entity.limit", "BusinessField", "credit limit", "credit_limit", ["LIMIT"], ["rule"]), ("entity.guess", "BusinessField", "guess", "guess", [], ["llm"])], E)
    artifacts = spark.createDataFrame([("api.apply", "API", "Apply API"), ("screen.form", "Screen", "Form"), ("test.x", "TestCase", "X")], A)
    relations = spark.createDataFrame(
        [
            ("r1", "REQUEST_FIELD", "api.apply", "entity.limit", ["e1"], "explicit", "unconfirmed", "exact"),
            ("r2", "CALLS", "screen.form", "api.apply", ["e2"], "explicit", "unconfirmed", "exact"),
            ("r3", "MENTIONS", "test.x", "entity.limit", ["e3"], "explicit", "unconfirmed", "alias"),
            ("r4", "READS", "test.x", "entity.limit", ["e4"], "explicit", "rejected", "exact"),
        ],
        R,
    )
    return entities, artifacts, relations


def test_rule_flow(spark):
    entities, artifacts, relations = graph(spark)
    changes = spark.createDataFrame([("c1", "Raise LIMIT", "p", "the credit limit becomes 999; guess"), ("c2", "nothing", "p", "unrelated")], "change_id string, title string, path string, body string")
    found, rejected = impact.analyse(changes, entities, artifacts, relations)
    rows = {r["artifact_id"]: r for r in found.collect()}
    assert set(rows) == {"entity.limit", "api.apply", "screen.form", "test.x"}
    assert rows["entity.limit"]["review_priority"] == "must_review" and rows["entity.limit"]["relation_distance"] == 0
    assert rows["api.apply"]["review_priority"] == "must_review" and rows["api.apply"]["evidence_ids"] == ["e1"]
    assert rows["screen.form"]["review_priority"] == "should_review" and rows["screen.form"]["evidence_ids"] == ["e1", "e2"]
    # a direct mention is raised by the second pass, which also covers relations into the changed entity
    assert rows["test.x"]["review_priority"] == "should_review" and rows["test.x"]["relation_distance"] == 1
    assert [r["relation_id"] for r in rejected.collect()] == ["r4"]
    trace = {r["artifact_id"]: r for r in impact.trace(changes.limit(1), artifacts, found, rejected).collect()}
    assert trace["test.x"]["included"]


def test_counted_equals_the_rows_with_their_texts(spark):
    # paths and evidence by hundreds, relations that share evidence or differ only in their ids, inexact ones in odd order
    entities = spark.createDataFrame([(f"entity.{i}", "BusinessField", f"field {i}", f"f{i}", [], ["llm"] if i == 3 else ["rule"]) for i in range(4)], E)
    artifacts = spark.createDataFrame([(f"api.{i}", "API", f"A{i}") for i in range(150)] + [(f"screen.{i}", "Screen", f"S{i}") for i in range(40)] + [("entity.1", "Screen", "both")], A)
    kinds, states, matches = ("READS", "DEFINES", "MENTIONS"), ("confirmed", "unconfirmed", "rejected", "stale"), ("exact", "alias", "semantic", "fuzzy")
    edges = []
    for i in range(600):
        edges.append((f"r{i * 7 % 601}", kinds[i % 3], f"api.{i % 150}", f"entity.{i % 3}", [f"e{i % 90}", f"e{i % 11}"], "inferred" if i % 4 == 0 else "explicit", states[i * i % 4 if i % 5 else 2], matches[1 + i % 3]))
    for i in range(900):
        edges.append((f"c{i * 5 % 907}", "CALLS", f"screen.{i % 40}", f"api.{i * i % 150}", [] if i % 3 else [f"e{i % 13}"], "inferred" if i % 2 else "explicit", states[i % 4], matches[i % 4 if i % 7 else 1]))
    edges += [(f"h{i}", "CALLS", "screen.0", f"api.{i}", [f"g{i}"], "inferred", "stale", "exact") for i in range(150)]
    edges.append(("z", "READS", "api.3", "api.3", ["e1"], "explicit", "stale", "alias"))
    edges.append(("y", "READS", "screen.1", "nowhere", None, "explicit", "stale", "alias"))
    edges.append(("x", "DEFINES", "entity.1", "entity.0", ["e1"], "explicit", "confirmed", "fuzzy"))
    relations = spark.createDataFrame(edges, R)
    changes = spark.createDataFrame([("a", "field 0", "p", ""), ("b", "field 1", "p", "field 2"), ("c", "field 3", "p", "field 0"), ("d", "none", "p", "")], "change_id string, title string, path string, body string")
    wanted = impact.analyse(changes, entities, artifacts, relations)[0].select(
        "change_id", "artifact_id", "review_priority", "evidence_strength", "match_type", "relation_distance", "rule_assessment", F.size("relation_paths").alias("n_paths"), F.size("evidence_ids").alias("n_evidence"), "relation_statuses"
    )
    found = impact.counted(changes, entities, artifacts, relations)
    assert found.columns == wanted.columns
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, wanted.collect()))
    assert max(r[7] for r in rows) > 64 and max(r[8] for r in rows) > 64 and {r[4] for r in rows} >= {"exact", "alias"}
    assert impact.counted(changes.limit(0), entities, artifacts, relations).count() == 0


def test_one_hop_keeps_mentions_low(spark):
    entities, artifacts, relations = graph(spark)
    changes = spark.createDataFrame([("c1", "LIMIT", "p", "")], "change_id string, title string, path string, body string")
    found, _ = impact.analyse(changes, entities, artifacts, relations, hops=1)
    assert {r["artifact_id"]: r["review_priority"] for r in found.collect()} == {"entity.limit": "must_review", "api.apply": "must_review", "test.x": "may_review"}


def test_short_names_and_empty_tables(spark):
    entities, artifacts, relations = graph(spark)
    names = spark.createDataFrame([("e", "ab"), ("f", "x"), ("g", "long name")], "entity_id string, name string")
    changes = spark.createDataFrame([("c", "zab", None, "long name"), ("d", None, None, None)], "change_id string, title string, path string, body string")
    assert {tuple(r) for r in impact.changed_entities(changes, names).collect()} == {("c", "e"), ("c", "g")}
    assert impact.analyse(changes.limit(0), entities, artifacts, relations)[0].count() == 0


def test_rerank_guardrails(spark):
    rows = [("c", "a1", "must_review", "strong", "explicit_relation", ["e1"]), ("c", "a2", "may_review", "weak", "alias_mention", ["e2"]), ("c", "a3", "should_review", "medium", "explicit_relation", ["e3"])]
    impacts = spark.createDataFrame(rows, "change_id string, artifact_id string, review_priority string, evidence_strength string, rule_assessment string, evidence_ids array<string>")
    answers = spark.createDataFrame([("c", "a1", "no_impact", "", []), ("c", "a2", "impact", "", ["e2", "zz"]), ("c", "a3", "no_impact", "", [])], "change_id string, artifact_id string, llm_judgement string, llm_reason string, selected_evidence_ids array<string>")
    out = {r["artifact_id"]: r for r in impact.apply_rerank(impacts, answers).collect()}
    assert out["a1"]["review_priority"] == "must_review"
    assert out["a2"]["review_priority"] == "should_review" and out["a2"]["selected_evidence_ids"] == ["e2"]
    assert out["a3"]["review_priority"] == "may_review"


def test_imported_relations_need_one_quote(spark):
    chunks = spark.createDataFrame([("k", "line one\nlimit is 9\nother other", 10)], "chunk_id string, text string, line_start int")
    answers = spark.createDataFrame([("k", "a", "READS", "e", "limit is 9"), ("k", "a", "READS", "e", "other"), ("k", "a", "READS", "e", "zzz"), ("q", "a", "READS", "e", "x")], "chunk_id string, source_id string, relation_type string, target_id string, quote string")
    ok, bad = impact.import_relations(answers, chunks)
    assert [(r["quote"], r["line_start"], r["status"]) for r in ok.collect()] == [("limit is 9", 11, "unconfirmed")]
    assert {r["quote"]: r["problem"] for r in bad.collect()} == {"other": "quote is ambiguous", "zzz": "quote not found", "x": "unknown chunk"}


def atom(spark, before="999"):
    return spark.createDataFrame([("a", "c", ["requestedCreditLimit"], "change_constraint", "max_value", before, "1000")], "atom_id string, change_id string, target_terms array<string>, operation string, property string, before string, after string")


def test_verifier_boundaries(spark):
    relations = spark.createDataFrame([("r", "VALIDATES", "v", "e", ["q"], "explicit", "unconfirmed", "exact")], R)
    evidence = spark.createDataFrame([("q", "requestedCreditLimit upper bound is 999")], "evidence_id string, quote string")
    seeds = spark.createDataFrame([("c", "e")], "change_id string, entity_id string")
    paths = search.bounded_search(seeds, relations)
    for kind, before, wanted in (("ValidationRule", "999", "must_review"), ("ValidationRule", "1000", "should_review"), ("DeploymentJob", "999", "should_review")):
        artifacts = spark.createDataFrame([("v", kind, "V")], A)
        v = search.verify(paths, atom(spark, before), artifacts.selectExpr("artifact_id", "artifact_type", "display_name"), evidence)
        assert v.first()["verdict"] == wanted, (kind, before)


def test_search_depth(spark):
    edges = [("r1", "DEFINES", "n1", "e"), ("r2", "READS", "n2", "n1"), ("r3", "CALLS", "n3", "n2"), ("m", "MENTIONS", "n4", "e"), ("m2", "READS", "n5", "n4"), ("d", "DEFINES", "n6", "n1"), ("d2", "ASSERTS", "n7", "n6"), ("d3", "CALLS", "n8", "n6")]
    relations = spark.createDataFrame([(i, k, s, t, [], "explicit", "unconfirmed", "exact") for i, k, s, t in edges], R)
    seeds = spark.createDataFrame([("c", "e")], "change_id string, entity_id string")
    found = {r["node_id"]: r["hops"] for r in search.bounded_search(seeds, relations).collect()}
    # READS stops at two hops, MENTIONS at one, ASSERTS is not followed
    assert found == {"n1": 1, "n4": 1, "n2": 2, "n6": 2, "n8": 3}


def test_change_atoms(spark):
    rows = [("c1", "「利用限度額」の上限を10万円から20万円。"), ("c2", "raise creditLimit from 10 to 20"), ("c3", "# Title only\n\nmore")]
    out = {r["change_id"]: r for r in search.change_atoms(spark.createDataFrame(rows, "change_id string, body string")).collect()}
    assert out["c1"]["property"] == "max_value" and out["c1"]["after"] == "20万円" and out["c1"]["operation"] == "change_constraint" and "LIMIT_AMT" in out["c1"]["target_terms"]
    assert out["c2"]["before"] == "10" and out["c2"]["after"] == "20"
    assert out["c3"]["target_terms"] == ["Title only"]


def test_decisions_and_submissions(spark):
    decisions = spark.createDataFrame([("impact.c.a", "c", "a", "accepted", "", "1")], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    impacts = spark.createDataFrame([("c", "a"), ("c", "b")], "change_id string, artifact_id string")
    seeded = search.seed_decisions(impacts, decisions, "now")
    assert {r["impact_id"]: r["status"] for r in seeded.collect()} == {"impact.c.a": "accepted", "impact.c.b": "unreviewed"}
    good, bad = search.set_impact_status(seeded, spark.createDataFrame([("impact.c.b", "rejected", "no"), ("impact.c.a", "odd", "")], "impact_id string, status string, reason string"), "later")
    assert {r["impact_id"]: r["status"] for r in good.collect()} == {"impact.c.a": "accepted", "impact.c.b": "rejected"} and bad.count() == 1
    cand = spark.createDataFrame([("c", "a", ["e1"], ["r1"])], "change_id string, node_id string, evidence array<string>, relations array<string>")
    answers = spark.createDataFrame([("s1", "c", "a", ["e1"], ["r1"]), ("s2", "c", "a", ["e9"], []), ("s2", "c", "a", ["e1"], []), ("s3", "c", "zz", ["e1"], [])], "submission_id string, change_id string, node_id string, evidence_ids array<string>, relation_ids array<string>")
    out = search.check_submission(answers, cand).groupBy("submission_id").agg(F.first("rejected").alias("r")).collect()
    assert {r["submission_id"]: r["r"] for r in out} == {"s1": False, "s2": True, "s3": True}
