from __future__ import annotations

import re

from pyspark.sql import functions as F

from ripplegraph.functions.containment import pairs_within
from ripplegraph.operators import alias, evaluate, freshness, grid, maintain, markdown, privacy, vectors, views
from ripplegraph.plans import further_queries
from ripplegraph.sources import readers, sinks, workbooks
from ripplegraph.streaming import ledgers


def test_merge_is_idempotent(spark):
    rows = [("n", 1, "first", ["b"], ["d2"], ["rule"]), ("n", 2, "second", ["a"], ["d1"], ["llm"]), ("m", 1, "one", ["z", "y"], ["d1"], ["rule"])]
    df = spark.createDataFrame(rows, "node_id string, seq int, display_name string, aliases array<string>, source_document_ids array<string>, extraction_methods array<string>")
    once = maintain.merge_nodes(df, "node_id", ["display_name"])
    got = {r["node_id"]: r for r in once.collect()}
    assert got["n"]["display_name"] == "first" and got["n"]["aliases"] == ["a", "b"] and got["n"]["source_document_ids"] == ["d1", "d2"]
    assert got["m"]["aliases"] == ["z", "y"]  # single rows stay as they are
    again = maintain.merge_nodes(once.withColumn("seq", F.lit(0)), "node_id", ["display_name"])
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_replace_and_contract(spark):
    cur = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, v int")
    new = spark.createDataFrame([("d1", 9)], "document_id string, v int")
    assert {tuple(r) for r in maintain.replace_by_document(cur, new, new).collect()} == {("d1", 9), ("d2", 2)}
    bad = spark.createDataFrame([("r", "READS", "a", "b", "explicit", "odd"), (None, "READS", "a", "b", "explicit", "confirmed")], "relation_id string, relation_type string, source_id string, target_id string, polarity string, status string")
    assert {tuple(r["violations"]) for r in maintain.check_contract(bad, maintain.relation_rules()).collect()} == {("status is unknown",), ("relation_id is required",)}


def test_freshness_scenario(spark):
    old = spark.createDataFrame([("d", "p.md", "h1")], "document_id string, path string, hash string")
    new = spark.createDataFrame([("d", "p.md", "h2")], "document_id string, path string, hash string")
    added = freshness.document_changes(old.limit(0), old)
    assert [r["change_type"] for r in added.collect()] == ["added"]
    changed = freshness.document_changes(old, new)
    assert [r["change_type"] for r in changed.collect()] == ["modified"]
    versions = spark.createDataFrame([("d", 1)], "document_id string, version_number int")
    assert freshness.append_versions(versions, changed, "diff").first()["version_number"] == 2
    nodes = spark.createDataFrame([("n", ["x", "d"]), ("k", ["x"])], "node_id string, source_document_ids array<string>")
    stale = freshness.stale_by_source(changed, nodes, "node", "node_id", "source_document_ids")
    assert [r["target_id"] for r in stale.collect()] == ["n"]
    ledger = spark.createDataFrame([("s0", "node", "q", "d", None, None, "old", None)], "stale_id string, target_type string, target_id string, document_id string, previous_hash string, current_hash string, reason string, resolved_at string")
    out = freshness.upsert_stale(ledger, stale, "now")
    assert out.count() == 2 and out.where("resolved_at = 'now'").count() == 1
    assert freshness.upsert_stale(out, stale, "later").count() == 2


def test_alias_pairs_equal_all_pairs(spark):
    names = [("entity.a", "postalCode", "postal_code"), ("entity.b", "POSTAL_CODE", "postal_code"), ("entity.c", "zipFormValue", "zip_form_value"), ("entity.d", "zipCd", "zip_cd")]
    entities = spark.createDataFrame([(i, "F", d, c, [], ["rule"]) for i, d, c in names], "entity_id string, entity_type string, display_name string, canonical_name string, aliases array<string>, extraction_methods array<string>")
    rel = [("r1", "DISPLAYS", "screen.m", "entity.c", ["e1"]), ("r2", "DISPLAYS", "screen.m", "entity.d", ["e2"])]
    relations = spark.createDataFrame(rel, "relation_id string, relation_type string, source_id string, target_id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "f", 10, 10), ("e2", "f", 12, 12)], "evidence_id string, file string, line_start int, line_end int").select("evidence_id", F.struct("file", "line_start", "line_end").alias("source_location"))
    got = {(r["left"], r["right"]): r["signals"] for r in alias.signals(entities, relations, evidence).collect()}
    assert set(got) == {("entity.a", "entity.b"), ("entity.c", "entity.d")}
    assert "same_evidence_neighborhood" in got[("entity.c", "entity.d")] and "relation_similarity:1.00" in got[("entity.c", "entity.d")]
    assert "camel_snake_shape_match" in got[("entity.a", "entity.b")]
    c = alias.candidates(entities, alias.signals(entities, relations, evidence)).where("target_id = 'entity.a'").first()
    assert c["aliases"] == ["POSTAL_CODE"]


def test_sections_and_headings(spark):
    docs = spark.createDataFrame([("d", "intro\n# A\ntext\n\n## 入力項目\n- x: y\n- z"), ("e", "plain"), ("n", None)], "document_id string, text string")
    got = sorted((r["document_id"], r["heading"], r["line_start"], r["line_end"]) for r in markdown.sections(docs).collect())
    assert got == [("d", "A", 2, 4), ("d", "入力項目", 5, 7), ("e", "Document", 1, 1), ("n", "Document", 1, 1)]
    heads = spark.createDataFrame([("Request   Fields",), ("参照",), ("Other",)], "h string").select(markdown.relation_type_for_heading(F.col("h")).alias("t"))
    assert [r["t"] for r in heads.collect()] == ["REQUEST_FIELD", "READS", None]


def test_cells_to_relations(spark):
    rows = {4: ["IF名", "項目名", "物理名"], 5: ["信用照会連携IF", "利用限度額", "REQUESTED_CREDIT_LIMIT"], 1: ["改訂", None, None]}
    cells = [("w", "s", "IF一覧", f"{'ABC'[c]}{r}", f"ev{r}{c}", v, r, c + 1) for r, vs in rows.items() for c, v in enumerate(vs) if v]
    df = spark.createDataFrame(cells, "workbook_id string, sheet_id string, sheet_name string, cell string, evidence_id string, value string, row int, column int")
    no = F.lit(None).cast("string")
    df = df.select("*", no.alias("merged_range"), F.struct(no.alias("fill_color"), F.lit(False).alias("font_bold"), F.lit(False).alias("border")).alias("style"), no.alias("hyperlink"), no.alias("comment"), F.lit(False).alias("is_hidden_row"), F.lit(False).alias("is_hidden_col"))
    sheets = grid.classify_sheets(df)
    assert sheets.first()["sheet_type"] == "external_interface"
    regions = grid.detect_regions(df, sheets)
    assert {(r["range"], r["region_type"]) for r in regions.collect()} == {("A1:A1", "revision_history"), ("A4:C5", "external_if_table")}
    rows_ = grid.region_rows(grid.region_members(regions, df.drop("sheet_name", "workbook_id")))
    edges = grid.row_edges(rows_, regions).collect()
    assert [(e["source"], e["relation_type"], e["target"]) for e in edges] == [("信用照会連携IF", "SENDS", "REQUESTED_CREDIT_LIMIT")]
    nodes, e = grid.proposals(grid.row_edges(rows_, regions))
    good, kept, warned = grid.clean(nodes, e, regions)
    assert (good.count(), kept.count(), warned.count()) == (2, 1, 0)


def test_cosine_scores(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.2]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("l", [1.0])], "chunk_id string, vector array<double>")
    top = vectors.cosine_top_k(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>"), chunks, 5).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 7)) for r in top] == [("a", 1.0), ("b", 0.9701425), ("c", 0.0), ("z", 0.0), ("l", -1.0)]


def test_redaction(spark):
    rows = [("顧客名: 山田太郎 mail a.b@example.com 090-1234-5678 https://x.y/z token=abcdefgh12 12345678 requestedCreditLimit",)]
    out = spark.createDataFrame(rows, "t string").select(privacy.redact_text(F.col("t")).alias("t")).first()["t"]
    assert "山田" not in out and "@" not in out and "5678" not in out and "https" not in out and "abcdefgh12" not in out and "requestedCreditLimit" in out
    m = spark.sql("select map('customer_name', 'x', 'note', 'call 090-1234-5678') as m").select(privacy.redact_map(F.col("m")).alias("m")).first()["m"]
    assert m == {"customer_name": "[REDACTED]", "note": "call [REDACTED]"}


def test_redaction_of_unicode_text(spark):
    rows = [("氏名　：　山田太郎",), ("電話０９０１２３４５６７８ 0３-1234-5678 x",), ("番号１２３４５６７です 1234567 １２３４５６７",), ("見https://a.b/c　次",), ("会員番号\u00a0=\u3000AB_12-x9 end",)]
    out = [r["t"] for r in spark.createDataFrame(rows, "t string").select(privacy.redact_text(F.col("t")).alias("t")).collect()]
    patterns = [
        re.compile(p, f)
        for p, f in (
            (r"(?:氏名|名前|顧客名|口座名義|full[_ ]?name|customer[_ ]?name)\s*[:：=]\s*[^\r\n,，。]{2,80}", re.I),
            (r"(?:顧客番号|会員番号|口座番号|customer[_ -]?id|account[_ -]?number)\s*[:：=]\s*[A-Za-z0-9_-]{4,40}", re.I),
            (r"\b0\d{1,4}[- ]?\d{1,4}[- ]?\d{3,4}\b", 0),
            (r"https?://[^\s)]+", 0),
            (r"\b\d{7,12}\b", 0),
        )
    ]
    for got, (text,) in zip(out, rows, strict=True):
        for p in patterns:
            text = p.sub("[REDACTED]", text)
        assert got == text
    assert out[0] == "[REDACTED]" and out[4] == "[REDACTED] end"


CASE = "case_id string, artifact_id string, level string"
FOUND = "case_id string, artifact_id string, review_priority string, relation_distance int, evidence_ids array<string>"


def test_metrics_count_must_and_should(spark):
    exp = spark.createDataFrame([("c", "a", "must_review"), ("c", "m", "may_review")], CASE)
    act = spark.createDataFrame([("c", "a", "must_review", 0, []), ("c", "m", "may_review", 1, []), ("d", "b", "may_review", 1, ["e"]), ("e", "x", "should_review", 1, [])], FOUND)
    got = {r["case_id"]: r for r in evaluate.case_metrics(exp, act).collect()}
    assert got["c"]["must_review_recall"] == 1.0 and got["c"]["visible_precision"] == 1.0 and got["c"]["evidence_coverage"] == 1.0 and got["c"]["report_size"] == 1
    assert got["d"]["must_review_recall"] == 1.0 and got["d"]["visible_precision"] == 1.0 and got["d"]["candidate_expansion_ratio"] == 0.0
    assert got["e"]["visible_precision"] == 0.0 and got["e"]["evidence_coverage"] == 0.0
    assert evaluate.missed_must(exp, act.where("artifact_id <> 'a'")).collect() == [("c", "a")]


def test_gate_without_evaluation_cases_fails(spark):
    exp = spark.createDataFrame([(f"c{i}", f"a{i}", "must_review") for i in range(24)], CASE)
    act = exp.select("case_id", "artifact_id", F.col("level").alias("review_priority"), F.lit(1).alias("relation_distance"), F.array(F.lit("e")).alias("evidence_ids"))
    kinds = lambda i, some: "golden" if i < 2 else "holdout" if i < 4 or not some else "evaluation"
    for some, status in ((True, "pass"), (False, "fail")):
        cases = spark.createDataFrame([(f"c{i}", kinds(i, some), f"chg{i}") for i in range(24)], "case_id string, category string, change_id string")
        g = evaluate.release_gate(evaluate.dataset_metrics(exp, act, cases), exp).first()
        assert g["status"] == status and g["must_review_recall"] == (1.0 if some else 0.0) and g["case_count"] == 24


def test_white_space_of_documents(spark):
    docs = spark.createDataFrame([("d", "#　見出し API\n\u00a0##\u3000 Request \u3000 fields\u2003\n-\u3000no bullet\n- 金額\u3000: key\n")], "document_id string, text string")
    assert [(r["heading"], r["level"]) for r in markdown.sections(docs).collect()] == [("見出し API", 1)]
    rows = markdown.scan(docs).collect()
    assert [(r["relation_type"], r["value"], r["line"]) for r in rows] == [("REQUEST_FIELD", "金額\u3000: key", 4)]
    assert markdown.targets(markdown.scan(docs)).first()["target_name"] == "金額"


def test_catalog_types_targets(spark):
    docs = spark.createDataFrame([("d", "# X API\n## Calls\n- 信用API\n- Known field\n- nothing\n## Table: T\n- amount\n- other")], "document_id string, text string")
    cat = [("api.credit", "API", "信用API", 0), ("entity.k", "BusinessField", "Known field", 1), ("column.c", "Column", "T.amount", 2), ("entity.money", "BusinessField", "amount", 3), ("free", None, "T.other", 4)]
    r = markdown.relations_of(markdown.scan(docs), spark.createDataFrame(cat, "item_id string, canonical_type string, alias string, seq int")).orderBy("line").collect()
    assert [(x["source_id"], x["target_type"], x["target_id"]) for x in r] == [
        ("api.x_api", "API", "api.credit"), ("api.x_api", "Document", "document.known_field"), ("api.x_api", "Document", "document.nothing"), ("column.c", "BusinessField", "entity.money"), ("free", "BusinessField", "free"),
    ]


def test_mutation_keys_and_params(spark):
    rows = [(1, " k ", "a", '{"a":1,"b":2}'), (2, "k", "a", '{ "b": 2, "a": 1 }'), (3, "k", "a", None), (4, "  ", "a", "{}"), (5, "x" * 201, "a", "{}"), (6, "n", None, None), (7, "n", None, None), (8, "n", None, "null"), (9, "t", "a", "no json"), (10, "t", "a", "no json")]
    e = spark.createDataFrame(rows, "seq long, key string, action string, params string")
    got = [r["outcome"] for r in ledgers.mutation_results(e, ledgers.first_mutations(e)).orderBy("seq").collect()]
    assert got == ["applied", "replayed", "conflict", "invalid", "invalid", "applied", "replayed", "conflict", "applied", "replayed"]


def test_pairs_within(spark):
    small, big = ["ab", "abc", "abcd", "z", "", "xyz q", "none"], ["xxabcdxx", "abc", "", "zz xyz q zz", "ab"]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "text string")
    got = {tuple(r) for r in pairs_within(frame(small * 2), frame(big)).collect()}
    assert got == {(a, b) for a in small for b in big if a and a in b}


def test_health_of_sheets(spark):
    cells = [("w", "s", "IF一覧", r, c, f"v{r}{c}") for r in (1, 2, 4) for c in (1, 2, 3)] + [("w", "t", "改訂", 1, 1, "利用限度額"), ("w", "t", "改訂", 2, 1, "利用限度額"), ("w", "t", "改訂", 2, 2, "limit_amt"), ("w", "t", "改訂", 3, 1, "limit_amt")]
    df = spark.createDataFrame(cells, "workbook_id string, sheet_id string, sheet_name string, row int, column int, value string").withColumn("merged_range", F.when(F.col("value") == "v11", "A1:B1"))
    sheets = spark.createDataFrame([("s", "外部IF.xlsx", False), ("t", "b.xlsx", True)], "sheet_id string, file_name string, hidden boolean")
    d = {r["sheet_id"]: r for r in grid.sheet_details(df, sheets).collect()}
    assert d["s"]["multi_header"] and d["s"]["columns"] == 3 and d["s"]["estimated_type"] == "external_if" and d["s"]["merged_cells"] == 1 and not d["s"]["hidden"]
    assert d["t"]["hidden"] and d["t"]["revision_history"] and not d["t"]["multi_header"]
    f = grid.folder_health(grid.sheet_details(df, sheets)).first()
    assert (f["sheets"], f["detected_artifacts"], f["hidden_sheets"], f["revision_sheets"], len(f["warnings"])) == (2, 4, 1, 1, 2)
    assert [tuple(r) for r in grid.repeated_fields(df).collect()] == [("limit_amt", 2)]
    assert [(r["name"], r["aliases"]) for r in grid.field_alias_groups(df).collect()] == [("限度額", ["limit_amt", "利用限度額"])]


def test_sources(spark, tmp_path):
    text = "openapi: 3\npaths:\n  /apply:\n    post:\n      requestBody:\n        content:\n          application/json:\n            schema:\n              properties:\n                limit: {}\n"
    try:
        import yaml  # noqa: F401
    except ImportError:
        text = '{"paths": {"/apply": {"post": {"requestBody": {"content": {"application/json": {"schema": {"properties": {"limit": {}}}}}}}}}}'
    files = spark.createDataFrame([("a", text), ("bad", "[1]")], "path string, text string")
    got = {r["path"]: r for r in readers.openapi_fields(files).collect()}
    assert got["a"]["field"] == "limit" and got["bad"]["error"]
    (tmp_path / "t.csv").write_text("﻿field_name,type\nlimit,int\n", encoding="utf-8")
    assert readers.read_csv(spark, str(tmp_path / "t.csv")).columns == ["field_name", "type"]
    (tmp_path / "doc.md").write_text("# Title\n- a", encoding="utf-8")
    assert readers.read_documents(spark, str(tmp_path / "doc.md")).first()["title"] == "Title"


def test_workbook(spark):
    files = [("in/A b.xlsx", bytearray(further_queries.small_book([("山田", 1.5, True)]))), ("b.xlsx", bytearray(b"no")), ("c.xlsx", None)]
    df = workbooks.parsed(spark.createDataFrame(files, "path string, content binary"))
    cells = {c["cell"]: c for c in workbooks.cells_table(df).collect()}
    assert (cells["A2"]["value"], cells["A2"]["style"]["fill_color"], cells["A2"]["style"]["font_bold"]) == ("山田", "theme:4", True)  # phonetic runs are no part of values
    assert cells["C2"]["value"] == "True" and cells["D2"]["value"] == "2023-03-15 12:00:00" and cells["D2"]["data_type"] == "d" and cells["B2"]["comment"] == "see note"
    assert cells["F1"]["merged_range"] == cells["G1"]["merged_range"] == "F1:G1" and cells["A1"]["hyperlink"] == "https://example.org/x" and cells["A1"]["workbook_id"].startswith("wb.a_b.")
    sheets = [(s["sheet_name"], s["hidden"], s["drawings"]) for s in workbooks.sheets_table(df).collect()]
    assert sheets == [("Data", False, []), ("Old", True, ["2 images"])]
    assert df.where("error is not null").count() == 2


def test_exports(spark):
    art = spark.createDataFrame([("api.x", "API", 'A "x"', [], ["d"])], "artifact_id string, artifact_type string, display_name string, aliases array<string>, source_document_ids array<string>")
    ent = spark.createDataFrame([("entity.y", "F", "y", [])], "entity_id string, entity_type string, display_name string, aliases array<string>")
    rel = spark.createDataFrame([("r", "reads-it", "api.x", "entity.y", ["e"], "unconfirmed")], "relation_id string, relation_type string, source_id string, target_id string, evidence_ids array<string>, status string")
    ev = spark.createDataFrame([("e", "[S!B2] q", "f", 1, 2)], "evidence_id string, quote string, file string, line_start int, line_end int").select("evidence_id", "quote", F.struct("file", "line_start", "line_end").alias("source_location"))
    dec = spark.createDataFrame([("i", "c", "api.x", "accepted", "ok", "1")], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    text = [r["statement"] for r in sinks.cypher(art, ent, rel, ev, dec).orderBy("part").collect()]
    assert len(text) == 6 and '"A \\"x\\""' in text[0] and ":READS_IT " in text[3]
    notes = {r["path"]: r["content"] for r in sinks.notes(art, ent, rel, ev, dec).collect()}
    assert len(notes) == 4 and "review_status: accepted" in notes["nodes/api.x.md"] and "[[entity.y]]" in notes["nodes/api.x.md"] and "`B2`" in notes["evidence/e.md"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"k{i % 3}", ["a", "b", "c"][i % 2], f"p{i // 5}") for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, key string, action string, params string")
    for part in range(4):
        df.where(F.col("seq") % 4 == part).orderBy("seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    status = stream.select(F.col("key").alias("impact_id"), F.col("action").alias("status"), "seq")
    q = ledgers.run(status, "decisions", str(tmp_path / "out"))
    q.awaitTermination()
    got = ledgers.latest(spark, "decisions", str(tmp_path / "out"), q.lastProgress["batchId"])
    want = ledgers.current_status(df.select(F.col("key").alias("impact_id"), F.col("action").alias("status"), "seq"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_queue_totals(spark):
    q = spark.createDataFrame([("a", "pending"), ("a", "reviewed"), ("b", "stale")], "kind string, status string")
    got = {(r["by"], r["name"]): (r["n"], r["actionable"]) for r in views.queue_summary(q).collect()}
    assert got[("total", "all")] == (3, 2) and got[("kind", "a")] == (2, 1) and got[("status", "stale")] == (1, 1)
