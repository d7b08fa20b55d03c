"""Queries of sources and sinks that go through files, and of the parts of operators that the main flows do not reach.

Files are written by Spark into the shared folder that the cluster names, from the given tables, and read back.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_folder
from ..functions.workers import importable
from ..operators import alias, freshness, grid, maintain, markdown, privacy, search, views
from ..sources import readers, sinks, workbooks
from . import impact_queries, more_queries
from . import tables as t

_joined = lambda c: F.array_join(c, ",").alias(c)
_doc = lambda: F.concat(F.lit("d"), F.col("doc_id").cast("string"))


def _folder(s: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(s)}/{name}-{uuid.uuid4()}"


def collection_rows(s: SparkSession, d: str) -> DataFrame:
    """Relations written as JSON lines and read back with their fixed schema."""
    path = _folder(s, "relations")
    sinks.write_collection(t.relations(s, d), path, "gzip")
    r = readers.read_collection(s, path, "relations")
    return r.select("relation_id", "relation_type", "source_id", "target_id", "status", F.size("evidence_ids").alias("n_evidence"), _joined("source_document_ids"))


def csv_rows(s: SparkSession, d: str) -> DataFrame:
    """Parts written as CSV whose first name has a byte-order mark, read back."""
    path = _folder(s, "parts")
    t.raw(s, d, "part").select(F.col("p_partkey").alias("﻿field_id"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name")).write.option("header", True).option("escape", '"').csv(path)
    return readers.read_csv(s, path).select("field_id", "name")


def review_rows(s: SparkSession, d: str) -> DataFrame:
    """Review results written as JSON lists and read back."""
    path = _folder(s, "reviews")
    row = F.struct(_doc().alias("artifact_id"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), F.lit("a\nnote").alias("note"))
    lists = t.raw(s, d, "labels").groupBy((F.col("doc_id") % 50).alias("k")).agg(F.to_json(F.collect_list(row)).alias("text"))
    lists.repartition(50, "k").sortWithinPartitions("k").select("text").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_reviews(s, path).groupBy("decision", "note").agg(F.count("*").alias("n"), F.count_distinct("artifact_id").alias("artifacts"))


_HEAD = '<?xml version="1.0"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006/relationships"


def small_book(rows: list[tuple[str, float, bool]]) -> bytes:
    """A workbook with two sheets: names (with a phonetic run), numbers, flags and a date per row; and a hidden sheet with a drawing."""
    cells = []
    for i, (name, number, flag) in enumerate(rows, start=2):
        text = f'<c r="A{i}" t="inlineStr" s="1"><is><r><t>{name}</t></r><rPh sb="0" eb="1"><t>read</t></rPh></is></c>'
        cells.append(f'<row r="{i}">{text}<c r="B{i}"><v>{number}</v></c><c r="C{i}" t="b"><v>{int(flag)}</v></c><c r="D{i}" s="2"><v>45000.5</v></c></row>')
    sheet = f'{_HEAD}<worksheet xmlns="{_MAIN}" xmlns:r="{_REL}"><cols><col min="4" max="4" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row>{"".join(cells)}</sheetData>'
    sheet += '<mergeCells><mergeCell ref="F1:G1"/></mergeCells><hyperlinks><hyperlink ref="A1" r:id="rId1"/></hyperlinks></worksheet>'
    styles = f'<styleSheet xmlns="{_MAIN}"><fonts><font/><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor theme="4"/></patternFill></fill></fills>'
    styles += '<borders><border/></borders><cellXfs><xf/><xf fontId="1" fillId="1"><alignment horizontal="center"/></xf><xf numFmtId="22"/></cellXfs></styleSheet>'
    links = lambda *rows: f'<Relationships xmlns="{_PACK}">{"".join(rows)}</Relationships>'
    link = lambda i, kind, target, mode="": f'<Relationship Id="rId{i}" Type="{_REL}/{kind}" Target="{target}"{mode}/>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Old" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": links(link(1, "worksheet", "worksheets/sheet1.xml"), link(2, "worksheet", "worksheets/sheet2.xml")),
        "xl/styles.xml": styles,
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/_rels/sheet1.xml.rels": links(link(1, "hyperlink", "https://example.org/x", ' TargetMode="External"'), link(2, "comments", "../comments1.xml")),
        "xl/comments1.xml": f'<comments xmlns="{_MAIN}"><commentList><comment ref="B2"><text><r><t>see </t></r><r><t>note</t></r></text></comment></commentList></comments>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>',
        "xl/worksheets/_rels/sheet2.xml.rels": links(link(1, "drawing", "../drawings/drawing1.xml")),
        "xl/drawings/drawing1.xml": '<d:wsDr xmlns:d="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"><d:pic/><d:pic/></d:wsDr>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return buffer.getvalue()


def _books(s: SparkSession, d: str) -> DataFrame:
    """Parsed workbooks: one per nation with its suppliers."""
    importable(s)
    rows = t.raw(s, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("s_suppkey")
        body = small_book([(n, k + 0.5 if k % 2 else int(k), k % 3 == 0) for k, n in zip(ordered["s_suppkey"], ordered["s_name"], strict=True)])
        return pd.DataFrame({"path": [f"in/Book {key[0]}.xlsx"], "content": [body]})

    return workbooks.parsed(rows.groupBy("s_nationkey").applyInPandas(write, "path string, content binary"))


def workbook_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells of the workbooks with values, types, styles, links and comments."""
    c = workbooks.cells_table(_books(s, d))
    return c.select(
        F.regexp_extract("file_path", "Book ([0-9]+)", 1).alias("book"), "sheet_name", "cell", F.coalesce("value", F.lit("")).alias("value"), "data_type", "row", "column", F.coalesce("merged_range", F.lit("")).alias("merged_range"),
        F.coalesce("style.fill_color", F.lit("")).alias("fill"), "style.font_bold", "style.number_format", F.coalesce("style.horizontal", F.lit("")).alias("horizontal"), F.coalesce("hyperlink", F.lit("")).alias("hyperlink"),
        F.coalesce("comment", F.lit("")).alias("comment"), "is_hidden_col", F.col("evidence_id").rlike(r"^cell\.wb_book_[0-9]+_[0-9a-f]{12}_sheet_001\.[a-g][0-9]+$").alias("named"),
    )


def workbook_sheets(s: SparkSession, d: str) -> DataFrame:
    """Sheets of the workbooks."""
    return workbooks.sheets_table(_books(s, d)).select("file_name", "sheet_name", "sheet_index", "hidden", _joined("drawings"))


def baseline_diff(s: SparkSession, d: str) -> DataFrame:
    """Relations against a named snapshot that was written of those that are not inferred."""
    folder = _folder(s, "baselines")
    r = t.flat(s, d, "relations")
    sinks.write_baseline(r.where("polarity <> 'inferred'"), folder, "first")
    return maintain.relation_diff(r.where("relation_type <> 'READS'"), s.read.parquet(f"{folder}/first"))


def _changes(s: SparkSession, d: str) -> DataFrame:
    old, new = t.flat(s, d, "documents_old"), t.flat(s, d, "documents_new")
    return freshness.document_changes(old, new, old.select("document_id"))


def stale_impacts(s: SparkSession, d: str) -> DataFrame:
    """Impacts that hold evidence of changed documents."""
    docs = t.raw(s, d, "documents")
    ev = docs.select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_id"), _doc().alias("document_id"))
    stale = freshness.stale_by_source(_changes(s, d), ev, "evidence", "evidence_id")
    i = docs.groupBy(F.concat(F.lit("a"), (F.col("doc_id") % 97).cast("string")).alias("artifact_id"), F.concat(F.lit("c"), F.col("lang")).alias("change_id")).agg(F.collect_list(F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("evidence_ids"))
    return freshness.stale_impacts(stale, i, _changes(s, d)).select("stale_id", "target_id", "document_id", "reason")


def _relation_changes(s: SparkSession, d: str) -> DataFrame:
    r = t.relations(s, d)
    return freshness.relation_changes(r.where("relation_type <> 'MENTIONS'"), r.where("relation_id not like 'rel.c%7'"))


def graph_diffs(s: SparkSession, d: str) -> DataFrame:
    """The record of a later load and that of a first one."""
    later = freshness.graph_diff("t1", _changes(s, d), _relation_changes(s, d), t.flat(s, d, "relations"))
    old = t.flat(s, d, "documents_old")
    r = t.relations(s, d)
    first = freshness.graph_diff("t0", freshness.document_changes(old.limit(0), old), freshness.relation_changes(r.limit(0), r), r.limit(0))
    return later.unionByName(first)


def graph_diff_items(s: SparkSession, d: str) -> DataFrame:
    """Documents and relations of a diff."""
    return freshness.diff_items("t1", _changes(s, d), _relation_changes(s, d)).select("kind", "item_id")


def resolved_stale(s: SparkSession, d: str) -> DataFrame:
    """Stale records after some of their relations were dealt with."""
    r = impact_queries.stale_relations(s, d).select("stale_id", F.lit("relation").alias("target_type"), "target_id", F.lit(None).cast("string").alias("resolved_at"))
    return freshness.resolve_stale(r, r.where("target_id like '%4'"), "now").select("target_id", F.coalesce("resolved_at", F.lit("open")).alias("state"))


def decided_diffs(s: SparkSession, d: str) -> DataFrame:
    """A diff per user after decisions on some."""
    u = t.raw(s, d, "events").select(F.concat(F.lit("diff."), F.col("user_id").cast("string")).alias("diff_id"), "user_id").distinct()
    diffs = u.select("diff_id", F.lit("pending").alias("status"), F.lit("").alias("reason"))
    dec = u.where("user_id % 3 = 0").select("diff_id", F.lit("reviewed").alias("status"), F.lit("seen").alias("reason"))
    return freshness.decide_diffs(diffs, dec, "now").withColumn("reviewed_at", F.coalesce("reviewed_at", F.lit("")))


def changed_aliases(s: SparkSession, d: str) -> DataFrame:
    """Entities after brands were added to their aliases and some canonical names taken away."""
    e, p = t.entities(s, d), t.raw(s, d, "part").select(F.concat(F.lit("entity."), F.col("p_partkey").cast("string")).alias("item_id"), "p_partkey", "p_brand")
    more = alias.add_aliases(e, p.where("p_partkey % 2 = 0").select("item_id", F.col("p_brand").alias("alias")), "entity_id")
    gone = e.where("entity_id like '%5' or entity_id like '%6'").select(F.col("entity_id").alias("item_id"), F.col("canonical_name").alias("alias"))
    return alias.remove_aliases(more, gone, "entity_id").select("entity_id", _joined("aliases"))


def submitted_atoms(s: SparkSession, d: str) -> DataFrame:
    """Submitted atoms with their problems; every part sends one for its change, every fourth with a value that no change has (its text may hold any number: it has the part's key)."""
    c = t.changes(s, d).where("change_id not like '%9'")
    p = t.raw(s, d, "part")
    a = p.select(F.concat(F.lit("chg."), F.col("p_partkey").cast("string")).alias("change_id"), (F.col("p_partkey") % 50).cast("string").alias("before"), F.when(F.col("p_partkey") % 4 == 0, "77777 days").otherwise("99").alias("after"), F.when(F.col("p_size") > 25, F.array("p_name")).otherwise(t.none()).alias("target_terms"))
    return search.check_atoms(a, c).select("change_id", _joined("problems"))


def region_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells of each region for an offline model, as their number and a hash of their values."""
    c = t.cells(s, d)
    r = grid.detect_regions(c, grid.classify_sheets(c))
    m = grid.region_members(r, c.drop("sheet_name"))
    return search.region_context(m).select("region_id", F.size("cells").alias("n"), F.sha2(F.array_join(F.transform("cells", lambda x: F.concat(x["cell"], F.lit("="), x["value"])), "|"), 256).alias("values_hash"))


def chunk_preview(s: SparkSession, d: str) -> DataFrame:
    """The first two chunks of each supplier's document."""
    m = more_queries._markdown(s, d)
    return views.chunk_preview(markdown.chunks(m, markdown.sections(m)), 2).select("document_id", "n", "line_start")


def cell_preview(s: SparkSession, d: str) -> DataFrame:
    """Cells near the marked references."""
    c = t.cells(s, d)
    return views.cell_preview(c, c.where("value = '別紙参照'"), 2, 3, 400).select("sheet_id", "cell", "value")


def count_delta(s: SparkSession, d: str) -> DataFrame:
    """Change of the collections' sizes after a load."""
    r = t.flat(s, d, "relations")
    one = views.counts({"relations": r.where("polarity = 'explicit'"), "calls": t.flat(s, d, "calls")})
    two = views.counts({"relations": r, "entities": t.flat(s, d, "entities")})
    return views.delta(one, two)


def latest_audit(s: SparkSession, d: str) -> DataFrame:
    """The ten latest calls (a limit of the report)."""
    return privacy.latest(more_queries.audit_rows(s, d), "run_id", 10)


def replayed_runs(s: SparkSession, d: str) -> DataFrame:
    """K1: changes with the artifacts that they led to."""
    from . import extra_queries

    r = sinks.replay(t.changes(s, d), extra_queries._hop1(s, d))
    return r.select("change_id", "title", F.coalesce(F.array_join("artifact_ids", ","), F.lit("")).alias("artifact_ids"))


def review_queue_items(s: SparkSession, d: str) -> DataFrame:
    """All six kinds of reviewable records with their sort keys."""
    from . import extra_queries

    i = extra_queries._hop1(s, d)
    none = s.createDataFrame([], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    board = views.decision_board(search.seed_decisions(i, none, "t"), i)
    users = t.raw(s, d, "events").select("user_id").distinct()
    name = F.col("user_id").cast("string")
    diffs = users.select(F.concat(F.lit("g"), name).alias("diff_id"), F.array(name).alias("document_ids"), F.when(F.col("user_id") % 2 == 0, "pending").otherwise("reviewed").alias("status"), F.lit("").alias("reason"))
    proposals = users.select(F.concat(F.lit("p"), name).alias("proposal_id"), F.concat(F.lit("r"), name).alias("region_id"), F.lit("pending").alias("status"), F.lit(2).alias("nodes"), F.lit(1).alias("edges"), t.none().alias("evidence_ids"), F.when(F.col("user_id") % 3 == 0, F.array(F.lit("同上"), F.lit("別紙参照"))).otherwise(t.none()).alias("unresolved"))
    al = extra_queries._trigram_candidates(s, d)
    stale = t.flat(s, d, "relations").where("relation_type = 'READS'").select(F.lit("relation").alias("target_type"), F.col("relation_id").alias("target_id"), F.lit(None).cast("string").alias("resolved_at"), F.lit("changed").alias("reason"))
    q = views.review_queue(diffs, proposals, al, t.flat(s, d, "relations").withColumn("evidence_ids", t.none()), board, stale)
    return q.select("item_id", "kind", "title", "subtitle", "status", "priority", "rank", "priority_rank")


QUERIES = {
    f.__name__: f
    for f in (
        collection_rows, csv_rows, review_rows, workbook_cells, workbook_sheets, baseline_diff, stale_impacts, graph_diffs, graph_diff_items, resolved_stale, decided_diffs, changed_aliases, submitted_atoms, region_cells, chunk_preview, cell_preview,
        count_delta, latest_audit, replayed_runs, review_queue_items,
    )
}

_I = impact_queries._INPUT
_S = impact_queries._STALE
_RC = """r AS (SELECT * FROM relations_t UNION ALL SELECT * FROM calls_t), rc AS (SELECT relation_id, CASE WHEN relation_id LIKE 'rel.c%7' THEN 'removed' WHEN relation_type = 'MENTIONS' THEN 'added' END AS change FROM r)"""
_HOP = "WITH " + impact_queries._HOP1 + """, ok AS (SELECT h.* FROM hop1 h JOIN artifacts_t USING (artifact_id) WHERE status <> 'rejected'),
    best AS (SELECT change_id, artifact_id, min(CASE review_priority WHEN 'must_review' THEN 0 WHEN 'should_review' THEN 1 ELSE 2 END) AS k FROM ok GROUP BY 1, 2)"""
ORACLE_SQL = {
    "collection_rows": t.with_views("""SELECT r.relation_id, relation_type, source_id, target_id, status, CAST(coalesce(n, 0) AS INTEGER) AS n_evidence, document_id AS source_document_ids FROM (SELECT * FROM relations_t UNION ALL SELECT * FROM calls_t) r
        LEFT JOIN (SELECT relation_id, count(DISTINCT evidence_id) AS n FROM evidence_t GROUP BY 1) e ON e.relation_id = r.relation_id""", "relations", "calls", "evidence"),
    "csv_rows": """SELECT CAST(p_partkey AS VARCHAR) AS field_id, p_name || ', "' || p_brand || '"' AS name FROM part""",
    "review_rows": "SELECT CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, 'a' || chr(10) || 'note' AS note, count(*) AS n, count(DISTINCT doc_id) AS artifacts FROM labels GROUP BY 1",
    "workbook_cells": """WITH s AS (SELECT CAST(s_nationkey AS VARCHAR) AS book, s_suppkey AS k, s_name, CAST(1 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS r FROM supplier),
        x AS (SELECT book, 'A' AS l, r, 1 AS c, s_name AS value, 's' AS data_type, 'theme:4' AS fill, true AS font_bold, 'General' AS number_format, 'center' AS horizontal, '' AS comment FROM s
            UNION ALL SELECT book, 'B', r, 2, CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) || '.5' ELSE CAST(k AS VARCHAR) END, 'n', '', false, 'General', '', CASE WHEN r = 2 THEN 'see note' ELSE '' END FROM s
            UNION ALL SELECT book, 'C', r, 3, CASE WHEN k % 3 = 0 THEN 'True' ELSE 'False' END, 'b', '', false, 'General', '', '' FROM s UNION ALL SELECT book, 'D', r, 4, '2023-03-15 12:00:00', 'd', '', false, 'm/d/yy h:mm', '', '' FROM s
            UNION ALL SELECT DISTINCT book, 'A', 1, 1, 'name', 's', '', false, 'General', '', '' FROM s UNION ALL SELECT DISTINCT book, 'F', 1, 6, '', 'n', '', false, 'General', '', '' FROM s UNION ALL SELECT DISTINCT book, 'G', 1, 7, '', 'n', '', false, 'General', '', '' FROM s)
        SELECT book, 'Data' AS sheet_name, l || CAST(r AS VARCHAR) AS cell, value, data_type, r AS row, CAST(c AS INTEGER) AS "column", CASE WHEN l IN ('F', 'G') THEN 'F1:G1' ELSE '' END AS merged_range, fill, font_bold, number_format, horizontal,
            CASE WHEN l = 'A' AND r = 1 THEN 'https://example.org/x' ELSE '' END AS hyperlink, comment, l = 'D' AS is_hidden_col, true AS named FROM x""",
    "workbook_sheets": """SELECT DISTINCT 'Book ' || CAST(s_nationkey AS VARCHAR) || '.xlsx' AS file_name, n AS sheet_name, CAST(i AS INTEGER) AS sheet_index, i = 2 AS hidden, CASE WHEN i = 2 THEN '2 images' ELSE '' END AS drawings FROM supplier, (VALUES (1, 'Data'), (2, 'Old')) v(i, n)""",
    "baseline_diff": t.with_views("SELECT relation_id, 'added' AS change FROM relations_t WHERE relation_type <> 'READS' AND polarity = 'inferred' UNION ALL SELECT relation_id, 'removed' FROM relations_t WHERE relation_type = 'READS' AND polarity <> 'inferred'", "relations"),
    "stale_impacts": t.with_views(_S + """, st AS (SELECT * FROM ch WHERE change_type IN ('modified', 'removed')), first AS (SELECT * FROM st ORDER BY document_id LIMIT 1),
        hit AS (SELECT DISTINCT 'impact.c' || lang || '.a' || CAST(doc_id % 97 AS VARCHAR) AS target_id FROM documents WHERE 'd' || CAST(doc_id AS VARCHAR) IN (SELECT document_id FROM st))
        SELECT 'stale.' || substring(sha1('impact|' || target_id || '|' || document_id || '|' || coalesce(current_hash, 'None')), 1, 16) AS stale_id, target_id, document_id, 'Source ' || change_type || ': ' || source_path AS reason FROM hit, first""", "documents_old", "documents_new"),
    "graph_diffs": t.with_views(_S + ", " + _RC + """ SELECT 'diff.' || substring(sha1('t1'), 1, 12) AS diff_id, 't1' AS transaction_id, (SELECT count(*) FROM ch WHERE change_type IS NOT NULL) AS documents, (SELECT count(*) FROM rc WHERE change = 'added') AS added_relations,
            (SELECT count(*) FROM rc WHERE change = 'removed' AND relation_id NOT IN (SELECT relation_id FROM r WHERE relation_type = 'MENTIONS')) AS removed_relations, 0 AS changed_relations, 'pending' AS status, '' AS reason
        UNION ALL SELECT 'diff.' || substring(sha1('t0'), 1, 12), 't0', (SELECT count(*) FROM old), (SELECT count(*) FROM r), 0, 0, 'reviewed', 'Initial graph build'""", "documents_old", "documents_new", "relations", "calls"),
    "graph_diff_items": t.with_views(_S + ", " + _RC + " SELECT 'document' AS kind, document_id AS item_id FROM ch WHERE change_type IS NOT NULL UNION ALL SELECT 'relation_' || change, relation_id FROM rc WHERE change IS NOT NULL", "documents_old", "documents_new", "relations", "calls"),
    "resolved_stale": t.with_views(_S + " SELECT 'r' || substring(document_id, 2) AS target_id, CASE WHEN document_id LIKE '%4' THEN 'now' ELSE 'open' END AS state FROM ch WHERE change_type IN ('modified', 'removed')", "documents_old", "documents_new"),
    "decided_diffs": "SELECT DISTINCT 'diff.' || CAST(user_id AS VARCHAR) AS diff_id, CASE WHEN user_id % 3 = 0 THEN 'reviewed' ELSE 'pending' END AS status, CASE WHEN user_id % 3 = 0 THEN 'seen' ELSE '' END AS reason, CASE WHEN user_id % 3 = 0 THEN 'now' ELSE '' END AS reviewed_at FROM events",
    "changed_aliases": t.with_views("""SELECT entity_id, array_to_string(list_sort(list_filter([CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 10 NOT IN (5, 6) THEN canonical_name END], lambda x: x IS NOT NULL)), ',') AS aliases
        FROM entities_t JOIN part ON entity_id = 'entity.' || CAST(p_partkey AS VARCHAR)""", "entities"),
    "submitted_atoms": """SELECT 'chg.' || CAST(p_partkey AS VARCHAR) AS change_id, array_to_string(list_filter([CASE WHEN p_partkey % 10 = 9 THEN 'unknown_change' END, CASE WHEN p_partkey % 10 <> 9 AND p_partkey % 4 = 0 THEN 'after_not_in_text' END, CASE WHEN p_size <= 25 THEN 'no_terms' END], lambda x: x IS NOT NULL), ',') AS problems FROM part""",
    "region_cells": t.with_views(more_queries._GRID + more_queries._REGIONS + " SELECT region_id, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(substring('ABCDEFGHIJ', c, 1) || CAST(r AS VARCHAR) || '=' || value, '|' ORDER BY r, c)) AS values_hash FROM mem GROUP BY 1", "cells"),
    "chunk_preview": "SELECT 'doc.s' || CAST(s_suppkey AS VARCHAR) AS document_id, CAST(n AS INTEGER) AS n, CAST(CASE n WHEN 1 THEN 1 ELSE 3 END AS INTEGER) AS line_start FROM supplier, (VALUES (1), (2)) v(n)",
    "cell_preview": t.with_views("WITH c AS (SELECT sheet_id, r, c, min(value) AS value FROM cells_t GROUP BY 1, 2, 3) SELECT DISTINCT a.sheet_id, substring('ABCDEFGHIJ', a.c, 1) || CAST(a.r AS VARCHAR) AS cell, a.value FROM c a JOIN c b ON a.sheet_id = b.sheet_id AND b.value = '別紙参照' AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 3", "cells"),
    "count_delta": t.with_views("""WITH n AS (SELECT 'relations' AS collection, count(*) FILTER (polarity = 'explicit') AS before, count(*) AS after FROM relations_t UNION ALL SELECT 'calls', count(*), 0 FROM calls_t UNION ALL SELECT 'entities', 0, count(*) FROM entities_t) SELECT *, after - before AS delta FROM n""", "relations", "calls", "entities"),
    "latest_audit": more_queries.ORACLE_SQL["audit_rows"] + " ORDER BY run_id DESC LIMIT 10",
    "replayed_runs": t.with_views(_HOP + " SELECT c.change_id, title, coalesce(string_agg(artifact_id, ',' ORDER BY artifact_id), '') AS artifact_ids FROM changes_t c LEFT JOIN best b ON b.change_id = c.change_id GROUP BY 1, 2", *_I),
    "review_queue_items": t.with_views(_HOP + """, u AS (SELECT DISTINCT user_id AS u, CAST(user_id AS VARCHAR) AS n FROM events), tri AS (""" + more_queries.ORACLE_SQL["alias_trigram_pairs"] + """),
        nm AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, p_name AS d FROM part), al AS (SELECT CASE WHEN (length(x.d), x.id) <= (length(y.d), y.id) THEN x.id ELSE y.id END AS a, CASE WHEN (length(x.d), x.id) <= (length(y.d), y.id) THEN y.id ELSE x.id END AS b FROM tri JOIN nm x ON x.id = tri."left" JOIN nm y ON y.id = tri."right"),
        q AS (SELECT 'graph_diff:g' || n AS item_id, 'graph_diff' AS kind, 'Graph diff g' || n AS title, '1 source changes' AS subtitle, CASE WHEN u % 2 = 0 THEN 'pending' ELSE 'reviewed' END AS status, CASE WHEN u % 2 = 0 THEN 'should_review' ELSE 'may_review' END AS priority FROM u
            UNION ALL SELECT 'proposal:p' || n, 'graph_proposal', 'Region r' || n, '2 nodes / 1 edges', 'pending', 'should_review' FROM u
            UNION ALL SELECT 'mention:p' || n || ':' || CAST(i AS VARCHAR), 'unresolved_mention', m, 'Region r' || n, 'needs_investigation', 'may_review' FROM u, (VALUES (0, '同上'), (1, '別紙参照')) v(i, m) WHERE u % 3 = 0
            UNION ALL SELECT 'alias:alias_' || substring(sha1('embedding_similarity' || a || b), 1, 10), 'alias', a, 'unsure: ' || b, 'pending', 'may_review' FROM al
            UNION ALL SELECT 'relation:' || relation_id, 'relation', relation_type, source_id || ' → ' || target_id, CASE WHEN relation_type = 'READS' THEN 'stale' ELSE status END, CASE WHEN relation_type = 'READS' OR status = 'unconfirmed' THEN 'should_review' ELSE 'may_review' END FROM relations_t
            UNION ALL SELECT 'impact:impact.' || change_id || '.' || b.artifact_id, 'impact', display_name, artifact_type, 'unreviewed', ['must_review', 'should_review', 'may_review'][k + 1] FROM best b JOIN artifacts_t a ON a.artifact_id = b.artifact_id)
        SELECT *, CAST(CASE WHEN status IN ('pending', 'unreviewed', 'unconfirmed', 'stale') THEN 0 WHEN status = 'needs_investigation' THEN 1 ELSE 2 END AS INTEGER) AS rank, CAST(CASE priority WHEN 'must_review' THEN 0 WHEN 'should_review' THEN 1 ELSE 2 END AS INTEGER) AS priority_rank FROM q""", *_I),
}
