"""Queries of text extraction, alias resolution, vectors, privacy, evaluation, grids, views, sources and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import EDGE, END, SPACE, START
from ..functions.lineage import checkpoint_folder, cut
from ..operators import alias, evaluate, grid, maintain, markdown, privacy, search, vectors, views
from ..sources import readers
from ..streaming import ledgers
from . import impact_queries
from . import tables as t

_joined = lambda c: F.array_join(c, ",").alias(c)
_doc = lambda: F.concat(F.lit("d"), F.col("doc_id").cast("string"))

#: A Markdown document per supplier, with Unicode white space where a document may have it ({w}: U+3000).
_LINES = (
    "'#' || {w} || s_name || ' API'",
    "''",
    "'##' || {w} || 'Request ' || {w} || ' fields' || {w}",
    "'- ' || lower(s_name) || ': key'",
    "'- balance_' || CAST(s_nationkey AS STRING) || {w}",
    "'## Reads'",
    "'- NATION_T' || CAST(s_nationkey AS STRING)",
    "'Note:'",
    "'- not a field'",
    "'Writes:' || {w} || 'LOG_A, LOG_B' || CAST(s_suppkey AS STRING)",
    "'## 呼び出し'",
    "'- Gateway ' || CAST(s_suppkey AS STRING)",
    "'- Doc field ' || CAST(s_suppkey AS STRING)",
    "'## Table' || {w} || ': T' || CAST(s_suppkey % 7 AS STRING)",
    "'- code'",
    "'- amount'",
    "{w}",
)
MARKDOWN = "SELECT 'doc.s' || CAST(s_suppkey AS STRING) AS document_id, " + " || chr(10) || ".join(_LINES).replace("{w}", "chr(12288)") + " AS text FROM {supplier}"


def _markdown(s: SparkSession, d: str) -> DataFrame:
    text = MARKDOWN.replace("chr(12288)", "decode(unhex('E38080'), 'UTF-8')")  # Spark's chr() stops at 255
    return s.sql(text, supplier=t.raw(s, d, "supplier"))


def _markdown_relations(s: SparkSession, d: str) -> DataFrame:
    return markdown.relations_of(markdown.scan(_markdown(s, d)), t.flat(s, d, "catalog"))


_MD = MARKDOWN.replace("{supplier}", "supplier")


def document_rows(s: SparkSession, d: str) -> DataFrame:
    """Id, title and content hash of every document."""
    x = t.raw(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_key"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return markdown.documents(x).select("document_id", "hash", "path")


def sections(s: SparkSession, d: str) -> DataFrame:
    """Sections of the suppliers' documents."""
    return markdown.sections(_markdown(s, d)).select("document_id", "heading", "level", "line_start", "line_end")


def chunks(s: SparkSession, d: str) -> DataFrame:
    """Text of each section, as a hash."""
    m = _markdown(s, d)
    return markdown.chunks(m, markdown.sections(m)).select("document_id", "line_start", F.sha2("text", 256).alias("text_hash"))


def document_chunks(s: SparkSession, d: str) -> DataFrame:
    """T1, T2 over the document table, which has no headings: one chunk each."""
    x = t.raw(s, d, "documents").select(_doc().alias("document_id"), "text")
    return markdown.chunks(x, markdown.sections(x)).select("document_id", "line_start", "line_end")


def markdown_relations(s: SparkSession, d: str) -> DataFrame:
    """Relations that the lines of the suppliers' documents state, named and typed by a catalog."""
    r = _markdown_relations(s, d)
    return r.select("document_id", "line", "source_type", "source_id", "relation_type", "target_type", "target_id", "evidence_type", "quote")


def markdown_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Relations of each document once."""
    kept, _ = markdown.dedupe_relations(_markdown_relations(s, d))
    return kept.select("document_id", "source_id", "relation_type", "target_id", F.size("evidence_ids").alias("n_evidence"))


def relation_lines_in_chunks(s: SparkSession, d: str) -> DataFrame:
    """The section that holds each relation's line."""
    m = _markdown(s, d)
    c = markdown.chunks(m, markdown.sections(m))
    r = markdown.with_chunk(_markdown_relations(s, d), c)
    return r.join(markdown.sections(m).select("section_id", "heading"), "section_id").select("document_id", "line", "target_id", "heading")


def plain_mentions(s: SparkSession, d: str) -> DataFrame:
    """Business fields (words of part names) that documents mention."""
    words = t.raw(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("alias")).distinct()
    al = words.select(F.concat(F.lit("entity."), "alias").alias("item_id"), F.lit("BusinessField").alias("canonical_type"), "alias", F.lit(0).alias("seq"))
    x = t.raw(s, d, "documents").select(_doc().alias("document_id"), "text")
    c = x.select("document_id", F.concat(F.lit("chunk."), "document_id").alias("chunk_id"), F.lit("s").alias("section_id"), F.lit(1).alias("line_start"), "text")
    src = x.select("document_id", F.concat(F.lit("document."), "document_id").alias("source_id"))
    empty = s.createDataFrame([], "source_id string, target_id string, document_id string")
    return markdown.plain_mentions(c, src, al, empty, empty.select("document_id")).select("source_id", "target_id", "alias")


def unresolved(s: SparkSession, d: str) -> DataFrame:
    """Unresolved references in cell regions."""
    c = t.cells(s, d)
    r = grid.detect_regions(c, grid.classify_sheets(c))
    return r.select("region_id", F.explode(markdown.unresolved_mentions(F.col("rendered_text"))).alias("mention"))


def alias_suggestions(s: SparkSession, d: str) -> DataFrame:
    """Display names that are no alias yet."""
    return markdown.alias_suggestions(t.entities(s, d), "entity_id")


def name_index(s: SparkSession, d: str) -> DataFrame:
    """A1: names that may mean several ids, with how many."""
    return alias.name_index(t.artifacts(s, d), t.entities(s, d)).select("name", F.size("ids").alias("n_ids"))


def alias_collisions(s: SparkSession, d: str) -> DataFrame:
    """A2: part names under several parts."""
    x = t.raw(s, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("alias"))
    return alias.collisions(x).select("alias", F.size("item_ids").alias("n_items"))


def concept_keys(s: SparkSession, d: str) -> DataFrame:
    """A3, A4: concept key and identifier tokens of every part."""
    e = t.entities(s, d)
    return e.select("entity_id", alias.concept_key(F.col("display_name"), F.col("canonical_name")).alias("concept"), F.array_join(F.array_sort(F.array_distinct(alias.tokens(F.col("canonical_name")))), ",").alias("tokens"))


def _distinct_names(s: SparkSession, d: str) -> DataFrame:
    """One entity per distinct part name."""
    g = t.flat(s, d, "shared_names").groupBy("display_name").agg(F.min("canonical_name").alias("canonical_name"))
    return g.select(F.concat(F.lit("entity."), "canonical_name").alias("entity_id"), F.lit("BusinessField").alias("entity_type"), "display_name", "canonical_name", t.none().alias("aliases"), F.array(F.lit("rule")).alias("extraction_methods"))


def alias_trigram_pairs(s: SparkSession, d: str) -> DataFrame:
    """A5: pairs of part names by trigram cosine."""
    return alias.trigram_pairs(_distinct_names(s, d)).select("left", "right", F.round("score", 4).alias("score"))


def _name_relations(s: SparkSession, d: str) -> DataFrame:
    p = t.raw(s, d, "part").select("p_partkey", F.concat(F.lit("entity."), F.regexp_replace("p_name", " ", "_")).alias("_e"))
    r = t.relations(s, d).where("target_id like 'entity.%'").withColumn("_k", F.substring_index("target_id", ".", -1).cast("long"))
    return r.join(p, F.col("_k") == F.col("p_partkey")).withColumn("target_id", F.col("_e")).drop("_e", "_k", "p_partkey")


def alias_context_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of part names by the Jaccard of their relation contexts."""
    return alias.context_pairs(_distinct_names(s, d), _name_relations(s, d)).select("left", "right", F.round("score", 4).alias("score"))


def alias_evidence_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of part names with evidence within three lines of one file, with the number of evidence rows."""
    x = alias.evidence_pairs(_distinct_names(s, d), _name_relations(s, d), t.evidence(s, d))
    return x.groupBy("left", "right").agg(F.count_distinct("evidence_id").alias("n"))


def alias_candidates(s: SparkSession, d: str) -> DataFrame:
    """Alias candidates of all signals."""
    e = _distinct_names(s, d)
    p = alias.signals(e, _name_relations(s, d), t.evidence(s, d))
    c = alias.candidates(e, p)
    return c.select("candidate_id", "target_id", "entity_b_id", F.size("signals").alias("n_signals"), _joined("aliases"))


def _all_entities(s: SparkSession, d: str) -> DataFrame:
    """One entity per part; parts of one name share it."""
    return t.flat(s, d, "shared_names").select("entity_id", F.lit("BusinessField").alias("entity_type"), "display_name", "canonical_name", t.none().alias("aliases"), F.array("method").alias("extraction_methods"))


def alias_trigram_members(s: SparkSession, d: str) -> DataFrame:
    """A5: the class of equal trigrams of every part."""
    return alias.trigram_classes(_all_entities(s, d))[0]


def alias_trigram_classes(s: SparkSession, d: str) -> DataFrame:
    """A5: pairs of those classes by trigram cosine; a class with itself stands for the pairs within."""
    return alias.trigram_classes(_all_entities(s, d))[1].select("l_grp", "r_grp", F.round("score", 4).alias("score"))


def alias_context_members(s: SparkSession, d: str) -> DataFrame:
    """The class of equal relation contexts of every part that has relations."""
    return alias.context_classes(t.entities(s, d), t.relations(s, d))[0]


def alias_context_classes(s: SparkSession, d: str) -> DataFrame:
    """Pairs of those classes by Jaccard; a class with itself stands for the pairs within."""
    return alias.context_classes(t.entities(s, d), t.relations(s, d))[1].select("l_grp", "r_grp", F.round("score", 4).alias("score"))


def alias_part_evidence_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of parts with evidence within three lines of one file, with the number of evidence rows."""
    x = alias.evidence_pairs(t.entities(s, d), t.relations(s, d), t.evidence(s, d))
    return x.groupBy("left", "right").agg(F.count_distinct("evidence_id").alias("n"))


def alias_class_members(s: SparkSession, d: str) -> DataFrame:
    """The class of equal names and contexts of every part."""
    return alias.content_classes(_all_entities(s, d), t.relations(s, d))


def alias_class_signals(s: SparkSession, d: str) -> DataFrame:
    """Signals that all pairs of members of two classes have."""
    e, r = _all_entities(s, d), t.relations(s, d)
    return alias.class_signals(e, r, alias.content_classes(e, r)).select("l_cls", "r_cls", F.array_join("signals", "|").alias("signals"))


def alias_part_candidates(s: SparkSession, d: str) -> DataFrame:
    """Alias candidates of all pairs of parts that have evidence in common; alias_class_signals has the others."""
    e, r = _all_entities(s, d), t.relations(s, d)
    c = alias.content_classes(e, r)
    p = alias.evidence_signals(e, r, t.evidence(s, d), c, alias.class_signals(e, r, c))
    return alias.candidates(e, p).select("candidate_id", "target_id", "entity_b_id", F.size("signals").alias("n_signals"), _joined("aliases"))


def embedding_plan(s: SparkSession, d: str) -> DataFrame:
    """V1: chunks whose vectors are missing or out of date."""
    x = t.raw(s, d, "documents").select(_doc().alias("chunk_id"), "text")
    done = x.where("length(text) % 2 = 0").select("chunk_id", F.sha2(F.when(F.length("text") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("content_hash"), F.lit("p").alias("provider"), F.lit("m").alias("model"))
    return vectors.embedding_plan(x, done, "p", "m").select("chunk_id", "content_hash", "state")


def cosine_top_k(s: SparkSession, d: str) -> DataFrame:
    """V2: the five nearest vectors of every vector whose id is divisible by 20."""
    e = t.raw(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return vectors.cosine_top_k(q, e, 5).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def redact_documents(s: SparkSession, d: str) -> DataFrame:
    """Hash of every redacted document."""
    return t.raw(s, d, "documents").select("doc_id", F.sha2(privacy.redact_text(F.col("text")), 256).alias("redacted_hash"))


def redact_fields(s: SparkSession, d: str) -> DataFrame:
    """Nested fields redacted by key and by content."""
    m = F.create_map(F.lit("customer_name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("note"), F.concat(F.lit("account_number: "), F.lpad(F.col("c_custkey").cast("string"), 8, "0")))
    r = t.raw(s, d, "customer").select("c_custkey", privacy.redact_map(m).alias("m"))
    return r.select("c_custkey", F.col("m")["customer_name"].alias("customer_name"), F.col("m")["segment"].alias("segment"), F.col("m")["note"].alias("note"))


def redact_nested(s: SparkSession, d: str) -> DataFrame:
    """A payload of three levels for every customer, redacted by key and by content."""
    p = t.raw(s, d, "customer").selectExpr(
        "c_custkey",
        """named_struct('customer', named_struct('full_name', c_name, 'segment', c_mktsegment, 'balance', c_acctbal), 'note', 'call 090-1234-' || lpad(cast(c_custkey % 10000 as string), 4, '0'),
            'lines', array(named_struct('text', 'mail u' || c_custkey || '@example.test', 'api_key', c_name, 'keys', array(c_name)), named_struct('text', c_name, 'api_key', null, 'keys', array(c_name))),
            'more', map('account number', map('a', c_name), 'design', map('x', 'term ' || c_mktsegment, 'y', 'token=abcdefgh' || c_custkey))) as payload""",
    )
    r = privacy.redact_columns(p, "c_custkey")
    x = lambda e, n: F.expr(f"payload.{e}").alias(n)
    return r.select(
        "c_custkey", x("customer.full_name", "full_name"), x("customer.segment", "segment"), x("customer.balance", "balance"), x("note", "note"), x("lines[0].text", "mail"), x("lines[0].api_key", "first_key"),
        x("lines[1].text", "plain"), x("lines[1].api_key", "second_key"), x("lines[0].keys[0]", "listed"), x("more['account number']['a']", "account"), x("more['design']['x']", "design"), x("more['design']['y']", "secret"),
    )


def sensitive_counts(s: SparkSession, d: str) -> DataFrame:
    """Documents with a hit per category."""
    return privacy.sensitive_counts(t.raw(s, d, "documents"))


def audit_rows(s: SparkSession, d: str) -> DataFrame:
    """Hashes and sizes of calls, here of the events."""
    e = t.raw(s, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("purpose"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.col("props").alias("payload"), F.col("event_type").alias("answer"), (F.col("event_id") % 2 == 0).alias("redacted"))
    return privacy.audit_rows(e).select("run_id", "payload_hash", "answer_hash", "payload_chars", "redacted")


def answer_summary(s: SparkSession, d: str) -> DataFrame:
    """Answers per kind and user."""
    return privacy.answer_summary(t.raw(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("llm_judgement")))


def _case_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = t.flat(s, d, "actual").withColumn("evidence_ids", F.when(F.col("n_evidence") > 0, F.array(F.lit("e"))).otherwise(t.none()))
    return t.flat(s, d, "expected"), a


_MEASURES = (
    "must_review_recall",
    "should_review_recall",
    "evidence_coverage",
    "evidence_accuracy",
    "relation_precision",
    "relation_recall",
    "visible_precision",
    "candidate_expansion_ratio",
)


def case_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics of each case."""
    m = evaluate.case_metrics(*_case_tables(s, d))
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in _MEASURES], "missed_critical_impacts", "report_size", "alias_resolution_accuracy")


def missed_must(s: SparkSession, d: str) -> DataFrame:
    """Expected must-review artifacts that are not shown as such."""
    return evaluate.missed_must(*_case_tables(s, d))


def dataset_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics of the golden and holdout cases."""
    m = evaluate.dataset_metrics(*_case_tables(s, d), t.flat(s, d, "cases"), ("golden", "holdout"))
    return m.select("case_id", "category", F.round("visible_precision", 6).alias("visible_precision"), "report_size")


def release_gate(s: SparkSession, d: str) -> DataFrame:
    """Totals and checks of the release gate."""
    e, a = _case_tables(s, d)
    pages = t.raw(s, d, "pages").select(F.col("html").alias("report"))
    g = evaluate.release_gate(evaluate.dataset_metrics(e, a, t.flat(s, d, "cases")), e, pages)
    rounded = ("must_review_recall", "visible_precision", "evidence_coverage", "max_expansion_ratio")
    return g.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in g.columns])


def expected_sets(s: SparkSession, d: str) -> DataFrame:
    """Different expected sets, case ids aside; every third case repeats another's set."""
    e = t.flat(s, d, "expected")
    n = F.substring("case_id", 6, 9).cast("int")
    again = e.where(n % 3 == 0).withColumn("case_id", F.concat("case_id", F.lit(".copy")))
    return evaluate.distinct_expected_sets(e.unionByName(again))


def field_is_absent(s: SparkSession, d: str) -> DataFrame:
    """E5: whether no page holds a quoted field name."""
    return evaluate.field_is_absent(t.raw(s, d, "pages").select(F.col("html").alias("report")), "internal_note")


def sheet_types(s: SparkSession, d: str) -> DataFrame:
    """Types of the sheets."""
    return grid.classify_sheets(t.cells(s, d)).select("sheet_id", "sheet_type")


def region_bounds(s: SparkSession, d: str) -> DataFrame:
    """Bounding boxes of the regions."""
    return grid.region_bounds(t.cells(s, d)).select("sheet_id", "start_row", "end_row", "start_column", "end_column")


def region_members(s: SparkSession, d: str) -> DataFrame:
    """Regions with their types and numbers of cells."""
    c = t.cells(s, d)
    return grid.detect_regions(c, grid.classify_sheets(c)).select("sheet_id", "start_row", "start_column", "region_type", "cells", F.size("evidence_ids").alias("n_evidence"))


def region_rendering(s: SparkSession, d: str) -> DataFrame:
    """Text and line offsets of the regions."""
    c = t.cells(s, d)
    r = grid.region_lines(grid.detect_regions(c, grid.classify_sheets(c)))
    return r.select("region_id", "line_start", "line_end", F.sha2("text", 256).alias("text_hash"))


def _proposed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells, regions and the clean nodes and edges that their rows propose."""
    c = cut(t.cells(s, d))
    r = cut(grid.detect_regions(c, grid.classify_sheets(c)))
    rows = grid.region_rows(grid.region_members(r, c.drop("sheet_name")))
    nodes, edges = grid.proposals(cut(grid.row_edges(rows, r)))
    good, kept, _ = grid.clean(cut(nodes), edges, r)
    return c, r, cut(good), cut(kept)


def _book_documents(regions: DataFrame) -> DataFrame:
    w = regions.select("workbook_id").distinct()
    return w.select("workbook_id", F.concat(F.lit("doc."), "workbook_id").alias("document_id"), F.concat("workbook_id", F.lit(".xlsx")).alias("file"))


def _graph_of_cells(s: SparkSession, d: str) -> dict[str, DataFrame]:
    _, r, nodes, edges = _proposed(s, d)
    return grid.proposals_to_graph(nodes, edges, r, r.select("region_id", F.lit("pending").alias("status")), _book_documents(r))


def region_edges(s: SparkSession, d: str) -> DataFrame:
    """Relations that the rows of the regions propose."""
    return _graph_of_cells(s, d)["relations"].select("relation_type", "source_id", "target_id", "polarity", "match_type", "region_id")


def proposed_entities(s: SparkSession, d: str) -> DataFrame:
    """Entities that the proposals name, with their documents."""
    return _graph_of_cells(s, d)["entities"].select("entity_id", "entity_type", "display_name", _joined("source_document_ids"), _joined("extraction_methods"))


def proposed_artifacts(s: SparkSession, d: str) -> DataFrame:
    """Artifacts that the proposals name."""
    return _graph_of_cells(s, d)["artifacts"].select("artifact_id", "artifact_type", "display_name", _joined("source_document_ids"))


def proposed_evidence(s: SparkSession, d: str) -> DataFrame:
    """Evidence of the proposals, with the quoted region as a hash."""
    e = _graph_of_cells(s, d)["evidence"]
    target = F.get("supports", F.lit(0))
    return e.select("document_id", "evidence_type", target["type"].alias("supported"), target["id"].alias("target_id"), "source_location.file", "source_location.line_start", "source_location.line_end", F.sha2("quote", 256).alias("quote_hash"))


def rebuilt_relations(s: SparkSession, d: str) -> DataFrame:
    """X11: relations of all workbooks after the proposals of every second region of some were rejected and theirs were rebuilt."""
    _, r, nodes, edges = _proposed(s, d)
    docs, status = _book_documents(r), r.select("region_id", F.lit("pending").alias("status"))
    decisions = r.where(F.col("workbook_id").rlike("[02468]$") & (F.col("idx") % 2 == 0)).select("region_id", F.lit("rejected").alias("status"))
    old = grid.proposals_to_graph(nodes, edges, r, status, docs)["relations"].withColumn("document_id", F.get("source_document_ids", F.lit(0)))
    new = grid.rebuild(nodes, edges, r, status, decisions, docs)["relations"].withColumn("document_id", F.get("source_document_ids", F.lit(0)))
    books = decisions.join(r.select("region_id", "workbook_id"), "region_id").join(docs, "workbook_id").select("document_id").distinct()
    return maintain.replace_by_document(old, new, books).select("document_id", "relation_type", "source_id", "target_id", "region_id")


def grid_health(s: SparkSession, d: str) -> DataFrame:
    """Totals and histograms of the grid, with drawings on some sheets."""
    c = t.cells(s, d)
    sh = grid.classify_sheets(c).withColumn("drawings", F.when(F.col("workbook_id").endswith("3"), F.array(F.lit("2 images"))).otherwise(t.none()))
    return grid.grid_health(sh, grid.detect_regions(c, sh), c)


def _details(s: SparkSession, d: str) -> DataFrame:
    c = t.cells(s, d)
    sheets = c.select("sheet_id", F.concat("workbook_id", F.lit(".xlsx")).alias("file_name"), F.col("workbook_id").endswith("1").alias("hidden")).distinct()
    return grid.sheet_details(c, sheets)


def sheet_details(s: SparkSession, d: str) -> DataFrame:
    """Health of each sheet."""
    return _details(s, d).drop("sheet_name")


def folder_health(s: SparkSession, d: str) -> DataFrame:
    """Totals and warnings over all workbooks."""
    return grid.folder_health(_details(s, d)).withColumn("warnings", F.size("warnings"))


def repeated_fields(s: SparkSession, d: str) -> DataFrame:
    """Field names that stand in cells more than once; here parts' names in a sheet per size."""
    p = t.raw(s, d, "part")
    c = p.select(F.concat(F.lit("sh."), F.col("p_size").cast("string")).alias("sheet_id"), (F.col("p_partkey") % 97 + 1).cast("int").alias("row"), F.col("p_name").alias("value"))
    return grid.repeated_fields(c)


def field_alias_groups(s: SparkSession, d: str) -> DataFrame:
    """Logical names with the physical names beside them; here an amount's name and a part's name in each row."""
    p = t.raw(s, d, "part")
    at = [F.lit("sh").alias("sheet_id"), (F.col("p_partkey") + 1).cast("int").alias("row")]
    left = p.select(*at, F.concat(F.lit("利用額"), (F.col("p_size") % 7).cast("string")).alias("value"))
    return grid.field_alias_groups(left.unionByName(p.select(*at, F.col("p_brand").alias("value")))).select("name", _joined("aliases"))


def ddl_columns(s: SparkSession, d: str) -> DataFrame:
    """Columns of a table definition per supplier."""
    x = t.raw(s, d, "supplier").select(F.col("s_name").alias("path"), F.concat(F.lit("-- t\nCREATE TABLE app.T"), F.col("s_suppkey").cast("string"), F.lit(" (\n  id INT NOT NULL,\n  bal"), F.col("s_nationkey").cast("string"), F.lit(" DECIMAL(10,2),\n  PRIMARY KEY (id)\n);")).alias("text"))
    return readers.ddl_columns(x).select("path", "table_name", "position", "column_name", "column_type", "is_constraint", "line")


def openapi_fields(s: SparkSession, d: str) -> DataFrame:
    """S3: request and response fields of an API description per part."""
    body = F.concat(F.lit('{"paths": {"/p'), F.col("p_partkey").cast("string"), F.lit('": {"post": {"operationId": "op", "requestBody": {"content": {"application/json": {"schema": {"properties": {"size": {}, "'), F.col("p_brand"), F.lit('": {}}}}}}, "responses": {"200": {"content": {"application/json": {"schema": {"properties": {"price": {}}}}}}}}}}}'))
    return readers.openapi_fields(t.raw(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), body.alias("text"))).select("endpoint", "method", "relation_type", "field", "line")


def alias_catalog(s: SparkSession, d: str) -> DataFrame:
    """Aliases of a catalog of parts, invalid entries left out."""
    x = t.raw(s, d, "part").select(F.concat(F.lit("entity."), F.col("p_partkey").cast("string")).alias("item_id"), F.when(F.col("p_size") > 40, "Widget").otherwise("BusinessField").alias("canonical_type"), F.array("p_name", "p_brand").alias("aliases"))
    return readers.alias_catalog(x)[0].select("item_id", "alias", "seq")


def manifest_gap(s: SparkSession, d: str) -> DataFrame:
    """Documents that disappeared from their source."""
    x = t.raw(s, d, "documents").select(F.col("source").alias("root_id"), _doc().alias("document_id"), "doc_id")
    return maintain.document_manifest_gap(x.select("root_id", "document_id"), x.where("doc_id % 6 <> 0").select("root_id", "document_id"))


def collection_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows of each collection."""
    return views.counts({n: t.flat(s, d, n) for n in ("artifacts", "entities", "relations", "calls", "evidence")})


def graph_view(s: SparkSession, d: str) -> DataFrame:
    """Nodes of a graph that has lost some artifacts, placeholders included, by type."""
    a = t.artifacts(s, d).where("artifact_id not like '%7'")
    stale = s.createDataFrame([], "target_type string, target_id string, resolved_at string, reason string")
    n, _ = views.graph_view(a, t.entities(s, d), t.relations(s, d), stale, status="unconfirmed")
    return n.groupBy("node_type", "is_stale").agg(F.count("*").alias("n"))


def source_preview(s: SparkSession, d: str) -> DataFrame:
    """Lines around the evidence of the suppliers' documents."""
    m = _markdown(s, d)
    ev = m.where("document_id like '%1'").select("document_id", F.struct(F.lit("f").alias("file"), F.lit(3).alias("line_start"), F.lit(4).alias("line_end")).alias("source_location"))
    return views.source_preview(markdown.lines(m), ev, 2, 5).select("document_id", "line", "highlighted")


def decision_board(s: SparkSession, d: str) -> DataFrame:
    """Decisions of the report's impacts, unreviewed at first."""
    i, _ = impact_queries._impacts(s, d)
    none = s.createDataFrame([], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    b = views.decision_board(search.seed_decisions(i, none, "2024-01-01"), i)
    return b.select("impact_id", "status", "display_name", "review_priority")


def review_queue(s: SparkSession, d: str) -> DataFrame:
    """The summary of the review queue of relations and impacts."""
    i, _ = impact_queries._impacts(s, d)
    none = s.createDataFrame([], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    board = views.decision_board(search.seed_decisions(i, none, "2024-01-01"), i)
    e = lambda schema: s.createDataFrame([], schema)
    q = views.review_queue(
        e("diff_id string, document_ids array<string>, status string, reason string"), e("proposal_id string, region_id string, status string, nodes int, edges int, evidence_ids array<string>, unresolved array<string>"),
        e("candidate_id string, entity_a_id string, entity_b_id string, judgement string, status string, reason string, evidence_ids array<string>"), t.relations(s, d), board, e("target_type string, target_id string, resolved_at string, reason string"),
    )
    return views.queue_summary(q)


def run_history(s: SparkSession, d: str) -> DataFrame:
    """Users with their numbers of events."""
    e = t.raw(s, d, "events").select(F.col("user_id").alias("run_id"))
    return views.run_history(e.distinct(), e)


def document_context(s: SparkSession, d: str) -> DataFrame:
    """First names of nodes per document."""
    n = t.artifacts(s, d).select(F.col("artifact_type").alias("node_type"), "display_name", "source_document_ids")
    docs = t.flat(s, d, "artifacts").select("document_id").distinct()
    return views.document_context(n, docs).select("document_id", "node_type", _joined("names"))


def ledger_mutations(s: SparkSession, d: str) -> DataFrame:
    """R2: outcome of every keyed mutation: applied, replayed, in conflict or with an invalid key."""
    e = t.flat(s, d, "mutations")
    return ledgers.mutation_results(e, ledgers.first_mutations(e)).select("seq", "outcome")


def ledger_status(s: SparkSession, d: str) -> DataFrame:
    """The last status of each key."""
    return ledgers.current_status(t.flat(s, d, "ledger").select(F.col("k").alias("impact_id"), F.col("action").alias("status"), "seq"))


def source_changes(s: SparkSession, d: str) -> DataFrame:
    """Last content of each path and how often it changed."""
    e = t.flat(s, d, "ledger").select(F.concat("k", F.lit(".md")).alias("path"), F.col("action").alias("hash"), "seq")
    return ledgers.last_hashes(e)


def streamed_status(s: SparkSession, d: str) -> DataFrame:
    """R3 as a stream over the event table; equal to ledger_status."""
    folder = f"{checkpoint_folder(s)}/ledger-{uuid.uuid4()}"
    stream = s.readStream.schema(t.raw(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = stream.select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("impact_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    q = ledgers.run(rows, "decisions", folder)
    q.awaitTermination()
    return ledgers.latest(s, "decisions", folder, q.lastProgress["batchId"] if q.lastProgress else 0)


QUERIES = {
    f.__name__: f
    for f in (
        document_rows, sections, chunks, document_chunks, markdown_relations, markdown_dedupe, relation_lines_in_chunks, plain_mentions, unresolved, alias_suggestions, name_index, alias_collisions, concept_keys, alias_trigram_pairs, alias_context_pairs,
        alias_evidence_pairs, alias_candidates, alias_trigram_members, alias_trigram_classes, alias_context_members, alias_context_classes, alias_part_evidence_pairs, alias_class_members, alias_class_signals, alias_part_candidates, embedding_plan, cosine_top_k, redact_documents, redact_nested, redact_fields, sensitive_counts, audit_rows, answer_summary, case_metrics, missed_must, dataset_metrics, release_gate, expected_sets, field_is_absent, sheet_types, region_bounds, region_members,
        region_rendering, region_edges, proposed_entities, proposed_artifacts, proposed_evidence, rebuilt_relations, grid_health, sheet_details, folder_health, repeated_fields, field_alias_groups, ddl_columns, openapi_fields, alias_catalog, manifest_gap, collection_counts, graph_view, source_preview, decision_board, review_queue, run_history, document_context, ledger_mutations,
        ledger_status, source_changes, streamed_status,
    )
}

_I = impact_queries._INPUT
_ALL = impact_queries._ALL
_REDACT = "text"
#: The patterns as SQL's regular expressions have them, whose classes and word edges are those of ASCII, which is what the table's texts hold around them.
_ASCII = [p.replace(f"[^{SPACE})]", r"[^\s)]").replace(f"[{SPACE}]", r"\s").replace(EDGE, r"\b").replace(START, r"\b").replace(END, r"\b").replace(r"\p{Nd}", r"\d") for p in privacy.REDACT]
for _p in _ASCII:
    _REDACT = f"regexp_replace({_REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')"
_GRID = """WITH c AS (SELECT workbook_id, sheet_id, sheet_name, r, c, min(value) AS value FROM cells_t GROUP BY 1, 2, 3, 4, 5),
    rb AS (SELECT sheet_id, r, sum(n) OVER (PARTITION BY sheet_id ORDER BY r) AS rb FROM (SELECT sheet_id, r, CASE WHEN r <= lag(r) OVER (PARTITION BY sheet_id ORDER BY r) + 1 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT sheet_id, r FROM c))),
    c2 AS (SELECT c.*, rb FROM c JOIN rb USING (sheet_id, r)),
    cb AS (SELECT sheet_id, rb, c, sum(n) OVER (PARTITION BY sheet_id, rb ORDER BY c) AS cb FROM (SELECT sheet_id, rb, c, CASE WHEN c <= lag(c) OVER (PARTITION BY sheet_id, rb ORDER BY c) + 1 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT sheet_id, rb, c FROM c2))),
    boxes AS (SELECT workbook_id, sheet_id, any_value(sheet_name) AS sheet_name, min(r) AS start_row, max(r) AS end_row, min(c) AS start_column, max(c) AS end_column, rb, cb FROM c2 JOIN cb USING (sheet_id, rb, c) GROUP BY workbook_id, sheet_id, rb, cb),
    reg AS (SELECT sheet_id, start_row, end_row, start_column, end_column FROM boxes)"""
_REGIONS = """, named AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY rb, cb) AS idx, substring('ABCDEFGHIJ', start_column, 1) || CAST(start_row AS VARCHAR) || ':' || substring('ABCDEFGHIJ', end_column, 1) || CAST(end_row AS VARCHAR) AS range FROM boxes),
    ids AS (SELECT *, sheet_id || '.region.' || lpad(CAST(idx AS VARCHAR), 3, '0') AS region_id FROM named),
    mem AS (SELECT region_id, g.workbook_id, g.sheet_name, range, idx, start_row, end_row, k.r, k.c, k.value FROM ids g JOIN c k ON k.sheet_id = g.sheet_id AND k.r BETWEEN start_row AND end_row AND k.c BETWEEN start_column AND end_column),
    text AS (SELECT region_id, workbook_id, sheet_id, sheet_name, range, idx, start_row, end_row, n, '# ' || sheet_name || ' ' || range || chr(10) || chr(10) || '| cell | value | style_hint |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines AS rendered,
            '[' || sheet_name || '!' || range || '] # ' || sheet_name || ' ' || range || ' / | cell | value | style_hint | / ' || replace(lines, chr(10), ' / ') AS quote, marked
        FROM (SELECT region_id, count(*) AS n, string_agg('| ' || substring('ABCDEFGHIJ', c, 1) || CAST(r AS VARCHAR) || ' | ' || value || ' |  |', chr(10) ORDER BY r, c) AS lines, bool_or(value = '別紙参照') AS marked FROM mem GROUP BY 1) JOIN ids USING (region_id))"""
#: What the rows of the customers' screen lists say; the suppliers' sheets have no named columns.
_ROWS = """, said AS (SELECT DISTINCT t.region_id, t.workbook_id, t.start_row, t.end_row, t.quote, t.idx, rel, 'screen.' || trim(regexp_replace(lower(s.value), '[^a-z0-9]+', '_', 'g'), '_') AS source_id, s.value AS screen,
            CASE rel WHEN 'DISPLAYS' THEN 'entity.' || trim(regexp_replace(lower(o.value), '[^a-z0-9]+', '_', 'g'), '_') ELSE 'api.' || trim(regexp_replace(lower(o.value), '[^a-z0-9]+', '_', 'g'), '_') END AS target_id, o.value AS target
        FROM text t JOIN mem s ON s.region_id = t.region_id AND s.c = 2 AND s.r > t.start_row JOIN mem o ON o.region_id = t.region_id AND o.r = s.r AND o.c > 2 JOIN (VALUES (3, 'DISPLAYS'), (4, 'CALLS')) v(k, rel) ON o.c = k WHERE t.sheet_id LIKE 'sh.c%')"""
_METRICS = """WITH ce AS (SELECT case_id, artifact_id, bool_or(level = 'must_review') AS em, bool_or(level = 'should_review') AS es FROM expected_t WHERE level IN ('must_review', 'should_review') GROUP BY 1, 2),
    ca AS (SELECT case_id, artifact_id, bool_or(review_priority = 'must_review') AS am, bool_or(review_priority = 'should_review') AS a_s, count(*) AS rows, count(*) FILTER (n_evidence > 0 OR relation_distance = 0) AS ok
        FROM actual_t WHERE review_priority IN ('must_review', 'should_review') GROUP BY 1, 2),
    k AS (SELECT coalesce(ce.case_id, ca.case_id) AS case_id, coalesce(ce.artifact_id, ca.artifact_id) AS artifact_id, coalesce(em, false) AS em, coalesce(es, false) AS es, coalesce(am, false) AS am, coalesce(a_s, false) AS a_s, coalesce(rows, 0) AS rows, coalesce(ok, 0) AS ok,
        ce.case_id IS NOT NULL AS wanted, ca.case_id IS NOT NULL AS shown FROM ce FULL JOIN ca ON ce.case_id = ca.case_id AND ce.artifact_id = ca.artifact_id),
    g AS (SELECT c.case_id, count(*) FILTER (em) AS must, count(*) FILTER (em AND am) AS mh, count(*) FILTER (es) AS sh, count(*) FILTER (es AND a_s) AS shh, count(*) FILTER (wanted) AS w, count(*) FILTER (shown) AS v, count(*) FILTER (wanted AND shown) AS hit,
        coalesce(sum(rows), 0) AS size, coalesce(sum(ok), 0) AS ok FROM (SELECT case_id FROM expected_t UNION SELECT case_id FROM actual_t) c LEFT JOIN k ON k.case_id = c.case_id GROUP BY 1),
    m AS (SELECT case_id, CASE WHEN must > 0 THEN mh / must ELSE 1.0 END AS must_review_recall, CASE WHEN sh > 0 THEN shh / sh ELSE 1.0 END AS should_review_recall, must - mh AS missed_critical_impacts, CASE WHEN size > 0 THEN ok / size ELSE 1.0 END AS evidence_coverage,
        CASE WHEN v > 0 THEN hit / v ELSE 1.0 END AS visible_precision, CASE WHEN w > 0 THEN hit / w ELSE 1.0 END AS relation_recall, CAST(size AS BIGINT) AS report_size, CASE WHEN w > 0 THEN v / w ELSE 0.0 END AS ratio FROM g)"""
_GATE = """, j AS (SELECT * FROM m JOIN cases_t USING (case_id)),
    t AS (SELECT count(*) AS case_count, count(*) FILTER (category = 'golden') AS golden, count(*) FILTER (category = 'evaluation') AS evaluation, count(*) FILTER (category = 'holdout') AS holdout, coalesce(avg(must_review_recall) FILTER (category = 'evaluation'), 0.0) AS must_review_recall,
        coalesce(avg(visible_precision) FILTER (category = 'evaluation'), 0.0) AS visible_precision, coalesce(avg(evidence_coverage), 0.0) AS evidence_coverage, coalesce(max(report_size), 0) AS max_report_size, coalesce(max(ratio), 0.0) AS max_expansion_ratio, count(DISTINCT change_id) AS unique_changes,
        (SELECT count(DISTINCT x) FROM (SELECT string_agg(DISTINCT level || artifact_id, ',' ORDER BY level || artifact_id) AS x FROM expected_t WHERE case_id IN (SELECT case_id FROM cases_t) GROUP BY case_id)) AS unique_expected,
        NOT EXISTS (SELECT 1 FROM pages WHERE contains(html, '"confidence"')) AS no_confidence_field, NOT EXISTS (SELECT 1 FROM pages WHERE contains(html, '"llm_judgement"')) AS no_llm_judgement_field FROM j),
    c AS (SELECT *, case_count BETWEEN 20 AND 30 AS case_count_20_to_30, golden > 0 AS golden_cases_present, evaluation > 0 AS evaluation_cases_present, holdout > 0 AS holdout_cases_present, must_review_recall >= 0.9 AS evaluation_must_review_recall_at_least_90_percent,
        visible_precision >= 0.7 AS evaluation_visible_precision_at_least_70_percent, evidence_coverage = 1.0 AS evidence_coverage_is_100_percent, max_report_size <= 50 AS visible_candidate_count_at_most_50, max_expansion_ratio <= 2.0 AS candidate_expansion_ratio_at_most_2,
        unique_changes >= 20 AS unique_changes_at_least_20, unique_expected >= 20 AS unique_expected_at_least_20 FROM t)
    SELECT * REPLACE (round(must_review_recall, 6) AS must_review_recall, round(visible_precision, 6) AS visible_precision, round(evidence_coverage, 6) AS evidence_coverage, round(max_expansion_ratio, 6) AS max_expansion_ratio),
        CASE WHEN case_count_20_to_30 AND golden_cases_present AND evaluation_cases_present AND holdout_cases_present AND evaluation_must_review_recall_at_least_90_percent AND evaluation_visible_precision_at_least_70_percent AND evidence_coverage_is_100_percent AND visible_candidate_count_at_most_50
            AND candidate_expansion_ratio_at_most_2 AND unique_changes_at_least_20 AND unique_expected_at_least_20 AND no_confidence_field AND no_llm_judgement_field THEN 'pass' ELSE 'fail' END AS status FROM c"""
#: The suppliers' documents as numbered lines, their white space at the ends taken off, and the sections they open.
_MD_LINES = f"""md AS ({_MD}), l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM md),
    h AS (SELECT *, regexp_extract(raw, '^(#+)', 1) AS marks, trim(regexp_extract(raw, '^#+[ 　]+(.+)$', 1), ' 　') AS heading, lead(line) OVER (PARTITION BY document_id ORDER BY line) AS nxt FROM l WHERE regexp_matches(raw, '^#{{1,6}}[ 　]+.'))"""
_MD_RELATIONS = """s AS (SELECT 'doc.s' || CAST(s_suppkey AS VARCHAR) AS document_id, 'api.' || lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g')) || '_api' AS api, lower(s_name) AS nm, CAST(s_nationkey AS VARCHAR) AS nk, CAST(s_suppkey % 7 AS VARCHAR) AS tk, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 7 < 5 AS known FROM supplier),
    r AS (SELECT document_id, 4 AS line, 'API' AS source_type, api AS source_id, 'REQUEST_FIELD' AS relation_type, 'BusinessField' AS target_type, 'entity.' || regexp_replace(nm, '[^a-z0-9]+', '_', 'g') AS target_id, 'api_request_definition' AS evidence_type, '- ' || nm || ': key' AS quote FROM s
        UNION ALL SELECT document_id, 5, 'API', api, 'REQUEST_FIELD', 'BusinessField', 'entity.balance_' || nk, 'api_request_definition', '- balance_' || nk FROM s
        UNION ALL SELECT document_id, 7, 'API', api, 'READS', 'Table', 'table.nation_t' || nk, 'plain_mention', '- NATION_T' || nk FROM s
        UNION ALL SELECT document_id, 10, 'API', api, 'WRITES', 'Table', 'table.log_a', 'plain_mention', 'Writes:　LOG_A, LOG_B' || k FROM s
        UNION ALL SELECT document_id, 10, 'API', api, 'WRITES', 'Table', 'untyped_' || k, 'plain_mention', 'Writes:　LOG_A, LOG_B' || k FROM s
        UNION ALL SELECT document_id, 12, 'API', api, 'CALLS', 'API', 'api.gateway_' || k, 'plain_mention', '- Gateway ' || k FROM s
        UNION ALL SELECT document_id, 13, 'API', api, 'CALLS', 'Document', 'document.doc_field_' || k, 'plain_mention', '- Doc field ' || k FROM s
        UNION ALL SELECT document_id, 15, 'Column', 'column.t' || tk || '_code', 'DEFINES', 'BusinessField', 'entity.t' || tk || '_code', 'db_column_definition', '- code' FROM s
        UNION ALL SELECT document_id, 16, 'Column', CASE WHEN known THEN 'column.known_' || tk ELSE 'column.t' || tk || '_amount' END, 'DEFINES', 'BusinessField', CASE WHEN known THEN 'entity.amount_of_money' ELSE 'entity.t' || tk || '_amount' END, 'db_column_definition', '- amount' FROM s)"""
ORACLE_SQL = {
    "document_rows": "SELECT 'doc.' || CAST(doc_id AS VARCHAR) || '.' || substring(sha1(source || '/' || CAST(doc_id AS VARCHAR)), 1, 8) AS document_id, sha256(text) AS hash, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path FROM documents",
    "sections": f"WITH {_MD_LINES} SELECT document_id, heading, CAST(length(marks) AS INTEGER) AS level, CAST(line AS INTEGER) AS line_start, CAST(coalesce(nxt - 1, n) AS INTEGER) AS line_end FROM h",
    "chunks": f"""WITH {_MD_LINES} SELECT h.document_id, CAST(h.line AS INTEGER) AS line_start, sha256(trim(string_agg(l.raw, chr(10) ORDER BY l.line), chr(10) || ' 　')) AS text_hash
        FROM h JOIN l ON l.document_id = h.document_id AND l.line BETWEEN h.line AND coalesce(h.nxt - 1, h.n) GROUP BY h.document_id, h.line""",
    "document_chunks": "SELECT 'd' || CAST(doc_id AS VARCHAR) AS document_id, 1 AS line_start, CAST(len(string_split(rtrim(text, chr(10)), chr(10))) AS INTEGER) AS line_end FROM documents",
    "markdown_relations": f"WITH {_MD_RELATIONS} SELECT * FROM r",
    "markdown_dedupe": f"WITH {_MD_RELATIONS} SELECT document_id, source_id, relation_type, target_id, CAST(count(*) AS INTEGER) AS n_evidence FROM r GROUP BY 1, 2, 3, 4",
    "relation_lines_in_chunks": f"WITH {_MD_RELATIONS}, {_MD_LINES} SELECT r.document_id, r.line, r.target_id, h.heading FROM r JOIN h ON h.document_id = r.document_id AND r.line BETWEEN h.line AND coalesce(h.nxt - 1, h.n)",
    "plain_mentions": "SELECT 'document.d' || CAST(doc_id AS VARCHAR) AS source_id, 'entity.' || w AS target_id, w AS alias FROM documents JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) ON contains(text, w)",
    "alias_suggestions": t.with_views("SELECT entity_id AS item_id, display_name AS alias FROM entities_t WHERE display_name <> canonical_name", "entities"),
    "name_index": t.with_views("""SELECT name, CAST(count(DISTINCT id) AS INTEGER) AS n_ids FROM (SELECT artifact_id AS id, artifact_id AS name FROM artifacts_t UNION ALL SELECT artifact_id, display_name FROM artifacts_t
        UNION ALL SELECT entity_id, entity_id FROM entities_t UNION ALL SELECT entity_id, display_name FROM entities_t UNION ALL SELECT entity_id, canonical_name FROM entities_t) GROUP BY 1""", "artifacts", "entities"),
    "alias_collisions": "SELECT p_name AS alias, CAST(count(DISTINCT p_partkey) AS INTEGER) AS n_items FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1",
    "concept_keys": t.with_views("""SELECT entity_id, CASE WHEN contains(lower(display_name), 'phone') OR contains(lower(display_name), 'tel') THEN 'phone_number' WHEN length(canonical_name) >= 4 THEN array_to_string(list_filter(string_split(canonical_name, '_'), lambda w: length(w) >= 2), '') ELSE '' END AS concept,
        array_to_string(list_sort(list_distinct(list_filter(string_split(canonical_name, '_'), lambda w: length(w) >= 2))), ',') AS tokens FROM entities_t""", "entities"),
    "alias_trigram_pairs": """WITH e AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, replace(p_name, ' ', '') || replace(p_name, ' ', '') AS t FROM part), g AS (SELECT id, substring(t, i, 3) AS gram, count(*) AS n FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM e) GROUP BY 1, 2),
        norm AS (SELECT id, sqrt(sum(n * n)) AS v FROM g GROUP BY 1)
        SELECT a.id AS "left", b.id AS "right", round(sum(a.n * b.n) / any_value(x.v) / any_value(y.v), 4) AS score FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id JOIN norm x ON x.id = a.id JOIN norm y ON y.id = b.id GROUP BY 1, 2 HAVING sum(a.n * b.n) / any_value(x.v) / any_value(y.v) >= 0.72 - 1e-12""",
    "alias_context_pairs": t.with_views("""WITH s AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, relation_type AS item FROM relations_t JOIN part ON target_id = 'entity.' || CAST(p_partkey AS VARCHAR)), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1)
        SELECT a.id AS "left", b.id AS "right", round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 4) AS score FROM s a JOIN s b ON a.item = b.item AND a.id < b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.4""", "relations"),
    "alias_evidence_pairs": t.with_views("""WITH o AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, evidence_id, file, line_start FROM evidence_t JOIN part ON p_partkey = CAST(string_split(evidence_id, '.')[5] AS BIGINT)),
        p AS (SELECT a.id AS l, b.id AS r, a.evidence_id AS x, b.evidence_id AS y FROM o a JOIN o b ON a.file = b.file AND a.id < b.id AND abs(a.line_start - b.line_start) <= 3)
        SELECT l AS "left", r AS "right", count(DISTINCT e) AS n FROM (SELECT l, r, x AS e FROM p UNION SELECT l, r, y FROM p) GROUP BY 1, 2""", "evidence"),
    "embedding_plan": "SELECT 'd' || CAST(doc_id AS VARCHAR) AS chunk_id, sha256(text) AS content_hash, CASE WHEN length(text) % 2 = 0 AND length(text) % 3 <> 0 THEN 'unchanged' ELSE 'pending' END AS state FROM documents",
    "cosine_top_k": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0)
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""",
    "redact_nested": r"""SELECT c_custkey, '[REDACTED]' AS full_name, c_mktsegment AS segment, c_acctbal AS balance, 'call [REDACTED]' AS note, 'mail [REDACTED]' AS mail, '[REDACTED]' AS first_key, regexp_replace(c_name, '\b\d{7,12}\b', '[REDACTED]', 'g') AS plain, '[REDACTED]' AS second_key, '[REDACTED]' AS listed,
        '[REDACTED]' AS account, 'term ' || c_mktsegment AS design, '[REDACTED]' AS secret FROM customer""",
    "redact_fields": "SELECT c_custkey, '[REDACTED]' AS customer_name, c_mktsegment AS segment, '[REDACTED]' AS note FROM customer",
    "audit_rows": "SELECT event_id AS run_id, sha256(props) AS payload_hash, sha256(event_type) AS answer_hash, CAST(length(props) AS INTEGER) AS payload_chars, event_id % 2 = 0 AS redacted FROM events",
    "answer_summary": "SELECT user_id AS run_id, event_type AS llm_judgement, count(*) AS answers FROM events GROUP BY 1, 2",
    "case_metrics": t.with_views(
        _METRICS
        + """ SELECT case_id, round(must_review_recall, 6) AS must_review_recall, round(should_review_recall, 6) AS should_review_recall, round(evidence_coverage, 6) AS evidence_coverage, round(evidence_coverage, 6) AS evidence_accuracy, round(visible_precision, 6) AS relation_precision,
        round(relation_recall, 6) AS relation_recall, round(visible_precision, 6) AS visible_precision, round(ratio, 6) AS candidate_expansion_ratio, missed_critical_impacts, report_size, 1.0 AS alias_resolution_accuracy FROM m""",
        "expected",
        "actual",
    ),
    "missed_must": t.with_views("SELECT DISTINCT case_id, artifact_id FROM expected_t WHERE level = 'must_review' EXCEPT SELECT case_id, artifact_id FROM actual_t WHERE review_priority = 'must_review'", "expected", "actual"),
    "dataset_metrics": t.with_views(_METRICS + " SELECT case_id, category, round(visible_precision, 6) AS visible_precision, report_size FROM m JOIN cases_t USING (case_id) WHERE category IN ('golden', 'holdout')", "expected", "actual", "cases"),
    "release_gate": t.with_views(_METRICS + _GATE, "expected", "actual", "cases"),
    "expected_sets": t.with_views("SELECT count(DISTINCT k) AS expected_sets FROM (SELECT string_agg(DISTINCT level || '|' || artifact_id, ',' ORDER BY level || '|' || artifact_id) AS k FROM expected_t GROUP BY case_id)", "expected"),
    "field_is_absent": """SELECT coalesce(bool_and(NOT contains(html, '"internal_note"')), true) AS absent FROM pages""",
    "region_bounds": t.with_views(_GRID + " SELECT * FROM reg", "cells"),
    "sheet_types": t.with_views("SELECT DISTINCT sheet_id, 'screen_item_definition' AS sheet_type FROM cells_t", "cells"),
    "region_members": t.with_views(_GRID + """ SELECT g.sheet_id, start_row, start_column, CASE WHEN count(*) <= 2 THEN 'note_block' ELSE 'screen_item_table' END AS region_type, count(*) AS cells, CAST(count(*) AS INTEGER) AS n_evidence
        FROM reg g JOIN c ON c.sheet_id = g.sheet_id AND c.r BETWEEN start_row AND end_row AND c.c BETWEEN start_column AND end_column GROUP BY g.sheet_id, start_row, start_column""", "cells"),
    "unresolved": t.with_views(_GRID + _REGIONS + " SELECT DISTINCT region_id, value AS mention FROM mem WHERE value = '別紙参照'", "cells"),
    "region_rendering": t.with_views(_GRID + _REGIONS + """ SELECT region_id, CAST(stop - n - 3 AS INTEGER) AS line_start, CAST(stop AS INTEGER) AS line_end, sha256(rendered) AS text_hash
        FROM (SELECT *, sum(n + 6) OVER (PARTITION BY workbook_id ORDER BY sheet_id, idx) - 2 AS stop FROM text)""", "cells"),
    "region_edges": t.with_views(_GRID + _REGIONS + _ROWS + " SELECT rel AS relation_type, source_id, target_id, 'explicit' AS polarity, 'exact' AS match_type, region_id FROM said", "cells"),
    "proposed_entities": t.with_views(_GRID + _REGIONS + _ROWS + """ SELECT target_id AS entity_id, 'BusinessField' AS entity_type, min(target) AS display_name, string_agg(DISTINCT 'doc.' || workbook_id, ',' ORDER BY 'doc.' || workbook_id) AS source_document_ids, 'rule' AS extraction_methods
        FROM said WHERE rel = 'DISPLAYS' GROUP BY 1""", "cells"),
    "proposed_artifacts": t.with_views(_GRID + _REGIONS + _ROWS + """ SELECT id AS artifact_id, kind AS artifact_type, min(name) AS display_name, string_agg(DISTINCT 'doc.' || workbook_id, ',' ORDER BY 'doc.' || workbook_id) AS source_document_ids
        FROM (SELECT source_id AS id, 'Screen' AS kind, screen AS name, workbook_id FROM said UNION ALL SELECT target_id, 'API', target, workbook_id FROM said WHERE rel = 'CALLS') GROUP BY 1, 2""", "cells"),
    "proposed_evidence": t.with_views(_GRID + _REGIONS + _ROWS + """ SELECT 'doc.' || workbook_id AS document_id, 'dirty_excel_region_relation' AS evidence_type, CASE rel WHEN 'DISPLAYS' THEN 'entity' ELSE 'artifact' END AS supported, target_id, workbook_id || '.xlsx' AS file, start_row AS line_start, end_row AS line_end,
        sha256(substring(quote, 1, 2000)) AS quote_hash FROM said""", "cells"),
    "rebuilt_relations": t.with_views(_GRID + _REGIONS + _ROWS + " SELECT 'doc.' || workbook_id AS document_id, rel AS relation_type, source_id, target_id, region_id FROM said WHERE NOT (regexp_matches(workbook_id, '[02468]$') AND idx % 2 = 0)", "cells"),
    "grid_health": t.with_views(_GRID + _REGIONS + """, kinds AS (SELECT CASE WHEN n <= 2 THEN 'note_block' ELSE 'screen_item_table' END AS k, marked FROM text), sheets AS (SELECT DISTINCT workbook_id, sheet_id, sheet_name FROM c)
        SELECT 'total' AS measure, 'workbooks' AS name, count(DISTINCT workbook_id) AS n FROM c UNION ALL SELECT 'total', 'sheets', count(*) FROM sheets UNION ALL SELECT 'total', 'cells', count(*) FROM c UNION ALL SELECT 'total', 'regions', count(*) FROM kinds UNION ALL SELECT 'total', 'proposals', count(*) FROM kinds
        UNION ALL SELECT 'sheet_type', 'screen_item_definition', count(*) FROM sheets UNION ALL SELECT 'region_type', k, count(*) FROM kinds GROUP BY 2 UNION ALL SELECT 'unresolved', '別紙参照', count(*) FROM kinds WHERE marked HAVING count(*) > 0
        UNION ALL SELECT DISTINCT 'warning', 'Sheet ' || chr(39) || sheet_name || chr(39) || ' ' || w || ' drawing content: 2 images', 1 FROM sheets, (VALUES ('contains unsupported'), ('has unresolved')) v(w) WHERE workbook_id LIKE '%3'""", "cells"),
    "sheet_details": t.with_views("""WITH c AS (SELECT workbook_id, sheet_id, r, c, min(value) AS value FROM cells_t GROUP BY 1, 2, 3, 4), n AS (SELECT workbook_id, sheet_id, r, count(*) AS n FROM c GROUP BY 1, 2, 3)
        SELECT workbook_id, sheet_id, count(*) AS rows, CAST(coalesce(max(n) FILTER (r = 1), 0) AS INTEGER) AS columns, 0 AS merged_cells, 'screen' AS estimated_type, count(*) FILTER (r <= 8 AND n >= 3) > 1 AS multi_header, workbook_id LIKE '%1' AS hidden, false AS revision_history FROM n GROUP BY 1, 2""", "cells"),
    "folder_health": t.with_views("""WITH n AS (SELECT workbook_id, sheet_id, r, count(DISTINCT c) AS n FROM cells_t GROUP BY 1, 2, 3), s AS (SELECT workbook_id, sheet_id, count(*) AS rows, count(*) FILTER (r <= 8 AND n >= 3) > 1 AS mh FROM n GROUP BY 1, 2)
        SELECT count(DISTINCT workbook_id) AS workbooks, count(*) AS sheets, CAST(sum(rows - 1) AS BIGINT) AS detected_artifacts, CAST(sum(rows - 1) AS BIGINT) AS possible_relations, 0 AS merged_cells, count(*) FILTER (workbook_id LIKE '%1') AS hidden_sheets, count(*) FILTER (mh) AS multi_header_sheets,
            0 AS revision_sheets, CAST((count(*) FILTER (mh) > 0) AS INTEGER) AS warnings FROM s""", "cells"),
    "repeated_fields": "SELECT p_name AS name, count(*) AS count FROM part WHERE p_partkey % 97 > 0 AND regexp_matches(p_name, '[A-Za-z_]{4,}') GROUP BY 1 HAVING count(*) > 1",
    "field_alias_groups": """WITH g AS (SELECT '額' || CAST(p_size % 7 AS VARCHAR) AS name, '利用額' || CAST(p_size % 7 AS VARCHAR) AS a, p_brand AS b FROM part WHERE p_partkey > 0)
        SELECT name, string_agg(x, ',' ORDER BY x) AS aliases FROM (SELECT name, a AS x FROM g UNION SELECT name, b FROM g) GROUP BY 1 HAVING count(*) > 1""",
    "ddl_columns": """WITH s AS (SELECT s_name AS path, 'app.T' || CAST(s_suppkey AS VARCHAR) AS table_name, 'bal' || CAST(s_nationkey AS VARCHAR) AS b FROM supplier)
        SELECT path, table_name, 0 AS position, 'id' AS column_name, 'INT' AS column_type, false AS is_constraint, 3 AS line FROM s UNION ALL SELECT path, table_name, 1, b, 'DECIMAL(10', false, 4 FROM s
        UNION ALL SELECT path, table_name, 2, '2)', 'unknown', false, 4 FROM s UNION ALL SELECT path, table_name, 3, NULL, NULL, true, 5 FROM s""",
    "openapi_fields": """SELECT '/p' || CAST(p_partkey AS VARCHAR) AS endpoint, 'post' AS method, k AS relation_type, CASE f WHEN 'b' THEN p_brand ELSE f END AS field, 1 AS line FROM part, (VALUES ('REQUEST_FIELD', 'size'), ('REQUEST_FIELD', 'b'), ('RESPONSE_FIELD', 'price')) v(k, f)""",
    "alias_catalog": "SELECT 'entity.' || CAST(p_partkey AS VARCHAR) AS item_id, p_name AS alias, 0 AS seq FROM part WHERE p_size <= 40 UNION ALL SELECT 'entity.' || CAST(p_partkey AS VARCHAR), p_brand, 1 FROM part WHERE p_size <= 40",
    "manifest_gap": "SELECT source AS root_id, 'd' || CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE doc_id % 6 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 6 <> 0)",
    "collection_counts": t.with_views("SELECT 'artifacts' AS collection, count(*) AS n FROM artifacts_t UNION ALL SELECT 'entities', count(*) FROM entities_t UNION ALL SELECT 'relations', count(*) FROM relations_t UNION ALL SELECT 'calls', count(*) FROM calls_t UNION ALL SELECT 'evidence', count(*) FROM evidence_t", *_I[:5]),
    "graph_view": t.with_views("""WITH a AS (SELECT * FROM artifacts_t WHERE artifact_id NOT LIKE '%7'), e AS (SELECT * FROM (SELECT * FROM relations_t UNION ALL SELECT * FROM calls_t) WHERE status = 'unconfirmed'),
        n AS (SELECT artifact_id AS id, artifact_type AS node_type FROM a UNION ALL SELECT entity_id, entity_type FROM entities_t), m AS (SELECT * FROM n UNION ALL SELECT id, 'Missing' FROM (SELECT source_id AS id FROM e UNION SELECT target_id FROM e) WHERE id NOT IN (SELECT id FROM n))
        SELECT node_type, false AS is_stale, count(*) AS n FROM m GROUP BY 1""", *_I[:4]),
    "source_preview": """WITH l AS (SELECT 'doc.s' || CAST(s_suppkey AS VARCHAR) AS document_id, s_suppkey % 10 = 1 AS hit, unnest(range(1, 18)) AS line FROM supplier)
        SELECT document_id, CAST(line AS INTEGER) AS line, hit AND line BETWEEN 3 AND 4 AS highlighted FROM l WHERE (hit AND line BETWEEN 1 AND 6) OR (NOT hit AND line <= 5)""",
    "decision_board": t.with_views("WITH " + _ALL + """ SELECT 'impact.' || change_id || '.' || m.artifact_id AS impact_id, 'unreviewed' AS status, coalesce(a.display_name, e.display_name) AS display_name, review_priority FROM merged m LEFT JOIN artifacts_t a ON a.artifact_id = m.artifact_id LEFT JOIN entities_t e ON e.entity_id = m.artifact_id""", *_I),
    "review_queue": t.with_views("WITH " + _ALL + """, q AS (SELECT 'relation' AS kind, status FROM relations_t UNION ALL SELECT 'relation', status FROM calls_t UNION ALL SELECT 'impact', 'unreviewed' FROM merged), r AS (SELECT *, status IN ('pending', 'unreviewed', 'unconfirmed', 'stale', 'needs_investigation') AS act FROM q)
        SELECT 'kind' AS "by", kind AS name, count(*) AS n, sum(act::INT) AS actionable FROM r GROUP BY 2 UNION ALL SELECT 'status', status, count(*), sum(act::INT) FROM r GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*), sum(act::INT) FROM r""", *_I),
    "run_history": "SELECT user_id AS run_id, count(*) AS candidates FROM events GROUP BY 1",
    "document_context": t.with_views("SELECT document_id, artifact_type AS node_type, string_agg(display_name, ',' ORDER BY display_name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY document_id, artifact_type ORDER BY display_name) AS n FROM (SELECT DISTINCT document_id, artifact_type, display_name FROM artifacts_t)) WHERE n <= 30 GROUP BY 1, 2", "artifacts"),
    "ledger_mutations": t.with_views("""WITH e AS (SELECT seq, trim(key, ' 　') AS key, action || '|' || json_extract_string(params, '$.u') || '|' || json_extract_string(params, '$.p') AS c FROM mutations_t),
        v AS (SELECT * FROM e WHERE length(key) BETWEEN 1 AND 200), f AS (SELECT key, min(seq) AS s, arg_min(c, seq) AS fc FROM v GROUP BY 1)
        SELECT e.seq, CASE WHEN f.key IS NULL THEN 'invalid' WHEN e.seq = s THEN 'applied' WHEN c = fc THEN 'replayed' ELSE 'conflict' END AS outcome FROM e LEFT JOIN f ON e.key = f.key""", "mutations"),
    "ledger_status": t.with_views("SELECT k AS impact_id, arg_max(action, seq) AS status, max(seq) AS seq FROM ledger_t GROUP BY 1", "ledger"),
    "streamed_status": t.with_views("SELECT k AS impact_id, arg_max(action, seq) AS status, max(seq) AS seq FROM ledger_t GROUP BY 1", "ledger"),
    "source_changes": t.with_views("SELECT k || '.md' AS path, arg_max(action, seq) AS hash, max(seq) AS seq, CAST(sum(c) AS BIGINT) AS changes FROM (SELECT *, CASE WHEN action IS NOT DISTINCT FROM lag(action) OVER (PARTITION BY k ORDER BY seq) THEN 0 ELSE 1 END AS c FROM ledger_t) GROUP BY 1", "ledger"),
    "redact_documents": f"SELECT doc_id, sha256({_REDACT}) AS redacted_hash FROM documents",
    "sensitive_counts": " UNION ALL ".join(f"SELECT '{k}' AS category, count(*) AS chunks FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for k, p in zip(privacy.CATEGORIES, _ASCII[2:], strict=True)),
}
for _name in ("decision_board", "review_queue"):
    ORACLE_SQL[_name] = t.for_shared(ORACLE_SQL[_name])
