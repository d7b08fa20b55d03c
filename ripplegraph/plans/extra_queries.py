"""Queries of the operators around the main flows: answers of models, boards, pages, listings, row-mapped sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import alias, freshness, grid, impact, maintain, search, views
from ..sources import sinks
from . import impact_queries, more_queries
from . import tables as t


def prune_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Vectors whose document is English text of more than 900 characters."""
    e = t.raw(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return maintain.prune_embeddings(e, t.raw(s, d, "documents").where("lang = 'en' and n_chars > 900").select(F.col("doc_id").alias("chunk_id")))


def upsert_stale(s: SparkSession, d: str) -> DataFrame:
    """Stale ledger after a second load: open and resolved records."""
    inc = impact_queries.stale_relations(s, d).select("stale_id", F.lit("relation").alias("target_type"), "target_id", "document_id", "reason")
    old = inc.where("document_id like '%2'").withColumn("stale_id", F.concat("stale_id", F.lit("-old"))).withColumn("resolved_at", F.lit(None).cast("string"))
    out = freshness.upsert_stale(old.unionByName(inc.where("document_id like '%4'").withColumn("resolved_at", F.lit("earlier"))), inc, "now")
    return out.groupBy(F.coalesce("resolved_at", F.lit("open")).alias("state")).agg(F.count("*").alias("n"))


def freshness_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals of versions and stale records over the document table."""
    v = impact_queries.append_versions(s, d)
    st = impact_queries.stale_relations(s, d).withColumn("resolved_at", F.when(F.col("document_id").endswith("1"), F.lit("x")))
    return freshness.freshness_totals(v, s.createDataFrame([], "status string"), st)


def replace_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of the sources that come in again are replaced."""
    r = t.flat(s, d, "relations").select("source_id", "relation_id")
    new = r.where("source_id like '%5'").groupBy("source_id").agg(F.min("relation_id").alias("relation_id"))
    return maintain.replace_rows(r, new, "source_id").groupBy("source_id").agg(F.count("*").alias("n"))


def _trigram_candidates(s: SparkSession, d: str) -> DataFrame:
    e = more_queries._distinct_names(s, d)
    p = alias.trigram_pairs(e).select("left", "right", F.array(F.lit("embedding_similarity")).alias("signals"))
    return alias.candidates(e, p).withColumn("evidence_ids", t.none())


def alias_pair_context(s: SparkSession, d: str) -> DataFrame:
    """Surroundings of the pairs that are similar by trigrams."""
    e = more_queries._distinct_names(s, d)
    c = alias.pair_context(alias.trigram_pairs(e), e, more_queries._name_relations(s, d), t.evidence(s, d))
    return c.select("left", "right", F.size("surrounding_node_ids").alias("n_surrounding"), F.size("relation_context").alias("n_relations"), F.size("evidence_ids").alias("n_evidence"), F.size("evidence_quotes").alias("n_quotes"))


def alias_inserts(s: SparkSession, d: str) -> DataFrame:
    """A10: candidates after new ones were inserted where absent."""
    c = _trigram_candidates(s, d)
    return alias.insert_new(c.where("target_id < 'entity.m'"), c).select("candidate_id", "target_id", "entity_b_id")


def alias_judgements(s: SparkSession, d: str) -> DataFrame:
    """Candidates after judgements; unknown evidence is dropped."""
    c = _trigram_candidates(s, d)
    answers = c.select("candidate_id", F.lit("same").alias("judgement"), F.when(F.col("target_id") < "entity.m", "ok").otherwise("").alias("reason"), F.array(F.lit("nowhere")).alias("evidence_ids"))
    return alias.apply_judgements(c, answers, t.flat(s, d, "evidence")).select("candidate_id", "judgement", "reason", F.size("evidence_ids").alias("n_evidence"))


def alias_decisions(s: SparkSession, d: str) -> DataFrame:
    """The alias catalog after all candidates were confirmed."""
    c = _trigram_candidates(s, d).withColumn("judgement", F.lit("same"))
    cat = more_queries._distinct_names(s, d).select(F.col("entity_id").alias("item_id"), F.lit("BusinessField").alias("canonical_type"), F.col("display_name").alias("alias"))
    return alias.decide(cat, c, c.select("candidate_id", F.lit("confirmed").alias("status")))


def semantic_candidates(s: SparkSession, d: str) -> DataFrame:
    """Artifacts reached from retrieved chunks through the evidence in them."""
    ev = t.evidence(s, d).withColumn("chunk_id", F.col("source_location.file")).withColumn("supports", F.array(F.struct(F.lit("relation").alias("type"), F.col("relation_id").alias("id"))))
    top = t.raw(s, d, "orders").select(F.lit("c").alias("change_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    c = impact.semantic_candidates(top, ev, t.relations(s, d), t.artifacts(s, d))
    return c.groupBy("change_id", "artifact_id").agg(F.count_distinct(F.element_at("evidence_ids", 1)).alias("n_evidence"))


def _hop1(s: SparkSession, d: str) -> DataFrame:
    return impact.merge(impact.hop1(impact_queries.changed_entities(s, d), t.relations(s, d), t.artifacts(s, d))[0])


def rerank_answers(s: SparkSession, d: str) -> DataFrame:
    """Priorities after a model's answers, within the guardrails."""
    i = _hop1(s, d)
    a = i.select("change_id", "artifact_id", F.when(F.col("artifact_id").rlike("[02468]$"), "impact").otherwise("no_impact").alias("llm_judgement"), F.lit("").alias("llm_reason"), F.slice("evidence_ids", 1, 1).alias("selected_evidence_ids"))
    return impact.apply_rerank(i, a).select("change_id", "artifact_id", "review_priority", "evidence_strength")


def ordered_impacts(s: SparkSession, d: str) -> DataFrame:
    """I8: impacts of each change in order of priority and artifact, with their place."""
    i = impact.ordered(_hop1(s, d)).select("change_id", "artifact_id", "review_priority")
    return i.withColumn("seq", F.monotonically_increasing_id()).select("*", F.row_number().over(Window.partitionBy("change_id").orderBy("seq")).alias("place")).drop("seq")


def rerank_batches(s: SparkSession, d: str) -> DataFrame:
    """Candidates in batches of twenty."""
    return impact.rerank_batches(_hop1(s, d), t.evidence(s, d)).select("change_id", "batch", F.size("candidates").alias("n"))


def explain_names(s: SparkSession, d: str) -> DataFrame:
    """Why the suppliers are, or are not, in the latest run."""
    runs = t.changes(s, d).select("change_id", F.expr("substring(change_id, 5)").cast("long").alias("seq"))
    asked = t.changes(s, d).join(F.broadcast(runs.agg(F.max_by("change_id", "seq").alias("change_id"))), "change_id")  # one row
    i, r = impact.analyse(asked, t.entities(s, d), t.artifacts(s, d), t.relations(s, d))
    tr = impact.trace(asked, t.artifacts(s, d), i, r)
    idx = alias.name_index(t.artifacts(s, d), t.entities(s, d))
    wanted = t.raw(s, d, "supplier").select(F.col("s_name").alias("name"))
    return impact.explain(tr, idx, runs, wanted).select("name", "artifact_id", "included")


def imported_relations(s: SparkSession, d: str) -> DataFrame:
    """Quotes of the last line of each document, kept if they occur once, else with the problem."""
    c = t.raw(s, d, "documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.lit(1).alias("line_start"))
    a = c.select("chunk_id", F.lit("a").alias("source_id"), F.lit("READS").alias("relation_type"), F.lit("e").alias("target_id"), F.element_at(F.split("text", "\n"), -1).alias("quote"))
    ok, bad = impact.import_relations(a, c)
    good = ok.select("chunk_id", "line_start", F.lit("ok").alias("problem"))
    return good.unionByName(bad.select("chunk_id", F.lit(0).alias("line_start"), "problem"))


def named_entities(s: SparkSession, d: str) -> DataFrame:
    """Entities that answers name, by id or by a unique name."""
    e = t.entities(s, d)
    a = t.raw(s, d, "part").select(F.lit("c").alias("change_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("entity."), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("name"))
    known, _ = impact.match_named_entities(a, e, alias.name_index(t.artifacts(s, d), e))
    return known


def evidence_seeds(s: SparkSession, d: str) -> DataFrame:
    """Seeds from quoted evidence for changes that name no entity."""
    a = impact_queries._term_atoms(t.changes(s, d)).withColumn("target_terms", F.transform("target_terms", lambda x: F.concat(x, F.lit(" limit is"))))
    none = s.createDataFrame([], "change_id string, entity_id string")
    return search.seeds_from_evidence(a.withColumn("before", F.lit(None).cast("string")), none, t.relations(s, d), t.evidence(s, d))


def _paths(s: SparkSession, d: str) -> DataFrame:
    return search.bounded_search(impact_queries._shared_seeds(s, d), t.relations(s, d))


def candidate_subgraphs(s: SparkSession, d: str) -> DataFrame:
    """Subgraph around each candidate."""
    g = search.candidate_subgraph(_paths(s, d), t.relations(s, d))
    return g.select("change_id", "node_id", F.size("relations").alias("n_relations"), F.size("nodes").alias("n_nodes"))


def impact_context(s: SparkSession, d: str) -> DataFrame:
    """Candidates per change for an offline model."""
    return search.impact_context(_paths(s, d), t.evidence(s, d)).select("change_id", F.size("candidates").alias("n"))


def checked_submissions(s: SparkSession, d: str) -> DataFrame:
    """Submissions by change; one with foreign evidence is rejected as a whole."""
    g = cut(search.candidate_subgraph(_paths(s, d), t.relations(s, d)))
    a = g.select(F.col("change_id").alias("submission_id"), "change_id", "node_id", F.when(F.col("change_id").rlike("[aeiou].$"), F.array(F.lit("zz"))).otherwise(F.slice("evidence", 1, 1)).alias("evidence_ids"), F.slice("relations", 1, 1).alias("relation_ids"))
    return search.check_submission(a, g).groupBy("submission_id", "rejected").agg(F.count("*").alias("n"))


def decided_impacts(s: SparkSession, d: str) -> DataFrame:
    """Decisions after status updates, and how many were refused."""
    none = s.createDataFrame([], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    dec = search.seed_decisions(_hop1(s, d), none, "t0")
    upd = dec.select("impact_id", F.when(F.col("impact_id").endswith("1"), "accepted").when(F.col("impact_id").endswith("2"), "odd").otherwise("rejected").alias("status"), F.lit("r").alias("reason"))
    return search.set_impact_status(dec, upd, "t1")[0].groupBy("status").agg(F.count("*").alias("n"))


def lowered_priorities(s: SparkSession, d: str) -> DataFrame:
    """Priorities after suggestions that may only lower them."""
    i = _hop1(s, d).withColumn("hint", F.when(F.col("artifact_id").rlike("[0-4]$"), "may_review").otherwise("must_review"))
    return i.select("change_id", "artifact_id", search.lower_by_suggestion(F.col("review_priority"), F.col("hint")).alias("review_priority"))


def report_rows(s: SparkSession, d: str) -> DataFrame:
    """K1: impacts of each change in priority arrays, by their sizes."""
    r = sinks.report(_hop1(s, d))
    return r.select("change_id", *[F.coalesce(F.size(p), F.lit(0)).alias(p) for p in ("must_review", "should_review", "may_review")])


def plain_table_columns(s: SparkSession, d: str) -> DataFrame:
    """Columns of a plain table per nation."""
    x = t.raw(s, d, "nation").select(F.col("n_name").alias("table_name"), F.array(F.lit("id"), F.concat(F.lit("Name "), F.col("n_nationkey").cast("string"))).alias("headers"))
    return grid.plain_tables(x).drop("relation_type")


def estimated_sheet_types(s: SparkSession, d: str) -> DataFrame:
    """Types of row-mapped sheets by names and headers."""
    kind = F.element_at(F.array(*map(F.lit, ("画面一覧", "API定義", "テーブル定義", "入力チェック一覧", "外部IF一覧", "試験項目"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    x = t.raw(s, d, "supplier").select("s_suppkey", kind.alias("file"))
    return x.select("s_suppkey", grid.estimate_sheet_type(F.col("file"), F.lit("Sheet1"), F.array(F.lit("x"))).alias("sheet_type"), grid.is_design_sheet(F.lit("book"), F.lit("s"), F.array(F.lit("画面名"), F.when(F.col("s_suppkey") % 2 == 0, "項目名").otherwise("x"))).alias("design"))


def mapped_sheet_rows(s: SparkSession, d: str) -> DataFrame:
    """Relations of an API sheet and a validation sheet with a row per part."""
    api = F.create_map(F.lit("API名"), F.col("p_brand"), F.lit("物理名"), F.col("p_name"), F.lit("区分"), F.when(F.col("p_size") > 25, "response").otherwise("request"))
    check = F.create_map(F.lit("チェックID"), F.concat(F.lit("V"), F.col("p_partkey").cast("string")), F.lit("対象項目"), F.col("p_name"))
    cols = F.create_map(F.lit("物理名"), F.lit(2), F.lit("対象項目"), F.lit(28))
    p = t.raw(s, d, "part")
    rows = p.select(F.lit("A").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), F.lit("api").alias("sheet_type"), api.alias("values"), cols.alias("columns")).unionByName(
        p.select(F.lit("V").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), F.lit("validation").alias("sheet_type"), check.alias("values"), cols.alias("columns"))
    )
    return grid.mapped_rows(rows).select("sheet", "row", "source", "relation_type", "target", "evidence_type", F.regexp_extract("quote", r"^\[(.*?)\]", 1).alias("place"))


def graph_page(s: SparkSession, d: str) -> DataFrame:
    """A page of the edges of one node, and W12's way of paging."""
    return views.page(views.node_edges(t.flat(s, d, "relations"), "api.1"), ["relation_id"], 5, 20)[0].select("relation_id", "relation_type")


def source_library(s: SparkSession, d: str) -> DataFrame:
    """Numbers of what each document holds."""
    docs = t.flat(s, d, "artifacts").select("document_id", F.col("document_id").alias("title")).distinct()
    n = t.artifacts(s, d).select(F.col("artifact_id").alias("node_id"), "source_document_ids")
    r = t.relations(s, d).select("relation_id", "source_document_ids")
    empty = s.createDataFrame([], "document_id string, change_type string, version_number int, resolved_at string")
    return views.source_library(docs, t.flat(s, d, "evidence").select("document_id"), n, r, empty, empty).select("document_id", "evidence", "nodes", "relations", "versions", "stale")


def quoted_impacts(s: SparkSession, d: str) -> DataFrame:
    """Impacts with their quotes in order."""
    q = views.with_quotes(_hop1(s, d), t.evidence(s, d))
    return q.select("change_id", "artifact_id", F.array_join(F.transform("quotes", lambda x: x["quote"]), "|").alias("quotes"))


def inspected_artifacts(s: SparkSession, d: str) -> DataFrame:
    """Artifacts by unique name."""
    w = t.raw(s, d, "customer").select(F.col("c_name").alias("name"))
    idx = alias.name_index(t.artifacts(s, d), t.entities(s, d))
    return views.inspect(t.artifacts(s, d), w, idx, "artifact_id").select("name", "artifact_id", "artifact_type")


def region_listing(s: SparkSession, d: str) -> DataFrame:
    """Listed regions without revision blocks."""
    c = t.cells(s, d)
    return views.region_listing(grid.detect_regions(c, grid.classify_sheets(c)), 0, 10)[0]


def change_sessions(s: SparkSession, d: str) -> DataFrame:
    """Atoms, impacts and decisions of each change side by side."""
    i = _hop1(s, d)
    none = s.createDataFrame([], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    r = views.change_session(search.change_atoms(t.changes(s, d)), i, search.seed_decisions(i, none, "t"))
    return r.select("change_id", F.size("atoms").alias("atoms"), F.coalesce(F.size("impacts"), F.lit(0)).alias("impacts"), F.coalesce(F.size("decisions"), F.lit(0)).alias("decisions"))


QUERIES = {
    f.__name__: f
    for f in (
        prune_embeddings, upsert_stale, freshness_totals, replace_rows, alias_pair_context, alias_inserts, alias_judgements, alias_decisions, semantic_candidates, rerank_answers, ordered_impacts, rerank_batches, explain_names, imported_relations, named_entities, evidence_seeds,
        candidate_subgraphs, impact_context, checked_submissions, decided_impacts, lowered_priorities, report_rows, plain_table_columns, estimated_sheet_types, mapped_sheet_rows, graph_page, source_library, quoted_impacts, inspected_artifacts, region_listing,
        change_sessions,
    )
}

_I = impact_queries._INPUT
_HOP = impact_queries._HOP1 + """,
    ok AS (SELECT h.* FROM hop1 h JOIN artifacts_t USING (artifact_id) WHERE status <> 'rejected'),
    best AS (SELECT change_id, artifact_id, CASE min(CASE review_priority WHEN 'must_review' THEN 0 WHEN 'should_review' THEN 1 ELSE 2 END) WHEN 0 THEN 'must_review' WHEN 1 THEN 'should_review' ELSE 'may_review' END AS review_priority FROM ok GROUP BY 1, 2)"""
_STALE = impact_queries._STALE + ", st AS (SELECT document_id FROM ch WHERE change_type IN ('modified', 'removed'))"
ORACLE_SQL = {
    "prune_embeddings": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 900)",
    "upsert_stale": t.with_views(_STALE + """ SELECT 'now' AS state, count(*) AS n FROM st WHERE document_id LIKE '%2' HAVING count(*) > 0 UNION ALL SELECT 'earlier', count(*) FROM st WHERE document_id LIKE '%4' HAVING count(*) > 0
        UNION ALL SELECT 'open', count(*) FROM st WHERE document_id NOT LIKE '%4' HAVING count(*) > 0""", "documents_old", "documents_new"),
    "freshness_totals": t.with_views(_STALE + """ SELECT (SELECT count(*) FROM ch WHERE change_type IS NOT NULL) AS versions, (SELECT count(DISTINCT document_id) FROM ch WHERE change_type IS NOT NULL) AS documents, 0 AS diffs, 0 AS pending_diffs,
        count(*) AS stale_records, coalesce(sum((document_id NOT LIKE '%1')::INT), 0) AS open_stale FROM st""", "documents_old", "documents_new"),
    "replace_rows": t.with_views("SELECT source_id, CASE WHEN source_id LIKE '%5' THEN 1 ELSE count(*) END AS n FROM relations_t GROUP BY source_id", "relations"),
    "alias_decisions": "WITH p AS (" + more_queries.ORACLE_SQL["alias_trigram_pairs"] + """), n AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, p_name, replace(p_name, ' ', '_') AS c FROM part),
        o AS (SELECT x.id AS a, y.id AS b, x.p_name AS an, y.p_name AS bn, y.c AS bc, x.c AS ac FROM p JOIN n x ON x.id = p."left" JOIN n y ON y.id = p."right"),
        k AS (SELECT CASE WHEN (length(an), a) <= (length(bn), b) THEN a ELSE b END AS item_id, CASE WHEN (length(an), a) <= (length(bn), b) THEN bn ELSE an END AS x, CASE WHEN (length(an), a) <= (length(bn), b) THEN bc ELSE ac END AS y FROM o)
        SELECT id AS item_id, 'BusinessField' AS canonical_type, p_name AS alias FROM n UNION SELECT item_id, 'BusinessField', x FROM k UNION SELECT item_id, 'BusinessField', y FROM k""",
    "semantic_candidates": t.with_views("SELECT 'c' AS change_id, 'api.' || string_split(evidence_id, '.')[4] AS artifact_id, count(DISTINCT evidence_id) AS n_evidence FROM evidence_t JOIN relations_t USING (relation_id) WHERE status <> 'rejected' AND CAST(substring(file, 7) AS BIGINT) IN (SELECT o_orderkey FROM orders) GROUP BY 2", "evidence", "relations"),
    "rerank_batches": t.with_views("WITH " + _HOP + " SELECT change_id, CAST(floor((r - 1) / 20) AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS n FROM (SELECT change_id, row_number() OVER (PARTITION BY change_id) AS r FROM best) GROUP BY 1, 2", *_I),
    "imported_relations": """WITH a AS (SELECT 'k' || CAST(doc_id AS VARCHAR) AS chunk_id, text, string_split(text, chr(10))[-1] AS q FROM documents),
        b AS (SELECT *, strpos(text, q) AS i FROM a) SELECT chunk_id, CASE WHEN p = 'ok' THEN CAST(1 + length(substring(text, 1, i - 1)) - length(replace(substring(text, 1, i - 1), chr(10), '')) AS INTEGER) ELSE 0 END AS line_start, p AS problem
        FROM (SELECT *, CASE WHEN q = '' THEN 'empty quote' WHEN strpos(substring(text, i + 1), q) > 0 THEN 'quote is ambiguous' ELSE 'ok' END AS p FROM b)""",
    "named_entities": "SELECT DISTINCT 'c' AS change_id, 'entity.' || CAST(p_partkey AS VARCHAR) AS entity_id FROM part WHERE p_partkey % 2 = 0",
    "evidence_seeds": t.with_views("SELECT DISTINCT change_id, target_id AS entity_id FROM (SELECT change_id, regexp_extract(body, '^Set (.*) limit from', 1) || ' limit is' AS term FROM changes_t) JOIN evidence_t ON contains(quote, term) JOIN relations_t USING (relation_id)", "changes", "evidence", "relations"),
    "decided_impacts": t.with_views("WITH " + _HOP + " SELECT CASE WHEN artifact_id LIKE '%1' THEN 'accepted' WHEN artifact_id LIKE '%2' THEN 'unreviewed' ELSE 'rejected' END AS status, count(*) AS n FROM best GROUP BY 1", *_I),
    "lowered_priorities": t.with_views("WITH " + _HOP + " SELECT change_id, artifact_id, CASE WHEN regexp_matches(artifact_id, '[0-4]$') THEN 'may_review' ELSE review_priority END AS review_priority FROM best", *_I),
    "report_rows": t.with_views("WITH " + _HOP + " SELECT change_id, CAST(sum((review_priority = 'must_review')::INT) AS INTEGER) AS must_review, CAST(sum((review_priority = 'should_review')::INT) AS INTEGER) AS should_review, CAST(sum((review_priority = 'may_review')::INT) AS INTEGER) AS may_review FROM best GROUP BY 1", *_I),
    "plain_table_columns": """SELECT n_name AS table_name, 'column.' || lower(n_name) || '_' || k AS source_id, 'entity.' || k AS target_id, q AS quote FROM (SELECT n_name, 'id' AS k, 'id' AS q FROM nation UNION ALL SELECT n_name, 'name_' || CAST(n_nationkey AS VARCHAR), 'Name ' || CAST(n_nationkey AS VARCHAR) FROM nation)""",
    "estimated_sheet_types": "SELECT s_suppkey, ['screen', 'api', 'table', 'validation', 'external_if', 'test'][s_suppkey % 6 + 1] AS sheet_type, s_suppkey % 2 = 0 AS design FROM supplier",
    "mapped_sheet_rows": """SELECT 'A' AS sheet, CAST(p_partkey AS INTEGER) AS row, p_brand AS source, CASE WHEN p_size > 25 THEN 'RESPONSE_FIELD' ELSE 'REQUEST_FIELD' END AS relation_type, p_name AS target, 'api_request_definition' AS evidence_type, 'A!B' || CAST(p_partkey AS VARCHAR) AS place FROM part
        UNION ALL SELECT 'V', CAST(p_partkey AS INTEGER), 'V' || CAST(p_partkey AS VARCHAR), 'VALIDATES', p_name, 'validation_rule_definition', 'V!AB' || CAST(p_partkey AS VARCHAR) FROM part""",
    "graph_page": t.with_views("SELECT relation_id, relation_type FROM relations_t WHERE source_id = 'api.1' ORDER BY relation_id LIMIT 20 OFFSET 5", "relations"),
    "source_library": t.with_views("""SELECT d.document_id, (SELECT count(*) FROM evidence_t e WHERE e.document_id = d.document_id) AS evidence, count(*) AS nodes, (SELECT count(*) FROM (SELECT document_id FROM relations_t UNION ALL SELECT document_id FROM calls_t) r WHERE r.document_id = d.document_id) AS relations, 0 AS versions, 0 AS stale
        FROM artifacts_t d GROUP BY d.document_id""", *_I[:5]),
    "quoted_impacts": t.with_views("WITH " + _HOP + " SELECT change_id, o.artifact_id, string_agg(quote, '|' ORDER BY evidence_id) AS quotes FROM (SELECT DISTINCT change_id, artifact_id, evidence_id, quote FROM ok JOIN evidence_t USING (relation_id)) o GROUP BY 1, 2", *_I),
    "inspected_artifacts": "SELECT c_name AS name, 'screen.' || CAST(c_custkey AS VARCHAR) AS artifact_id, 'Screen' AS artifact_type FROM customer",
    "rerank_answers": t.with_views("WITH " + _HOP + """, full_best AS (SELECT change_id, artifact_id, arg_min(review_priority, (k, relation_id)) AS p, arg_min(rule_assessment, (k, relation_id)) AS a FROM (SELECT *, CASE review_priority WHEN 'must_review' THEN 0 WHEN 'should_review' THEN 1 ELSE 2 END AS k FROM ok) GROUP BY 1, 2),
        j AS (SELECT *, p = 'must_review' AND a = 'explicit_relation' AS kept, regexp_matches(artifact_id, '[02468]$') AS up FROM full_best)
        SELECT change_id, artifact_id, CASE WHEN kept THEN p WHEN up THEN CASE WHEN p = 'may_review' THEN 'should_review' ELSE p END ELSE 'may_review' END AS review_priority,
            CASE WHEN kept THEN 'strong' WHEN up THEN CASE p WHEN 'must_review' THEN 'strong' ELSE 'medium' END ELSE 'weak' END AS evidence_strength FROM j""", *_I),
    "ordered_impacts": t.with_views("WITH " + _HOP + " SELECT change_id, artifact_id, review_priority, CAST(row_number() OVER (PARTITION BY change_id ORDER BY CASE review_priority WHEN 'must_review' THEN 0 WHEN 'should_review' THEN 1 ELSE 2 END, artifact_id) AS INTEGER) AS place FROM best", *_I),
    "explain_names": t.with_views("WITH latest AS (SELECT arg_max(change_id, CAST(substring(change_id, 5) AS BIGINT)) AS c FROM changes_t), " + impact_queries._BY_CLASS.replace("FROM changes_t JOIN names", "FROM changes_t JOIN latest ON change_id = c JOIN names") + """
        SELECT s_name AS name, 'api.' || CAST(s_suppkey AS VARCHAR) AS artifact_id, m.artifact_id IS NOT NULL AS included FROM supplier LEFT JOIN found m ON m.artifact_id = 'api.' || CAST(s_suppkey AS VARCHAR)""", *_I),
    "candidate_subgraphs": t.with_views(impact_queries._WAYS.replace("{only}", "true") + """, r AS (SELECT * FROM both_r),
        ends AS (SELECT source_id AS n, relation_id FROM r UNION ALL SELECT target_id, relation_id FROM r), few AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY n ORDER BY relation_id) <= 60),
        nodes AS (SELECT change_id, node_id, node_id AS n FROM found UNION SELECT s.change_id, s.node_id, source_id FROM steps s JOIN r USING (relation_id) UNION SELECT s.change_id, s.node_id, target_id FROM steps s JOIN r USING (relation_id)),
        every AS (SELECT change_id, node_id, relation_id, 0 AS k, i FROM steps UNION ALL SELECT change_id, node_id, relation_id, 1, 0 FROM nodes JOIN few USING (n)),
        top AS (SELECT *, row_number() OVER (PARTITION BY change_id, node_id ORDER BY o, relation_id) AS x FROM (SELECT change_id, node_id, relation_id, min((k, i)) AS o FROM every GROUP BY 1, 2, 3))
        SELECT change_id, node_id, CAST(count(DISTINCT relation_id) AS INTEGER) AS n_relations, CAST(len(list_distinct(flatten(list([source_id, target_id])))) AS INTEGER) AS n_nodes FROM top JOIN r USING (relation_id) WHERE x <= 40 GROUP BY 1, 2""", *_I),
    "impact_context": t.with_views(impact_queries._WAYS.replace("{only}", "true") + " SELECT change_id, CAST(least(100, count(*)) AS INTEGER) AS n FROM found GROUP BY 1", *_I),
    "checked_submissions": t.with_views(impact_queries._WAYS.replace("{only}", "true") + " SELECT change_id AS submission_id, regexp_matches(change_id, '[aeiou].$') AS rejected, count(*) AS n FROM found GROUP BY 1, 2", *_I),
    "region_listing": t.with_views(more_queries._GRID + more_queries._REGIONS + " SELECT region_id, sheet_name, range, CASE WHEN n <= 2 THEN 'note_block' ELSE 'screen_item_table' END AS region_type FROM text ORDER BY region_id LIMIT 10", "cells"),
    "change_sessions": t.with_views("WITH " + _HOP + " SELECT c.change_id, 1 AS atoms, CAST(count(b.artifact_id) AS INTEGER) AS impacts, CAST(count(b.artifact_id) AS INTEGER) AS decisions FROM changes_t c LEFT JOIN best b ON b.change_id = c.change_id GROUP BY 1", *_I),
}

#: Pairs of part names by trigrams as candidates: target first.
_TRIGRAM = "WITH p AS (" + more_queries.ORACLE_SQL["alias_trigram_pairs"] + """), n AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, p_name AS d FROM part),
    o AS (SELECT CASE WHEN (length(x.d), x.id) <= (length(y.d), y.id) THEN x.id ELSE y.id END AS target_id, CASE WHEN (length(x.d), x.id) <= (length(y.d), y.id) THEN y.id ELSE x.id END AS entity_b_id FROM p JOIN n x ON x.id = p."left" JOIN n y ON y.id = p."right"),
    k AS (SELECT 'alias_' || substring(sha1('embedding_similarity' || target_id || entity_b_id), 1, 10) AS candidate_id, * FROM o)"""
ORACLE_SQL["alias_inserts"] = _TRIGRAM + " SELECT candidate_id, target_id, entity_b_id FROM k"
ORACLE_SQL["alias_judgements"] = _TRIGRAM + " SELECT candidate_id, 'same' AS judgement, CASE WHEN target_id < 'entity.m' THEN 'ok' ELSE 'candidate signals: embedding_similarity' END AS reason, 0 AS n_evidence FROM k"
ORACLE_SQL["alias_pair_context"] = t.with_views("WITH p AS (" + more_queries.ORACLE_SQL["alias_trigram_pairs"] + """), r AS (SELECT relation_id, source_id, 'entity.' || replace(p_name, ' ', '_') AS target_id FROM relations_t JOIN part ON target_id = 'entity.' || CAST(p_partkey AS VARCHAR)),
    own AS (SELECT "left" AS l, "right" AS r, "left" AS n FROM p UNION SELECT "left", "right", "right" FROM p), around AS (SELECT DISTINCT l, own.r, source_id AS n FROM own JOIN r ON r.target_id = own.n), nodes AS (SELECT * FROM own UNION SELECT * FROM around),
    touch AS (SELECT nodes.l, nodes.r, relation_id FROM nodes JOIN r ON n = source_id UNION SELECT nodes.l, nodes.r, relation_id FROM nodes JOIN r ON n = target_id), top AS (SELECT * FROM touch QUALIFY row_number() OVER (PARTITION BY l, r ORDER BY relation_id) <= 24),
    o AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, evidence_id, file, line_start FROM evidence_t JOIN part ON p_partkey = CAST(string_split(evidence_id, '.')[5] AS BIGINT)),
    near AS (SELECT a.id AS l, b.id AS r, unnest([a.evidence_id, b.evidence_id]) AS evidence_id FROM o a JOIN o b ON a.file = b.file AND a.id < b.id AND abs(a.line_start - b.line_start) <= 3),
    ev AS (SELECT l, r, evidence_id FROM top JOIN evidence_t USING (relation_id) UNION SELECT near.l, near.r, evidence_id FROM near JOIN p ON p."left" = near.l AND p."right" = near.r),
    e AS (SELECT l, r, count(*) AS n FROM ev GROUP BY 1, 2), a AS (SELECT l, r, count(DISTINCT n) AS n FROM around GROUP BY 1, 2), c AS (SELECT l, r, count(*) AS n FROM top GROUP BY 1, 2)
    SELECT a.l AS "left", a.r AS "right", CAST(a.n AS INTEGER) AS n_surrounding, CAST(c.n AS INTEGER) AS n_relations, CAST(e.n AS INTEGER) AS n_evidence, CAST(least(8, e.n) AS INTEGER) AS n_quotes FROM a JOIN c ON a.l = c.l AND a.r = c.r JOIN e ON e.l = a.l AND e.r = a.r""", "relations", "evidence")
_M = more_queries.ORACLE_SQL
_TWO = "printf('%.2f', floor(s * 100 + 0.5 + 1e-9) / 100)"
ORACLE_SQL["alias_candidates"] = t.with_views("""WITH n AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, p_name AS d, replace(p_name, ' ', '_') AS c FROM part),
    words AS (SELECT id, list_filter(string_split(replace(d || '_' || c, ' ', '_'), '_'), lambda w: length(w) >= 2) AS ws FROM n), tok AS (SELECT DISTINCT id, unnest(ws) AS w FROM words),
    concept AS (SELECT id, CASE WHEN contains(lower(d), 'phone') OR contains(lower(d), 'tel') THEN 'phone_number' WHEN length(c) >= 4 THEN array_to_string(list_filter(string_split(c, '_'), lambda w: length(w) >= 2), '') ELSE '' END AS k FROM n),
    useful AS (SELECT id, w FROM tok WHERE length(w) >= 4 AND w NOT IN ('id', 'no', 'name', 'field', 'item', 'value', 'code', 'type')),
    met AS (SELECT DISTINCT a.id AS l, b.id AS r FROM useful a JOIN useful b ON a.w = b.w AND a.id < b.id), shared AS (SELECT l, r, list_sort(list(a.w)) AS ws FROM met JOIN tok a ON a.id = l JOIN tok b ON b.id = met.r AND a.w = b.w GROUP BY 1, 2),
    gram AS (""" + _M["alias_trigram_pairs"].replace("round(sum(a.n * b.n) / any_value(x.v) / any_value(y.v), 4) AS score", "sum(a.n * b.n) / any_value(x.v) / any_value(y.v) AS s") + """),
    items AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, relation_type AS item FROM relations_t JOIN part ON target_id = 'entity.' || CAST(p_partkey AS VARCHAR)), sizes AS (SELECT id, count(*) AS n FROM items GROUP BY 1),
    ctx AS (SELECT a.id AS l, b.id AS r, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS s FROM items a JOIN items b ON a.item = b.item AND a.id < b.id JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.4),
    o AS (SELECT DISTINCT 'entity.' || replace(p_name, ' ', '_') AS id, file, line_start FROM evidence_t JOIN part ON p_partkey = CAST(string_split(evidence_id, '.')[5] AS BIGINT)),
    sig AS (SELECT a.id AS l, b.id AS r, 'concept_key:' || a.k AS s FROM concept a JOIN concept b ON a.k = b.k AND a.k <> '' AND a.id < b.id UNION SELECT a.id, b.id, 'camel_snake_shape_match' FROM words a JOIN words b ON array_to_string(a.ws, '') = array_to_string(b.ws, '') AND a.id < b.id
        UNION SELECT l, r, 'name_token_overlap:' || array_to_string(ws[1:4], ',') FROM shared UNION SELECT "left", "right", 'embedding_similarity:' || """ + _TWO + " FROM gram UNION SELECT l, r, 'relation_similarity:' || " + _TWO + """ FROM ctx
        UNION SELECT a.id, b.id, 'same_evidence_neighborhood' FROM o a JOIN o b ON a.file = b.file AND a.id < b.id AND abs(a.line_start - b.line_start) <= 3),
    pairs AS (SELECT l, r, list_sort(list(s)) AS ss FROM sig GROUP BY 1, 2), sided AS (SELECT ss, CASE WHEN (length(x.d), x.id) <= (length(y.d), y.id) THEN x ELSE y END AS t, CASE WHEN (length(x.d), x.id) <= (length(y.d), y.id) THEN y ELSE x END AS c FROM pairs JOIN n x ON x.id = l JOIN n y ON y.id = pairs.r)
    SELECT 'alias_' || substring(sha1(array_to_string(ss, '|') || t.id || c.id), 1, 10) AS candidate_id, t.id AS target_id, c.id AS entity_b_id, CAST(len(ss) AS INTEGER) AS n_signals, array_to_string(list_sort(list_distinct([c.d, c.c])), ',') AS aliases FROM sided""", "relations", "evidence")
for _name in ("candidate_subgraphs", "impact_context", "checked_submissions"):
    ORACLE_SQL[_name] = t.for_shared(ORACLE_SQL[_name])
