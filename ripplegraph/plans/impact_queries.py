"""Queries of impact analysis, graph maintenance and freshness, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import freshness, impact, maintain, search
from ..sources import sinks
from . import tables as t

_joined = lambda c: F.array_join(c, ",").alias(c)


def _impacts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Impacts, row by row, of the changes by name: together they change every part. Those of a change for each part are counted by class."""
    return impact.analyse(t.shared_changes(s, d), t.shared_entities(s, d), t.artifacts(s, d), cut(t.relations(s, d)))


def _classes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return impact.classes(t.changes(s, d), t.entities(s, d), t.artifacts(s, d), cut(t.relations(s, d)))


def changed_entities(s: SparkSession, d: str) -> DataFrame:
    """Entities named in each change."""
    return impact.changed_entities(t.changes(s, d), impact.names_of(t.entities(s, d)))


def impact_direct(s: SparkSession, d: str) -> DataFrame:
    """Changed entities themselves."""
    r = impact.direct(changed_entities(s, d), t.entities(s, d), t.relations(s, d))
    return r.select("change_id", "artifact_id", "review_priority", "evidence_strength", "rule_assessment")


def impact_hop1(s: SparkSession, d: str) -> DataFrame:
    """Candidates one relation away."""
    found, _ = impact.hop1(changed_entities(s, d), t.relations(s, d), t.artifacts(s, d))
    return found.select("change_id", "artifact_id", F.col("_seq").alias("relation_id"), "review_priority", "evidence_strength", "rule_assessment")


def impact_rejected(s: SparkSession, d: str) -> DataFrame:
    """Rejected relations into changed entities."""
    return impact.hop1(changed_entities(s, d), t.relations(s, d), t.artifacts(s, d))[1]


def impact_report(s: SparkSession, d: str) -> DataFrame:
    """What must, should or may be reviewed when all parts of a name change, over two hops."""
    r, _ = _impacts(s, d)
    return r.select("change_id", "artifact_id", "review_priority", "evidence_strength", "match_type", "relation_distance", "rule_assessment", F.size("relation_paths").alias("n_paths"), F.size("evidence_ids").alias("n_evidence"), _joined("relation_statuses"))


def impact_trace(s: SparkSession, d: str) -> DataFrame:
    """Whether and why each artifact is included, per change."""
    i, r = _impacts(s, d)
    return impact.trace_counts(t.shared_changes(s, d), t.artifacts(s, d), i, r)


def all_impact_report(s: SparkSession, d: str) -> DataFrame:
    """What must, should or may be reviewed for every part's change, over two hops."""
    r = impact.counted(t.changes(s, d), t.entities(s, d), t.artifacts(s, d), cut(t.relations(s, d)))
    return r.select("change_id", "artifact_id", "review_priority", "evidence_strength", "match_type", "relation_distance", "rule_assessment", "n_paths", "n_evidence", _joined("relation_statuses"))


def all_impact_classes(s: SparkSession, d: str) -> DataFrame:
    """In which ways, and how often in each, every part's change reaches artifacts over two hops."""
    return _classes(s, d)[0]


def all_impact_trace(s: SparkSession, d: str) -> DataFrame:
    """Artifacts by whether and why they are included, for every part's change."""
    return _classes(s, d)[1]


def report_counts(s: SparkSession, d: str) -> DataFrame:
    """K1: candidates per change and priority, for every part's change."""
    n = lambda p: F.coalesce(F.sum(F.when(F.col("review_priority") == p, F.col("n_links"))), F.lit(0)).alias(p)
    return _classes(s, d)[0].groupBy("change_id").agg(F.sum("n_links").alias("candidates"), *[n(p) for p in impact.PRIORITIES])


_CHANGED = """
    names AS (SELECT entity_id, display_name AS name FROM entities_t WHERE method <> 'llm' UNION SELECT entity_id, canonical_name FROM entities_t WHERE method <> 'llm'),
    changed AS (SELECT DISTINCT change_id, entity_id FROM changes_t JOIN names ON contains(title || chr(10) || body, name))"""
_HOP1 = (
    _CHANGED
    + """,
    hop1 AS (
        SELECT change_id, source_id AS artifact_id, relation_id, relation_type, polarity, status, match_type,
            CASE WHEN (polarity = 'inferred' AND status <> 'confirmed') OR relation_type = 'MENTIONS' THEN 'may_review'
                WHEN relation_type IN ('DEFINES', 'WRITES', 'VALIDATES', 'SENDS', 'REQUEST_FIELD') THEN 'must_review'
                WHEN relation_type IN ('READS', 'DISPLAYS', 'RESPONSE_FIELD', 'COVERS', 'CALLS') THEN 'should_review' ELSE 'may_review' END AS review_priority,
            CASE WHEN relation_type = 'MENTIONS' THEN 'alias_mention' WHEN polarity = 'inferred' THEN 'inferred_relation' ELSE 'explicit_relation' END AS rule_assessment,
            'change -> ' || target_id || ' <- ' || relation_type || ' - ' || source_id AS path
        FROM relations_t JOIN changed ON target_id = entity_id)"""
)
_ALL = (
    _HOP1
    + """,
    sure AS (SELECT DISTINCT target_id FROM relations_t WHERE status = 'confirmed'),
    ev AS (SELECT relation_id, list(DISTINCT evidence_id) AS ids FROM evidence_t GROUP BY relation_id),
    cand1 AS (
        SELECT change_id, c.entity_id AS artifact_id, CASE WHEN method = 'llm' AND sure.target_id IS NULL THEN 'may_review' ELSE 'must_review' END AS review_priority, 'direct_match' AS rule_assessment,
            CASE WHEN method = 'llm' AND sure.target_id IS NULL THEN 'semantic' ELSE 'exact' END AS match_type, 0 AS dist, '' AS seq, ['change -> ' || c.entity_id] AS paths, CAST([] AS VARCHAR[]) AS evs, CAST([] AS VARCHAR[]) AS statuses,
            CASE WHEN method = 'llm' AND sure.target_id IS NULL THEN 'An unconfirmed LLM-only entity was matched.' ELSE '変更依頼が ' || e.display_name || ' を直接参照しているため。' END AS reason
        FROM changed c JOIN entities_t e ON c.entity_id = e.entity_id LEFT JOIN sure ON sure.target_id = c.entity_id
        UNION ALL
        SELECT change_id, h.artifact_id, review_priority, rule_assessment, match_type, 1, h.relation_id, [path], coalesce(ev.ids, []), [status], relation_type || ' relation with explicit local evidence was found.'
        FROM hop1 h JOIN artifacts_t a ON a.artifact_id = h.artifact_id LEFT JOIN ev ON ev.relation_id = h.relation_id WHERE status <> 'rejected'),
    near AS (
        SELECT change_id, artifact_id, list_sort(list_distinct(flatten(list(paths))))[1] AS path, list_distinct(flatten(list(evs))) AS evs, list_distinct(flatten(list(statuses))) AS statuses FROM cand1 GROUP BY 1, 2),
    edges AS (SELECT r.*, coalesce(ev.ids, []) AS ids FROM relations_t r LEFT JOIN ev ON ev.relation_id = r.relation_id UNION ALL SELECT c.*, [] FROM calls_t c),
    cand2 AS (
        SELECT n.change_id, e.source_id AS artifact_id, CASE WHEN polarity = 'inferred' AND status <> 'confirmed' THEN 'may_review' ELSE 'should_review' END AS review_priority, 'explicit_relation' AS rule_assessment,
            match_type, 2 AS dist, '~' || relation_id || '|' || target_id AS seq, [n.path || ' <- ' || relation_type || ' - ' || source_id] AS paths, list_concat(n.evs, e.ids) AS evs, list_append(n.statuses, status) AS statuses,
            'A two-hop explicit relation path to the changed entity was found.' AS reason
        FROM edges e JOIN near n ON e.target_id = n.artifact_id JOIN artifacts_t a ON a.artifact_id = e.source_id WHERE status <> 'rejected'),
    cands AS (SELECT *, CASE review_priority WHEN 'must_review' THEN 0 WHEN 'should_review' THEN 1 ELSE 2 END AS rank FROM (SELECT * FROM cand1 UNION ALL SELECT * FROM cand2)),
    merged AS (
        SELECT change_id, artifact_id, arg_min(review_priority, (rank, dist, seq)) AS review_priority, arg_min(rule_assessment, (rank, dist, seq)) AS rule_assessment, arg_min(match_type, (dist, seq)) AS first_match, arg_min(reason, (dist, seq)) AS reason, bool_or(match_type = 'exact') AS exact,
            min(dist) AS relation_distance, list_distinct(flatten(list(paths))) AS paths, list_distinct(flatten(list(evs))) AS evs, list_sort(list_distinct(flatten(list(statuses)))) AS statuses
        FROM cands GROUP BY 1, 2)"""
)
#: What each change reaches, without paths and evidence: the first hop by rows, the second one grouped by itself.
_BY_CLASS = (
    _HOP1
    + """,
    sure AS (SELECT DISTINCT target_id FROM relations_t WHERE status = 'confirmed'),
    cand1 AS (
        SELECT change_id, c.entity_id AS artifact_id, CASE WHEN method = 'llm' AND sure.target_id IS NULL THEN 'may_review' ELSE 'must_review' END AS p, CASE WHEN method = 'llm' AND sure.target_id IS NULL THEN 'inferred_relation' ELSE 'direct_match' END AS a,
            CASE WHEN method = 'llm' AND sure.target_id IS NULL THEN 'semantic' ELSE 'exact' END AS match_type, 0 AS dist, '' AS seq, false AS c, false AS u
        FROM changed c JOIN entities_t e ON c.entity_id = e.entity_id LEFT JOIN sure ON sure.target_id = c.entity_id
        UNION ALL SELECT change_id, h.artifact_id, review_priority, rule_assessment, match_type, 1, h.relation_id, status = 'confirmed', status = 'unconfirmed' FROM hop1 h JOIN artifacts_t USING (artifact_id) WHERE status <> 'rejected'),
    near AS (
        SELECT change_id, artifact_id, arg_min(p, (rank, dist, seq)) AS p, arg_min(a, (rank, dist, seq)) AS a, min(rank) AS rank, arg_min(match_type, (dist, seq)) AS first, bool_or(match_type = 'exact') AS exact, min(dist) AS dist, bool_or(c) AS c, bool_or(u) AS u
        FROM (SELECT *, CASE p WHEN 'must_review' THEN 0 WHEN 'should_review' THEN 1 ELSE 2 END AS rank FROM cand1) GROUP BY 1, 2),
    edges AS (SELECT source_id, target_id, CASE WHEN polarity = 'inferred' AND status <> 'confirmed' THEN 2 ELSE 1 END AS rank, match_type, status = 'confirmed' AS c, status = 'unconfirmed' AS u
        FROM (SELECT * FROM relations_t UNION ALL SELECT * FROM calls_t) WHERE status <> 'rejected'),
    far AS (
        SELECT n.change_id, e.source_id AS artifact_id, min(e.rank) AS rank, bool_or(e.match_type = 'exact') AS exact, min(e.match_type) AS first, bool_or(n.c OR e.c) AS c, bool_or(n.u OR e.u) AS u
        FROM edges e JOIN near n ON e.target_id = n.artifact_id WHERE e.source_id IN (SELECT artifact_id FROM artifacts_t) GROUP BY 1, 2),
    found AS (
        SELECT coalesce(n.change_id, f.change_id) AS change_id, coalesce(n.artifact_id, f.artifact_id) AS artifact_id, CASE least(n.rank, f.rank) WHEN 0 THEN 'must_review' WHEN 1 THEN 'should_review' ELSE 'may_review' END AS review_priority,
            CASE WHEN n.rank IS NULL OR f.rank < n.rank THEN 'explicit_relation' ELSE n.a END AS rule_assessment, CASE WHEN coalesce(n.exact, false) OR coalesce(f.exact, false) THEN 'exact' ELSE coalesce(n.first, f.first) END AS match_type,
            coalesce(n.dist, 2) AS dist, coalesce(n.c, false) OR coalesce(f.c, false) AS c, coalesce(n.u, false) OR coalesce(f.u, false) AS u
        FROM near n FULL JOIN far f ON n.change_id = f.change_id AND n.artifact_id = f.artifact_id)"""
)
_INPUT = ("artifacts", "entities", "relations", "calls", "evidence", "changes")


def _graph(s: SparkSession, d: str) -> DataFrame:
    return t.flat(s, d, "relations").withColumn("seq", F.lit(0))


def replace_by_document(s: SparkSession, d: str) -> DataFrame:
    """G1: relations after the documents doc.1 and doc.2 were replaced by their confirmed ones."""
    r = t.flat(s, d, "relations")
    gone = r.where("document_id in ('doc.1', 'doc.2')").select("document_id").distinct()
    return maintain.replace_by_document(r, r.where("document_id in ('doc.1', 'doc.2') and status = 'confirmed'"), gone).groupBy("document_id", "status").agg(F.count("*").alias("n"))


def unique_last(s: SparkSession, d: str) -> DataFrame:
    """The last event of every user."""
    return maintain.unique_last(t.flat(s, d, "ledger"), ["k"])


def merge_nodes(s: SparkSession, d: str) -> DataFrame:
    """Parts of one name become one node."""
    e = t.flat(s, d, "shared_names").select(F.col("display_name").alias("name"), F.col("entity_id").alias("first_id"), F.array("canonical_name").alias("aliases"), F.array("document_id").alias("source_document_ids"), F.array("method").alias("extraction_methods"), F.regexp_extract("entity_id", r"(\d+)", 1).cast("long").alias("seq"))
    return maintain.merge_nodes(e, "name", ["first_id"]).select("name", "first_id", _joined("aliases"), _joined("source_document_ids"), _joined("extraction_methods"))


def merge_relations(s: SparkSession, d: str) -> DataFrame:
    """Evidence rows of one relation become one relation."""
    e = t.flat(s, d, "evidence").select("relation_id", F.col("file").alias("match_type"), F.array("evidence_id").alias("evidence_ids"), F.array("document_id").alias("source_document_ids"), F.col("evidence_id").alias("seq"))
    return maintain.merge_relations(e).select("relation_id", F.col("match_type").alias("first_file"), F.size("evidence_ids").alias("n_evidence"), _joined("source_document_ids"))


def carry_status(s: SparkSession, d: str) -> DataFrame:
    """Statuses after a re-load in which doc.3 changed."""
    r = t.relations(s, d)
    stale = t.flat(s, d, "relations").where("document_id = 'doc.3'").select("document_id").distinct()
    return maintain.carry_status(r.withColumn("status", F.lit("unconfirmed")), r, stale).select("relation_id", "status")


def document_collisions(s: SparkSession, d: str) -> DataFrame:
    """Source names that stand for several languages."""
    return maintain.document_collisions(t.raw(s, d, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("path")))


def check_contract(s: SparkSession, d: str) -> DataFrame:
    """Violations of the relation contract, counted."""
    r = maintain.check_contract(t.flat(s, d, "relations").withColumn("relation_type", F.when(F.col("relation_type") != "ASSERTS", F.col("relation_type"))), maintain.relation_rules())
    return r.groupBy(F.array_join("violations", "; ").alias("violations")).agg(F.count("*").alias("n"))


def relation_diff(s: SparkSession, d: str) -> DataFrame:
    """Relations that came and went against a baseline."""
    r = t.flat(s, d, "relations")
    return maintain.relation_diff(r.where("status <> 'rejected'"), r.where("polarity = 'explicit'"))


def set_status(s: SparkSession, d: str) -> DataFrame:
    """Statuses after the decisions on inferred relations."""
    r = t.flat(s, d, "relations")
    dec = r.where("polarity = 'inferred'").select("relation_id", F.lit("rejected").alias("status"), F.lit(1).alias("seq"))
    return maintain.set_status(r, dec)[0].groupBy("status", "polarity").agg(F.count("*").alias("n"))


def without_sources(s: SparkSession, d: str) -> DataFrame:
    """Nodes after two sources were taken away."""
    e = t.flat(s, d, "shared_names").groupBy("display_name").agg(F.array_sort(F.collect_set("document_id")).alias("source_document_ids"))
    gone = t.flat(s, d, "entities").where("document_id in ('doc.1', 'doc.4')").select("document_id")
    return maintain.without_sources(e, gone).select("display_name", _joined("source_document_ids"))


def document_changes(s: SparkSession, d: str) -> DataFrame:
    """Documents added, modified and removed between two versions."""
    old, new = t.flat(s, d, "documents_old"), t.flat(s, d, "documents_new")
    return freshness.document_changes(old, new, old.select("document_id")).select("document_id", "source_path", "change_type")


def stale_relations(s: SparkSession, d: str) -> DataFrame:
    """Relations of which a source changed, with hashed stale ids."""
    r = t.raw(s, d, "documents").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("relation_id"), F.array(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("source_document_ids"))
    old, new = t.flat(s, d, "documents_old"), t.flat(s, d, "documents_new")
    return freshness.stale_by_source(freshness.document_changes(old, new, old.select("document_id")), r, "relation", "relation_id", "source_document_ids").select("stale_id", "target_id", "document_id", "reason")


def relation_changes(s: SparkSession, d: str) -> DataFrame:
    """Relations added, removed or changed in content between two loads."""
    r = t.relations(s, d)
    new = r.where("relation_id not like 'rel.c%7'").withColumn("match_type", F.when(F.col("relation_type") == "READS", "semantic").otherwise(F.col("match_type"))).withColumn("status", F.lit("unconfirmed"))
    return freshness.relation_changes(r.where("relation_type <> 'MENTIONS'"), new).groupBy("change").agg(F.count("*").alias("n"))


def append_versions(s: SparkSession, d: str) -> DataFrame:
    """Version rows of the changed documents, numbered on."""
    old, new = t.flat(s, d, "documents_old"), t.flat(s, d, "documents_new")
    first = freshness.document_changes(old.limit(0), old)
    v1 = freshness.append_versions(s.createDataFrame([], "document_id string, version_number int"), first, "diff.1")
    v2 = freshness.append_versions(v1.select("document_id", "version_number"), freshness.document_changes(old, new, old.select("document_id")), "diff.2")
    return v2.select("version_id", "document_id", "version_number", "change_type")


def change_atoms(s: SparkSession, d: str) -> DataFrame:
    """B1: what each change asks for."""
    a = search.change_atoms(t.changes(s, d))
    return a.select("change_id", F.get("target_terms", F.lit(0)).alias("target"), "operation", "before", "after")


def atom_counts(s: SparkSession, d: str) -> DataFrame:
    """B2: atoms per change."""
    return search.atom_counts(search.change_atoms(t.changes(s, d)))


def _term_atoms(changes: DataFrame) -> DataFrame:
    """Atoms whose one term is the part name of the change."""
    return changes.select(F.concat(F.lit("atom."), "change_id").alias("atom_id"), "change_id", F.array(F.regexp_extract("body", "^Set (.*) limit from", 1)).alias("target_terms"), F.lit("change_constraint").alias("operation"), F.lit("max_value").alias("property"), F.regexp_extract("body", "from ([0-9]+) to", 1).alias("before"), F.lit("99").alias("after"))


def seed_entities(s: SparkSession, d: str) -> DataFrame:
    """Entities that each change's term names."""
    return search.seed_entities(_term_atoms(t.changes(s, d)), _both_names(t.entities(s, d)))


def _both_names(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", F.explode(F.array("display_name", "canonical_name")).alias("name"))


def _shared_seeds(s: SparkSession, d: str) -> DataFrame:
    return search.seed_entities(_term_atoms(t.shared_changes(s, d)), _both_names(t.shared_entities(s, d)))


def bounded_search(s: SparkSession, d: str) -> DataFrame:
    """Nodes reached within the depth of their relation types, with hops and evidence."""
    return search.reached_nodes(_shared_seeds(s, d), t.relations(s, d)).select("change_id", "node_id", "hops")


def verified_impacts(s: SparkSession, d: str) -> DataFrame:
    """Verified impact hypotheses."""
    paths = search.bounded_search(_shared_seeds(s, d), cut(t.relations(s, d)))
    v = search.verify(paths, _term_atoms(t.shared_changes(s, d)), t.artifacts(s, d), t.evidence(s, d))
    decisions = t.artifacts(s, d).select(F.concat(F.lit("i."), "artifact_id").alias("impact_id"), F.col("artifact_id").alias("candidate_node_id"), F.when(F.col("artifact_id").endswith("3"), "rejected").otherwise("accepted").alias("status"), F.lit("2024").alias("updated_at"))
    h = search.hypotheses(search.apply_prior_decisions(v, decisions))
    return h.select("change_id", "artifact_id", "review_priority", "relation_distance", "rule_assessment", F.size("evidence_ids").alias("n_evidence"))


def flat_export(s: SparkSession, d: str) -> DataFrame:
    """K2: one row per candidate with its first evidence."""
    r = sinks.flat_export(_impacts(s, d)[0], t.evidence(s, d))
    return r.select("change_id", "artifact_id", "review_priority", "evidence_count", "file", F.coalesce("line", F.lit(0)).alias("line"), "quote")


def cypher_export(s: SparkSession, d: str) -> DataFrame:
    """K4: property-graph statements."""
    none = s.createDataFrame([], "impact_id string, change_id string, candidate_node_id string, status string, reason string")
    return sinks.cypher(t.artifacts(s, d), t.entities(s, d), t.relations(s, d), t.evidence(s, d), none)


def markdown_export(s: SparkSession, d: str) -> DataFrame:
    """K3: blocks of the Markdown report."""
    return sinks.markdown_report(_impacts(s, d)[0], t.evidence(s, d)).select("change_id", "place", F.length("text").alias("n_chars"))


def notes_export(s: SparkSession, d: str) -> DataFrame:
    """K5: linked notes."""
    none = s.createDataFrame([], "impact_id string, change_id string, candidate_node_id string, status string, reason string, updated_at string")
    n = sinks.notes(t.artifacts(s, d), t.entities(s, d), t.relations(s, d), t.evidence(s, d), none)
    return n.select("path", F.sha2("content", 256).alias("content_hash"))


QUERIES = {
    f.__name__: f
    for f in (
        changed_entities, impact_direct, impact_hop1, impact_rejected, impact_report, impact_trace, all_impact_report, all_impact_classes, all_impact_trace, report_counts, replace_by_document, unique_last, merge_nodes, merge_relations, carry_status, document_collisions, check_contract, relation_diff,
        set_status, without_sources, document_changes, stale_relations, relation_changes, append_versions, change_atoms, atom_counts, seed_entities, bounded_search, verified_impacts, flat_export, cypher_export, markdown_export, notes_export,
    )
}

_STALE = """WITH old AS (SELECT * FROM documents_old_t), new AS (SELECT * FROM documents_new_t),
    ch AS (SELECT coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.path, o.path) AS source_path, o.hash AS previous_hash, n.hash AS current_hash,
        CASE WHEN o.document_id IS NULL THEN 'added' WHEN n.document_id IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' END AS change_type FROM old o FULL JOIN new n ON o.document_id = n.document_id)"""
ORACLE_SQL = {
    "changed_entities": t.with_views("WITH " + _CHANGED + " SELECT * FROM changed", *_INPUT),
    "impact_direct": t.with_views("WITH " + _CHANGED + """, sure AS (SELECT DISTINCT target_id FROM relations_t WHERE status = 'confirmed')
        SELECT change_id, c.entity_id AS artifact_id, CASE WHEN w THEN 'may_review' ELSE 'must_review' END AS review_priority, CASE WHEN w THEN 'weak' ELSE 'strong' END AS evidence_strength, CASE WHEN w THEN 'inferred_relation' ELSE 'direct_match' END AS rule_assessment
        FROM (SELECT changed.*, method = 'llm' AND target_id IS NULL AS w FROM changed JOIN entities_t USING (entity_id) LEFT JOIN sure ON target_id = entity_id) c""", *_INPUT),
    "impact_hop1": t.with_views("WITH " + _HOP1 + " SELECT change_id, artifact_id, relation_id, review_priority, CASE review_priority WHEN 'may_review' THEN 'weak' WHEN 'must_review' THEN 'strong' ELSE 'medium' END AS evidence_strength, rule_assessment FROM hop1 WHERE status <> 'rejected'", *_INPUT),
    "impact_rejected": t.with_views("WITH " + _HOP1 + " SELECT change_id, artifact_id, relation_id FROM hop1 WHERE status = 'rejected'", *_INPUT),
    "impact_report": t.with_views("WITH " + _ALL + """ SELECT change_id, artifact_id, review_priority, CASE WHEN relation_distance = 0 AND review_priority = 'must_review' THEN 'strong' WHEN review_priority = 'may_review' THEN 'weak' WHEN review_priority = 'must_review' THEN 'strong' ELSE 'medium' END AS evidence_strength,
        CASE WHEN exact THEN 'exact' ELSE first_match END AS match_type, relation_distance, rule_assessment, len(paths) AS n_paths, len(evs) AS n_evidence, array_to_string(statuses, ',') AS relation_statuses FROM merged""", *_INPUT),
    "impact_trace": t.with_views("WITH " + _ALL + """, rej AS (SELECT DISTINCT change_id, artifact_id FROM hop1 JOIN artifacts_t USING (artifact_id) WHERE status = 'rejected')
        SELECT c.change_id, m.artifact_id IS NOT NULL AS included, coalesce(m.review_priority, 'hidden') AS review_priority, CASE WHEN m.artifact_id IS NULL AND r.artifact_id IS NOT NULL THEN 'rejected' ELSE 'other' END AS why, count(*) AS n
        FROM changes_t c CROSS JOIN artifacts_t a LEFT JOIN merged m ON m.change_id = c.change_id AND m.artifact_id = a.artifact_id LEFT JOIN rej r ON r.change_id = c.change_id AND r.artifact_id = a.artifact_id GROUP BY 1, 2, 3, 4""", *_INPUT),
    "all_impact_classes": t.with_views("WITH " + _BY_CLASS + """ SELECT change_id, review_priority, CASE review_priority WHEN 'must_review' THEN 'strong' WHEN 'should_review' THEN 'medium' ELSE 'weak' END AS evidence_strength, match_type, CAST(dist AS INTEGER) AS relation_distance, rule_assessment,
        array_to_string(list_filter([CASE WHEN c THEN 'confirmed' END, CASE WHEN u THEN 'unconfirmed' END], lambda x: x IS NOT NULL), ',') AS relation_statuses, count(*) AS n_links FROM found GROUP BY ALL""", *_INPUT),
    "all_impact_trace": t.with_views("WITH " + _BY_CLASS + """, rej AS (SELECT DISTINCT change_id, artifact_id FROM hop1 JOIN artifacts_t USING (artifact_id) WHERE status = 'rejected'),
        met AS (SELECT change_id, true AS included, review_priority, 'other' AS why, count(*) AS n FROM found JOIN artifacts_t USING (artifact_id) GROUP BY 1, 3
            UNION ALL SELECT change_id, false, 'hidden', 'rejected', count(*) FROM rej r WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.change_id = r.change_id AND f.artifact_id = r.artifact_id) GROUP BY 1)
        SELECT * FROM met UNION ALL SELECT change_id, false, 'hidden', 'other', n FROM (SELECT c.change_id, (SELECT count(*) FROM artifacts_t) - coalesce(sum(n), 0) AS n FROM changes_t c LEFT JOIN met ON met.change_id = c.change_id GROUP BY 1) WHERE n > 0""", *_INPUT),
    "report_counts": t.with_views("WITH " + _BY_CLASS + " SELECT change_id, count(*) AS candidates, " + ", ".join(f"sum((review_priority = '{p}')::INT) AS {p}" for p in impact.PRIORITIES) + " FROM found GROUP BY 1", *_INPUT),
    "replace_by_document": t.with_views("SELECT document_id, status, count(*) AS n FROM relations_t WHERE document_id NOT IN ('doc.1', 'doc.2') OR status = 'confirmed' GROUP BY 1, 2", "relations"),
    "unique_last": t.with_views("SELECT * FROM ledger_t QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1", "ledger"),
    "merge_nodes": t.with_views("SELECT display_name AS name, arg_min(entity_id, CAST(substring(entity_id, 8) AS BIGINT)) AS first_id, string_agg(DISTINCT canonical_name, ',' ORDER BY canonical_name) AS aliases, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS source_document_ids, string_agg(DISTINCT method, ',' ORDER BY method) AS extraction_methods FROM shared_names_t GROUP BY 1", "shared_names"),
    "merge_relations": t.with_views("SELECT relation_id, arg_min(file, evidence_id) AS first_file, CAST(count(DISTINCT evidence_id) AS INTEGER) AS n_evidence, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS source_document_ids FROM evidence_t GROUP BY 1", "evidence"),
    "carry_status": t.with_views("SELECT relation_id, CASE WHEN document_id = 'doc.3' THEN 'unconfirmed' ELSE status END AS status FROM (SELECT * FROM relations_t UNION ALL SELECT * FROM calls_t)", "relations", "calls"),
    "document_collisions": "SELECT source AS document_id, count(DISTINCT lang) AS paths FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1",
    "check_contract": t.with_views("SELECT CASE WHEN relation_type = 'ASSERTS' THEN 'relation_type is required; relation_type is unknown' ELSE '' END AS violations, count(*) AS n FROM relations_t GROUP BY 1", "relations"),
    "relation_diff": t.with_views("SELECT relation_id, 'added' AS change FROM relations_t WHERE status <> 'rejected' AND polarity <> 'explicit' UNION ALL SELECT relation_id, 'removed' FROM relations_t WHERE polarity = 'explicit' AND status = 'rejected'", "relations"),
    "set_status": t.with_views("SELECT CASE WHEN polarity = 'inferred' THEN 'rejected' ELSE status END AS status, polarity, count(*) AS n FROM relations_t GROUP BY 1, 2", "relations"),
    "without_sources": t.with_views("SELECT display_name, string_agg(DISTINCT document_id, ',' ORDER BY document_id) AS source_document_ids FROM shared_names_t WHERE document_id NOT IN ('doc.1', 'doc.4') GROUP BY 1", "shared_names"),
    "document_changes": t.with_views(_STALE + " SELECT document_id, source_path, change_type FROM ch WHERE change_type IS NOT NULL", "documents_old", "documents_new"),
    "stale_relations": t.with_views(_STALE + """ SELECT 'stale.' || substring(sha1('relation|r' || substring(document_id, 2) || '|' || document_id || '|' || coalesce(current_hash, 'None')), 1, 16) AS stale_id, 'r' || substring(document_id, 2) AS target_id, document_id, 'Source ' || change_type || ': ' || source_path AS reason
        FROM ch WHERE change_type IN ('modified', 'removed')""", "documents_old", "documents_new"),
    "relation_changes": t.with_views("""WITH r AS (SELECT * FROM relations_t UNION ALL SELECT * FROM calls_t), x AS (SELECT CASE WHEN relation_id LIKE 'rel.c%7' THEN 'removed' WHEN relation_type = 'MENTIONS' THEN 'added' WHEN relation_type = 'READS' THEN 'changed' END AS change FROM r)
        SELECT change, count(*) AS n FROM x WHERE change IS NOT NULL GROUP BY 1""", "relations", "calls"),
    "append_versions": t.with_views(_STALE + """ SELECT 'version.' || substring(sha1(document_id || '|' || CAST(v AS VARCHAR) || '|' || coalesce(current_hash, 'None')), 1, 16) AS version_id, document_id, CAST(v AS INTEGER) AS version_number, change_type
        FROM (SELECT *, CASE WHEN change_type = 'added' THEN 1 ELSE 2 END AS v FROM ch WHERE change_type IS NOT NULL)""", "documents_old", "documents_new"),
    "change_atoms": t.with_views(r"""SELECT change_id, 'Set' AS target, 'change_spec' AS operation, regexp_extract(body, '[A-Za-z_][A-Za-z0-9_]+.*?([0-9]+).*?([0-9]+)', 1) AS before, regexp_extract(body, '[A-Za-z_][A-Za-z0-9_]+.*?([0-9]+).*?([0-9]+)', 2) AS after FROM changes_t""", "changes"),
    "atom_counts": t.with_views("SELECT change_id, count(*) AS atoms FROM changes_t GROUP BY 1", "changes"),
    "seed_entities": t.with_views("""SELECT DISTINCT change_id, entity_id FROM (SELECT change_id, regexp_extract(body, '^Set (.*) limit from', 1) AS term FROM changes_t) c JOIN (SELECT entity_id, display_name AS name FROM entities_t UNION ALL SELECT entity_id, canonical_name FROM entities_t) n
        ON contains(name, term) OR contains(term, name) OR contains(replace(lower(name), '_', ''), replace(lower(term), '_', '')) OR contains(replace(lower(term), '_', ''), replace(lower(name), '_', ''))""", "changes", "entities"),
}
_NODES = """, all_nodes AS (SELECT artifact_id AS id, display_name, artifact_type AS kind FROM artifacts_t UNION ALL SELECT entity_id, display_name, entity_type FROM entities_t)"""
_GRAPH = "both_r AS (SELECT r.*, coalesce(ev.ids, []) AS ids FROM relations_t r LEFT JOIN (SELECT relation_id, list_sort(list(DISTINCT evidence_id)) AS ids FROM evidence_t GROUP BY 1) ev USING (relation_id) UNION ALL SELECT c.*, [] FROM calls_t c)"
_PRIORITIES = "(VALUES (1, 'must_review'), (2, 'should_review'), (3, 'may_review'), (4, 'hidden')) p(k, v)"
ORACLE_SQL |= {
    "flat_export": t.with_views("WITH " + _ALL + """, f AS (SELECT *, list_sort(evs)[1] AS first FROM merged) SELECT change_id, artifact_id, review_priority, CAST(len(evs) AS INTEGER) AS evidence_count, coalesce(file, '') AS file, coalesce(line_start, 0) AS line, coalesce(quote, '') AS quote
        FROM f LEFT JOIN evidence_t ON evidence_id = first""", *_INPUT),
    "markdown_export": t.with_views("WITH " + _ALL + _NODES + f""", x AS (SELECT change_id, artifact_id, unnest(evs) AS evidence_id FROM merged), ev_lines AS (SELECT change_id, artifact_id, string_agg('- `' || file || ':' || CAST(line_start AS VARCHAR) || '` ' || quote, chr(10) ORDER BY evidence_id) AS l FROM x JOIN evidence_t USING (evidence_id) GROUP BY 1, 2)
        SELECT m.change_id, CAST(k AS VARCHAR) || '.' || m.artifact_id AS place, CAST(length('## ' || display_name || ' (`' || m.artifact_id || '`)__- Priority: ' || review_priority || '_- Reason: ' || reason || '_- Paths: ' || array_to_string(paths, '; ') || '__' || coalesce(l, '- no evidence') || '_') AS INTEGER) AS n_chars
        FROM merged m JOIN all_nodes ON id = m.artifact_id JOIN {_PRIORITIES} ON v = review_priority LEFT JOIN ev_lines e ON e.change_id = m.change_id AND e.artifact_id = m.artifact_id
        UNION ALL SELECT change_id, '0', CAST(length('# Impact of ' || change_id || '__') + sum(length('- ' || v || ': ' || CAST(n AS VARCHAR) || '_')) AS INTEGER) FROM (SELECT change_id, v, count(*) FILTER (review_priority = v) AS n FROM merged, {_PRIORITIES} GROUP BY 1, 2) GROUP BY 1""", *_INPUT),
    "cypher_export": t.with_views("WITH " + _GRAPH + """ SELECT 1 AS part, artifact_id AS id, 'MERGE (n:Node:Artifact {id: ' || to_json(artifact_id) || '}) SET n.name=' || to_json(display_name) || ', n.type=' || to_json(artifact_type) || ';' AS statement FROM artifacts_t
        UNION ALL SELECT 2, entity_id, 'MERGE (n:Node:Entity {id: ' || to_json(entity_id) || '}) SET n.name=' || to_json(display_name) || ', n.type=' || to_json(entity_type) || ';' FROM entities_t
        UNION ALL SELECT 3, evidence_id, 'MERGE (e:Evidence {id: ' || to_json(evidence_id) || '}) SET e.file=' || to_json(file) || ', e.line_start=' || CAST(line_start AS VARCHAR) || ', e.line_end=' || CAST(line_end AS VARCHAR) || ';' FROM evidence_t
        UNION ALL SELECT 4, relation_id, 'MATCH (s:Node {id: ' || to_json(source_id) || '}), (t:Node {id: ' || to_json(target_id) || '}) MERGE (s)-[r:' || relation_type || ' {id: ' || to_json(relation_id) || '}]->(t) SET r.status=' || to_json(status) || ', r.layer=' || chr(39) || 'domain' || chr(39) || ';' FROM both_r
        UNION ALL SELECT 5, relation_id || '|' || e, 'MATCH (s:Node {id: ' || to_json(source_id) || '}), (e:Evidence {id: ' || to_json(e) || '}) MERGE (s)-[:HAS_EVIDENCE {relation_id: ' || to_json(relation_id) || '}]->(e);' FROM (SELECT *, unnest(ids) AS e FROM both_r)""", *_INPUT[:5]),
    "notes_export": t.with_views("WITH " + _GRAPH + _NODES + """, o AS (SELECT source_id AS id, string_agg('- `' || relation_type || '` -> [[' || target_id || ']] (`' || status || '`)', chr(10) ORDER BY '- `' || relation_type || '` -> [[' || target_id || ']] (`' || status || '`)') AS o FROM both_r GROUP BY 1),
        i AS (SELECT target_id AS id, string_agg('- [[' || source_id || ']] -> `' || relation_type || '` (`' || status || '`)', chr(10) ORDER BY '- [[' || source_id || ']] -> `' || relation_type || '` (`' || status || '`)') AS i FROM both_r GROUP BY 1)
        SELECT 'nodes/' || n.id || '.md' AS path, sha256('---' || chr(10) || 'id: ' || to_json(n.id) || chr(10) || 'type: ' || to_json(kind) || chr(10) || 'review_status: unreviewed' || chr(10) || '---' || chr(10) || chr(10) || '# ' || n.display_name || chr(10) || chr(10) || '## Outgoing Relations' || chr(10) || coalesce(o, '') || chr(10) || chr(10)
            || '## Incoming Relations' || chr(10) || coalesce(i, '') || chr(10) || chr(10) || '## Aliases' || chr(10) || coalesce(canonical_name, '') || chr(10)) AS content_hash FROM all_nodes n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id LEFT JOIN entities_t e ON e.entity_id = n.id
        UNION ALL SELECT 'evidence/' || evidence_id || '.md', sha256('# ' || evidence_id || chr(10) || chr(10) || '- File: `' || file || '`' || chr(10) || '- Lines: `' || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR) || '`' || chr(10) || '- Cell: ``' || chr(10) || chr(10) || '```text' || chr(10) || quote || chr(10) || '```' || chr(10)) FROM evidence_t""", *_INPUT[:5]),
}
_SEARCH = """WITH seeds AS (SELECT DISTINCT change_id, entity_id FROM (SELECT change_id, regexp_extract(body, '^Set (.*) limit from', 1) AS term FROM changes_t) c JOIN (SELECT entity_id, display_name AS name FROM entities_t UNION ALL SELECT entity_id, canonical_name FROM entities_t) n
        ON contains(name, term) OR contains(term, name) OR contains(replace(lower(name), '_', ''), replace(lower(term), '_', '')) OR contains(replace(lower(term), '_', ''), replace(lower(name), '_', ''))),
    edges AS (SELECT source_id, target_id, relation_type, CASE WHEN relation_type = 'MENTIONS' THEN 1 WHEN relation_type IN ('DEFINES', 'DISPLAYS', 'VALIDATES', 'REQUEST_FIELD', 'SENDS', 'COVERS') THEN 3 ELSE 2 END AS depth
        FROM (SELECT * FROM relations_t UNION ALL SELECT * FROM calls_t) WHERE status <> 'rejected' AND relation_type <> 'ASSERTS'),
    h1 AS (SELECT change_id, source_id AS node_id, bool_or(1 < depth) AS go FROM seeds JOIN edges ON target_id = entity_id GROUP BY 1, 2),
    h2 AS (SELECT change_id, source_id AS node_id, bool_or(2 < depth) AS go FROM h1 JOIN edges ON target_id = node_id WHERE go GROUP BY 1, 2),
    h3 AS (SELECT change_id, source_id AS node_id FROM h2 JOIN edges ON target_id = node_id WHERE go AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.change_id = h2.change_id AND h1.node_id = h2.node_id AND h1.go) GROUP BY 1, 2)
    SELECT change_id, node_id, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT change_id, node_id, 1 AS hops FROM h1 UNION ALL SELECT change_id, node_id, 2 FROM h2 UNION ALL SELECT change_id, node_id, 3 FROM h3) GROUP BY 1, 2"""
ORACLE_SQL["bounded_search"] = t.with_views(_SEARCH, "changes", "entities", "relations", "calls")
#: The same search with the ways: the best by seed and relations of each node and hop.
_WAYS = """WITH terms AS (SELECT change_id, regexp_extract(body, '^Set (.*) limit from', 1) AS term, regexp_extract(body, 'from ([0-9]+) to', 1) AS before FROM changes_t),
    seeds AS (SELECT DISTINCT change_id, entity_id FROM terms JOIN (SELECT entity_id, display_name AS name FROM entities_t UNION ALL SELECT entity_id, canonical_name FROM entities_t) n
        ON contains(name, term) OR contains(term, name) OR contains(replace(lower(name), '_', ''), replace(lower(term), '_', '')) OR contains(replace(lower(term), '_', ''), replace(lower(name), '_', ''))),
    """ + _GRAPH + """,
    edges AS (SELECT *, CASE WHEN relation_type = 'MENTIONS' THEN 1 WHEN relation_type IN ('DEFINES', 'DISPLAYS', 'VALIDATES', 'REQUEST_FIELD', 'SENDS', 'COVERS') THEN 3 ELSE 2 END AS depth FROM both_r WHERE status <> 'rejected' AND relation_type <> 'ASSERTS' AND {only}),
    w1 AS (SELECT change_id, source_id AS node_id, entity_id AS seed, [relation_id] AS way, 1 < depth AS go FROM seeds JOIN edges ON target_id = entity_id),
    b1 AS (SELECT change_id, node_id, arg_min(way, (seed, way)) AS way FROM w1 GROUP BY 1, 2), f1 AS (SELECT change_id, node_id, arg_min(seed, (seed, way)) AS seed, arg_min(way, (seed, way)) AS way FROM w1 WHERE go GROUP BY 1, 2),
    w2 AS (SELECT change_id, source_id AS node_id, seed, list_append(way, relation_id) AS way, 2 < depth AS go FROM f1 JOIN edges ON target_id = node_id),
    b2 AS (SELECT change_id, node_id, arg_min(way, (seed, way)) AS way FROM w2 GROUP BY 1, 2), f2 AS (SELECT change_id, node_id, arg_min(seed, (seed, way)) AS seed, arg_min(way, (seed, way)) AS way FROM w2 WHERE go AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.change_id = w2.change_id AND f1.node_id = w2.node_id) GROUP BY 1, 2),
    w3 AS (SELECT change_id, source_id AS node_id, seed, list_append(way, relation_id) AS way FROM f2 JOIN edges ON target_id = node_id), b3 AS (SELECT change_id, node_id, arg_min(way, (seed, way)) AS way FROM w3 GROUP BY 1, 2),
    found AS (SELECT *, 1 AS hops FROM b1 UNION ALL SELECT *, 2 FROM b2 WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.change_id = b2.change_id AND b1.node_id = b2.node_id)
        UNION ALL SELECT *, 3 FROM b3 WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.change_id = b3.change_id AND b1.node_id = b3.node_id) AND NOT EXISTS (SELECT 1 FROM b2 WHERE b2.change_id = b3.change_id AND b2.node_id = b3.node_id)),
    steps AS (SELECT f.change_id, f.node_id, f.hops, generate_subscripts(way, 1) AS i, unnest(way) AS relation_id FROM found f)"""
ORACLE_SQL["verified_impacts"] = t.with_views(_WAYS.replace("{only}", "true") + """,
    facts AS (SELECT change_id, node_id, min(hops) AS hops, bool_or(polarity = 'explicit') AS explicit, bool_and(polarity = 'inferred') AS inferred, list_distinct(flatten(list(ids))) AS evs FROM steps JOIN both_r USING (relation_id) GROUP BY 1, 2),
    q AS (SELECT f.change_id, node_id, evidence_id FROM (SELECT change_id, node_id, unnest(evs) AS evidence_id FROM facts) f), said AS (SELECT q.change_id, node_id, bool_or(contains(quote, term)) AS term, bool_or(contains(quote, before)) AS was FROM q JOIN evidence_t USING (evidence_id) JOIN terms ON terms.change_id = q.change_id GROUP BY 1, 2),
    v AS (SELECT f.*, CASE WHEN term IS NULL THEN 'hidden' WHEN explicit AND (term OR was) THEN 'must_review' WHEN inferred AND NOT term THEN 'may_review' WHEN explicit THEN 'should_review' ELSE 'may_review' END AS v FROM facts f JOIN artifacts_t ON artifact_id = f.node_id LEFT JOIN said s ON s.change_id = f.change_id AND s.node_id = f.node_id),
    w AS (SELECT *, CASE WHEN node_id LIKE '%3' THEN CASE v WHEN 'must_review' THEN 'should_review' WHEN 'should_review' THEN 'may_review' ELSE v END WHEN v = 'may_review' THEN 'should_review' ELSE v END AS p FROM v)
    SELECT change_id, node_id AS artifact_id, p AS review_priority, CAST(hops AS INTEGER) AS relation_distance, CASE WHEN explicit THEN 'explicit_relation' ELSE 'inferred_relation' END AS rule_assessment, CAST(len(evs) AS INTEGER) AS n_evidence FROM w WHERE p <> 'hidden'""", *_INPUT)
ORACLE_SQL["all_impact_report"] = ORACLE_SQL["impact_report"]
for _name in ("impact_report", "impact_trace", "bounded_search", "verified_impacts", "flat_export", "markdown_export"):
    ORACLE_SQL[_name] = t.for_shared(ORACLE_SQL[_name])
