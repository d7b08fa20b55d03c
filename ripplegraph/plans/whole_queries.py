"""First steps of the impact rules over the names that parts share, and two further views of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alias, impact, views
from . import extra_queries, impact_queries
from . import tables as t

def _changed(s: SparkSession, d: str) -> DataFrame:
    return impact.changed_entities(t.shared_changes(s, d), impact.names_of(t.shared_entities(s, d)))


def shared_changed_entities(s: SparkSession, d: str) -> DataFrame:
    """All parts of each name that a change gives."""
    return _changed(s, d)


def shared_impact_hop1(s: SparkSession, d: str) -> DataFrame:
    """Candidates one relation away from all parts of a name."""
    found, _ = impact.hop1(_changed(s, d), t.relations(s, d), t.artifacts(s, d))
    return found.select("change_id", "artifact_id", F.col("_seq").alias("relation_id"), "review_priority", "evidence_strength", "rule_assessment")


def all_semantic_candidates(s: SparkSession, d: str) -> DataFrame:
    """Artifacts reached from all orders through the evidence in them."""
    ev = t.evidence(s, d).withColumn("chunk_id", F.col("source_location.file")).withColumn("supports", F.array(F.struct(F.lit("relation").alias("type"), F.col("relation_id").alias("id"))))
    top = t.raw(s, d, "orders").select(F.lit("c").alias("change_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    c = impact.semantic_candidates(top, ev, t.relations(s, d), t.artifacts(s, d))
    return c.groupBy("change_id", "artifact_id").agg(F.count_distinct(F.element_at("evidence_ids", 1)).alias("n_evidence"))


def all_inspected_artifacts(s: SparkSession, d: str) -> DataFrame:
    """Artifacts of all customers' names, among the names of artifacts and entities."""
    a = t.artifacts(s, d)
    w = t.raw(s, d, "customer").select(F.col("c_name").alias("name"))
    return views.inspect(a, w, alias.name_index(a, t.entities(s, d)), "artifact_id").select("name", "artifact_id", "artifact_type")


QUERIES = {f.__name__: f for f in (shared_changed_entities, shared_impact_hop1, all_semantic_candidates, all_inspected_artifacts)}

ORACLE_SQL = {f"shared_{n}": t.for_shared(impact_queries.ORACLE_SQL[n]) for n in ("changed_entities", "impact_hop1")}
ORACLE_SQL["all_semantic_candidates"] = extra_queries.ORACLE_SQL["semantic_candidates"]
ORACLE_SQL["all_inspected_artifacts"] = extra_queries.ORACLE_SQL["inspected_artifacts"]
