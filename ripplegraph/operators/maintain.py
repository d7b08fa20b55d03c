"""Keeping an evidence graph: replace by document, de-duplicate, merge, check, diff.

Tables whose order decides carry an integer `seq`; a larger one came later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sorted_union

RELATION_TYPES = ("DEFINES", "DISPLAYS", "VALIDATES", "REQUEST_FIELD", "RESPONSE_FIELD", "READS", "WRITES", "SENDS", "RECEIVES", "CALLS", "COVERS", "ASSERTS", "MENTIONS")
STATUSES = ("unconfirmed", "confirmed", "rejected")
POLARITIES = ("explicit", "inferred")


def replace_by_document(current: DataFrame, incoming: DataFrame, replaced: DataFrame, key: str = "document_id") -> DataFrame:
    """G1: rows of replaced documents (a table of ids) go, the new rows come."""
    return current.join(replaced.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def unique_last(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key, the last by seq. A max over a struct combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    best = df.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("r")) if _ordered(df, rest) else None
    if best is None:
        order = Window.partitionBy(*keys).orderBy(F.desc(seq))
        return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return best.select(*keys, F.col(f"r.{seq}").alias(seq), *[F.col(f"r.{c}").alias(c) for c in rest]).select(df.columns)


def _ordered(df: DataFrame, columns: list[str]) -> bool:
    return not any("map<" in t for c, t in df.dtypes if c in columns)


def without_sources(df: DataFrame, gone: DataFrame, column: str = "source_document_ids", key: str = "document_id") -> DataFrame:
    """Take replaced sources out of the source arrays and drop rows that have none left.

    The removed ids meet the exploded array by a join, so the list of them may be of any size.
    """
    ids = gone.select(F.col(key).alias("_src")).distinct()
    rest = [c for c in df.columns if c != column]
    long = df.withColumn("_row", F.struct(*rest)).select("_row", F.posexplode(column).alias("_pos", "_src"))
    kept = long.join(ids, "_src", "left_anti")
    packed = kept.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_src"))).alias("_s"))
    return packed.select("_row.*", F.transform("_s", lambda s: s["_src"]).alias(column)).select(df.columns)


def merge_nodes(df: DataFrame, key: str, scalars: list[str], arrays: tuple[str, ...] = ("aliases", "source_document_ids", "extraction_methods"), seq: str = "seq") -> DataFrame:
    """Rows of one node become one: scalars of the first, sorted unions of the arrays; single rows stay as they are."""
    first = F.min_by(F.struct(*scalars, *arrays), seq).alias("f")
    many = [sorted_union(F.col(a)).alias(a) for a in arrays]
    g = df.groupBy(key).agg(first, F.count("*").alias("n"), *many)
    return g.select(key, *[F.col(f"f.{c}").alias(c) for c in scalars], *[F.when(F.col("n") == 1, F.col(f"f.{a}")).otherwise(F.col(a)).alias(a) for a in arrays])


def merge_relations(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Relations of one id become one: evidence and sources united, the rest from the first."""
    return merge_nodes(df, "relation_id", [c for c in df.columns if c not in ("relation_id", "evidence_ids", "source_document_ids", seq)], ("evidence_ids", "source_document_ids"), seq)


def carry_status(incoming: DataFrame, prior: DataFrame, stale_documents: DataFrame) -> DataFrame:
    """Keep the reviewed status of a relation over a new load; back to unconfirmed if one of its sources changed."""
    old = prior.select("relation_id", F.col("status").alias("_old"))
    hit = (
        incoming.select("relation_id", F.explode("source_document_ids").alias("document_id"))
        .join(stale_documents.select("document_id").distinct(), "document_id", "left_semi")
        .select("relation_id", F.lit(True).alias("_stale"))
        .distinct()
    )
    out = incoming.join(old, "relation_id", "left").join(hit, "relation_id", "left")
    status = F.when(F.col("_stale"), F.lit("unconfirmed")).otherwise(F.coalesce("_old", "status"))
    return out.withColumn("status", status).select(incoming.columns)


def prune_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk still exists."""
    return embeddings.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def document_collisions(documents: DataFrame) -> DataFrame:
    """Document ids that stand for more than one path."""
    return documents.groupBy("document_id").agg(F.count_distinct("path").alias("paths")).where("paths > 1")


def check_contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Df plus `violations`, the names of the rules that do not hold (null counts as failing)."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("violations", found)


def relation_rules() -> dict[str, Column]:
    """Contract of a relation row."""
    present = {f"{c} is required": F.col(c).isNotNull() & (F.col(c) != "") for c in ("relation_id", "relation_type", "source_id", "target_id")}
    return present | {
        "relation_type is unknown": F.col("relation_type").isin(*RELATION_TYPES),
        "polarity is unknown": F.col("polarity").isin(*POLARITIES),
        "status is unknown": F.col("status").isin(*STATUSES),
    }


def evidence_rules() -> dict[str, Column]:
    """Contract of an evidence row."""
    at = F.col("source_location")
    return {
        "evidence_id is required": F.col("evidence_id").isNotNull() & (F.col("evidence_id") != ""),
        "quote is required": F.col("quote").isNotNull() & (F.col("quote") != ""),
        "line_start is under 1": at["line_start"] >= 1,
        "line_end is under 1": at["line_end"] >= 1,
    }


def relation_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(relation_id, change) of relations that came or went since a baseline."""
    a, b = current.select("relation_id").distinct(), baseline.select("relation_id").distinct()
    added = a.join(b, "relation_id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(b.join(a, "relation_id", "left_anti").withColumn("change", F.lit("removed")))


def set_status(relations: DataFrame, decisions: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Apply (relation_id, status) decisions, the last of an id wins; also the decisions on unknown ids."""
    last = unique_last(decisions.select("relation_id", F.col("status").alias("_new"), seq), ["relation_id"], seq).drop(seq)
    out = relations.join(last, "relation_id", "left").withColumn("status", F.coalesce("_new", "status")).select(relations.columns)
    return out, decisions.join(relations.select("relation_id"), "relation_id", "left_anti")


def replace_rows(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that come in are replaced."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def document_manifest_gap(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(root_id, document_id) of documents that a root had at its last load and has no more.

    Only roots that take part in the current load are compared.
    """
    roots = current.select("root_id").distinct()
    return previous.join(roots, "root_id", "left_semi").join(current, ["root_id", "document_id"], "left_anti").select("root_id", "document_id").distinct()
