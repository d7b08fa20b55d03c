"""Explicit schemas of the collections; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "a": TEXTS, "b": T.BooleanType(), "d": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, _, kind in (x.partition(":") for x in spec.split())])


LOCATION = _struct("file:s line_start:i line_end:i")
SUPPORT = _struct("type:s id:s")
STYLE = _struct("fill_color:s font_bold:b border:b number_format:s horizontal:s vertical:s")

DOCUMENTS = _struct("document_id:s path:s title:s document_type:s hash:s loaded_at:s")
SECTIONS = _struct("section_id:s document_id:s heading:s level:i line_start:i line_end:i")
CHUNKS = _struct("chunk_id:s document_id:s section_id:s text:s line_start:i line_end:i")
ARTIFACTS = _struct("artifact_id:s artifact_type:s display_name:s aliases:a source_document_ids:a extraction_methods:a")
ENTITIES = _struct("entity_id:s entity_type:s display_name:s canonical_name:s aliases:a source_document_ids:a extraction_methods:a")
RELATIONS = _struct("relation_id:s relation_type:s source_id:s target_id:s evidence_ids:a extraction_method:s polarity:s status:s match_type:s source_document_ids:a")
EVIDENCE = (
    _struct("evidence_id:s document_id:s section_id:s chunk_id:s quote:s evidence_type:s")
    .add("supports", T.ArrayType(SUPPORT))
    .add("source_location", LOCATION)
)
CHANGES = _struct("change_id:s title:s path:s body:s")
ATOMS = _struct("atom_id:s change_id:s target_terms:a operation:s property:s before:s after:s")
DECISIONS = _struct("impact_id:s change_id:s candidate_node_id:s status:s reason:s updated_at:s")
EMBEDDINGS = _struct("chunk_id:s content_hash:s provider:s model:s vector:d created_at:s")
CELLS = (
    _struct("workbook_id:s file_path:s sheet_id:s sheet_name:s cell:s evidence_id:s value:s data_type:s row:i column:i merged_range:s")
    .add("style", STYLE)
    .add("hyperlink", T.StringType())
    .add("comment", T.StringType())
    .add("is_hidden_row", T.BooleanType())
    .add("is_hidden_col", T.BooleanType())
)
ALIASES = _struct("item_id:s canonical_type:s alias:s")
COLLECTIONS = {
    "documents": DOCUMENTS,
    "sections": SECTIONS,
    "chunks": CHUNKS,
    "artifacts": ARTIFACTS,
    "entities": ENTITIES,
    "relations": RELATIONS,
    "evidence": EVIDENCE,
    "change_atoms": ATOMS,
    "impact_decisions": DECISIONS,
    "embeddings": EMBEDDINGS,
    "cells": CELLS,
    "aliases": ALIASES,
}
