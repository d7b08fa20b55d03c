"""Text to structure: sections, chunks, artifacts, relations and evidence of Markdown documents.

Documents are exploded into lines once; one window per document, ordered by line, carries the current
artifact and the current relation type forward, and serves sections, chunks and relations alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SPACE, lines_of, short_hash, slug, sorted_union, strip

# Artifact types and the prefixes of their ids.
TYPES = {"api": "API", "screen": "Screen", "table": "Table", "column": "Column", "validationrule": "ValidationRule", "externalif": "ExternalIF", "testcase": "TestCase", "batch": "Batch", "document": "Document"}
PREFIXES = {"API": "api", "Screen": "screen", "Table": "table", "Column": "column", "ValidationRule": "validation", "ExternalIF": "external_if", "TestCase": "test", "Batch": "batch", "Document": "document"}
# Headings that open a relation type, English and Japanese.
HEADINGS = {
    "REQUEST_FIELD": ("request fields", "input items", "input fields", "inputs", "api parameters", "request parameters", "req fields", "入力項目", "リクエスト項目", "リクエストパラメータ"),
    "RESPONSE_FIELD": ("response fields", "output items", "output fields", "outputs", "response parameters", "レスポンス項目", "応答項目", "出力項目"),
    "DEFINES": ("fields", "items", "画面項目", "表示項目", "項目"),
    "READS": ("reads", "uses", "read tables", "参照", "参照テーブル"),
    "WRITES": ("writes", "write tables", "更新", "更新テーブル", "登録テーブル"),
    "DISPLAYS": ("displays", "shows", "表示"),
    "VALIDATES": ("validates", "target", "validation", "checks", "チェック", "入力チェック"),
    "SENDS": ("sends", "send fields", "送信", "送信項目"),
    "RECEIVES": ("receives", "receive fields", "受信", "受信項目"),
    "CALLS": ("calls", "dependencies", "call api", "呼び出し", "呼出", "連携先"),
    "COVERS": ("covers", "coverage", "対象", "確認対象"),
    "ASSERTS": ("asserts", "expectations", "期待結果", "検証内容"),
}
FIELD_RELATIONS = ("REQUEST_FIELD", "RESPONSE_FIELD", "DEFINES", "READS", "DISPLAYS", "VALIDATES", "SENDS", "RECEIVES", "ASSERTS")
EVIDENCE_TYPES = {
    "REQUEST_FIELD": "api_request_definition",
    "RESPONSE_FIELD": "api_response_definition",
    "DEFINES": "explicit_field_definition",
    "DISPLAYS": "screen_display_definition",
    "VALIDATES": "validation_rule_definition",
    "SENDS": "external_mapping_definition",
    "RECEIVES": "external_mapping_definition",
    "COVERS": "test_coverage_definition",
}
NAMED = rf"(?i)^(API|Screen|Table|Column|ValidationRule|ExternalIF|TestCase|Batch|Document)[{SPACE}]*:[{SPACE}]*(.+)$"
INLINE = rf"^([^:：]{{1,80}})[:：][{SPACE}]*(.+)$"
HEADING = rf"^(#{{1,6}})[{SPACE}]+(.+)$"


def documents(texts: DataFrame) -> DataFrame:
    """(source_key, path, text) to document rows: title is the first non-blank line without its marks."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    first = F.element_at(F.filter(lines_of(F.col("text")), lambda s: strip(s) != ""), 1)
    return texts.select(
        F.concat(F.lit("doc."), slug(stem), F.lit("."), F.substring(F.sha1(F.col("source_key").cast("binary")), 1, 8)).alias("document_id"),
        "path",
        F.coalesce(strip(F.regexp_replace(first, "^[# ]+", "")), stem).alias("title"),
        F.lit("markdown").alias("document_type"),
        F.sha2(F.col("text"), 256).alias("hash"),
        "text",
    )


def lines(docs: DataFrame) -> DataFrame:
    """(document_id, line, raw): lines from 1; the one shuffle of the extraction follows."""
    return docs.select("document_id", F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("_p", "raw")).select("document_id", (F.col("_p") + 1).alias("line"), "raw")


def sections(docs: DataFrame) -> DataFrame:
    """Every heading opens a section up to the line before the next; documents without one have a section "Document"."""
    size = docs.select("document_id", F.greatest(F.size(lines_of(F.coalesce("text", F.lit("")))), F.lit(1)).alias("n"))
    heads = lines(docs).where(F.col("raw").rlike(HEADING))
    w = Window.partitionBy("document_id").orderBy("line")
    h = heads.select(
        "document_id",
        "line",
        F.length(F.regexp_extract("raw", HEADING, 1)).alias("level"),
        strip(F.regexp_extract("raw", HEADING, 2)).alias("heading"),
        F.lead("line").over(w).alias("_next"),
        F.row_number().over(w).alias("_i"),
    )
    j = size.join(h, "document_id", "left")
    return j.select(
        F.concat(F.lit("sec."), "document_id", F.lit("."), F.lpad(F.coalesce("_i", F.lit(1)).cast("string"), 3, "0")).alias("section_id"),
        "document_id", F.coalesce("heading", F.lit("Document")).alias("heading"), F.coalesce("level", F.lit(1)).alias("level"),
        F.coalesce("line", F.lit(1)).cast("int").alias("line_start"), F.when(F.col("line").isNull(), F.col("n")).otherwise(F.coalesce(F.col("_next") - 1, F.col("n"))).cast("int").alias("line_end"),
    )


def chunks(docs: DataFrame, secs: DataFrame) -> DataFrame:
    """The stripped text of each section, sliced from the document's line array."""
    j = secs.join(docs.select("document_id", lines_of(F.coalesce("text", F.lit(""))).alias("_l")), "document_id")
    text = strip(F.array_join(F.slice("_l", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))
    return j.select(F.regexp_replace("section_id", "^sec", "chunk").alias("chunk_id"), "document_id", "section_id", text.alias("text"), "line_start", "line_end")


def relation_type_for_heading(text: Column) -> Column:
    """Relation type of a heading; white space collapsed, case folded; null if it is none."""
    pairs = [x for kind, names in HEADINGS.items() for name in names for x in (F.lit(name), F.lit(kind))]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_replace(strip(text), f"[{SPACE}]+", " ")))


def named_type(text: Column) -> Column:
    """T4: artifact type of a heading `Type: name`, else null."""
    pairs = [x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(text, NAMED, 1)))


def named_name(text: Column) -> Column:
    return strip(F.regexp_extract(text, NAMED, 2))


def roots(docs: DataFrame) -> DataFrame:
    """T5: (document_id, root_type, root_name): artifact that a document as a whole describes, if any."""
    ls = lines_of(F.coalesce("text", F.lit("")))
    head = F.element_at(F.filter(ls, lambda s: s.startswith("#")), 1)
    d = docs.select("document_id", strip(F.regexp_replace(head, "^[# ]+", "")).alias("title"), F.lower("text").alias("low"))
    low = F.lower("title")
    kind = (
        F.when(F.col("title").isNull() | (F.col("title") == ""), None)
        .when(low.rlike("^(" + "|".join(TYPES) + "):"), named_type(F.col("title")))
        .when(F.col("low").contains("## endpoint") | low.endswith("api"), "API")
        .when(F.col("low").contains("## displays") | F.col("low").contains("## fields"), "Screen")
        .when(low.startswith("batch"), "Batch")
    )
    typed = low.rlike("^(" + "|".join(TYPES) + "):")
    return d.withColumn("root_type", kind).where("root_type is not null").select("document_id", "root_type", F.when(typed, named_name(F.col("title"))).otherwise(F.col("title")).alias("root_name"))


def scan(docs: DataFrame) -> DataFrame:
    """(document_id, line, raw, source_type, source_name, relation_type, value): one row per value that a bullet or inline line gives.

    A named heading sets the artifact (and DEFINES for tables); another heading sets the relation type,
    and without one goes back to the document's root; a bare `key:` line ends the relation type.
    """
    root = roots(docs)
    l = lines(docs).withColumn("t", strip(F.col("raw")))
    head = F.when(F.col("t").rlike(HEADING), strip(F.regexp_extract("t", HEADING, 2)))
    l = l.withColumn("head", head).withColumn("named", named_type(F.col("head"))).withColumn("by_head", relation_type_for_heading(F.col("head")))
    inline = F.when(F.col("head").isNull() & F.col("t").rlike(INLINE), relation_type_for_heading(F.regexp_extract("t", INLINE, 1)))
    l = l.withColumn("inline", inline).join(root, "document_id", "left")
    ends = F.col("head").isNull() & F.col("inline").isNull() & F.col("t").endswith(":")
    # what a line sets: an artifact (type, name) and a relation type ('' ends it); null leaves it
    to_root = F.col("head").isNotNull() & F.col("by_head").isNull() & F.col("root_type").isNotNull()
    artifact = F.when(F.col("named").isNotNull(), F.struct(F.col("named").alias("type"), named_name(F.col("head")).alias("name"))).when(to_root, F.struct(F.col("root_type").alias("type"), F.col("root_name").alias("name")))
    relation = F.when(F.col("named") == "Table", "DEFINES").when(F.col("named").isNotNull(), "").when(F.col("head").isNotNull(), F.coalesce("by_head", F.lit(""))).when(F.col("inline").isNotNull(), F.col("inline")).when(ends, "")
    w = Window.partitionBy("document_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("_a", artifact).withColumn("_r", relation)
    l = l.withColumn("cur", F.coalesce(F.last("_a", True).over(w), F.when(F.col("root_type").isNotNull(), F.struct(F.col("root_type").alias("type"), F.col("root_name").alias("name"))))).withColumn("rel", F.last("_r", True).over(w))
    bullet = F.col("head").isNull() & F.col("inline").isNull() & ~ends & F.col("t").startswith("- ") & (F.coalesce("rel", F.lit("")) != "")
    values = F.when(F.col("inline").isNotNull(), F.filter(F.transform(F.split(F.regexp_extract("t", INLINE, 2), "[,/]"), strip), lambda v: v != "")).when(bullet, F.array(strip(F.col("t").substr(F.lit(3), F.length("t")))))
    out = l.where("cur is not null").withColumn("v", F.explode(values)).where("v <> ''")
    kind = F.when((F.col("cur.type") == "Screen") & (F.col("rel") == "DEFINES"), "DISPLAYS").otherwise(F.col("rel"))
    column = (F.col("cur.type") == "Table") & (F.col("rel") == "DEFINES") & F.col("inline").isNull()
    full = F.concat("cur.name", F.lit("."), field_name(F.col("v")))
    return out.select(
        "document_id", "line", "raw", F.when(column, "Column").otherwise(F.col("cur.type")).alias("source_type"), F.when(column, full).otherwise(F.col("cur.name")).alias("source_name"),
        kind.alias("relation_type"), F.when(column, full).otherwise(F.col("v")).alias("value"), column.alias("is_column"),
    )


def field_name(value: Column) -> Column:
    """Name of a field in a bullet: what stands before a colon or full stop."""
    return strip(F.substring_index(strip(F.substring_index(value, ":", 1)), "。", 1))


def catalog_names(aliases: DataFrame) -> DataFrame:
    """(name, item_id, canonical_type, seq): every name of the catalog's entries, their ids included; no type is null."""
    kind = F.when(F.col("canonical_type") != "", F.col("canonical_type")).alias("canonical_type")
    own = aliases.groupBy("item_id", "canonical_type").agg(F.min("seq").alias("seq")).select(F.col("item_id").alias("name"), "item_id", kind, "seq")
    return aliases.select(F.col("alias").alias("name"), "item_id", kind, "seq").unionByName(own)


def catalog_ids(df: DataFrame, name: str, kind: str, names: DataFrame, out: str) -> DataFrame:
    """df with `out`: the first entry (by `seq`) of that name whose type is that of `kind` or not given; null if there is none."""
    first = names.groupBy(F.col("name").alias("_n"), F.col("canonical_type").alias("_k")).agg(F.min(F.struct("seq", "item_id")).alias("_e"))
    typed = first.where("_k is not null")
    free = first.where("_k is null").select("_n", F.col("_e").alias("_f"))
    j = df.join(typed, (F.col(name) == F.col("_n")) & (F.col(kind) == F.col("_k")), "left").drop("_n", "_k").join(free, F.col(name) == F.col("_n"), "left")
    return j.withColumn(out, F.least("_e", "_f")["item_id"]).drop("_n", "_e", "_f")


def with_ids(df: DataFrame, name: str, kind: str, aliases: DataFrame | None, out: str, prefix: Column) -> DataFrame:
    """Ids of names: the catalog's id of that name and type, else prefix.slug.

    A business field that the catalog knows only as a column takes the id of the field named like the column's leaf.
    """
    plain = F.concat(prefix, F.lit("."), slug(F.col(name)))
    if aliases is None:
        return df.withColumn(out, plain)
    names = catalog_names(aliases)
    j = catalog_ids(df, name, kind, names, "_id")
    j = catalog_ids(j.withColumn("_column", F.lit("Column")), name, "_column", names, "_as_column")
    j = catalog_ids(j.withColumn("_leaf", F.substring_index(name, ".", -1)).withColumn("_field", F.lit("BusinessField")), "_leaf", "_field", names, "_by_leaf")
    leaf = F.when((F.col(kind) == "BusinessField") & F.col("_as_column").isNotNull(), F.col("_by_leaf"))
    return j.withColumn(out, F.coalesce("_id", leaf, plain)).drop("_id", "_column", "_as_column", "_leaf", "_field", "_by_leaf")


def targets(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Type and name of each target.

    READS of an upper-case name is a table, field relations are business fields; other targets have the type of the
    catalog's first entry of that name (a type that is no artifact's is a document), else WRITES tables and the rest documents.
    """
    table = (F.col("relation_type") == "READS") & F.col("value").rlike("^[A-Z][A-Z0-9_]*$")
    field = F.col("relation_type").isin(*FIELD_RELATIONS)
    known = F.lit(None).cast("string")
    if aliases is not None:
        first = catalog_names(aliases).groupBy(F.col("name").alias("_n")).agg(F.min_by("canonical_type", F.struct("seq", "item_id")).alias("_known"))
        rows = rows.join(first, F.col("value") == F.col("_n"), "left").drop("_n")
        known = F.when(F.col("_known").isNull() | F.col("_known").isin(*PREFIXES), F.col("_known")).otherwise("Document")
    other = F.coalesce(known, F.when(F.col("relation_type") == "WRITES", "Table").otherwise("Document"))
    kind = F.when(table, "Table").when(field, "BusinessField").otherwise(other)
    out = rows.withColumn("target_type", kind).withColumn("target_name", F.when(kind == "BusinessField", field_name(F.col("value"))).otherwise(F.col("value")))
    return out.drop("_known")


def prefix_of(kind: Column) -> Column:
    pairs = [x for k, v in {**PREFIXES, "BusinessField": "entity"}.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), kind)


def relations_of(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Relation and evidence ids of scanned rows, hashed over source, type, target, document, line and quote."""
    r = targets(rows, aliases)
    r = with_ids(r, "source_name", "source_type", aliases, "source_id", prefix_of(F.col("source_type")))
    r = with_ids(r, "target_name", "target_type", aliases, "target_id", prefix_of(F.col("target_type")))
    quote = strip(F.col("raw"))
    key = short_hash(F.concat_ws("|", "source_id", "relation_type", "target_id", "document_id", F.col("line").cast("string"), quote))
    kinds = F.create_map(*[x for k, v in EVIDENCE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return r.select(
        F.concat(F.lit("rel."), slug(F.col("source_id")), F.lit("."), F.lower("relation_type"), F.lit("."), slug(F.col("target_id")), F.lit("."), key).alias("relation_id"),
        F.concat(F.lit("ev."), key).alias("evidence_id"), "document_id", "line", "source_type", "source_name", "source_id", "relation_type", "target_type", "target_name", "target_id", quote.alias("quote"),
        F.when(F.col("is_column"), "db_column_definition").otherwise(F.coalesce(F.element_at(kinds, F.col("relation_type")), F.lit("plain_mention"))).alias("evidence_type"), F.lit("exact").alias("match_type"),
    )


def with_chunk(rows: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """The chunk that holds each line (document_id, line): an interval join within the document."""
    c = chunk_rows.select(F.col("document_id").alias("_d"), "chunk_id", "section_id", F.col("line_start").alias("_a"), F.col("line_end").alias("_b"))
    return rows.join(c, (F.col("document_id") == F.col("_d")) & F.col("line").between(F.col("_a"), F.col("_b")), "left").drop("_d", "_a", "_b")


def plain_mentions(chunk_rows: DataFrame, sources: DataFrame, aliases: DataFrame, existing: DataFrame, named_documents: DataFrame) -> DataFrame:
    """In documents without a named artifact, the first alias of each business field found in a chunk, for new pairs.

    sources: document_id, source_id of the document's artifact; existing: source_id, target_id.
    Aliases meet chunks by their first two characters, so neither side need be small; texts come back only for those.
    """
    c = chunk_rows.join(named_documents.select("document_id").distinct(), "document_id", "left_anti").join(sources.select("document_id", "source_id"), "document_id")
    fields = aliases.where("canonical_type = 'BusinessField' and alias <> ''").withColumn("gram", F.substring("alias", 1, 2))
    grams = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1)), F.regexp_extract_all("text", F.lit("(?s)(?=(.{2}))"), F.lit(1))))
    maybe = c.select("chunk_id", F.explode(grams).alias("gram")).join(fields, "gram").drop("gram")
    hit = maybe.join(c, "chunk_id").where(F.col("text").contains(F.col("alias")))
    first = hit.groupBy("document_id", "source_id", "item_id").agg(F.min_by(F.struct("alias", "chunk_id", "section_id", "line_start"), F.struct("seq", "line_start")).alias("m"))
    out = first.select("document_id", "source_id", F.col("item_id").alias("target_id"), "m.*", F.lit("MENTIONS").alias("relation_type"), F.lit("alias").alias("match_type"), F.lit("plain_mention").alias("evidence_type"))
    return out.join(existing.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")


def dedupe_relations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One relation per document, source, type and target: the first line's id, all evidence; and (old_id, relation_id) for supports."""
    keys = ["document_id", "source_id", "relation_type", "target_id"]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct("relation_id", "match_type"), F.struct("line", "relation_id")).alias("f"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.collect_set("relation_id").alias("_ids"))
    out = g.select("f.relation_id", *keys, "evidence_ids", "f.match_type")
    return out, g.select(F.explode("_ids").alias("old_id"), F.col("f.relation_id").alias("relation_id"))


def supports(rows: DataFrame, renamed: DataFrame) -> DataFrame:
    """Evidence rows with two supports; relation ids are those kept."""
    j = rows.join(renamed.withColumnRenamed("relation_id", "_keep"), F.col("relation_id") == F.col("old_id"), "left")
    target = F.struct(F.when(F.col("target_type") == "BusinessField", "entity").otherwise("artifact").alias("type"), F.col("target_id").alias("id"))
    relation = F.struct(F.lit("relation").alias("type"), F.coalesce("_keep", "relation_id").alias("id"))
    return j.select("evidence_id", "document_id", "line", "quote", "evidence_type", F.array(target, relation).alias("supports")).dropDuplicates(["evidence_id"])


def alias_suggestions(nodes: DataFrame, id_col: str) -> DataFrame:
    """Display names that are not among a node's aliases."""
    return nodes.where(~F.array_contains(F.coalesce("aliases", F.array().cast("array<string>")), F.col("display_name"))).select(F.col(id_col).alias("item_id"), F.col("display_name").alias("alias"))


def unresolved_mentions(text: Column) -> Column:
    """Sorted set of references that name no target."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("同上|上記と同じ|別紙参照"), F.lit(0))))


def nodes_of(rows: DataFrame, end: str) -> DataFrame:
    """Artifact or entity rows named by scanned relations (end is source or target)."""
    g = rows.groupBy(F.col(f"{end}_id").alias("node_id"), F.col(f"{end}_type").alias("node_type")).agg(F.min_by(f"{end}_name", F.struct("document_id", "line")).alias("display_name"), sorted_union(F.array("document_id")).alias("source_document_ids"))
    return g
