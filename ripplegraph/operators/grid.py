"""Cell grids: sheet and region classification, region detection, headers, rows, proposals.

All work is by sheet: two gaps-and-islands passes find regions, an equi-join on the sheet with a
range condition finds their cells, and rows become maps from header to value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import column_letter, holds_any, lines_of, short_hash, slug, strip
from .markdown import field_name, unresolved_mentions, with_ids

# Header signatures (every group needs a hit), then keywords, in this order.
SIGNATURES = (
    ("external_interface", (("外部if", "if名", "interface name"), ("項目名", "物理名", "送信", "受信"))),
    ("db_mapping", (("テーブル名", "table name", "db定義"), ("カラム名", "column name"))),
    ("api_mapping", (("api id", "api名", "endpoint"), ("request", "response", "リクエスト", "レスポンス"))),
    ("validation_rule", (("チェックid", "入力チェック", "validationrule"), ("対象項目", "条件", "エラーメッセージ"))),
    ("test_case", (("テストケースid", "test case id"), ("期待結果", "expected result"))),
    ("screen_item_definition", (("画面id", "screen id"), ("項目名", "field name"), ("入力可否", "表示有無"))),
)
KEYWORDS = (
    ("screen_item_definition", ("画面", "項目名", "入力可否", "screen")),
    ("validation_rule", ("入力チェック", "チェック", "validationrule", "必須", "上限")),
    ("api_mapping", ("api", "リクエスト", "レスポンス", "endpoint", "request")),
    ("db_mapping", ("テーブル", "db", "カラム", "column", "table")),
    ("external_interface", ("外部if", "if名", "送信", "受信", "interface")),
    ("test_case", ("試験", "テスト", "期待結果", "境界値", "test")),
    ("glossary", ("用語", "glossary")),
    ("revision_history", ("改訂", "履歴", "revision")),
)
# Relation and node types of proposals.
RELATION_MAP = {"contains": "DEFINES", "displays": "DISPLAYS", "accepts_input": "DISPLAYS", "validates": "VALIDATES", "calls": "CALLS", "reads": "READS", "writes": "WRITES", "maps_to": "REQUEST_FIELD", "sends": "SENDS", "receives": "RECEIVES", "tested_by": "COVERS", "depends_on": "CALLS", "same_as": "MENTIONS", "may_affect": "MENTIONS"}
NODE_TYPES = {"Screen": "Screen", "ValidationRule": "ValidationRule", "API": "API", "DBTable": "Table", "DBColumn": "Column", "ExternalIF": "ExternalIF", "BatchJob": "Batch", "TestCase": "TestCase", "BusinessRule": "Document", "DocumentSection": "Document", "ScreenField": "BusinessField", "APIField": "BusinessField"}
PREFIX = {"Screen": "screen", "ValidationRule": "validation", "API": "api", "Table": "table", "Column": "column", "ExternalIF": "external_if", "Batch": "batch", "TestCase": "test", "Document": "document", "BusinessField": "entity"}


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def has_value() -> Column:
    return F.col("value").isNotNull() & (F.col("value") != "")


def layout_cell() -> Column:
    """Cells that count for the layout: any value, merge, border, fill, comment or link."""
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return has_value() | set_("merged_range") | F.coalesce(F.col("style.border"), F.lit(False)) | set_("style.fill_color") | set_("comment") | set_("hyperlink")


def sheet_type(text: Column) -> Column:
    """Type of a sheet's text: the first complete signature, else most keyword hits (first of equals)."""
    low = F.lower(text)
    hits = [F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))) for _, words in KEYWORDS]
    best = F.greatest(*hits)
    by_words = F.when(best == 0, "unknown")
    for (name, _), n in zip(KEYWORDS, hits, strict=True):
        by_words = by_words.when(n == best, name)
    out = None
    for name, groups in SIGNATURES:
        full = F.lit(True)
        for words in groups:
            full = full & holds_any(low, words)
        out = F.when(full, name) if out is None else out.when(full, name)
    return out.otherwise(by_words)


def classify_sheets(cells: DataFrame, first: int = 80) -> DataFrame:
    """(sheet_id, sheet_name, sheet_type) from the sheet name and the first values in reading order."""
    order = Window.partitionBy("sheet_id").orderBy("row", "column")
    v = cells.where(has_value()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first)
    text = v.groupBy("sheet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda s: s["value"]), " ").alias("t"))
    sheets = cells.groupBy("sheet_id").agg(F.first("sheet_name").alias("sheet_name"), F.first("workbook_id").alias("workbook_id"))
    return sheets.join(text, "sheet_id", "left").select("workbook_id", "sheet_id", "sheet_name", sheet_type(F.concat_ws(" ", "sheet_name", "t")).alias("sheet_type"))


def region_bounds(cells: DataFrame) -> DataFrame:
    """(sheet_id, idx, start_row, end_row, start_column, end_column): blocks of adjacent rows, and in each of adjacent columns."""
    c = cells.where(layout_cell()).select("sheet_id", "row", "column").distinct()
    island = lambda by, of: F.when(F.col(of) <= F.lag(of).over(Window.partitionBy(*by).orderBy(of)) + 1, 0).otherwise(1)
    rows = c.select("sheet_id", "row").distinct().withColumn("_new", island(["sheet_id"], "row"))
    rows = rows.select("sheet_id", "row", F.sum("_new").over(Window.partitionBy("sheet_id").orderBy("row")).alias("rb"))
    c = c.join(rows, ["sheet_id", "row"])
    cols = c.select("sheet_id", "rb", "column").distinct().withColumn("_new", island(["sheet_id", "rb"], "column"))
    cols = cols.select("sheet_id", "rb", "column", F.sum("_new").over(Window.partitionBy("sheet_id", "rb").orderBy("column")).alias("cb"))
    b = c.join(cols, ["sheet_id", "rb", "column"]).groupBy("sheet_id", "rb", "cb").agg(F.min("row").alias("start_row"), F.max("row").alias("end_row"), F.min("column").alias("start_column"), F.max("column").alias("end_column"))
    return b.withColumn("idx", F.row_number().over(Window.partitionBy("sheet_id").orderBy("rb", "cb"))).drop("rb", "cb")


def region_members(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with the region that holds them: equal sheet, row and column within."""
    r = regions.select("sheet_id", "region_id", "start_row", "end_row", "start_column", "end_column")
    inside = (cells["sheet_id"] == r["sheet_id"]) & F.col("row").between(F.col("start_row"), F.col("end_row")) & F.col("column").between(F.col("start_column"), F.col("end_column"))
    return cells.join(r, inside).drop(r["sheet_id"])


def region_type(kind: Column, text: Column, values: Column, cells: Column) -> Column:
    """Type of a region from its sheet's type, its text and its counts, by rules in order."""
    low = F.lower(text)
    check = holds_any(text, ("チェックID", "チェック名", "エラーメッセージ"))
    screen = (text.contains("画面") & holds_any(text, ("項目名", "物理名", "入力可否"))) | (low.contains("screen") & holds_any(low, ("field", "item")))
    out = F.when(holds_any(text, ("改訂", "履歴", "版数", "revision")), "revision_history")
    out = out.when((values <= 2) & (cells <= 6), "note_block").when(check, "validation_block")
    out = out.when(text.contains("テーブル名") & text.contains("カラム名"), "db_mapping_table")
    out = out.when(holds_any(low, ("外部if", "if名", "interface name")) & holds_any(text, ("項目名", "物理名", "送信", "受信")), "external_if_table")
    out = out.when(holds_any(low, ("api id", "api名", "endpoint")) & holds_any(low, ("request", "response", "リクエスト", "レスポンス")), "api_mapping_table")
    out = out.when(text.contains("テストケースID") & text.contains("期待結果"), "test_case_table").when(screen, "screen_item_table")
    for sheet, region in (("screen_item_definition", "screen_item_table"), ("validation_rule", "validation_block"), ("api_mapping", "api_mapping_table"), ("db_mapping", "db_mapping_table"), ("external_interface", "external_if_table"), ("test_case", "test_case_table"), ("glossary", "glossary_table")):
        out = out.when(kind == sheet, region)
    return out.when((values <= 2) | (cells <= 6), "note_block").otherwise("unknown")


def style_hints() -> Column:
    """Style of a cell as short words."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.array_compact(F.array(F.when(on("style.font_bold"), "bold"), F.when(some("style.fill_color"), F.concat(F.lit("fill:"), "style.fill_color")), F.when(on("style.border"), "border"), F.when(some("merged_range"), F.concat(F.lit("merged:"), "merged_range")), F.when(on("is_hidden_row") | on("is_hidden_col"), "hidden")))


def _cell_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\|", r"\\\\|"), "\n", " ")


def detect_regions(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Regions with bounds, type, evidence ids and their text, one line per cell in reading order."""
    bounds = region_bounds(cells).join(sheets.select("sheet_id", "sheet_name", "sheet_type", "workbook_id"), "sheet_id")
    a1 = F.concat(column_letter(F.col("start_column")), F.col("start_row").cast("string"), F.lit(":"), column_letter(F.col("end_column")), F.col("end_row").cast("string"))
    bounds = bounds.withColumn("region_id", F.concat("sheet_id", F.lit(".region."), F.lpad(F.col("idx").cast("string"), 3, "0"))).withColumn("range", a1)
    m = region_members(bounds, cells.drop("sheet_name", "workbook_id"))
    line = F.concat(F.lit("| "), "cell", F.lit(" | "), _cell_text(F.col("value")), F.lit(" | "), _cell_text(F.array_join(style_hints(), ",")), F.lit(" |"))
    g = m.groupBy("region_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "column", "evidence_id"))), lambda s: s["evidence_id"]).alias("evidence_ids"),
        F.array_sort(F.collect_list(F.when(has_value(), F.struct("row", "column", F.col("value").alias("value"), line.alias("line"))))).alias("_v"),
        F.count("*").alias("cells"),
    )
    text = F.array_join(F.transform("_v", lambda s: s["value"]), " ")
    head = F.array(F.concat(F.lit("# "), "sheet_name", F.lit(" "), "range"), F.lit(""), F.lit("| cell | value | style_hint |"), F.lit("| --- | --- | --- |"))
    j = bounds.join(g, "region_id")
    return j.select(
        "region_id", "workbook_id", "sheet_id", "sheet_name", "range", "idx", region_type(F.col("sheet_type"), text, F.size("_v"), F.col("cells")).alias("region_type"), "evidence_ids",
        "start_row", "end_row", "start_column", "end_column", "cells", F.array_join(F.concat(head, F.transform("_v", lambda s: s["line"])), "\n").alias("rendered_text"),
    )


def region_lines(regions: DataFrame) -> DataFrame:
    """Sections and chunks of a workbook's regions: line offsets run on with a gap of two."""
    n = F.greatest(F.size(F.split("rendered_text", "\n")), F.lit(1))
    w = Window.partitionBy("workbook_id").orderBy("sheet_id", "idx").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(n + 2).over(w), F.lit(0)) + 1).cast("int")
    key = short_hash(F.col("region_id"))
    return regions.select("workbook_id", "region_id", F.concat(F.lit("sec."), key).alias("section_id"), F.concat(F.lit("chunk."), key).alias("chunk_id"), F.concat("sheet_name", F.lit(" "), "range").alias("heading"), F.col("rendered_text").alias("text"), start.alias("line_start"), (start + n - 1).cast("int").alias("line_end"))


def header_row(members: DataFrame, first: int = 8) -> DataFrame:
    """(region_id, header_row): of a region's first rows the fullest with two values or more, the first of equals."""
    v = members.where(has_value() & (strip(F.col("value")) != "") & (F.col("row") < F.col("start_row") + first))
    n = v.groupBy("region_id", "row").agg(F.count("*").alias("n")).where("n >= 2")
    return n.groupBy("region_id").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("header_row"))


def region_rows(members: DataFrame) -> DataFrame:
    """(region_id, row, values, evidence_ids): rows under the header as maps from header, and from col_n, to value."""
    head = header_row(members)
    m = members.join(head, "region_id").withColumn("_i", F.col("column") - F.col("start_column") + 1).withColumn("_v", strip(F.coalesce("value", F.lit(""))))
    names = m.where("row = header_row").select("region_id", "_i", F.col("_v").alias("_h"))
    body = m.where("row > header_row").join(names, ["region_id", "_i"], "left")
    col = F.concat(F.lit("col_"), F.col("_i").cast("string"))
    cell = F.struct("_i", col.alias("c"), F.when(F.coalesce("_h", F.lit("")) == "", col).otherwise(F.col("_h")).alias("h"), F.col("_v").alias("v"), F.col("evidence_id").alias("e"))
    g = body.groupBy("region_id", "row").agg(F.array_sort(F.collect_list(cell)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x: F.array(F.struct(x["c"].alias("key"), x["v"].alias("value")), F.struct(x["h"].alias("key"), x["v"].alias("value")))))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    rows = g.select("region_id", "row", F.map_from_entries(last).alias("values"), F.transform("s", lambda x: x["e"]).alias("evidence_ids"))
    return rows.where(F.exists(F.map_values("values"), lambda v: v != ""))


def lookup(values: Column, *names: str) -> Column:
    """Value of the first name that has one: exactly, else of a key that contains it in folded case."""
    entries = F.map_entries(values)

    def part(name: str) -> Column:
        inside = F.filter(entries, lambda e: F.lower(e["key"]).contains(name.lower()) & (e["value"] != ""))
        exact = F.try_element_at(values, F.lit(name))
        return F.when(F.coalesce(exact, F.lit("")) != "", exact).when(F.size(inside) > 0, F.get(inside, F.lit(0))["value"])

    return F.coalesce(*[part(n) for n in names], F.lit(""))


def _sheet_name(c: Column) -> Column:
    short = strip(F.regexp_replace(c, "(定義書|一覧|シート|項目|設計書)$", ""))
    return F.when(short == "", c).otherwise(short)


def row_edges(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, row, source_type, source, relation_type, target_type, target, evidence_ids) of every row by its region's type."""
    r = rows.join(regions.select("region_id", "region_type", "sheet_name"), "region_id")
    v, sheet = F.col("values"), _sheet_name(F.col("sheet_name"))
    named = lambda c: F.when(c != "", c).otherwise(sheet)
    edge = lambda st, s, rel, tt, t: F.struct(F.lit(st).alias("source_type"), s.alias("source"), rel.alias("relation_type"), F.lit(tt).alias("target_type"), t.alias("target"))
    screen, table, api, if_ = named(lookup(v, "画面名", "screen_name", "col_2")), named(lookup(v, "テーブル名", "table_name", "col_1")), named(lookup(v, "API名", "api_name", "API", "col_2")), named(lookup(v, "IF名", "if_name", "外部IF", "col_2"))
    way = F.lower(lookup(v, "区分", "direction", "col_4"))
    column = lookup(v, "カラム名", "column_name", "物理名", "col_3")
    logical = lookup(v, "カラム論理名", "logical_name", "項目名", "col_4")
    full = F.concat(table, F.lit("."), column)
    cases = {
        "screen_item_table": [
            edge("Screen", screen, F.lit("DISPLAYS"), "ScreenField", lookup(v, "項目名", "物理名", "item_name", "field", "col_5", "col_4")),
            edge("Screen", screen, F.lit("CALLS"), "API", lookup(v, "呼び出すAPI", "API", "api", "col_10")),
        ],
        "api_mapping_table": [edge("API", api, F.when(way.contains("response") | way.contains("レスポンス"), "RESPONSE_FIELD").otherwise("REQUEST_FIELD"), "APIField", lookup(v, "物理名", "項目名", "field", "リクエスト項目", "col_6", "col_5"))],
        "db_mapping_table": [edge("DBTable", table, F.lit("contains"), "DBColumn", F.when(column == "", "").otherwise(full)), edge("DBColumn", F.when(column == "", "").otherwise(full), F.lit("DEFINES"), "ScreenField", F.when(logical == "", column).otherwise(logical))],
        "validation_block": [edge("ValidationRule", lookup(v, "チェック名", "チェックID", "validation", "col_2", "col_1"), F.lit("VALIDATES"), "ScreenField", lookup(v, "対象項目", "物理名", "項目名", "target", "col_5", "col_4"))],
        "external_if_table": [edge("ExternalIF", if_, F.lit("SENDS"), "APIField", lookup(v, "物理名", "項目名", "送信項目", "受信項目", "field", "col_5", "col_4"))],
        "test_case_table": [edge("TestCase", lookup(v, "テスト名", "テストケースID", "試験ID", "test", "col_2", "col_1"), F.lit("COVERS"), "ScreenField", lookup(v, "対象項目", "確認観点", "項目名", "target", "col_4"))],
    }
    edges = None
    for kind, found in cases.items():
        edges = F.when(F.col("region_type") == kind, F.array(*found)) if edges is None else edges.when(F.col("region_type") == kind, F.array(*found))
    return r.select("region_id", "row", "evidence_ids", F.explode(edges).alias("e")).where("e.source <> '' and e.target <> ''").select("region_id", "row", "e.*", "evidence_ids")


def proposals(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows (evidence of all rows merged) and edge rows of each region, with hashed ids."""
    ends = edges.select("region_id", F.explode(F.array(F.struct(F.col("source_type").alias("node_type"), F.col("source").alias("name")), F.struct(F.col("target_type").alias("node_type"), F.col("target").alias("name")))).alias("n"), "evidence_ids")
    nodes = ends.groupBy("region_id", "n.node_type", F.col("n.name").alias("display_name")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))
    node_id = lambda t, n: F.concat(F.lit("n_"), short_hash(F.concat("region_id", t, F.lit(":"), n)))
    nodes = nodes.withColumn("temp_id", node_id(F.col("node_type"), F.col("display_name")))
    e = edges.withColumn("source_temp_id", node_id(F.col("source_type"), F.col("source"))).withColumn("target_temp_id", node_id(F.col("target_type"), F.col("target")))
    key = F.concat("region_id", "source_temp_id", F.lit(":"), "relation_type", F.lit(":"), "target_temp_id", F.lit(":"), F.array_join("evidence_ids", ","))
    return nodes, e.select("region_id", F.concat(F.lit("e_"), short_hash(key)).alias("temp_id"), "source_temp_id", "relation_type", "target_temp_id", F.array_sort(F.array_distinct("evidence_ids")).alias("evidence_ids"), F.lit("explicit").alias("inference_level"))


def clean(nodes: DataFrame, edges: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges with evidence of their own region and known ends; and (region_id, warnings) on the rest."""
    # a region's list has an id for each of its cells, so only what is used and not in it travels with nodes and edges
    used = lambda df: df.select("region_id", F.explode("evidence_ids").alias("id"))
    own = used(regions).select(F.col("region_id").alias("of"), F.col("id").alias("ok"))
    foreign = used(nodes).unionByName(used(edges)).distinct().join(own, (F.col("region_id") == F.col("of")) & F.col("id").eqNullSafe(F.col("ok")), "left_anti")
    foreign = foreign.groupBy("region_id").agg(F.transform(F.collect_list(F.struct("id")), lambda x: x["id"]).alias("_foreign"))
    allowed = regions.select("region_id").join(foreign, "region_id", "left").withColumn("_foreign", F.coalesce("_foreign", F.array().cast("array<string>")))
    bad = F.array_intersect("evidence_ids", "_foreign")
    problem = F.when(F.size("evidence_ids") == 0, "missing evidence_ids").when(F.size(bad) > 0, F.concat(F.lit("invalid evidence_ids "), F.array_join(bad, ", ")))
    n = nodes.join(allowed, "region_id").withColumn("_p", problem)
    good = n.where("_p is null").drop("_p", "_foreign")
    ids = good.select("region_id", F.col("temp_id").alias("_t"), F.lit(True).alias("_known"))
    e = edges.join(allowed, "region_id")
    for end in ("source", "target"):
        e = e.join(ids.select("region_id", F.col("_t").alias(f"{end}_temp_id"), F.col("_known").alias(f"_{end}")), ["region_id", f"{end}_temp_id"], "left")
    e = e.withColumn("_p", F.when(F.col("_source").isNull() | F.col("_target").isNull(), "unknown node reference").otherwise(problem))
    told = n.where("_p is not null").select("region_id", F.concat(F.lit("dropped node "), "temp_id", F.lit(": "), "_p").alias("w")).unionByName(e.where("_p is not null").select("region_id", F.concat(F.lit("dropped edge "), "temp_id", F.lit(": "), "_p").alias("w")))
    return good, e.where("_p is null").select(edges.columns), told.groupBy("region_id").agg(F.array_sort(F.collect_set("w")).alias("warnings"))


def _named_slug(value: Column) -> Column:
    """Letters and digits of any script in lower case, joined by underscores; texts without any are named by their hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", short_hash(value)).otherwise(plain)


def _live_nodes(nodes: DataFrame, status: DataFrame, names: DataFrame | None) -> DataFrame:
    """Nodes of proposals that are not rejected, with id, type and name in the graph."""
    live = status.where("status <> 'rejected'").select("region_id")
    kind = F.coalesce(_map(NODE_TYPES, F.col("node_type")), F.lit("Document"))
    name = F.when(kind == "BusinessField", field_name(F.col("display_name"))).otherwise(F.col("display_name"))
    n = nodes.join(live, "region_id", "left_semi").withColumn("kind", kind).withColumn("name", name)
    return with_ids(n, "name", "kind", names, "node_id", _map(PREFIX, F.col("kind")))


def proposals_to_graph(
    nodes: DataFrame, edges: DataFrame, regions: DataFrame, status: DataFrame, document: DataFrame, names: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Artifacts, entities, relations and evidence of the proposals that are not rejected.

    status: region_id, status, and optionally extraction_method; document: workbook_id, document_id, file; names: the alias
    catalog. Node and relation types are mapped, guesses are inferred, each relation has the region's text as evidence.
    """
    n = _live_nodes(nodes, status, names).join(regions.select("region_id", "workbook_id"), "region_id").join(document, "workbook_id")
    method = F.when(F.col("rationale").contains("LLM"), "llm").otherwise("rule") if "rationale" in nodes.columns else F.lit("rule")
    sets = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    node = n.groupBy("node_id", "kind").agg(
        F.min_by("name", F.struct("region_id", "temp_id")).alias("display_name"), sets("document_id", "source_document_ids"), sets(method, "extraction_methods")
    )
    ends = n.select("region_id", "temp_id", "node_id", "kind")
    e = edges
    for end in ("source", "target"):
        e = e.join(
            ends.select("region_id", F.col("temp_id").alias(f"{end}_temp_id"), F.col("node_id").alias(f"{end}_id"), F.col("kind").alias(f"{end}_kind")),
            ["region_id", f"{end}_temp_id"],
        )
    e = e.withColumn("relation_type", F.coalesce(_map(RELATION_MAP, F.col("relation_type")), F.col("relation_type")))
    place = region_lines(regions).select("region_id", "section_id", "chunk_id")
    about = regions.select("region_id", "workbook_id", "start_row", "end_row")
    e = e.join(about, "region_id").join(document, "workbook_id").join(place, "region_id").join(status.drop("status"), "region_id")
    key = F.concat_ws("|", "source_id", "relation_type", "target_id", "region_id")
    guess = F.col("inference_level") != "explicit"
    by = F.when(F.col("extraction_method") == "llm", "llm").otherwise("rule") if "extraction_method" in status.columns else F.lit("rule")
    lines = F.filter(lines_of(F.col("rendered_text")), lambda x: (x != "") & ~x.startswith("| ---"))
    quote = F.substring(F.concat(F.lit("["), "sheet_name", F.lit("!"), "range", F.lit("] "), F.array_join(lines, " / ")), 1, 2000)
    slugs = F.concat(F.lit("rel."), _named_slug(F.col("source_id")), F.lit("."), F.lower("relation_type"), F.lit("."), _named_slug(F.col("target_id")))
    rows = e.select(
        F.concat(slugs, F.lit("."), short_hash(key)).alias("relation_id"),
        "relation_type",
        "source_id",
        "target_id",
        F.concat(F.lit("ev."), short_hash(F.concat("region_id", F.lit("|"), key))).alias("evidence_id"),
        by.alias("extraction_method"),
        F.when(guess, "inferred").otherwise("explicit").alias("polarity"),
        F.lit("unconfirmed").alias("status"),
        F.when(guess, "semantic").otherwise("exact").alias("match_type"),
        "document_id",
        "section_id",
        "chunk_id",
        F.when(F.col("target_kind") == "BusinessField", "entity").otherwise("artifact").alias("target_support"),
        F.struct(
            "file", F.greatest("start_row", F.lit(1)).alias("line_start"), F.greatest("start_row", "end_row").alias("line_end")
        ).alias("source_location"),
        "region_id",
    )
    first = rows.groupBy("relation_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "relation_id"])).alias("r")).select("relation_id", "r.*")
    quotes = regions.select("region_id", quote.alias("quote"))  # once for each region, not for each of its edges
    supports = F.array(
        F.struct(F.col("target_support").alias("type"), F.col("target_id").alias("id")), F.struct(F.lit("relation").alias("type"), F.col("relation_id").alias("id"))
    )
    return {
        "artifacts": node.where("kind <> 'BusinessField'").withColumnsRenamed({"node_id": "artifact_id", "kind": "artifact_type"}),
        "entities": node.where("kind = 'BusinessField'").withColumnsRenamed({"node_id": "entity_id", "kind": "entity_type"}),
        "relations": first.withColumn("evidence_ids", F.array("evidence_id")).withColumn("source_document_ids", F.array("document_id")).drop(
            "evidence_id", "section_id", "chunk_id", "target_support", "source_location"
        ),
        "evidence": first.join(quotes, "region_id").select(
            "evidence_id", "document_id", "section_id", "chunk_id", "quote", F.lit("dirty_excel_region_relation").alias("evidence_type"), supports.alias("supports"), "source_location"
        ),
    }


def decide_proposals(status: DataFrame, decisions: DataFrame) -> DataFrame:
    """X11: proposal states after (region_id, status) decisions; only accepted and rejected are states that can be decided."""
    d = decisions.where(F.col("status").isin("accepted", "rejected")).select("region_id", F.col("status").alias("_s"))
    return status.join(d, "region_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def rebuild(
    nodes: DataFrame, edges: DataFrame, regions: DataFrame, status: DataFrame, decisions: DataFrame, document: DataFrame, names: DataFrame | None = None
) -> dict[str, DataFrame]:
    """X11: the new graph (X10) of every workbook that has a decided proposal; it replaces that of the workbook's document by G1."""
    books = regions.join(decisions.select("region_id"), "region_id", "left_semi").select("workbook_id").distinct()
    mine = regions.join(books, "workbook_id", "left_semi")
    keep = lambda df: df.join(mine.select("region_id"), "region_id", "left_semi")
    return proposals_to_graph(keep(nodes), keep(edges), mine, keep(decide_proposals(status, decisions)), document, names)


def drawing_warnings(sheets: DataFrame) -> DataFrame:
    """Warnings on drawings that are not read; sheets: sheet_name, drawings (array)."""
    some = sheets.where(F.size("drawings") > 0)
    said = lambda verb: F.concat(F.lit("Sheet '"), "sheet_name", F.lit(f"' {verb} drawing content: "), F.array_join("drawings", ", "))
    return some.select(F.explode(F.array(said("contains unsupported"), said("has unresolved"))).alias("warning"))


def grid_health(sheets: DataFrame, regions: DataFrame, cells: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(measure, name, n): totals, histograms of sheet and region types, unresolved mentions and different warnings.

    There is a proposal for every region but revision histories. warnings: warning. Sheets may have `drawings`.
    """
    one = lambda df, m, n: df.groupBy(n.alias("name")).agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), "name", "n")
    total = lambda df, m: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("measure"), F.lit(m).alias("name"), "n")
    proposed = regions.where("region_type <> 'revision_history'")
    mention = proposed.select(F.explode(unresolved_mentions(F.col("rendered_text"))).alias("m"))
    told = warnings.select("warning") if warnings is not None else sheets.select(F.lit("").alias("warning")).limit(0)
    if "drawings" in sheets.columns:
        told = told.unionByName(drawing_warnings(sheets))
    parts = [
        total(sheets.select("workbook_id").distinct(), "workbooks"),
        total(sheets, "sheets"),
        total(cells, "cells"),
        total(regions, "regions"),
        total(proposed, "proposals"),
        one(sheets, "sheet_type", F.col("sheet_type")),
        one(regions, "region_type", F.col("region_type")),
        one(mention, "unresolved", F.col("m")),
        one(told.distinct(), "warning", F.col("warning")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sheet_details(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Per sheet: rows with values, header cells, merged ranges, estimated type, and whether it has several header rows, is hidden or a revision history.

    A header row is one of the first eight with three values or more. sheets: sheet_id, file_name, hidden; without it no sheet is hidden and
    the workbook's id stands for its file.
    """
    n = cells.where(has_value()).groupBy("sheet_id", "row").agg(F.count("*").alias("n"))
    per = n.groupBy("sheet_id").agg(F.count("*").alias("rows"), F.sum(((F.col("row") <= 8) & (F.col("n") >= 3)).cast("int")).alias("heads"))
    top = cells.where(has_value() & (F.col("row") == 1)).groupBy("sheet_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column", "value"))), lambda s: s["value"]).alias("headers")
    )
    base = cells.groupBy("workbook_id", "sheet_id").agg(
        F.first("sheet_name").alias("sheet_name"), F.count_distinct(F.when(F.coalesce("merged_range", F.lit("")) != "", F.col("merged_range"))).alias("merged_cells")
    )
    known = sheets.select("sheet_id", "file_name", "hidden") if sheets is not None else base.select("sheet_id", F.col("workbook_id").alias("file_name"), F.lit(False).alias("hidden"))
    j = base.join(per, "sheet_id", "left").join(top, "sheet_id", "left").join(known, "sheet_id", "left")
    headers = F.coalesce("headers", F.array().cast("array<string>"))
    return j.select(
        "workbook_id",
        "sheet_id",
        "sheet_name",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.size(headers).alias("columns"),
        "merged_cells",
        estimate_sheet_type(F.coalesce("file_name", F.lit("")), F.col("sheet_name"), headers).alias("estimated_type"),
        (F.coalesce("heads", F.lit(0)) > 1).alias("multi_header"),
        F.coalesce("hidden", F.lit(False)).alias("hidden"),
        holds_any(F.col("sheet_name"), ("改訂", "履歴")).alias("revision_history"),
    )


def folder_health(details: DataFrame) -> DataFrame:
    """One row of totals over sheet details, with the warnings."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    data = F.greatest(F.col("rows") - 1, F.lit(0))
    t = details.agg(
        F.count_distinct("workbook_id").alias("workbooks"),
        F.count("*").alias("sheets"),
        F.coalesce(F.sum(data), F.lit(0)).alias("detected_artifacts"),
        F.coalesce(F.sum(data), F.lit(0)).alias("possible_relations"),
        n("merged_cells").alias("merged_cells"),
        n("hidden").alias("hidden_sheets"),
        n("multi_header").alias("multi_header_sheets"),
        n("revision_history").alias("revision_sheets"),
    )
    # The warnings.
    merged = F.when(F.col("merged_cells") > 0, "結合セルがあります。必要に応じて表形式へ整形してください。")
    heads = F.when(F.col("multi_header_sheets") > 0, "複数のヘッダー候補があるシートがあります。")
    return t.withColumn("warnings", F.array_compact(F.array(merged, heads)))


def repeated_fields(cells: DataFrame) -> DataFrame:
    """(name, count) of values like field names that stand below the first rows of sheets more than once."""
    looks = F.col("value").rlike("[A-Za-z_]{4,}|額|金額|ID|コード")
    return cells.where(has_value() & (F.col("row") > 1) & looks).groupBy(F.col("value").alias("name")).agg(F.count("*").alias("count")).where("count > 1")


def field_alias_groups(cells: DataFrame) -> DataFrame:
    """(name, aliases): logical names in rows below the first with the physical names beside them; groups of two or more."""
    v = cells.where(has_value() & (F.col("row") > 1)).select("sheet_id", "row", "value")
    left = v.where(holds_any(F.col("value"), ("額", "金額", "限度"))).withColumnRenamed("value", "left").distinct()
    right = v.where(F.col("value").rlike("[A-Za-z]")).withColumnRenamed("value", "right").distinct()
    name = F.regexp_replace("left", "利用|希望", "").alias("name")
    pairs = left.join(right, ["sheet_id", "row"]).select(name, F.col("right").alias("alias")).unionByName(left.select(name, F.col("left").alias("alias")))
    groups = pairs.distinct().groupBy("name").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return groups.where(F.size("aliases") > 1)


def is_design_sheet(file_name: Column, sheet_name: Column, top_values: Column) -> Column:
    """Whether a sheet is a design sheet: by file name, sheet name, or two header words in its first three rows."""
    # Words of file names and of headers.
    words = ("画面ID", "画面名", "項目名", "物理名", "API名", "endpoint", "エンドポイント", "テーブル名", "カラム名", "チェック内容", "外部IF", "IF名", "送信項目", "受信項目", "テストケースID", "期待結果")
    known = F.array(*map(F.lit, words))
    return holds_any(file_name, ("画面", "API", "テーブル", "入力チェック", "外部IF", "試験")) | sheet_name.isin(*words) | (F.size(F.array_intersect(top_values, known)) >= 2)


def estimate_sheet_type(file_name: Column, sheet_name: Column, headers: Column) -> Column:
    """Type of a row-mapped sheet: by names first, then by headers, else table."""
    name = F.concat_ws(" ", file_name, sheet_name)
    text = F.concat_ws(" ", file_name, sheet_name, headers)
    by_name = (("screen", ("画面",)), ("validation", ("入力チェック", "チェック一覧")), ("external_if", ("外部IF",)), ("test", ("試験", "テスト")), ("api", ("API",)), ("table", ("テーブル",)))
    by_text = (("validation", ("チェック",)), ("external_if", ("外部IF", "IF名")), ("test", ("試験", "テスト")), ("api", ("API",)), ("table", ("テーブル", "カラム", "DB")), ("screen", ("画面",)))
    out = F.lit("table")
    for kind, words in [*reversed(by_text)]:
        out = F.when(holds_any(text, words), kind).otherwise(out)
    for kind, words in [*reversed(by_name)]:
        out = F.when(holds_any(name, words), kind).otherwise(out)
    return out


def mapped_rows(rows: DataFrame) -> DataFrame:
    """(sheet, row, source_type, source, relation_type, target_type, target, evidence_type, quote) of rows by sheet type.

    rows: sheet, row, sheet_type, values (map from header to text), columns (map from header to column number).
    """
    v = F.col("values")
    get = lambda *names: F.coalesce(*[F.when(strip(F.coalesce(F.try_element_at(v, F.lit(n)), F.lit(""))) != "", strip(F.try_element_at(v, F.lit(n)))) for n in names])
    has = lambda name: get(name).isNotNull()
    one = lambda st, s, rel, tt, t, ev, head: F.struct(F.lit(st).alias("source_type"), s.alias("source"), rel.alias("relation_type"), F.lit(tt).alias("target_type"), t.alias("target"), F.lit(ev).alias("evidence_type"), head.alias("header"))
    shown = F.when(F.coalesce(get("入力可否"), F.lit("")).contains("不可"), "DISPLAYS").otherwise("DEFINES")
    screen, item, physical = get("画面名", "screen_name"), get("項目名", "item_name"), get("物理名", "physical_name")
    way = F.lower(F.coalesce(get("区分", "direction"), F.lit("request")))
    table, column = F.coalesce(get("テーブル名", "table_name"), F.col("sheet")), get("カラム名", "column_name")
    full = F.concat(table, F.lit("."), column)
    either = lambda a, b: F.when(has(a), a).otherwise(b)
    any_item = F.coalesce(item, physical).isNotNull()
    cases = {
        "screen": [one("Screen", screen, shown, "BusinessField", item, "screen_field_definition", F.lit("項目名")), one("Screen", screen, shown, "BusinessField", physical, "screen_field_definition", F.lit("物理名")), one("Screen", F.when(any_item, screen), F.lit("CALLS"), "API", get("呼び出すAPI", "api"), "screen_api_call", F.lit("呼び出すAPI"))],
        "api": [one("API", get("API名", "api_name"), F.when(way.contains("response") | way.contains("レスポンス"), "RESPONSE_FIELD").otherwise("REQUEST_FIELD"), "BusinessField", get("物理名", "項目名", "field"), "api_request_definition", either("物理名", "項目名"))],
        "table": [one("Column", full, F.lit("DEFINES"), "BusinessField", column, "db_column_definition", F.lit("カラム名")), one("Column", full, F.lit("DEFINES"), "BusinessField", get("カラム論理名", "logical_name"), "db_column_definition", F.lit("カラム論理名"))],
        "validation": [one("ValidationRule", get("チェック名", "チェックID"), F.lit("VALIDATES"), "BusinessField", get("対象項目", "物理名"), "validation_rule_definition", either("対象項目", "物理名"))],
        "external_if": [one("ExternalIF", get("IF名", "if_name"), F.lit("SENDS"), "BusinessField", get("物理名", "項目名"), "external_mapping_definition", either("物理名", "項目名"))],
        "test": [one("TestCase", get("テスト名", "テストケースID"), F.lit("VALIDATES"), "BusinessField", get("対象項目", "確認観点"), "test_coverage_definition", either("対象項目", "確認観点"))],
    }
    found = None
    for kind, items in cases.items():
        found = F.when(F.col("sheet_type") == kind, F.array(*items)) if found is None else found.when(F.col("sheet_type") == kind, F.array(*items))
    r = rows.withColumn("e", F.explode(found)).where("e.source is not null and e.target is not null")
    text = F.array_join(F.transform(F.filter(F.map_entries(v), lambda p: F.coalesce(p["value"], F.lit("")) != ""), lambda p: F.concat(p["key"], F.lit("="), p["value"])), " / ")
    at = F.concat(column_letter(F.coalesce(F.try_element_at("columns", F.col("e.header")), F.lit(1))), F.col("row").cast("string"))
    quote = F.concat(F.lit("["), "sheet", F.lit("!"), at, F.lit("] "), text)
    return r.select("sheet", "row", "e.source_type", "e.source", "e.relation_type", "e.target_type", "e.target", "e.evidence_type", quote.alias("quote")).distinct()


def plain_tables(tables: DataFrame) -> DataFrame:
    """(table_name, headers) to columns: one DEFINES row per header."""
    t = tables.select("table_name", F.explode("headers").alias("header")).where("header is not null and header <> ''")
    full = F.concat("table_name", F.lit("."), "header")
    return t.select("table_name", F.concat(F.lit("column."), slug(full)).alias("source_id"), F.lit("DEFINES").alias("relation_type"), F.concat(F.lit("entity."), slug(field_name(F.col("header")))).alias("target_id"), F.col("header").alias("quote")).distinct()
