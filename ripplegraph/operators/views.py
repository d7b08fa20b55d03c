"""Review views: counts, graph and source pages, libraries, boards, the review queue.

One-to-many tables are aggregated before they are joined; pages use offset and limit over a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_path, path_parts, rank_in

OPEN = ("pending", "unreviewed", "unconfirmed", "stale")
ACTIONABLE = (*OPEN, "needs_investigation")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(collection, n)."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of every count."""
    b = before.select("collection", F.col("n").alias("before"))
    j = b.join(after.select("collection", F.col("n").alias("after")), "collection", "full_outer")
    return j.select("collection", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def open_stale(stale: DataFrame, target_type: str) -> DataFrame:
    """(target_id, stale_reason) of open stale records."""
    return stale.where((F.col("target_type") == target_type) & F.col("resolved_at").isNull()).groupBy("target_id").agg(F.min("reason").alias("stale_reason"))


def graph_view(artifacts: DataFrame, entities: DataFrame, relations: DataFrame, stale: DataFrame, types: list[str] | None = None, status: str | None = None, method: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with filters and stale flags; ends that are no node become placeholders."""
    e = relations
    e = e.where(F.col("relation_type").isin(*types)) if types else e
    e = e.where(F.col("status") == status) if status else e
    e = e.where(F.col("extraction_method") == method) if method else e
    e = e.join(open_stale(stale, "relation").select(F.col("target_id").alias("relation_id"), F.lit(True).alias("_s")), "relation_id", "left").withColumn("is_stale", F.coalesce("_s", F.lit(False))).drop("_s")
    n = artifacts.select(F.col("artifact_id").alias("node_id"), F.col("artifact_type").alias("node_type"), "display_name").unionByName(entities.select(F.col("entity_id").alias("node_id"), F.col("entity_type").alias("node_type"), "display_name"))
    ends = e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    ghosts = ends.join(n, "node_id", "left_anti").select("node_id", F.lit("Missing").alias("node_type"), F.col("node_id").alias("display_name"))
    n = n.unionByName(ghosts).join(open_stale(stale, "node").select(F.col("target_id").alias("node_id"), F.lit(True).alias("_s")), "node_id", "left")
    return n.withColumn("is_stale", F.coalesce("_s", F.lit(False))).drop("_s"), e


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One page and the total."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def node_edges(relations: DataFrame, node_id: str) -> DataFrame:
    """Relations on either end of a node."""
    return relations.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))


def source_preview(lines: DataFrame, evidence: DataFrame, around: int = 4, first: int = 120) -> DataFrame:
    """(document_id, line, raw, highlighted): lines within `around` of evidence; documents without any show their first lines (a limit of the report)."""
    ev = evidence.select("document_id", F.col("source_location.line_start").alias("a"), F.col("source_location.line_end").alias("b")).where("a is not null")
    near = ev.select("document_id", F.explode(F.sequence(F.greatest(F.col("a") - around, F.lit(1)), F.col("b") + around)).alias("line"), "a", "b")
    near = near.groupBy("document_id", "line").agg(F.bool_or(F.col("line").between(F.col("a"), F.col("b"))).alias("highlighted"))
    shown = lines.join(near, ["document_id", "line"])
    rest = lines.join(ev.select("document_id").distinct(), "document_id", "left_anti").where(F.col("line") <= first).withColumn("highlighted", F.lit(False))
    return shown.select("document_id", "line", "raw", "highlighted").unionByName(rest.select("document_id", "line", "raw", "highlighted"))


def chunk_preview(chunks: DataFrame, first: int = 80) -> DataFrame:
    """The first chunks of each document (a limit of the report)."""
    order = Window.partitionBy("document_id").orderBy("line_start", "chunk_id")
    return chunks.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)


def cell_preview(cells: DataFrame, spots: DataFrame, rows: int = 4, columns: int = 3, most: int = 400) -> DataFrame:
    """Cells near the given (sheet_id, row, column), at most `most` a sheet (a limit of the report)."""
    s = spots.select("sheet_id", F.col("row").alias("_r"), F.col("column").alias("_c")).distinct()
    wide = s.select("sheet_id", F.explode(F.sequence(F.col("_r") - rows, F.col("_r") + rows)).alias("row"), "_c")
    hit = cells.join(wide, ["sheet_id", "row"]).where(F.abs(F.col("column") - F.col("_c")) <= columns).drop("_c").dropDuplicates(["sheet_id", "row", "column"])
    order = Window.partitionBy("sheet_id").orderBy("row", "column")
    return hit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def source_library(documents: DataFrame, evidence: DataFrame, nodes: DataFrame, relations: DataFrame, versions: DataFrame, stale: DataFrame) -> DataFrame:
    """Per document the numbers of its evidence, nodes, relations, versions and open stale records, and its latest change."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    of = lambda df, key: df.select(key, F.explode("source_document_ids").alias("document_id")).distinct()
    out = documents.select("document_id", "title")
    last = versions.groupBy("document_id").agg(F.count("*").alias("versions"), F.max_by("change_type", "version_number").alias("latest_change"))
    for part in (count(evidence, "evidence"), count(of(nodes, "node_id"), "nodes"), count(of(relations, "relation_id"), "relations"), last, count(stale.where("resolved_at is null"), "stale")):
        out = out.join(part, "document_id", "left")
    return out.fillna(0, ["evidence", "nodes", "relations", "versions", "stale"])


def source_list(
    documents: DataFrame, workbooks: DataFrame, sheets: DataFrame, regions: DataFrame, evidence: DataFrame, nodes: DataFrame, relations: DataFrame, versions: DataFrame, stale: DataFrame
) -> DataFrame:
    """Every source: documents with what they and their workbook hold, and workbooks that no document stands for.

    A workbook (workbook_id, file_path, original_path, warnings, seq) belongs to the documents of either of its paths, a path of
    several workbooks to the last by seq. Paths are compared in their normal form; a missing one belongs to nothing.
    """
    count = lambda df, name: df.groupBy("workbook_id").agg(F.count("*").alias(name))
    books = workbooks.join(count(sheets, "sheets"), "workbook_id", "left").join(count(regions, "regions"), "workbook_id", "left").fillna(0, ["sheets", "regions"])
    paths = books.select("workbook_id", "seq", F.explode(F.array("file_path", "original_path")).alias("_p"))
    owner = paths.groupBy(normal_path(F.col("_p")).alias("_key")).agg(F.max_by("workbook_id", F.struct("seq", "workbook_id")).alias("workbook_id")).where("_key is not null")
    rows = documents.withColumn("_key", normal_path(F.col("path"))).join(owner, "_key", "left").join(books.select("workbook_id", "sheets", "regions", "warnings"), "workbook_id", "left")
    held = source_library(documents, evidence, nodes, relations, versions, stale).drop("title")
    none = F.array().cast("array<string>")
    known = rows.join(held, "document_id").select(
        F.col("document_id").alias("source_id"), "title", "path", F.col("document_type").alias("source_type"), F.when(F.col("evidence") > 0, "ready").otherwise("indexed").alias("status"),
        "evidence", "nodes", "relations", F.coalesce("sheets", F.lit(0)).alias("sheets"), F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("warnings", none).alias("warnings"), "versions", "latest_change", "stale",
    )
    cited = evidence.groupBy(normal_path(F.col("source_location.file")).alias("_key")).agg(F.count("*").alias("evidence"))
    alone = books.join(rows.select("workbook_id").where("workbook_id is not null").distinct(), "workbook_id", "left_anti").withColumn("_key", normal_path(F.col("file_path"))).join(cited, "_key", "left")
    zero = F.lit(0).cast("long")
    rest = alone.select(
        F.col("workbook_id").alias("source_id"), F.coalesce(F.try_element_at(path_parts(F.col("file_path")), F.lit(-1)), F.lit("")).alias("title"), F.col("file_path").alias("path"), F.lit("dirty_excel").alias("source_type"), F.lit("ready").alias("status"),
        F.coalesce("evidence", zero).alias("evidence"), zero.alias("nodes"), zero.alias("relations"), "sheets", "regions", F.coalesce("warnings", none).alias("warnings"), zero.alias("versions"), F.lit(None).cast("string").alias("latest_change"), zero.alias("stale"),
    )
    return known.unionByName(rest)


def with_quotes(impacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Impacts with their evidence quotes, in the order of the ids."""
    long = impacts.select("change_id", "artifact_id", F.posexplode("evidence_ids").alias("_i", "evidence_id")).join(evidence.select("evidence_id", "quote"), "evidence_id")
    q = long.groupBy("change_id", "artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "evidence_id", "quote"))), lambda s: F.struct(s["evidence_id"].alias("evidence_id"), s["quote"].alias("quote"))).alias("quotes"))
    return impacts.join(q, ["change_id", "artifact_id"], "left")


def run_history(runs: DataFrame, impacts: DataFrame) -> DataFrame:
    """Runs with their numbers of candidates."""
    n = impacts.groupBy("run_id").agg(F.count("*").alias("candidates"))
    return runs.join(n, "run_id", "left").fillna(0, ["candidates"])


def decision_board(decisions: DataFrame, impacts: DataFrame) -> DataFrame:
    """Decisions with the impact they are about."""
    i = impacts.select(F.concat(F.lit("impact."), "change_id", F.lit("."), "artifact_id").alias("impact_id"), "display_name", "artifact_type", "review_priority", F.col("reason").alias("impact_reason"), "evidence_ids")
    return decisions.join(i, "impact_id", "left").withColumn("display_name", F.coalesce("display_name", "candidate_node_id"))


QUEUE = ("item_id", "kind", "record_id", "title", "subtitle", "status", "priority", "reason", "evidence_ids")


def review_queue(diffs: DataFrame, proposals: DataFrame, alias_rows: DataFrame, relations: DataFrame, board: DataFrame, stale: DataFrame) -> DataFrame:
    """Six kinds of reviewable records in one table, with the four sort keys as columns rank, priority_rank, kind, title.

    proposals: proposal_id, region_id, status, nodes, edges (counts), evidence_ids, unresolved.
    """
    none = F.array().cast("array<string>")
    pend = lambda c: F.when(c, "should_review").otherwise("may_review")
    d = diffs.select(
        F.concat(F.lit("graph_diff:"), "diff_id").alias("item_id"), F.lit("graph_diff").alias("kind"), F.col("diff_id").alias("record_id"), F.concat(F.lit("Graph diff "), "diff_id").alias("title"), F.concat(F.size("document_ids").cast("string"), F.lit(" source changes")).alias("subtitle"),
        "status", pend(F.col("status") == "pending").alias("priority"), F.when(F.coalesce("reason", F.lit("")) == "", "再取り込みで変化したrelationを確認します。").otherwise(F.col("reason")).alias("reason"), none.alias("evidence_ids"),
    )
    p = proposals.select(
        F.concat(F.lit("proposal:"), "proposal_id").alias("item_id"), F.lit("graph_proposal").alias("kind"), F.col("proposal_id").alias("record_id"), F.concat(F.lit("Region "), "region_id").alias("title"), F.concat(F.col("nodes").cast("string"), F.lit(" nodes / "), F.col("edges").cast("string"), F.lit(" edges")).alias("subtitle"),
        "status", pend(F.col("status") == "pending").alias("priority"), F.lit("抽出nodeとedgeをgraphへ採用するか確認します。").alias("reason"), "evidence_ids",
    )
    m = proposals.select("proposal_id", "region_id", "evidence_ids", F.posexplode("unresolved").alias("i", "mention")).select(
        F.concat(F.lit("mention:"), "proposal_id", F.lit(":"), F.col("i").cast("string")).alias("item_id"), F.lit("unresolved_mention").alias("kind"), F.col("proposal_id").alias("record_id"), F.col("mention").alias("title"), F.concat(F.lit("Region "), "region_id").alias("subtitle"),
        F.lit("needs_investigation").alias("status"), F.lit("may_review").alias("priority"), F.lit("別紙参照、同上、または文脈不足の参照を人間が確認してください。").alias("reason"), "evidence_ids",
    )
    a = alias_rows.select(
        F.concat(F.lit("alias:"), "candidate_id").alias("item_id"), F.lit("alias").alias("kind"), F.col("candidate_id").alias("record_id"), F.col("entity_a_id").alias("title"), F.concat("judgement", F.lit(": "), "entity_b_id").alias("subtitle"),
        "status", pend((F.col("status") == "pending") & F.col("judgement").isin("same", "related")).alias("priority"), "reason", "evidence_ids",
    )
    sr = open_stale(stale, "relation").withColumnRenamed("target_id", "relation_id")
    r = relations.join(sr, "relation_id", "left")
    is_stale = F.col("stale_reason").isNotNull()
    r = r.select(
        F.concat(F.lit("relation:"), "relation_id").alias("item_id"), F.lit("relation").alias("kind"), F.col("relation_id").alias("record_id"), F.col("relation_type").alias("title"), F.concat("source_id", F.lit(" → "), "target_id").alias("subtitle"),
        F.when(is_stale, "stale").otherwise(F.col("status")).alias("status"), pend(is_stale | (F.col("status") == "unconfirmed")).alias("priority"), F.concat_ws(" / ", "extraction_method", "polarity", "match_type").alias("reason"), "evidence_ids",
    )
    si = open_stale(stale, "impact").withColumnRenamed("target_id", "impact_id")
    b = board.join(si, "impact_id", "left").select(
        F.concat(F.lit("impact:"), "impact_id").alias("item_id"), F.lit("impact").alias("kind"), F.col("impact_id").alias("record_id"), F.col("display_name").alias("title"), F.coalesce("artifact_type", F.lit("")).alias("subtitle"),
        F.when(is_stale, "stale").otherwise(F.col("status")).alias("status"), F.coalesce("review_priority", F.lit("may_review")).alias("priority"), F.coalesce("impact_reason", "reason", F.lit("")).alias("reason"), F.coalesce("evidence_ids", none).alias("evidence_ids"),
    )
    q = d
    for part in (p, m, a, r, b):
        q = q.unionByName(part)
    rank = F.when(F.col("status").isin(*OPEN), 0).when(F.col("status") == "needs_investigation", 1).otherwise(2)
    return q.withColumn("rank", rank).withColumn("priority_rank", rank_in(F.col("priority"), ("must_review", "should_review", "may_review")))


def queue_order() -> list:
    return ["rank", "priority_rank", "kind", "title", "item_id"]


def queue_summary(queue: DataFrame) -> DataFrame:
    """Totals by kind, by status and over all, and actionable items, in one grouping-sets pass."""
    queue = queue.withColumn("actionable", F.col("status").isin(*ACTIONABLE).cast("int"))
    g = queue.groupingSets([["kind"], ["status"], []], "kind", "status").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("actionable").alias("actionable"))
    name = F.when(F.col("_g") == 1, "kind").when(F.col("_g") == 2, "status").otherwise("total")
    return g.select(name.alias("by"), F.coalesce("kind", "status", F.lit("all")).alias("name"), "n", F.coalesce("actionable", F.lit(0)).alias("actionable"))


def inspect(df: DataFrame, wanted: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Records by (name), which is an id or any unique name of an index."""
    w = wanted.join(index, "name", "left").select("name", F.coalesce(F.when(F.size("ids") == 1, F.element_at("ids", 1)), F.col("name")).alias(key)).distinct()
    return df.join(w, key)


def document_context(nodes: DataFrame, documents: DataFrame, most: int = 30) -> DataFrame:
    """(document_id, node_type, names): the first names of artifacts and entities of documents (a limit of the report)."""
    long = nodes.select("node_type", "display_name", F.explode("source_document_ids").alias("document_id")).join(documents.select("document_id"), "document_id", "left_semi").distinct()
    order = Window.partitionBy("document_id", "node_type").orderBy("display_name")
    top = long.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return top.groupBy("document_id", "node_type").agg(F.array_sort(F.collect_list("display_name")).alias("names"))


def region_listing(regions: DataFrame, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Regions without revision blocks, paged."""
    return page(regions.where("region_type <> 'revision_history'").select("region_id", "sheet_name", "range", "region_type"), ["region_id"], offset, limit)


def change_session(atoms: DataFrame, impacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per change its atoms, impacts and decisions side by side."""
    a = atoms.groupBy("change_id").agg(F.array_sort(F.collect_list("atom_id")).alias("atoms"))
    i = impacts.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("artifact_id", "review_priority"))).alias("impacts"))
    d = decisions.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("impact_id", "status"))).alias("decisions"))
    return a.join(i, "change_id", "full_outer").join(d, "change_id", "full_outer")
