"""Impact analysis by change atoms: seeds, bounded reverse search, verification, hypotheses, decisions.

Ties that the semantics leave open are settled by fewest hops, then seed id, then relation ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EDGE, any_of, lines_of, rank_in, short_hash, strip
from ..functions.containment import pairs_within
from ..functions.firsts import first_relations
from ..functions.lineage import cut
from .impact import PRIORITIES

# Relation types that are followed, by the depth at which a path that ends on them stops.
EXPAND = (
    "DEFINES", "DISPLAYS", "VALIDATES", "REQUEST_FIELD", "RESPONSE_FIELD", "READS", "WRITES", "SENDS", "RECEIVES", "CALLS", "COVERS", "MENTIONS",
    "contains", "displays", "accepts_input", "validates", "calls", "reads", "writes", "maps_to", "sends", "receives", "tested_by", "depends_on", "may_affect",
)
DEPTH_ONE = ("MENTIONS",)
DEPTH_THREE = ("DEFINES", "DISPLAYS", "VALIDATES", "REQUEST_FIELD", "SENDS", "COVERS")
# Characters and words of the change patterns.
_WORD = "0-9A-Za-z一-龥ぁ-んァ-ヶ万円"
_PROPERTY = "上限|下限|桁数|必須|方式|値"
PATTERNS = (
    rf"(?s)[「\"]([^」\"]+)[」\"].*?({_PROPERTY}).*?([{_WORD}]+)から([{_WORD}]+)",
    rf"(?s)([一-龥ぁ-んァ-ヶA-Za-z0-9_]+).*?({_PROPERTY}).*?([{_WORD}]+)から([{_WORD}]+)",
    r"(?s)([A-Za-z_][A-Za-z0-9_]+)(.*?)([0-9]+).*?([0-9]+)",  # the second group only keeps the places of the others
)
LIMIT_NAMES = ("requestedCreditLimit", "REQUESTED_CREDIT_LIMIT", "LIMIT_AMT")
DECISION_STATUSES = ("unreviewed", "accepted", "rejected", "not_applicable", "needs_investigation")


def _strip(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+\z", "")


def change_atoms(changes: DataFrame) -> DataFrame:
    """B1: one atom per change (change_id, body): the first pattern that matches, else the first line."""
    body = F.coalesce(F.col("body"), F.lit(""))
    df = changes.select("change_id", body.alias("body"), F.regexp_replace(body, "\n", " ").alias("text"))
    # a pattern has matched where its first group is not empty; each is tried only where what it needs occurs, as a search in vain takes the square of the text's length
    text = F.col("text")
    said = text.contains("から") & any_of([text.contains(w) for w in _PROPERTY.split("|")])
    part = lambda i, g: F.regexp_extract("text", PATTERNS[i], g)
    df = df.withColumn("_0", F.when(said & (text.contains("」") | text.contains('"')), part(0, 1)).otherwise(""))
    df = df.withColumn("_1", F.when(said & (F.col("_0") == ""), part(1, 1)).otherwise(""))
    df = df.withColumn("_2", F.when((F.col("_0") == "") & (F.col("_1") == "") & text.rlike("[0-9][^0-9]*[0-9]"), part(2, 1)).otherwise(""))
    hit = lambda i: F.col(f"_{i}") != ""
    pick = lambda g: F.when(hit(0), part(0, g)).when(hit(1), part(1, g)).when(hit(2), part(2, g))
    first = F.when(hit(0), F.col("_0")).when(hit(1), F.col("_1")).when(hit(2), F.col("_2"))
    label = F.when(hit(0), part(0, 2)).when(hit(1), part(1, 2)).otherwise("")
    first_line = F.get(F.filter(lines_of(F.col("body")), lambda s: strip(s) != ""), F.lit(0))
    plain = strip(F.regexp_replace(first_line, "^[# ]+", ""))
    matched = first.isNotNull()
    df = df.withColumn("target", F.when(matched, _strip(first, " の")).otherwise(F.coalesce(plain, F.substring("body", 1, 40)))).withColumn("label", label)
    prop = (
        F.when(F.col("label").contains("上限"), "max_value")
        .when(F.col("label").contains("下限"), "min_value")
        .when(F.col("label").contains("桁"), "length")
        .when(F.col("label").contains("必須"), "required")
        .when(F.col("label").contains("方式"), "method")
    )
    df = df.withColumn("property", F.when(matched, prop)).withColumn("before", F.when(matched, _strip(pick(3), " をに、。"))).withColumn("after", F.when(matched, _strip(pick(4), " をに、。")))
    none = F.array().cast("array<string>")
    names = lambda word, pattern: F.when(text.contains(word), F.regexp_extract_all("text", F.lit(rf"{EDGE}{pattern}{EDGE}"), F.lit(0))).otherwise(none)
    terms = F.concat(
        F.array("target"),
        names("Limit", "[A-Za-z][A-Za-z0-9_]*Limit[A-Za-z0-9_]*"),
        names("LIMIT", "[A-Z][A-Z0-9_]*LIMIT[A-Z0-9_]*"),
        F.when(F.col("target").contains("限度") | F.col("text").contains("限度"), F.array(*map(F.lit, LIMIT_NAMES))).otherwise(none),
    )
    key = F.when(matched, F.concat("change_id", "target", F.coalesce("before", F.lit("None")), F.coalesce("after", F.lit("None")))).otherwise(F.concat("change_id", "target"))
    operation = F.when(F.col("property").isin("max_value", "min_value", "length"), "change_constraint").otherwise("change_spec")
    return df.select(F.concat(F.lit("atom."), short_hash(key)).alias("atom_id"), "change_id", F.array_distinct(terms).alias("target_terms"), operation.alias("operation"), "property", "before", "after")


def replace_atoms(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """B2: a change's atoms are replaced as a whole."""
    return current.join(incoming.select("change_id").distinct(), "change_id", "left_anti").unionByName(incoming)


def atom_counts(atoms: DataFrame) -> DataFrame:
    """B2: atoms per change."""
    return atoms.groupBy("change_id").agg(F.count("*").alias("atoms"))


def seed_entities(atoms: DataFrame, names: DataFrame) -> DataFrame:
    """(change_id, entity_id): a term within a name or a name within a term, underscores and case aside.

    Folding goes by characters, so what contains a text also contains it folded. A text of underscores
    alone is folded to nothing and lies within every other.
    """
    fold = lambda c: F.regexp_replace(F.lower(c), "_", "")
    terms = atoms.select("change_id", F.explode("target_terms").alias("term")).where("term <> ''").select("change_id", fold(F.col("term")).alias("term")).distinct()
    known = names.where("name <> ''").select("entity_id", fold(F.col("name")).alias("name")).distinct()
    terms, known = cut(terms), cut(known)
    t, n = terms.select(F.col("term").alias("text")), known.select(F.col("name").alias("text"))
    pairs = pairs_within(t, n).select(F.col("inner").alias("term"), F.col("outer").alias("name")).unionByName(pairs_within(n, t).select(F.col("outer").alias("term"), F.col("inner").alias("name")))
    out = terms.join(pairs.distinct(), "term").join(known, "name").select("change_id", "entity_id")
    for one, other in ((terms.where("term = ''"), known), (known.where("name = ''"), terms)):
        if one.limit(1).count():
            out = out.unionByName(one.crossJoin(other).select("change_id", "entity_id"))  # all of them by definition
    return out.distinct()


def seeds_from_evidence(atoms: DataFrame, seeds: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """For changes without B3 seeds, targets of relations whose evidence quotes a term or the before value."""
    left = atoms.join(seeds.select("change_id").distinct(), "change_id", "left_anti")
    terms = cut(left.select("change_id", F.explode(F.array_union("target_terms", F.array(F.coalesce("before", F.lit(""))))).alias("term")).where("term <> ''").distinct())
    pairs = pairs_within(terms.select(F.col("term").alias("text")), evidence.select(F.col("quote").alias("text")))
    quoted = terms.join(pairs.select(F.col("inner").alias("term"), F.col("outer").alias("quote")), "term").select("change_id", "quote").distinct()
    hit = evidence.select("evidence_id", "quote").join(quoted, "quote").select("change_id", "evidence_id").distinct()
    long = relations.select("target_id", F.explode("evidence_ids").alias("evidence_id"))
    return hit.join(long, "evidence_id").select("change_id", F.col("target_id").alias("entity_id")).distinct()


def depth_of(relation_type: Column) -> Column:
    return F.when(relation_type.isin(*DEPTH_ONE), 1).when(relation_type.isin(*DEPTH_THREE), 3).otherwise(2)


def reached_nodes(seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """(change_id, node_id, hops, seed, relation_ids): the shortest way from a seed to each node against
    the direction of relations, at most three hops. A node is recorded over any followed relation but
    expanded only if the path is shorter than the depth of the relation just used.

    Only ids travel. One best path per change, node and hop goes on, and a hop orders its paths by the
    place of the path before among its change's and the relation, so the table never grows by the number of paths.
    """
    edge = relations.where(F.col("relation_type").isin(*EXPAND) & (F.col("status") != "rejected")).select(
        F.col("target_id").alias("node_id"), F.col("source_id").alias("next_id"), "relation_id", depth_of(F.col("relation_type")).alias("depth")
    )
    frontier = seeds.select("change_id", F.col("entity_id").alias("node_id"), F.col("entity_id").alias("seed"), F.array().cast("array<string>").alias("relation_ids")).distinct()
    frontier = cut(frontier.withColumn("place", F.struct("seed", F.lit("").alias("relation_id"))))
    visited = frontier.select("change_id", "node_id")
    found = None
    for hop in (1, 2, 3):
        walked = frontier.select("change_id", "node_id", "place").join(edge, "node_id").select(
            "change_id", F.col("node_id").alias("last_id"), F.col("next_id").alias("node_id"), F.struct("place", "relation_id").alias("way"), (F.lit(hop) < F.col("depth")).alias("goes_on")
        )
        row = F.struct("way", "last_id")
        best = walked.groupBy("change_id", "node_id").agg(F.min(row).alias("b"), F.min(F.when(F.col("goes_on"), row)).alias("e"))
        best = cut(best) if hop < 3 else best
        before = frontier.select("change_id", F.col("node_id").alias("last_id"), "seed", F.col("relation_ids").alias("_before"))

        def told(rows: DataFrame, c: str, before: DataFrame = before) -> DataFrame:
            r = rows.select("change_id", "node_id", F.col(f"{c}.last_id").alias("last_id"), F.col(f"{c}.way").alias("way"))
            ids = F.concat("_before", F.array("way.relation_id"))
            return r.join(before, ["change_id", "last_id"]).select("change_id", "node_id", "seed", ids.alias("relation_ids"), "way")

        new = best.select("change_id", "node_id", "b")
        new = new if found is None else new.join(found.select("change_id", "node_id"), ["change_id", "node_id"], "left_anti")
        rows = told(new, "b").select("change_id", "node_id", F.lit(hop).alias("hops"), "seed", "relation_ids")
        found = rows if found is None else found.unionByName(rows)
        if hop < 3:
            ahead = told(best.where("e is not null").join(visited, ["change_id", "node_id"], "left_anti"), "e")
            order = Window.partitionBy("change_id").orderBy("way")
            place = F.struct(F.lpad(F.row_number().over(order).cast("string"), 12, "0").alias("seed"), F.lit("").alias("relation_id"))
            frontier = cut(ahead.select("change_id", "node_id", "seed", "relation_ids", place.alias("place")))
            visited = visited.unionByName(frontier.select("change_id", "node_id"))
    return found


def with_paths(found: DataFrame, relations: DataFrame) -> DataFrame:
    """Reached nodes with their path (relations in order) and the evidence of all of it."""
    step = F.struct("relation_id", "relation_type", "source_id", "target_id", "polarity", "status")
    r = relations.select("relation_id", step.alias("step"), "evidence_ids")
    out, none = found, F.array().cast("array<string>")
    steps, ids = [], []
    for i in range(3):
        side = r.select(F.col("relation_id").alias(f"_r{i}"), F.col("step").alias(f"_s{i}"), F.col("evidence_ids").alias(f"_e{i}"))
        out = out.join(side, F.get("relation_ids", F.lit(i)) == F.col(f"_r{i}"), "left")
        steps.append(F.col(f"_s{i}"))
        ids.append(F.coalesce(f"_e{i}", none))
    return out.select("change_id", "node_id", "hops", "seed", F.array_compact(F.array(*steps)).alias("path"), F.array_sort(F.array_distinct(F.concat(*ids))).alias("evidence_ids"))


def bounded_search(seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """(change_id, node_id, hops, seed, path, evidence_ids) of the reached nodes."""
    return with_paths(reached_nodes(seeds, relations), relations)


def _fits(prop: Column, kind: Column) -> Column:
    tokens = any_of([F.lower(kind).contains(t) for t in ("field", "validation", "column", "api", "screen", "test", "external")])
    bound = F.lower(prop).isin("max_value", "min_value", "length", "required")
    return F.when(prop.isNull() | (prop == "") | kind.isNull() | (kind == ""), True).when(bound, tokens).otherwise(True)


def verify(paths: DataFrame, atoms: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Paths to artifacts with verdict and verdict_reason, from the polarity of the path and the quotes on it.

    A change of several atoms is judged by the first one that was submitted (column `seq`, where atoms have it).
    Each quote is read once per change that asks for it and reduced to two booleans before the paths come back.
    """
    order = F.struct(*[c for c in ("seq", "atom_id") if c in atoms.columns])
    atom = atoms.groupBy("change_id").agg(F.min_by(F.struct("target_terms", "before", "after", "property", "operation"), order).alias("atom"))
    p = paths.join(artifacts.select(F.col("artifact_id").alias("node_id"), "display_name", "artifact_type"), "node_id").join(atom, "change_id")
    rows = p.select("change_id", "node_id", F.explode("evidence_ids").alias("evidence_id"))
    asked = rows.select("change_id", "evidence_id").distinct().join(atom, "change_id").join(evidence.select("evidence_id", "quote"), "evidence_id")
    term = F.exists("atom.target_terms", lambda t: (t != "") & F.col("quote").contains(t))
    was = F.coalesce((F.col("atom.before") != "") & F.col("quote").contains(F.col("atom.before")), F.lit(False))
    said = asked.groupBy("change_id", "evidence_id").agg(F.bool_or(term).alias("term"), F.bool_or(was).alias("was"))
    facts = rows.join(said, ["change_id", "evidence_id"]).groupBy("change_id", "node_id").agg(F.bool_or("term").alias("term"), F.bool_or("was").alias("was"))
    j = p.join(facts, ["change_id", "node_id"], "left")
    explicit = F.exists("path", lambda s: s["polarity"] == "explicit")
    inferred = F.forall("path", lambda s: s["polarity"] == "inferred")
    needs = any_of([F.lower("artifact_type").contains(t) for t in ("validation", "test")])
    before = F.coalesce(F.col("atom.before") != "", F.lit(False))
    case = (
        F.when(F.col("term").isNull(), F.struct(F.lit("hidden"), F.lit("No graph path with persisted evidence was found.")))
        .when(explicit & (F.col("term") | F.col("was")) & ~_fits(F.col("atom.property"), F.col("artifact_type")), F.struct(F.lit("should_review"), F.lit("Evidence exists, but change property and artifact type are weakly related.")))
        .when(explicit & (F.col("term") | F.col("was")) & before & ~F.col("was") & needs, F.struct(F.lit("should_review"), F.lit("Target evidence exists, but the before value was not found.")))
        .when(explicit & (F.col("term") | F.col("was")), F.struct(F.lit("must_review"), F.lit("Direct evidence and graph path were found.")))
        .when(inferred & ~F.col("term"), F.struct(F.lit("may_review"), F.lit("Only inferred relations connected this candidate.")))
        .when(explicit, F.struct(F.lit("should_review"), F.lit("Graph path exists, but direct term evidence is weak.")))
        .otherwise(F.struct(F.lit("may_review"), F.lit("Semantic or inferred relation exists with weak grounding.")))
    )
    return j.withColumn("_v", case).select(*p.columns, F.col("_v.col1").alias("verdict"), F.col("_v.col2").alias("verdict_reason"))


def apply_prior_decisions(verified: DataFrame, decisions: DataFrame, order: str = "updated_at") -> DataFrame:
    """The last accepted or rejected decision on a node moves the verdict by one step."""
    last = decisions.where(F.col("status").isin("accepted", "rejected")).groupBy(F.col("candidate_node_id").alias("node_id")).agg(F.max_by("status", F.struct(order, "impact_id")).alias("_d"))
    v, d = F.col("verdict"), F.col("_d")
    new = F.when((d == "accepted") & (v == "may_review"), "should_review").when((d == "rejected") & (v == "must_review"), "should_review").when((d == "rejected") & (v == "should_review"), "may_review").otherwise(v)
    return verified.join(last, "node_id", "left").withColumn("verdict", new).drop("_d").select(verified.columns)


def lower_by_suggestion(verdict: Column, suggestion: Column) -> Column:
    """A model's suggestion may lower a priority, never raise it."""
    return F.when(rank_in(suggestion, PRIORITIES) > rank_in(verdict, PRIORITIES), suggestion).otherwise(verdict)


def hypotheses(verified: DataFrame) -> DataFrame:
    """Impact rows of everything that is not hidden: strength, assessment, reason, path text, actions and type."""
    terms = F.array_join("atom.target_terms", ", ")
    change = F.when(F.coalesce(F.col("atom.before"), F.col("atom.after")).isNotNull(), F.concat(F.lit(" ("), F.coalesce("atom.before", F.lit("?")), F.lit(" -> "), F.coalesce("atom.after", F.lit("?")), F.lit(")"))).otherwise("")
    types = F.array_join(F.transform("path", lambda s: s["relation_type"]), " -> ")
    text = F.array_join(F.concat(F.array(F.concat(F.lit("change:"), F.array_join("atom.target_terms", ","))), F.transform("path", lambda s: F.concat(s["source_id"], F.lit(" -"), s["relation_type"], F.lit("-> "), s["target_id"]))), " <- ")
    strength = F.when(F.col("verdict") == "must_review", "strong").when(F.col("verdict") == "should_review", "medium").otherwise("weak")
    kind = F.when(F.col("atom.operation") == "change_constraint", "constraint_change").when(F.coalesce("atom.operation", F.lit("")) != "", F.col("atom.operation")).otherwise("review")
    return verified.where("verdict <> 'hidden'").select(
        "change_id", F.col("node_id").alias("artifact_id"), "display_name", "artifact_type", F.col("verdict").alias("review_priority"), strength.alias("evidence_strength"),
        F.when(F.col("verdict") == "must_review", "exact").otherwise("semantic").alias("match_type"), F.col("hops").alias("relation_distance"),
        F.when(F.exists("path", lambda s: s["polarity"] == "explicit"), "explicit_relation").otherwise("inferred_relation").alias("rule_assessment"),
        F.concat(terms, change, F.lit(": "), "verdict_reason", F.lit(" Relation path: "), types, F.lit(".")).alias("reason"),
        F.array(text).alias("relation_paths"), "evidence_ids", F.array_sort(F.array_distinct(F.transform("path", lambda s: s["status"]))).alias("relation_statuses"),
        kind.alias("impact_type"), F.array(_action()).alias("required_actions"),
    )


def _action() -> Column:
    """Default action by property and artifact type."""
    # The texts of the default actions.
    name, kind, after = F.col("display_name"), F.lower("artifact_type"), F.col("atom.after")
    target = F.array_join(F.slice("atom.target_terms", 1, 3), ", ")
    target = F.when(target == "", name).otherwise(target)
    of = lambda text: F.concat(name, F.lit(" の "), target, F.lit(text))

    def by_type(action: Column) -> Column:
        return (
            F.when(kind.contains("test"), F.concat(name, F.lit(" の境界値テストを "), target, F.lit(" の変更後条件に合わせて更新する")))
            .when(kind.contains("validation"), F.concat(name, F.lit(" の "), target, F.lit(" "), action))
            .when(kind.contains("api"), of(" API項目仕様と桁数/型を確認する"))
            .when(kind.contains("column") | kind.contains("table"), of(" DB定義、桁数、制約を確認する"))
            .when(kind.contains("external"), of(" 外部IF送受信項目を確認する"))
            .when(kind.contains("screen"), of(" 表示、入力、エラーメッセージを確認する"))
            .otherwise(F.concat(name, F.lit(" の "), target, F.lit(" "), action))
        )

    has, prop = F.coalesce(after, F.lit("")) != "", F.col("atom.property")
    out = F.when(kind.contains("test"), F.concat(name, F.lit(" のテスト観点が変更対象 "), target, F.lit(" をカバーするか確認する"))).otherwise(F.concat(name, F.lit(" が変更対象 "), target, F.lit(" に関係するか確認する")))
    out = F.when(prop == "required", by_type(F.lit("必須/任意条件を確認する"))).otherwise(out)
    for value, text in (("length", "桁数"), ("min_value", "下限値"), ("max_value", "上限値")):
        out = F.when((prop == value) & has, by_type(F.concat(F.lit(f"{text}を "), after, F.lit(" に合わせて確認する")))).otherwise(out)
    return out


def candidate_subgraph(paths: DataFrame, relations: DataFrame, limit: int = 40) -> DataFrame:
    """(change_id, node_id, relations, nodes, evidence): path relations first, then relations that touch the path, up to `limit` in all (a limit of the report).

    Of a node no more than `limit` relations can come up beside the three of the path, so each node gives its first ones."""
    on_path = paths.select("change_id", "node_id", F.posexplode("path").alias("_i", "s")).select("change_id", "node_id", F.col("s.relation_id").alias("relation_id"), F.lit(0).alias("_k"), F.col("_i"))
    nodes = paths.select("change_id", "node_id", F.explode(F.array_union(F.array("node_id"), F.flatten(F.transform("path", lambda s: F.array(s["source_id"], s["target_id"]))))).alias("_n")).distinct()
    touch = nodes.join(first_relations(relations, limit + 3).withColumnRenamed("node", "_n"), "_n").select("change_id", "node_id", "relation_id", F.lit(1).alias("_k"), F.lit(0).alias("_i"))
    both = on_path.unionByName(touch).groupBy("change_id", "node_id", "relation_id").agg(F.min(F.struct("_k", "_i")).alias("_o"))
    order = Window.partitionBy("change_id", "node_id").orderBy("_o", "relation_id")
    top = both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
    r = top.join(relations.select("relation_id", "source_id", "target_id", "evidence_ids"), "relation_id")
    return r.groupBy("change_id", "node_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "relation_id"))), lambda s: s["relation_id"]).alias("relations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("source_id", "target_id"))))).alias("nodes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence"),
    )


def seed_decisions(impacts: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Decision rows for impacts that have none."""
    new = impacts.select(F.concat(F.lit("impact."), "change_id", F.lit("."), "artifact_id").alias("impact_id"), "change_id", F.col("artifact_id").alias("candidate_node_id"))
    new = new.distinct().join(decisions.select("impact_id"), "impact_id", "left_anti")
    return decisions.unionByName(new.select("impact_id", "change_id", "candidate_node_id", F.lit("unreviewed").alias("status"), F.lit("").alias("reason"), F.lit(now).alias("updated_at")).select(decisions.columns))


def set_impact_status(decisions: DataFrame, updates: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Keyed status updates (impact_id, status, reason); rows with an unknown status or id come back apart."""
    ok = updates.where(F.col("status").isin(*DECISION_STATUSES)).join(decisions.select("impact_id"), "impact_id", "left_semi")
    new = ok.select("impact_id", F.col("status").alias("_s"), F.col("reason").alias("_r"))
    out = decisions.join(new, "impact_id", "left").withColumn("updated_at", F.when(F.col("_s").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")))
    out = out.withColumn("status", F.coalesce("_s", "status")).withColumn("reason", F.coalesce("_r", "reason")).select(decisions.columns)
    return out, updates.exceptAll(ok)


def impact_context(paths: DataFrame, evidence: DataFrame, limit: int = 100) -> DataFrame:
    """Per change its first `limit` candidates with their quotes, for an offline model (a limit of the report)."""
    order = Window.partitionBy("change_id").orderBy("hops", "node_id")
    top = paths.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    ev = top.select("change_id", "node_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "quote"), "evidence_id")
    quotes = ev.groupBy("change_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "quote"))).alias("evidence"))
    return top.join(quotes, ["change_id", "node_id"], "left").groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("_n", "node_id", "hops", "evidence"))).alias("candidates"))


def region_context(cells: DataFrame) -> DataFrame:
    """Cells of each region (region_id, row, column, cell, value) in reading order."""
    return cells.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("row", "column", "cell", "value"))).alias("cells"))


def check_submission(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reasons why rows of submitted answers fail (submission_id, change_id, node_id, evidence_ids, relation_ids).

    One failing row rejects its whole submission. candidates: change_id, node_id, evidence, relations.
    """
    c = candidates.select("change_id", "node_id", F.col("evidence").alias("_ev"), F.col("relations").alias("_re"), F.lit(True).alias("_known"))
    j = answers.join(c, ["change_id", "node_id"], "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull(), "unknown_node"),
            F.when(F.col("_known") & (F.size(F.array_except("evidence_ids", "_ev")) > 0), "foreign_evidence"),
            F.when(F.col("_known") & (F.size(F.array_except("relation_ids", "_re")) > 0), "foreign_relation"),
            F.when(F.size("evidence_ids") == 0, "no_evidence"),
        )
    )
    w = Window.partitionBy("submission_id")
    out = j.withColumn("problems", problems).withColumn("rejected", F.bool_or(F.size("problems") > 0).over(w))
    return out.select(*answers.columns, "problems", "rejected")


def check_atoms(atoms: DataFrame, changes: DataFrame) -> DataFrame:
    """Submitted atoms with the reasons they fail: unknown change, or before / after not in its text."""
    c = changes.select("change_id", F.concat_ws("\n", "title", "body").alias("_text"))
    j = atoms.join(c, "change_id", "left")
    missing = lambda v: F.coalesce(F.col(v), F.lit("")) != ""
    problems = F.array_compact(
        F.array(
            F.when(F.col("_text").isNull(), "unknown_change"),
            *[F.when(missing(v) & ~F.col("_text").contains(F.col(v)), f"{v}_not_in_text") for v in ("before", "after")],
            F.when(F.size("target_terms") == 0, "no_terms"),
        )
    )
    return j.withColumn("problems", problems).drop("_text")
