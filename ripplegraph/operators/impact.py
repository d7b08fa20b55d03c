"""Impact analysis by rules: changed entities, two hops over relations, priorities, merging, traces.

Hop 2 reads the result of hop 1 as it was, so that the answer does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rank_in, sorted_union
from ..functions.containment import pairs_within
from ..functions.lineage import cut

# Priorities, and the relation types that give them.
PRIORITIES = ("must_review", "should_review", "may_review", "hidden")
MUST = ("DEFINES", "WRITES", "VALIDATES", "SENDS", "REQUEST_FIELD")
SHOULD = ("READS", "DISPLAYS", "RESPONSE_FIELD", "COVERS", "CALLS")


def priority(relation_type: Column, polarity: Column, status: Column) -> Column:
    """I4: review priority that a relation gives."""
    guessed = (polarity == "inferred") & (status != "confirmed")
    return (
        F.when(guessed | (relation_type == "MENTIONS"), "may_review")
        .when(relation_type.isin(*MUST), "must_review")
        .when(relation_type.isin(*SHOULD), "should_review")
        .otherwise("may_review")
    )


def llm_only(methods: Column) -> Column:
    return methods == F.array(F.lit("llm"))


def names_of(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(entity_id, name): display name and aliases of the entities that rules found."""
    out = entities.where(~llm_only(F.col("extraction_methods"))).select("entity_id", F.explode(F.array_union(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    if aliases is not None:
        known = entities.where(~llm_only(F.col("extraction_methods"))).select("entity_id")
        out = out.unionByName(aliases.join(known, F.col("item_id") == F.col("entity_id")).select("entity_id", F.col("alias").alias("name")))
    return out.where("name is not null and name <> ''").distinct()


def changed_entities(changes: DataFrame, names: DataFrame) -> DataFrame:
    """(change_id, entity_id) of entities of which a name occurs in title and body; names meet texts through their rarest characters."""
    text = changes.select("change_id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"))
    found = pairs_within(names.select(F.col("name").alias("text")), text)
    named = found.join(text, F.col("outer") == F.col("text")).select("change_id", F.col("inner").alias("name"))
    return named.join(names, "name").select("change_id", "entity_id").distinct()


IMPACT = ["change_id", "artifact_id", "display_name", "artifact_type", "review_priority", "evidence_strength", "match_type", "relation_distance", "rule_assessment", "reason", "relation_paths", "evidence_ids", "relation_statuses"]


def direct(changed: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The changed entities themselves; one that only a model found, without a confirmed relation, may be reviewed."""
    sure = relations.where("status = 'confirmed'").select(F.col("target_id").alias("entity_id"), F.lit(True).alias("_sure")).distinct()
    e = changed.join(entities.select("entity_id", "display_name", "entity_type", "extraction_methods"), "entity_id").join(sure, "entity_id", "left")
    weak = llm_only(F.col("extraction_methods")) & F.col("_sure").isNull()
    return e.select(
        "change_id",
        F.col("entity_id").alias("artifact_id"),
        "display_name",
        F.col("entity_type").alias("artifact_type"),
        F.when(weak, "may_review").otherwise("must_review").alias("review_priority"),
        F.when(weak, "weak").otherwise("strong").alias("evidence_strength"),
        F.when(weak, "semantic").otherwise("exact").alias("match_type"),
        F.lit(0).alias("relation_distance"),
        F.when(weak, "inferred_relation").otherwise("direct_match").alias("rule_assessment"),
        F.when(weak, "An unconfirmed LLM-only entity was matched.").otherwise(F.concat(F.lit("変更依頼が "), "display_name", F.lit(" を直接参照しているため。"))).alias("reason"),
        F.array(F.concat(F.lit("change -> "), "entity_id")).alias("relation_paths"),
        F.array().cast("array<string>").alias("evidence_ids"),
        F.array().cast("array<string>").alias("relation_statuses"),
    )


def hop1(changed: DataFrame, relations: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates by relations into a changed entity, one row per relation; and the rejected relations."""
    r = relations.join(changed.withColumnRenamed("entity_id", "target_id"), "target_id").join(
        artifacts.select(F.col("artifact_id").alias("source_id"), "display_name", "artifact_type"), "source_id"
    )
    rejected = r.where("status = 'rejected'").select("change_id", F.col("source_id").alias("artifact_id"), "relation_id")
    ok = r.where("status <> 'rejected'").withColumn("_p", priority(F.col("relation_type"), F.col("polarity"), F.col("status")))
    kind = F.when(F.col("relation_type") == "MENTIONS", "alias_mention").when(F.col("polarity") == "inferred", "inferred_relation").otherwise("explicit_relation")
    found = ok.select(
        "change_id",
        F.col("source_id").alias("artifact_id"),
        "display_name",
        "artifact_type",
        F.col("_p").alias("review_priority"),
        F.when(F.col("_p") == "may_review", "weak").when(F.col("_p") == "must_review", "strong").otherwise("medium").alias("evidence_strength"),
        "match_type",
        F.lit(1).alias("relation_distance"),
        kind.alias("rule_assessment"),
        F.concat("relation_type", F.lit(" relation with explicit local evidence was found.")).alias("reason"),
        F.array(F.concat(F.lit("change -> "), "target_id", F.lit(" <- "), "relation_type", F.lit(" - "), "source_id")).alias("relation_paths"),
        "evidence_ids",
        F.array("status").alias("relation_statuses"),
        F.col("relation_id").alias("_seq"),
    )
    return found, rejected


def merge(candidates: DataFrame) -> DataFrame:
    """One impact per change and artifact. The best priority brings strength and assessment, the
    nearest candidate gives reason and distance, arrays are united, any exact match counts."""
    rank = rank_in(F.col("review_priority"), PRIORITIES)
    first = F.struct("relation_distance", F.coalesce("_seq", F.lit("")).alias("_seq"))
    g = candidates.withColumn("_first", first).withColumn("_best", F.struct(rank.alias("rank"), first.alias("at"))).groupBy("change_id", "artifact_id").agg(
        F.min_by(F.struct("display_name", "artifact_type", "reason", "relation_distance", "match_type"), "_first").alias("f"),
        F.min_by(F.struct("review_priority", "evidence_strength", "rule_assessment"), "_best").alias("b"),
        sorted_union(F.col("relation_paths")).alias("relation_paths"),
        sorted_union(F.col("evidence_ids")).alias("evidence_ids"),
        sorted_union(F.col("relation_statuses")).alias("relation_statuses"),
        F.bool_or(F.col("match_type") == "exact").alias("exact"),
    )
    return g.select(
        "change_id", "artifact_id", "f.display_name", "f.artifact_type", "b.review_priority", "b.evidence_strength",
        F.when(F.col("exact"), "exact").otherwise(F.col("f.match_type")).alias("match_type"),
        "f.relation_distance", "b.rule_assessment", "f.reason", "relation_paths", "evidence_ids", "relation_statuses",
    )


def hop2(near: DataFrame, relations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Candidates by relations into anything found so far, changed entities included; paths are extended."""
    n = near.select("change_id", F.col("artifact_id").alias("target_id"), F.element_at("relation_paths", 1).alias("_path"), F.col("evidence_ids").alias("_ev"), F.col("relation_statuses").alias("_st"))
    r = relations.where("status <> 'rejected'").join(n, "target_id").join(artifacts.select(F.col("artifact_id").alias("source_id"), "display_name", "artifact_type"), "source_id")
    guessed = (F.col("polarity") == "inferred") & (F.col("status") != "confirmed")
    return r.select(
        "change_id",
        F.col("source_id").alias("artifact_id"),
        "display_name",
        "artifact_type",
        F.when(guessed, "may_review").otherwise("should_review").alias("review_priority"),
        F.when(guessed, "weak").otherwise("medium").alias("evidence_strength"),
        "match_type",
        F.lit(2).alias("relation_distance"),
        F.lit("explicit_relation").alias("rule_assessment"),
        F.lit("A two-hop explicit relation path to the changed entity was found.").alias("reason"),
        F.array(F.concat("_path", F.lit(" <- "), "relation_type", F.lit(" - "), "source_id")).alias("relation_paths"),
        F.concat("_ev", "evidence_ids").alias("evidence_ids"),  # merge() makes sets of them, once for each impact
        F.array_union("_st", F.array("status")).alias("relation_statuses"),
        F.concat(F.lit("~"), "relation_id", F.lit("|"), "target_id").alias("_seq"),
    )


def analyse(changes: DataFrame, entities: DataFrame, artifacts: DataFrame, relations: DataFrame, aliases: DataFrame | None = None, hops: int = 2, semantic: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Impacts of every change, and its rejected relations. `semantic` are further candidates."""
    changed = cut(changed_entities(changes, names_of(entities, aliases)))
    one, rejected = hop1(changed, relations, artifacts)
    found = cut(direct(changed, entities, relations).withColumn("_seq", F.lit("")).unionByName(one))
    near = merge(found)
    if hops >= 2:
        near = cut(near)  # hop 2 reads it as it is
        found = found.unionByName(hop2(near, relations, artifacts))
    if semantic is not None:
        found = found.unionByName(semantic)
    return (merge(found) if hops >= 2 or semantic is not None else near), rejected


def node_bits(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, word, bit): every artifact is one bit of a 64-bit word; neighbours in the order of ids share words."""
    rows = artifacts.select("artifact_id").distinct().repartitionByRange("artifact_id").sortWithinPartitions("artifact_id").withColumn("n", F.monotonically_increasing_id())
    return cut(rows.select("artifact_id", F.shiftright("n", 6).alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bit")))


#: Values that a graph's relations have; masks are kept for each of them.
DOMAIN = 4


def _domain(relations: DataFrame, most: int = DOMAIN) -> tuple[list[str], list[str]]:
    """Statuses and match types of relations that are followed (each at most `most`, else an error), exact first."""
    out = []
    for name in ("status", "match_type"):
        found = sorted(r[0] for r in relations.where(F.col("status") != "rejected").select(name).where(f"{name} is not null").distinct().limit(most + 1).collect())
        if len(found) > most:
            raise ValueError(f"more than {most} values of {name}: {found}")
        out.append(found)
    return out[0], sorted(out[1], key=lambda v: (v != "exact", v))


def _hop2_masks(near: DataFrame, relations: DataFrame, bits: DataFrame, statuses: list[str], types: list[str]) -> DataFrame:
    """I5 in masks: (change_id, word, should, may, t0.., s0..), a bit for each artifact that a second hop reaches with that property.

    A target's artifacts are gathered once, as words; a change unites the words of what it has reached, so a hub
    sends a 64th of its neighbours at most, and no path or evidence travels.
    """
    guessed = (F.col("polarity") == "inferred") & (F.col("status") != "confirmed")
    held = lambda cond: F.bit_or(F.when(cond, F.col("bit")).otherwise(F.lit(0).cast("long")))
    edges = relations.where("status <> 'rejected'").select("target_id", F.col("source_id").alias("artifact_id"), "polarity", "status", "match_type").join(bits, "artifact_id")
    fan = edges.groupBy("target_id", "word").agg(
        held(~guessed).alias("should"), held(guessed).alias("may"),
        *[held(F.col("match_type") == v).alias(f"t{i}") for i, v in enumerate(types)], *[held(F.col("status") == v).alias(f"s{i}") for i, v in enumerate(statuses)],
    )
    n = near.select("change_id", F.col("artifact_id").alias("target_id"), *[F.col(f"s{i}").alias(f"has{i}") for i in range(len(statuses))])
    met = n.join(fan, "target_id")
    every = F.col("should").bitwiseOR(F.col("may"))
    plain = ["should", "may", *[f"t{i}" for i in range(len(types))]]
    through = [F.bit_or(F.when(F.col(f"has{i}"), every).otherwise(F.col(f"s{i}"))).alias(f"s{i}") for i in range(len(statuses))]
    return met.groupBy("change_id", "word").agg(*[F.bit_or(c).alias(c) for c in plain], *through)


def classes(changes: DataFrame, entities: DataFrame, artifacts: DataFrame, relations: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """I1 to I6 by class: (change_id, review_priority, evidence_strength, match_type, relation_distance, rule_assessment,
    relation_statuses, n_links), how many artifacts each change reaches in each way; and I11 by class, as trace_counts() gives it.

    What lies a hop away is counted by rows, which grow with the relations; what lies two hops away by masks. The rows
    themselves, with paths and evidence, are those of analyse() for the changes that one asks for. Where an artifact is
    reached by several inexact match types, the least of them names the class.
    """
    changed = cut(changed_entities(changes, names_of(entities, aliases)))
    statuses, types = _domain(relations)
    bits = node_bits(artifacts)
    one, rejected = hop1(changed, relations, artifacts)
    both = direct(changed, entities, relations).withColumn("_seq", F.lit("")).unionByName(one)
    rank = rank_in(F.col("review_priority"), PRIORITIES)
    at = F.struct("relation_distance", "_seq")
    near = both.groupBy("change_id", "artifact_id").agg(
        F.min_by(F.struct("review_priority", "evidence_strength", "rule_assessment"), F.struct(rank.alias("rank"), at.alias("at"))).alias("b"),
        F.min_by("match_type", at).alias("first"),
        F.min("relation_distance").alias("relation_distance"),
        F.bool_or(F.col("match_type") == "exact").alias("exact"),
        *[F.bool_or(F.array_contains("relation_statuses", v)).alias(f"s{i}") for i, v in enumerate(statuses)],
    )
    near = cut(near.join(bits, "artifact_id", "left"))
    masks = cut(_hop2_masks(near, relations, bits, statuses, types))

    # artifacts of the first hop: a second one may raise their priority and adds its statuses
    on = lambda c: F.coalesce(F.col(c).bitwiseAND(F.col("bit")) != 0, F.lit(False))
    second = masks.select("change_id", "word", *[F.col(c).alias(f"_{c}") for c in masks.columns[2:]])
    j = near.join(second, ["change_id", "word"], "left")
    raised = (F.col("b.review_priority") == "may_review") & on("_should")
    exact = F.col("exact") | (on("_t0") if types[:1] == ["exact"] else F.lit(False))
    has = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"s{i}") | on(f"_s{i}"), v) for i, v in enumerate(statuses)])), ",") if statuses else F.lit("")
    firsts = j.select(
        "change_id",
        F.when(raised, "should_review").otherwise(F.col("b.review_priority")).alias("review_priority"),
        F.when(raised, "medium").otherwise(F.col("b.evidence_strength")).alias("evidence_strength"),
        F.when(exact, "exact").otherwise(F.col("first")).alias("match_type"),
        "relation_distance",
        F.when(raised, "explicit_relation").otherwise(F.col("b.rule_assessment")).alias("rule_assessment"),
        has.alias("relation_statuses"),
        F.col("word").isNotNull().alias("known"),
        F.lit(1).cast("long").alias("n"),
    )

    # artifacts of the second hop alone: bits counted by every way of being in the masks
    own = near.where("word is not null").groupBy("change_id", "word").agg(F.bit_or("bit").alias("own"))
    only = masks.join(own, ["change_id", "word"], "left").withColumn("free", F.bitwise_not(F.coalesce("own", F.lit(0).cast("long"))))
    found = []
    for p, strength in (("should", "medium"), ("may", "weak")):
        of_p = F.col("should") if p == "should" else F.col("may").bitwiseAND(F.bitwise_not("should"))
        before = F.lit(-1).cast("long")
        for k, kind in enumerate(types):
            of_t, before = before.bitwiseAND(F.col(f"t{k}")), before.bitwiseAND(F.bitwise_not(F.col(f"t{k}")))
            for which in range(1, 1 << len(statuses)):
                mask = F.col("free").bitwiseAND(of_p).bitwiseAND(of_t)
                for i in range(len(statuses)):
                    mask = mask.bitwiseAND(F.col(f"s{i}") if which >> i & 1 else F.bitwise_not(F.col(f"s{i}")))
                named = ",".join(v for i, v in enumerate(statuses) if which >> i & 1)
                found.append(F.struct(F.lit(f"{p}_review").alias("p"), F.lit(strength).alias("s"), F.lit(kind).alias("t"), F.lit(named).alias("st"), F.bit_count(mask).cast("long").alias("n")))
    if found:
        rows = only.select("change_id", F.explode(F.array(*found)).alias("c")).where("c.n > 0")
        firsts = firsts.unionByName(rows.select(
            "change_id", F.col("c.p").alias("review_priority"), F.col("c.s").alias("evidence_strength"), F.col("c.t").alias("match_type"), F.lit(2).alias("relation_distance"),
            F.lit("explicit_relation").alias("rule_assessment"), F.col("c.st").alias("relation_statuses"), F.lit(True).alias("known"), F.col("c.n").alias("n"),
        ))
    keys = ["change_id", "review_priority", "evidence_strength", "match_type", "relation_distance", "rule_assessment", "relation_statuses"]
    counts = cut(firsts.groupBy(*keys, "known").agg(F.sum("n").alias("n")))
    report = counts.groupBy(*keys).agg(F.sum("n").alias("n_links"))

    # rejected relations to artifacts that nothing else reaches
    out = rejected.select("change_id", "artifact_id").distinct().join(near.select("change_id", "artifact_id"), ["change_id", "artifact_id"], "left_anti").join(bits, "artifact_id")
    reached = masks.select("change_id", "word", F.col("should").bitwiseOR(F.col("may")).alias("any"))
    out = out.join(reached, ["change_id", "word"], "left").where(~on("any"))
    met = counts.where("known").select("change_id", F.lit(True).alias("included"), "review_priority", F.lit("other").alias("why"), "n")
    met = met.unionByName(out.select("change_id", F.lit(False).alias("included"), F.lit("hidden").alias("review_priority"), F.lit("rejected").alias("why"), F.lit(1).cast("long").alias("n")))
    return report, _with_rest(changes, artifacts, met)


def _with_rest(changes: DataFrame, artifacts: DataFrame, met: DataFrame) -> DataFrame:
    """Counts of what a change meets, and by subtraction those of what it does not."""
    counts = met.groupBy("change_id", "included", "review_priority", "why").agg(F.sum("n").alias("n"))
    every = changes.select("change_id").distinct().crossJoin(F.broadcast(artifacts.agg(F.count("*").alias("_all"))))  # one row
    rest = every.join(counts.groupBy("change_id").agg(F.sum("n").alias("_met")), "change_id", "left").withColumn("n", F.col("_all") - F.coalesce("_met", F.lit(0))).where("n > 0")
    return counts.unionByName(rest.select("change_id", F.lit(False).alias("included"), F.lit("hidden").alias("review_priority"), F.lit("other").alias("why"), "n"))


def _place(value: Column, values: list[str]) -> Column:
    """Place of a value in a list, from 1; others are 0."""
    return (rank_in(value, values, -1) + 1).cast("long")


def _at(place: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int") - 1)


def counted(changes: DataFrame, entities: DataFrame, artifacts: DataFrame, relations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """A row for every change and artifact as analyse() gives it, with how many paths and how much evidence it has in place of their texts.

    Paths and evidence of a change are numbered, so a set of them is bits of 64-bit words. A target's neighbours travel in arrays
    of at most 4096, dealt out by change and neighbourhood, and are unfolded where they are united: no pair of a change
    and an artifact is shuffled.
    """
    changed = cut(changed_entities(changes, names_of(entities, aliases)))
    statuses, types = _domain(relations, 58)
    kinds, assessments, strengths = sorted({*types, "exact", "semantic"}), ["direct_match", "explicit_relation", "inferred_relation", "alias_mention"], ["strong", "medium", "weak"]
    nodes = node_bits(artifacts).select("artifact_id", F.shiftright("word", 6).alias("chunk"))
    bits = lambda held: sum((F.when(held(v), F.lit(4 << i)).otherwise(0) for i, v in enumerate(statuses)), F.lit(0)).cast("long")
    near = merge(direct(changed, entities, relations).withColumn("_seq", F.lit("")).unionByName(hop1(changed, relations, artifacts)[0]))
    told = (("review_priority", list(PRIORITIES)), ("evidence_strength", strengths), ("rule_assessment", assessments), ("match_type", kinds))
    code = sum((F.shiftleft(_place(F.col(c), v), 8 * i) for i, (c, v) in enumerate(told)), F.shiftleft(F.col("relation_distance").cast("long"), 32))
    near = near.join(nodes, "artifact_id", "left").select(
        "change_id", "artifact_id", F.coalesce("chunk", F.lit(-1)).alias("chunk"), code.alias("code"), bits(lambda v: F.array_contains("relation_statuses", v)).alias("flags"), "relation_paths", "evidence_ids"
    )
    near = cut(near)

    # edges: bit 0 of the flags is a sure one, bit 1 an exact one, then statuses; inexact ones keep their place among the edges
    e = relations.where("status <> 'rejected'").select("target_id", F.col("source_id").alias("artifact_id"), "relation_id", "relation_type", "polarity", "status", "match_type", "evidence_ids").join(nodes, "artifact_id")
    guessed = (F.col("polarity") == "inferred") & (F.col("status") != "confirmed")
    exact = F.coalesce(F.col("match_type") == "exact", F.lit(False))
    flags = F.when(guessed, 0).otherwise(1) + F.when(exact, 2).otherwise(0) + bits(lambda v: F.col("status") == v)
    e = e.withColumn("flags", flags).withColumn("seq", F.concat("relation_id", F.lit("|"), "target_id")).repartitionByRange("seq").sortWithinPartitions("seq").withColumn("n", F.monotonically_increasing_id())
    first = F.when(~exact, F.shiftleft("n", 6) + _place(F.col("match_type"), kinds))
    by = ["target_id", "relation_type", "edge_evidence"]
    e = e.select("target_id", "relation_type", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("edge_evidence"), "chunk", F.col("flags").alias("edge_flags"), first.alias("first"), "artifact_id")
    fans = cut(e.groupBy(*by, "chunk", "edge_flags", "first").agg(F.collect_list("artifact_id").alias("artifacts")))

    # numbers of the paths (without the artifact at their end) and of the evidence that a change meets
    end = F.concat(F.lit(" - "), F.col("artifact_id"))
    item = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    all_items = lambda ways, evidence: F.concat(F.transform(ways, item(1)), F.transform(evidence, item(2)))
    way = lambda p: F.when(F.endswith(p, end), F.left(p, F.length(p) - F.length(end))).otherwise(p)
    none = F.lit(None).cast("string")
    own = near.select("change_id", "artifact_id", "chunk", "code", "flags", none.alias("target_id"), none.alias("relation_type"), F.lit(None).cast("array<string>").alias("edge_evidence"), all_items(F.transform("relation_paths", way), F.col("evidence_ids")).alias("items"))
    n = near.select("change_id", F.col("artifact_id").alias("target_id"), "flags", F.array_min("relation_paths").alias("path"), "evidence_ids")
    far = n.join(fans.select(*by).distinct(), "target_id").select(
        "change_id", none.alias("artifact_id"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("code"), "flags", *by,
        all_items(F.array(F.concat("path", F.lit(" <- "), "relation_type")), F.concat("evidence_ids", "edge_evidence")).alias("items"),
    )
    items = own.unionByName(far).withColumn("item", F.explode("items")).drop("items")
    items = items.withColumn("n", F.dense_rank().over(Window.partitionBy("change_id").orderBy("item")) - 1)
    bit = F.expr("shiftleft(1L, n & 63)")
    marks = lambda kind: F.coalesce(F.bit_or(F.when(F.col("item.kind") == kind, bit)), F.lit(0).cast("long"))
    sets = cut(items.groupBy("change_id", "artifact_id", "chunk", "code", "flags", *by, F.shiftright("n", 6).alias("word")).agg(marks(1).alias("paths"), marks(2).alias("evidence")))

    held = ["word", "paths", "evidence"]
    ones = sets.where("code is not null").select("change_id", "chunk", F.array("artifact_id").alias("artifacts"), "code", "flags", F.lit(None).cast("long").alias("first"), *held)
    twos = sets.where("code is null").drop("artifact_id", "chunk").join(fans, by).select("change_id", "chunk", "artifacts", "code", F.col("flags").bitwiseOR(F.col("edge_flags")).alias("flags"), "first", *held)
    rows = ones.unionByName(twos).repartition("change_id", "chunk").withColumn("artifact_id", F.explode("artifacts"))
    keys = ["change_id", "chunk", "artifact_id"]
    words = rows.groupBy(*keys, "word").agg(F.max("code").alias("code"), F.bit_or("flags").alias("flags"), F.min("first").alias("first"), F.bit_or("paths").alias("paths"), F.bit_or("evidence").alias("evidence"))
    number = lambda c: F.sum(F.bit_count(c)).cast("int")
    out = words.groupBy(*keys).agg(F.max("code").alias("code"), F.bit_or("flags").alias("flags"), F.min("first").alias("first"), number("paths").alias("n_paths"), number("evidence").alias("n_evidence"))

    # what lies a hop away keeps its own values, unless it may only be reviewed and a sure second hop reaches it
    has = lambda i: F.col("flags").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    byte = lambda i: F.shiftright("code", 8 * i).bitwiseAND(F.lit(255).cast("long"))
    value = {c: _at(byte(i), v) for i, (c, v) in enumerate(told)}
    raised = has(0) & (F.col("code").isNull() | value["review_priority"].isin("may_review", "hidden"))
    alone = F.col("code").isNull()
    kind = F.when(alone, _at(F.col("first").bitwiseAND(F.lit(63).cast("long")), kinds)).otherwise(value["match_type"])
    return out.select(
        "change_id", "artifact_id",
        F.when(raised, "should_review").when(alone, "may_review").otherwise(value["review_priority"]).alias("review_priority"),
        F.when(raised, "medium").when(alone, "weak").otherwise(value["evidence_strength"]).alias("evidence_strength"),
        F.when(has(1), "exact").otherwise(kind).alias("match_type"),
        F.when(alone, 2).otherwise(F.shiftright("code", 32).cast("int")).alias("relation_distance"),
        F.when(raised | alone, "explicit_relation").otherwise(value["rule_assessment"]).alias("rule_assessment"),
        "n_paths", "n_evidence",
        F.array_compact(F.array(*[F.when(has(2 + i), v) for i, v in enumerate(statuses)])).cast("array<string>").alias("relation_statuses"),
    )


def semantic_candidates(top_chunks: DataFrame, evidence: DataFrame, relations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts reached from (change_id, chunk_id) by evidence that supports a relation; they may be reviewed."""
    e = evidence.join(top_chunks, "chunk_id").select("change_id", "evidence_id", F.explode("supports").alias("s")).where("s.type = 'relation'")
    r = e.join(relations.select(F.col("relation_id").alias("_rid"), F.col("source_id").alias("artifact_id"), "relation_type", "status"), F.col("s.id") == F.col("_rid")).where("status <> 'rejected'")
    return r.join(artifacts.select("artifact_id", "display_name", "artifact_type"), "artifact_id").select(
        "change_id", "artifact_id", "display_name", "artifact_type",
        F.lit("may_review").alias("review_priority"), F.lit("weak").alias("evidence_strength"), F.lit("semantic").alias("match_type"),
        F.lit(1).alias("relation_distance"), F.lit("semantic_candidate").alias("rule_assessment"),
        F.lit("Semantic similarity retrieved a related chunk.").alias("reason"),
        F.array(F.concat(F.lit("change ~ "), "evidence_id", F.lit(" - "), "artifact_id")).alias("relation_paths"),
        F.array("evidence_id").alias("evidence_ids"), F.array("status").alias("relation_statuses"), F.concat(F.lit("~~"), "evidence_id").alias("_seq"),
    )


def ordered(impacts: DataFrame) -> DataFrame:
    """I8: by change, priority, artifact."""
    return impacts.orderBy("change_id", rank_in(F.col("review_priority"), PRIORITIES), "artifact_id")


def apply_rerank(impacts: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of a model (change_id, artifact_id, llm_judgement, llm_reason, selected_evidence_ids), within guardrails:
    evidence is limited to the candidate's own, promotion stops at should, a protected must stays."""
    a = answers.select("change_id", "artifact_id", "llm_judgement", "llm_reason", F.col("selected_evidence_ids").alias("_sel"))
    out = impacts.join(a, ["change_id", "artifact_id"], "left").withColumn("selected_evidence_ids", F.coalesce(F.array_intersect("_sel", "evidence_ids"), F.array().cast("array<string>")))
    p, kept = F.col("review_priority"), (F.col("review_priority") == "must_review") & F.col("rule_assessment").isin("direct_match", "explicit_relation")
    up = (F.col("llm_judgement") == "impact") & (F.size("selected_evidence_ids") > 0)
    down = F.col("llm_judgement") == "no_impact"
    new = F.when(kept, p).when(up, F.when(p.isin("may_review", "hidden"), "should_review").otherwise(p)).when(down, "may_review").otherwise(p)
    s = F.col("evidence_strength")
    strength = F.when(kept, s).when(up, F.when(p.isin("may_review", "hidden"), "medium").otherwise(s)).when(down, "weak").otherwise(s)
    return out.select(*[c for c in impacts.columns if c not in ("review_priority", "evidence_strength")], new.alias("review_priority"), strength.alias("evidence_strength"), "llm_judgement", "llm_reason", "selected_evidence_ids")


def rerank_batches(impacts: DataFrame, evidence: DataFrame, size: int = 20) -> DataFrame:
    """Candidates of a change in batches of `size`, with their evidence, for an offline model."""
    order = Window.partitionBy("change_id").orderBy(rank_in(F.col("review_priority"), PRIORITIES), "artifact_id")
    numbered = impacts.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    ev = numbered.select("change_id", "artifact_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "quote"), "evidence_id")
    quotes = ev.groupBy("change_id", "artifact_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "quote"))).alias("evidence"))
    rows = numbered.join(quotes, ["change_id", "artifact_id"], "left")
    return rows.groupBy("change_id", "batch").agg(F.array_sort(F.collect_list(F.struct("artifact_id", "review_priority", "reason", "evidence"))).alias("candidates"))


def trace(changes: DataFrame, artifacts: DataFrame, impacts: DataFrame, rejected: DataFrame) -> DataFrame:
    """For the given changes, every artifact with whether and why it is included. The result has a row per change and artifact by nature."""
    r = rejected.groupBy("change_id", "artifact_id").agg(F.array_sort(F.collect_set("relation_id")).alias("_rej"))
    i = impacts.select("change_id", "artifact_id", "review_priority", "relation_statuses", F.col("reason").alias("_why"))
    all_rows = changes.select("change_id").distinct().crossJoin(artifacts.select("artifact_id"))
    out = all_rows.join(i, ["change_id", "artifact_id"], "left").join(r, ["change_id", "artifact_id"], "left")
    hit = F.col("review_priority").isNotNull()
    none = F.array().cast("array<string>")
    return out.select(
        "change_id",
        "artifact_id",
        hit.alias("included"),
        F.coalesce("review_priority", F.lit("hidden")).alias("review_priority"),
        F.when(hit, F.col("relation_statuses")).when(F.col("_rej").isNotNull(), F.array(F.lit("rejected"))).otherwise(none).alias("relation_statuses"),
        F.when(hit, F.col("_why")).when(F.col("_rej").isNotNull(), F.concat(F.lit("Rejected relations: "), F.array_join("_rej", ", "))).otherwise("No relation to the changed entities was found.").alias("reason"),
    )


def trace_counts(changes: DataFrame, artifacts: DataFrame, impacts: DataFrame, rejected: DataFrame) -> DataFrame:
    """I11 per change: (change_id, included, review_priority, why, n) of all artifacts. Those that no relation reaches are counted by subtraction, so no change meets every artifact."""
    known = artifacts.select("artifact_id")
    in_ = impacts.select("change_id", "artifact_id", "review_priority", "reason").join(known, "artifact_id", "left_semi")
    out = rejected.select("change_id", "artifact_id").distinct().join(known, "artifact_id", "left_semi").join(in_, ["change_id", "artifact_id"], "left_anti")
    why = F.when(F.col("reason").startswith("Rejected"), "rejected").otherwise("other")
    met = in_.select("change_id", F.lit(True).alias("included"), "review_priority", why.alias("why")).unionByName(out.select("change_id", F.lit(False).alias("included"), F.lit("hidden").alias("review_priority"), F.lit("rejected").alias("why")))
    return _with_rest(changes, artifacts, met.withColumn("n", F.lit(1).cast("long")))


def explain(trace_rows: DataFrame, names: DataFrame, runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Why (not) for wanted (name): names resolve by an index (name, ids); the latest run (run_id, change_id, seq) answers."""
    latest = runs.agg(F.max_by("change_id", "seq").alias("change_id"))
    resolved = wanted.join(names, "name", "left").withColumn("artifact_id", F.when(F.size("ids") == 1, F.element_at("ids", 1)))
    rows = trace_rows.join(F.broadcast(latest), "change_id")  # one row
    out = resolved.join(rows, "artifact_id", "left")
    why = F.when(F.coalesce(F.size("ids"), F.lit(0)) > 1, F.concat(F.lit("Ambiguous: "), F.array_join("ids", ", "))).when(F.col("artifact_id").isNull(), "Unknown name").otherwise(F.coalesce("reason", F.lit("Not an artifact of the run")))
    return out.select("name", "artifact_id", "included", why.alias("answer"))


def import_relations(answers: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations that a model read from a chunk (chunk_id, source_id, relation_type, target_id, quote): the quote must occur exactly once.

    Good rows get line numbers and are marked inferred and unconfirmed; the others come back with a reason.
    """
    j = answers.join(chunks.select("chunk_id", "text", F.col("line_start").alias("_first")), "chunk_id", "left")
    at = F.instr(F.col("text"), F.col("quote"))
    again = F.expr("locate(quote, text, instr(text, quote) + 1)")
    why = F.when(F.col("text").isNull(), "unknown chunk").when(F.coalesce(F.length("quote"), F.lit(0)) == 0, "empty quote").when(at == 0, "quote not found").when(again > 0, "quote is ambiguous")
    j = j.withColumn("problem", why)
    line = F.col("_first") + F.length(F.regexp_replace(F.col("text").substr(F.lit(1), at - 1), "[^\n]", ""))
    ok = j.where("problem is null").withColumn("line_start", line.cast("int")).withColumn("line_end", (line + F.length(F.regexp_replace("quote", "[^\n]", ""))).cast("int"))
    ok = ok.withColumn("polarity", F.lit("inferred")).withColumn("status", F.lit("unconfirmed")).withColumn("extraction_method", F.lit("llm"))
    return ok.drop("text", "_first", "problem"), j.where("problem is not null").select(*answers.columns, "problem")


def match_named_entities(answers: DataFrame, entities: DataFrame, name_index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that a model named (change_id, name): by id, else by a unique name; the rest are suggestions."""
    by_id = answers.join(entities.select(F.col("entity_id").alias("_eid")), F.col("name") == F.col("_eid"), "left")
    both = by_id.join(name_index.select("name", "ids"), "name", "left")
    found = F.coalesce("_eid", F.when(F.size("ids") == 1, F.element_at("ids", 1)))
    both = both.withColumn("entity_id", found)
    known = both.where("entity_id is not null").select("change_id", "entity_id").distinct()
    return known, both.where("entity_id is null").select(*answers.columns)
