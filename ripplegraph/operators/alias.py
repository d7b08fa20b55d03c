"""Alias resolution: candidates between entities by six signals, without comparing all pairs.

Every signal needs a shared key (concept, token, shape, trigram, relation-signature item, evidence or
line bucket), so pairs come from self-joins on those keys, and are scored only then. Keys that many
entities share are handled through groups of entities of identical content: pairs of groups are scored
once and expanded last, since the output itself lists every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, short_hash
from ..functions.firsts import first_per, first_relations
from ..functions.lineage import cut

# What an identifier token is, words that make no meaningful overlap, concept rules, thresholds.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9]*|\p{Nd}+|[一-龥ぁ-んァ-ン]+"
STOP = ("id", "no", "name", "field", "item", "value", "code", "type")
MIN_TRIGRAM, MIN_CONTEXT, NEAR_LINES = 0.72, 0.4, 3
BY_EVIDENCE = "same_evidence_neighborhood"


def tokens(value: Column) -> Column:
    """A4: identifier tokens of two characters or more: camel, snake and Japanese words, folded."""
    spaced = F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(spaced, F.lit(IDENTIFIER), F.lit(0)), F.lower)
    return F.filter(words, lambda w: F.length(w) >= 2)


def shape(value: Column) -> Column:
    return F.array_join(tokens(value), "")


def entity_text(display: str = "display_name", canonical: str = "canonical_name", aliases: str = "aliases") -> Column:
    return F.concat_ws(" ", F.col(display), F.col(canonical), F.col(aliases))


def concept_key(display: Column, canonical: Column) -> Column:
    """A3: concept of the domain rules, else the canonical shape of names of four characters or more, else empty."""
    text = F.concat_ws(" ", display, canonical)
    folded, plain, words = F.lower(text), shape(text), tokens(text)
    return (
        F.when(any_of([plain.contains(t) for t in ("creditlimit", "requestedcreditlimit", "limitamt")]), "credit_limit")
        .when(text.contains("利用限度額") | text.contains("希望利用限度額"), "credit_limit")
        .when(F.array_contains(words, "credit") & F.array_contains(words, "limit"), "credit_limit")
        .when(folded.contains("phone") | folded.contains("tel") | text.contains("電話"), "phone_number")
        .when(folded.contains("identity") | folded.contains("kyc") | text.contains("本人確認"), "identity_verification")
        .when(F.length(canonical) >= 4, shape(canonical))
        .otherwise("")
    )


def meaningful(overlap: Column) -> Column:
    """A4: whether shared tokens mean anything."""
    return F.exists(overlap, lambda t: ~t.isin(*STOP) & ((F.length(t) >= 4) | t.rlike(r"[^\x00-\x7F]")))


def trigrams(value: Column) -> Column:
    """Character trigrams of a shape, repeats kept; shorter shapes are their own gram."""
    n = F.length(value)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: value.substr(i, F.lit(3)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(value)).otherwise(many)


def name_index(artifacts: DataFrame, entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """A1: (name, ids): every id that a name may mean."""
    none = F.array().cast("array<string>")
    a = artifacts.select(F.col("artifact_id").alias("id"), F.array_union(F.array("artifact_id", "display_name"), F.coalesce("aliases", none)).alias("n"))
    e = entities.select(F.col("entity_id").alias("id"), F.array_union(F.array("entity_id", "display_name", "canonical_name"), F.coalesce("aliases", none)).alias("n"))
    long = a.unionByName(e).select("id", F.explode("n").alias("name"))
    if aliases is not None:
        ids = artifacts.select(F.col("artifact_id").alias("id")).unionByName(entities.select(F.col("entity_id").alias("id")))
        long = long.unionByName(aliases.join(ids, F.col("item_id") == F.col("id")).select("id", F.col("alias").alias("name")))
    return long.where("name is not null").groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolve(names: DataFrame, index: DataFrame) -> DataFrame:
    """A1: names with their id, or the candidates where they are ambiguous."""
    j = names.join(index, "name", "left")
    return j.select("name", F.when(F.size("ids") == 1, F.element_at("ids", 1)).alias("id"), F.when(F.size("ids") > 1, F.col("ids")).alias("candidates"))


def collisions(aliases: DataFrame) -> DataFrame:
    """A2: aliases that stand under more than one item."""
    return aliases.groupBy("alias").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).where(F.size("item_ids") > 1)


def _pairs(df: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """(left, right) of a self-join on a key, smaller id first."""
    cols = ["id", key, *(keep or [])]
    a = df.select(*[F.col(c).alias(f"l_{c}") for c in cols])
    b = df.select(*[F.col(c).alias(f"r_{c}") for c in cols])
    return a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("l_id") < F.col("r_id")))


def _weight(score: str):
    """What an item of a list weighs: the square of its number for the cosine, one for Jaccard."""
    return lambda x: x["n"] * x["n"] if score == "cosine" else F.lit(1.0)


def _meetings(lists: DataFrame, score: str, least: float) -> DataFrame:
    """(l_grp, r_grp): lists (grp, weight, list in the common order) whose beginnings share an item."""
    weigh = _weight(score)
    light = F.lit(least * least if score == "cosine" else least) * F.col("weight") * (1 - 1e-9)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("rest"))
    rest = F.aggregate(F.reverse("list"), zero, lambda s, x: F.struct((s["sum"] + weigh(x)).alias("sum"), (s["rest"] + F.when(s["sum"] + weigh(x) < light, 1).otherwise(0)).alias("rest")))["rest"]
    starts = lists.select("grp", "weight", F.explode(F.slice("list", F.lit(1), F.size("list") - rest)).alias("x")).select("grp", "weight", "x.item")
    a = starts.select(F.col("grp").alias("l_grp"), F.col("weight").alias("l_weight"), "item")
    b = starts.select(F.col("grp").alias("r_grp"), F.col("weight").alias("r_weight"), "item")
    met = a.join(b, "item").where("l_grp <= r_grp")
    if score == "jaccard":
        met = met.where(F.least("l_weight", "r_weight") >= F.lit(least * (1 - 1e-9)) * F.greatest("l_weight", "r_weight"))
    return met.select("l_grp", "r_grp").distinct()


def similar_classes(items: DataFrame, score: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, grp) and (l_grp, r_grp, score): ids of equal multisets of items (id, item, n) form a class, and which classes are similar.

    Classes are compared once; l_grp = r_grp stands for the pairs within a class. Both tables together say what all pairs
    of ids would, without a row for each.

    Two classes meet through rare items only: all lists are put in one order, rarest item first, and of each list the
    shortest beginning is taken whose rest is too light to reach the threshold (weight n * n for the cosine, a count for
    Jaccard). If two beginnings share no item, all shared items lie in the rest of one of them, which is too light; so no
    pair is lost, and the list of a common item is joined only for the classes that have little else.
    """
    content = items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("item", "n"))).alias("content"))
    content = cut(content.withColumn("grp", F.sha2(F.to_json("content"), 256)))
    groups = content.groupBy("grp").agg(F.first("content").alias("content"))
    long = groups.select("grp", F.explode("content").alias("c")).select("grp", "c.item", "c.n")
    seen = long.groupBy("item").agg(F.count("*").alias("df"))
    lists = long.join(seen, "item").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("df", "item", "n"))).alias("list"))
    weigh = _weight(score)
    whole = F.aggregate("list", F.lit(0.0), lambda s, x: s + weigh(x))
    lists = cut(lists.withColumn("weight", whole).withColumn("by_item", F.map_from_entries(F.transform("list", lambda x: F.struct(x["item"], x["n"])))))
    met = _meetings(lists, score, least)
    side = lambda p: lists.select(*[F.col(c).alias(f"{p}_{c}") for c in ("grp", "weight", "by_item")])
    g = met.join(side("l"), "l_grp").join(side("r"), "r_grp")
    other = lambda x: F.try_element_at("r_by_item", x["key"])
    term = lambda x: F.coalesce(x["value"] * other(x) if score == "cosine" else F.when(other(x).isNotNull(), 1.0), F.lit(0.0))
    dot = F.aggregate(F.map_entries("l_by_item"), F.lit(0.0), lambda s, x: s + term(x))
    value = F.col("dot") / (F.sqrt("l_weight") * F.sqrt("r_weight")) if score == "cosine" else F.col("dot") / (F.col("l_weight") + F.col("r_weight") - F.col("dot"))
    close = g.withColumn("dot", dot).withColumn("score", value).where(F.col("score") >= least - 1e-12)
    return content.select("id", "grp"), close.select("l_grp", "r_grp", "score")


def _similar_groups(items: DataFrame, score: str, least: float) -> DataFrame:
    """(left, right, score) of the ids whose multisets of items (id, item, n) are similar: classes are expanded last."""
    ids, close = similar_classes(items, score, least)
    out = close.join(ids.select(F.col("id").alias("x"), F.col("grp").alias("l_grp")), "l_grp").join(ids.select(F.col("id").alias("y"), F.col("grp").alias("r_grp")), "r_grp")
    return out.where("x <> y").select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "score").distinct()


def _grams(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("entity_id").alias("id"), F.explode(trigrams(shape(entity_text()))).alias("item")).groupBy("id", "item").agg(F.count("*").cast("double").alias("n"))


def trigram_pairs(entities: DataFrame) -> DataFrame:
    """A5: pairs by cosine of their character trigrams."""
    return _similar_groups(_grams(entities), "cosine", MIN_TRIGRAM)


def trigram_classes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5 as classes of equal trigrams and their similar pairs."""
    return similar_classes(_grams(entities), "cosine", MIN_TRIGRAM)


def signatures(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, item): relation context of each entity, as in or out, type and family of the other end."""
    family = lambda c: F.substring_index(c, ".", 1)
    out = relations.select(F.col("source_id").alias("id"), F.concat_ws(":", F.lit("out"), "relation_type", family("target_id")).alias("item"))
    inc = relations.select(F.col("target_id").alias("id"), F.concat_ws(":", F.lit("in"), "relation_type", family("source_id")).alias("item"))
    return out.unionByName(inc).join(entities.select(F.col("entity_id").alias("id")), "id", "left_semi").distinct()


def context_pairs(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs by Jaccard of their relation contexts."""
    return _similar_groups(signatures(entities, relations).withColumn("n", F.lit(1.0)), "jaccard", MIN_CONTEXT)


def context_classes(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A6 as classes of equal relation contexts and their similar pairs."""
    return similar_classes(signatures(entities, relations).withColumn("n", F.lit(1.0)), "jaccard", MIN_CONTEXT)


def evidence_of(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, evidence_id) of the relations on either end of an entity."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("id"), "evidence_ids").select("id", F.explode("evidence_ids").alias("evidence_id"))
    return ends.join(entities.select(F.col("entity_id").alias("id")), "id", "left_semi").distinct()


def evidence_pairs(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(left, right, evidence_id): pairs that share evidence, or have some in one file at most three lines apart.

    The band join meets buckets of lines with their neighbours.
    """
    own = evidence_of(entities, relations)
    shared = _pairs(own, "evidence_id").select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), F.col("l_evidence_id").alias("evidence_id"))
    at = own.join(evidence.select("evidence_id", F.col("source_location.file").alias("file"), F.col("source_location.line_start").alias("line")), "evidence_id").where("file is not null")
    wide = NEAR_LINES + 1
    a = at.select(*[F.col(c).alias(f"l_{c}") for c in at.columns], F.floor(F.col("line") / wide).alias("bucket"))
    b = at.select(*[F.col(c).alias(f"r_{c}") for c in at.columns], F.explode(F.sequence(F.floor(F.col("line") / wide) - 1, F.floor(F.col("line") / wide) + 1)).alias("bucket"))
    near = a.join(b, (F.col("l_file") == F.col("r_file")) & (a["bucket"] == b["bucket"]) & (F.col("l_id") < F.col("r_id")) & (F.abs(F.col("l_line") - F.col("r_line")) <= NEAR_LINES))
    both = near.select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), F.explode(F.array("l_evidence_id", "r_evidence_id")).alias("evidence_id"))
    return shared.unionByName(both).distinct()


def signals(entities: DataFrame, relations: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """(left, right, signals) of every pair with at least one signal; without evidence, of the signals that names and contexts give."""
    e = entities.select(F.col("entity_id").alias("id"), concept_key(F.col("display_name"), F.col("canonical_name")).alias("concept"), F.array_distinct(tokens(entity_text())).alias("tokens"), shape(entity_text()).alias("shape"))
    named = lambda df, text: df.select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), text.alias("signal"))
    by_concept = named(_pairs(e.where("concept <> ''"), "concept"), F.concat(F.lit("concept_key:"), "l_concept"))
    by_shape = named(_pairs(e.where("shape <> ''"), "shape"), F.lit("camel_snake_shape_match"))
    useful = e.select("id", "tokens", F.explode("tokens").alias("token")).where(meaningful(F.array("token")))
    met = _pairs(useful, "token", ["tokens"]).dropDuplicates(["l_id", "r_id"])
    shared = F.slice(F.array_sort(F.array_intersect("l_tokens", "r_tokens")), 1, 4)
    by_token = named(met, F.concat(F.lit("name_token_overlap:"), F.array_join(shared, ",")))
    two = lambda c: F.format_string("%.2f", c)
    by_gram = trigram_pairs(entities).select("left", "right", F.concat(F.lit("embedding_similarity:"), two("score")).alias("signal"))
    by_context = context_pairs(entities, relations).select("left", "right", F.concat(F.lit("relation_similarity:"), two("score")).alias("signal"))
    every = by_concept
    for part in (by_shape, by_token, by_gram, by_context):
        every = every.unionByName(part)
    if evidence is not None:
        every = every.unionByName(evidence_pairs(entities, relations, evidence).select("left", "right", F.lit(BY_EVIDENCE).alias("signal")).distinct())
    return every.groupBy("left", "right").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def content_classes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, cls): entities of equal names, aliases and relation context, which have all signals but evidence in common; cls is a hash of them."""
    context = signatures(entities, relations).groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("context"))
    e = entities.select(F.col("entity_id").alias("id"), "display_name", "canonical_name", "aliases").join(context, "id", "left")
    return e.select("id", F.sha2(F.to_json(F.struct("display_name", "canonical_name", "aliases", "context")), 256).alias("cls"))


def class_signals(entities: DataFrame, relations: DataFrame, classes: DataFrame) -> DataFrame:
    """(l_cls, r_cls, signals) that every pair of members of two classes has (of one class where l_cls = r_cls).

    Two members stand for each class, so that pairs within it are seen too.
    """
    low = classes.groupBy("cls").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    some = low.select("cls", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
    pairs = signals(entities.join(some.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), relations, None)
    of = lambda p, end: some.select(F.col("id").alias(end), F.col("cls").alias(p))
    named = pairs.join(of("x", "left"), "left").join(of("y", "right"), "right")
    return named.groupBy(F.least("x", "y").alias("l_cls"), F.greatest("x", "y").alias("r_cls")).agg(F.max("signals").alias("signals"))


def evidence_signals(entities: DataFrame, relations: DataFrame, evidence: DataFrame, classes: DataFrame, by_class: DataFrame) -> DataFrame:
    """(left, right, signals) of every pair that has evidence in common, with the signals of its classes.

    With class_signals these are all pairs: members of two classes have the classes' signals unless they stand here.
    """
    near = evidence_pairs(entities, relations, evidence).select("left", "right").distinct()
    of = lambda p, end: classes.select(F.col("id").alias(end), F.col("cls").alias(p))
    named = near.join(of("x", "left"), "left").join(of("y", "right"), "right").select("left", "right", F.least("x", "y").alias("l_cls"), F.greatest("x", "y").alias("r_cls"))
    own = F.array(F.lit(BY_EVIDENCE))
    return named.join(by_class, ["l_cls", "r_cls"], "left").select("left", "right", F.array_sort(F.array_union(F.coalesce("signals", own), own)).alias("signals"))


def candidates(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate rows of the pairs: target first (non-ASCII, shorter, smaller id), alias list, hashed id."""
    cols = ("entity_id", "display_name", "canonical_name", "aliases")
    side = lambda p: entities.select(*[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = pairs.join(side("l"), F.col("left") == F.col("l_entity_id")).join(side("r"), F.col("right") == F.col("r_entity_id"))
    order = lambda p: F.struct(~F.col(f"{p}_display_name").rlike(r"[^\x00-\x7F]"), F.length(f"{p}_display_name"), F.col(f"{p}_entity_id"))
    swap = order("r") < order("l")
    for c in cols:
        j = j.withColumn(f"t_{c}", F.when(swap, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}"))).withColumn(f"c_{c}", F.when(swap, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")))
    own = F.array("t_display_name", "t_canonical_name", "t_entity_id")
    names = F.array_sort(F.filter(F.array_distinct(F.array_except(F.concat(F.array("c_display_name", "c_canonical_name"), "c_aliases"), own)), lambda x: x.isNotNull() & (x != "")))
    key = F.concat(F.array_join("signals", "|"), "t_entity_id", "c_entity_id")
    return j.select(
        F.concat(F.lit("alias_"), short_hash(key)).alias("candidate_id"), F.col("t_entity_id").alias("target_id"), names.alias("aliases"), F.lit("unsure").alias("judgement"), F.lit("pending").alias("status"),
        F.concat(F.lit("candidate signals: "), F.array_join("signals", ", ")).alias("reason"), F.col("t_entity_id").alias("entity_a_id"), F.col("c_entity_id").alias("entity_b_id"), "left", "right", "signals",
    )


def pair_context(pairs: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame, max_relations: int = 24, max_quotes: int = 8) -> DataFrame:
    """(left, right): neighbours, the first relations that touch the pair or a neighbour, and evidence with its first quotes (limits of the report).

    Evidence is that of those relations and that which the pair has in common or close by (A7). The first relations of a
    pair are among the first ones of its ends, and theirs among the first ones of their neighbours.
    """
    p = pairs.select("left", "right")
    named = cut(p.select(F.explode(F.array("left", "right")).alias("entity_id")).distinct())
    ends = relations.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("node")).unionByName(relations.select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("node")))
    around = cut(ends.join(named, "entity_id", "left_semi").distinct())
    # each entity is summed up once: its neighbours, and the first relations of all of them; a pair unites two such rows
    reach = around.unionByName(named.select("entity_id", F.col("entity_id").alias("node"))).distinct()
    touch = reach.join(first_relations(relations, max_relations), "node").select("entity_id", "relation_id").distinct()
    firsts = first_per(touch, "entity_id", "relation_id", max_relations).groupBy("entity_id").agg(F.array_sort(F.collect_list("relation_id")).alias("first"))
    own = named.join(around.groupBy("entity_id").agg(F.collect_set("node").alias("around")), "entity_id", "left").join(firsts, "entity_id", "left")
    none = F.array().cast("array<string>")
    side = lambda c, x: own.select(F.col("entity_id").alias(c), F.coalesce("around", none).alias(f"{x}_around"), F.coalesce("first", none).alias(f"{x}_first"))
    both = p.join(side("left", "l"), "left").join(side("right", "r"), "right")
    both = both.select("left", "right", F.array_sort(F.array_union("l_around", "r_around")).alias("_around"), F.slice(F.array_sort(F.array_union("l_first", "r_first")), 1, max_relations).alias("_first"))
    surrounding = both.select("left", "right", F.when(F.size("_around") > 0, F.col("_around")).alias("surrounding_node_ids"))
    top = both.select("left", "right", F.posexplode("_first").alias("_n", "relation_id"))
    text = F.concat("source_id", F.lit(" -"), "relation_type", F.lit("-> "), "target_id", F.lit(" ["), "status", F.lit("/"), "polarity", F.lit("]"))
    r = top.join(relations.select("relation_id", text.alias("line"), "evidence_ids"), "relation_id")
    lines = r.groupBy("left", "right").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda s: s["line"]).alias("relation_context"))
    near = evidence_pairs(entities.join(named, "entity_id", "left_semi"), relations, evidence).join(p, ["left", "right"], "left_semi")
    ids = r.select("left", "right", F.explode("evidence_ids").alias("evidence_id")).unionByName(near.select("left", "right", "evidence_id")).distinct()
    ev = ids.join(evidence.select("evidence_id", "quote"), "evidence_id")
    quotes = ev.groupBy("left", "right").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "quote"))).alias("_q"))
    out = p.join(surrounding, ["left", "right"], "left").join(lines, ["left", "right"], "left").join(quotes, ["left", "right"], "left")
    return out.withColumn("evidence_ids", F.transform("_q", lambda s: s["evidence_id"])).withColumn("evidence_quotes", F.transform(F.slice("_q", 1, max_quotes), lambda s: s["quote"])).drop("_q")


def _key(*tables: DataFrame) -> list[str]:
    """What names a candidate: its id, and where all tables have it its pair, as a short hash may stand for several pairs."""
    return ["candidate_id", *[c for c in ("entity_a_id", "entity_b_id") if all(c in x.columns for x in tables)]]


def insert_new(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """A10: candidates that are not there yet are added."""
    key = _key(current, incoming)
    return current.unionByName(incoming.dropDuplicates(key).join(current.select(key), key, "left_anti").select(current.columns))


def apply_judgements(rows: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """A model's judgements (candidate_id, judgement, reason, evidence_ids, and the pair where it is known); unknown evidence is dropped, and without any left the own list stays."""
    key = _key(rows, answers)
    known = answers.select(*key, F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_semi")
    good = known.groupBy(*key).agg(F.array_sort(F.collect_set("evidence_id")).alias("_ev"))
    a = answers.select(*key, F.col("judgement").alias("_j"), F.nullif("reason", F.lit("")).alias("_r")).join(good, key, "left")
    j = rows.join(a, key, "left")
    return j.withColumn("judgement", F.coalesce("_j", "judgement")).withColumn("reason", F.coalesce("_r", "reason")).withColumn("evidence_ids", F.coalesce("_ev", "evidence_ids")).drop("_j", "_r", "_ev")


def decide(catalog: DataFrame, rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The alias catalog after decisions (candidate_id, status): confirmed candidates judged the same add their aliases."""
    yes = rows.where("judgement = 'same'").join(decisions.where("status = 'confirmed'").select("candidate_id"), "candidate_id", "left_semi")
    kinds = catalog.groupBy("item_id").agg(F.first("canonical_type").alias("canonical_type"))
    new = yes.select(F.col("target_id").alias("item_id"), F.explode("aliases").alias("alias")).distinct().join(kinds, "item_id", "left")
    new = new.withColumn("canonical_type", F.coalesce("canonical_type", F.lit("BusinessField")))
    return catalog.unionByName(new.select(catalog.columns)).distinct()


def add_aliases(nodes: DataFrame, added: DataFrame, id_col: str) -> DataFrame:
    """Node rows with added (item_id, alias) united into their aliases."""
    a = added.groupBy(F.col("item_id").alias(id_col)).agg(F.collect_set("alias").alias("_a"))
    return nodes.join(a, id_col, "left").withColumn("aliases", F.when(F.col("_a").isNull(), F.col("aliases")).otherwise(F.array_sort(F.array_union("aliases", "_a")))).select(nodes.columns)


def remove_aliases(nodes: DataFrame, removed: DataFrame, id_col: str) -> DataFrame:
    """Node rows without removed (item_id, alias)."""
    a = removed.groupBy(F.col("item_id").alias(id_col)).agg(F.collect_set("alias").alias("_a"))
    return nodes.join(a, id_col, "left").withColumn("aliases", F.when(F.col("_a").isNull(), F.col("aliases")).otherwise(F.array_except("aliases", "_a"))).select(nodes.columns)
