"""Similarity joins of entities against a plain double loop over all pairs."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

from ripplegraph.operators import alias
from ripplegraph.plans import tables as t

SMALL = "/root/testdata/sf0.001"
ITEMS = "id string, item string, n double"


def loop(content, score, least):
    out = {}
    for a, b in itertools.combinations(sorted(content), 2):
        x, y = content[a], content[b]
        if score == "cosine":
            s = sum(v * y.get(k, 0) for k, v in x.items()) / math.sqrt(sum(v * v for v in x.values())) / math.sqrt(sum(v * v for v in y.values()))
        else:
            s = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
        if s >= least - 1e-12:
            out[a, b] = round(s, 9)
    return out


def grams(display, canonical, aliases=()):
    text = " ".join([display, canonical, *aliases])
    spaced = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text))
    shape = "".join(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9]*|\d+|[一-龥ぁ-んァ-ン]+", spaced) if len(w) >= 2)
    return collections.Counter([shape[i : i + 3] for i in range(max(len(shape) - 2, 1))])


def pairs_of(df):
    return {(r["left"], r["right"]): round(r["score"], 9) for r in df.collect()}


def test_random_lists(spark):
    rng = random.Random(6)
    content = {}
    for i in range(220):
        names = rng.choices([f"i{k}" for k in range(40)], weights=[40 / (k + 1) for k in range(40)], k=rng.randint(1, 12))
        content[f"e{i:03}"] = dict(collections.Counter(names))
    content |= {f"h{i}": {"i0": 1} for i in range(30)} | {f"m{i}": {"i0": 50, f"u{i}": 1} for i in range(30)}
    df = spark.createDataFrame([(i, k, float(v)) for i, c in content.items() for k, v in c.items()], ITEMS)
    for score, least in (("cosine", 0.72), ("cosine", 0.3), ("jaccard", 0.4), ("jaccard", 0.8)):
        assert pairs_of(alias._similar_groups(df, score, least)) == loop(content, score, least), (score, least)


def test_all_parts_by_trigrams(spark):
    e = t.entities(spark, SMALL)
    content = {r["entity_id"]: grams(r["display_name"], r["canonical_name"], r["aliases"]) for r in e.collect()}
    got = pairs_of(alias.trigram_pairs(e))
    assert got == loop(content, "cosine", 0.72) and len(got) > 50


def test_all_parts_by_context(spark):
    e, r = t.entities(spark, SMALL), t.relations(spark, SMALL)
    ids = {x["entity_id"] for x in e.select("entity_id").collect()}
    content = collections.defaultdict(dict)
    for x in r.select("source_id", "target_id", "relation_type").collect():
        if x["target_id"] in ids:
            content[x["target_id"]][f"in:{x['relation_type']}:{x['source_id'].split('.')[0]}"] = 1
    assert pairs_of(alias.context_pairs(e, r)) == loop(content, "jaccard", 0.4)


def test_common_items_are_not_joined(spark, monkeypatch):
    """Every list holds two common items, which are light beside its own: no two lists meet through them."""
    met, plain = [], alias._meetings
    monkeypatch.setattr(alias, "_meetings", lambda *a: met.append(plain(*a)) or met[-1])
    rows = [(f"e{i}", k, n) for i in range(300) for k, n in (("hub", 1.0), ("hub2", 1.0), (f"own{i}", 3.0), (f"more{i}", 3.0))]
    _, close = alias.similar_classes(spark.createDataFrame(rows, ITEMS), "cosine", 0.72)
    assert close.count() == 300 and met[0].count() == 300 and close.where("l_grp <> r_grp").count() == 0
