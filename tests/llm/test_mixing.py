"""Mixing: targets against a plain loop, what is taken against the words of the mixture itself."""

from __future__ import annotations

import collections
import random
import re
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from ripplegraph.llm import common, mixing, queries

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"


def shared(sizes, weights=(5, 2, 1)):
    """sizes by source, in order; excess is shared anew by weight until no target is above two times the size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, full = Fraction(3, 2) * sum(sizes), set()
    while True:
        left = total - sum(2 * sizes[i] for i in full)
        free = sum(w[i] for i in range(len(sizes)) if i not in full)
        t = [Fraction(2 * sizes[i]) if i in full else left * w[i] / free for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if t[i] > 2 * sizes[i]}
        if not over:
            return [float(x) for x in t]
        full |= over


def test_permutations():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        a, b = (mixing.permuted(np.arange(n), n, k) for k in (1, 2))
        assert sorted(a) == list(range(n)) == sorted(b)
        assert n < 64 or (a != b).any()


def test_targets_of_large_sources(spark):
    for n in (10**6, 4 * 10**8, 10**9, 10**12):  # a word of share is an int, one near its limit, a long
        sizes = [n, n, n]
        rows = spark.createDataFrame([(f"s{i}", n, 0) for i, n in enumerate(sizes)], "source string, source_size long, begin long")
        got = [r["target"] for r in mixing.targets(rows, mixing.Recipe()).orderBy("number").collect()]
        assert np.allclose(got, shared(sizes))


def test_query_against_its_rules(spark):
    docs = common.read(spark, SMALL, "documents")
    got = queries.op11_mixing(spark, SMALL).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert len(got) == len(texts) and all(len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) == n for i, n in zip(got.doc_id, got["size"], strict=True))
    got["source"] = [source[i] for i in got.doc_id]
    sums = got.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).reset_index()
    sums = sums.sort_values("source", na_position="last")
    assert (sums["size"] == sums.source_size).all()
    assert np.allclose(sums.target, shared([int(n) for n in sums["size"]]))
    assert (abs(sums.taken - sums.target) <= 64).all() and (got.taken <= 2 * got["size"]).all()
    assert abs(sums.taken.sum() - 1.5 * sums["size"].sum()) < 0.01 * sums["size"].sum()


def test_taken_are_the_words_of_the_mixture(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        s = "hot" if i % 3 else rng.choice(["b", "Ä", "a", None, "tiny"])
        n = 3000 if i == 7 else rng.choice([0, 1, 5, 40, 90])
        rows.append((i, " \t".join(f"d{i}.{k}" for k in range(n)) + "\n", s))
    rows += [(500, None, "none"), (501, " \n", "none"), (None, "x y z", "hot"), (None, "x y z", "hot")]
    df = spark.createDataFrame(rows, DOC).withColumn("size", F.lit("x")).withColumn("number", F.lit(-1))
    recipe = mixing.Recipe(block=8, shard=50)
    got = mixing.mix(df, recipe).collect()
    assert len(got) == len(rows)
    slots = mixing.mixture(df.repartition(5), recipe).collect()
    words = collections.Counter(w.split(".")[0] for r in slots for w in r["text"].split(" "))
    assert {r["doc_id"]: r["taken"] for r in got if r["doc_id"] is not None} == {i: words[f"d{i}"] for i, _, _ in rows if i is not None}
    assert sum(r["taken"] for r in got if r["doc_id"] is None) == words["x"] + words["y"] + words["z"]
    assert max(collections.Counter((r["source"], r["block"]) for r in slots).values()) <= 2
    per = collections.Counter(r["shard"] for r in slots)
    assert max(per.values()) < 100 and len(per) > 30
    again = mixing.mix(df.repartition(7), recipe).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_no_words(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, None)], DOC)).collect()] == [(1, 0, 0, 0.0, 0)]
