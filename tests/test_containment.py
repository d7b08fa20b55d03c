"""Texts within texts against a plain double loop."""

from __future__ import annotations

import random

from ripplegraph.functions import containment


def pairs(spark, inner, outer, **sizes):
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "text string")
    return sorted((r["inner"], r["outer"]) for r in containment.pairs_within(frame(inner), frame(outer), **sizes).collect())


def test_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice(["a", "b", "ab", "é", "限", "😀", " ", "_", "\n"]) for _ in range(rng.randint(1, n)))
    inner = [word(4) for _ in range(150)] + ["", None, "name 1", "name 11", "name 111", "a", "a"]
    outer = [word(40) for _ in range(200)] + ["", None, "x name 111 y", "a", "a" * 5000]
    want = sorted((i, o) for i in {i for i in inner if i} for o in {o for o in outer if o} if i in o)
    assert pairs(spark, inner, outer) == want
    assert pairs(spark, inner, outer, slice_rows=40) == want
    assert pairs(spark, inner, outer, slice_chars=100) == want


def test_numbered_names_cost_what_is_found(spark):
    names = [f"part {i}" for i in range(3000)]
    got = pairs(spark, names, [f"set part {i} now" for i in range(2990, 3000)])
    assert len(got) == 40 and all(o[4:].startswith(i) for i, o in got)


def test_nothing(spark):
    assert pairs(spark, [], ["a"]) == [] == pairs(spark, ["a"], []) == pairs(spark, [""], ["a"])
