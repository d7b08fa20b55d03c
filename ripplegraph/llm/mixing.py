"""Mixing sources to target weights: the words of each source are packed into blocks of equal length, and a mixture of
output shards takes blocks so that every source comes near its target.

1. Sources in code-point order (null last) get the weights in turn and share `share` times all words; none gets more than
   `epochs` times its own, and what it leaves is shared anew by weight until none is above.
2. A source's documents, in order of id, are one run of words, cut into blocks of `block` words (the last may be shorter).
3. A source's slots (its target in blocks) are dealt to output shards by multinomial draws: first to groups of shards, then
   within a group, so a task holds one group's counts at most. A source's total is fixed and shards vary around their mean.
4. The j-th slot of a source takes the block that a pseudorandom permutation of the source's blocks (a Feistel network,
   one for each epoch) has at j; so within an epoch no block comes twice.
5. Blocks join the pieces of documents by (source, block).

Seeds are the parameter, the source's place and the group, so reruns agree whatever the partitions. No task holds a source:
words before a document are found by a range-ordered sum, draws by group, blocks by index.

Defined cases: a null text has no words; documents without words belong to no block and are taken 0 times; rows that are
equal are rows of their own; null sources form one source; a source without words has target 0; no documents, no rows;
columns other than doc_id, text and source are ignored. A source shorter than a block is one block, taken 0 to `epochs` times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
EMIT = 1 << 16


@dataclass(frozen=True)
class Recipe:
    """How much of each source, in what pieces."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: Fraction = Fraction(3, 2)
    epochs: int = 2
    block: int = 32
    shard: int = 4096
    seed: int = 20_24


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """sizes (source, source_size, ...) with `number` (place of the source), `target` in words, `n_blocks` and `slots`.

    The driver sees three sums a round: what the full sources hold, the weight of the others, how many are full.
    """
    rows = common.ordered(sizes, [F.col("source").asc_nulls_last()], F.lit(0), place="number", run="_none").drop("_none")
    weight = F.element_at(F.array(*[F.lit(w) for w in recipe.weights]), (F.col("number") % len(recipe.weights) + 1).cast("int"))
    wide = lambda c: c.cast("decimal(38,0)")
    up, down = recipe.share.numerator, recipe.share.denominator
    rows = common.cut(rows.withColumn("weight", weight))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    full, count, num, den = F.lit(False), -1, 0, 1
    while True:  # a word of share is num / (down * den) for each unit of weight; sources once full stay full as it grows
        held, free, n = rows.agg(F.sum(F.when(full, wide(F.col("source_size")))), F.sum(F.when(~full, wide(F.col("weight")))), F.count(F.when(full, 1))).first()
        num, den = up * total - down * recipe.epochs * int(held or 0), int(free or 1)
        if n == count:
            break
        count = n
        full = wide(F.col("weight")) * F.lit(num).cast("decimal(20,0)") > wide(F.col("source_size") * down * recipe.epochs) * F.lit(den).cast("decimal(18,0)")
    # num is an int or a long by its size, so the product would be one too
    shared = (wide(F.col("weight")) * F.lit(num).cast("decimal(20,0)")).cast("double") / F.lit(float(down * den))
    target = F.when(full, (F.col("source_size") * recipe.epochs).cast("double")).otherwise(shared)
    blocks = F.ceil(F.col("source_size") / recipe.block)
    out = rows.withColumn("target", target).withColumn("n_blocks", blocks)
    slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), F.col("n_blocks") * recipe.epochs)).otherwise(0)
    return common.cut(out.withColumn("slots", slots.cast("long")))


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of j in a pseudorandom order of 0..n-1: four Feistel rounds, again while the result is outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), j.astype(np.uint64)
    keys = common.mix(np.arange(1, 5, dtype=np.uint64) + common.mix(np.array([key & (2**64 - 1)], np.uint64)))
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (common.mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    """One number from several."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = common.mix(out + np.uint64(p) + np.uint64(0x9E3779B97F4A7C15))
    return int(out[0])


def draw(plan: DataFrame, recipe: Recipe) -> DataFrame:
    """(shard, at, number, block, epoch) for every slot of the mixture; `at` orders the slots of a shard.

    plan is what targets() gives.
    """
    every = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-every // recipe.shard))
    groups = max(1, math.isqrt(shards))
    edges = np.arange(groups + 1, dtype=np.int64) * shards // groups
    seed, epochs = recipe.seed, recipe.epochs

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.random.default_rng([seed, r["number"], 1]).multinomial(r["slots"], np.diff(edges) / shards)
                some = np.flatnonzero(n)
                first = np.cumsum(n) - n
                same = np.full(len(some), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same * r["number"]), pa.array(same * r["n_blocks"]), pa.array(some), pa.array(first[some]), pa.array(n[some])], ["number", "n_blocks", "group", "first", "n"]
                )

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lo, hi = int(edges[r["group"]]), int(edges[r["group"] + 1])
                counts = np.random.default_rng([seed, r["number"], 2, r["group"]]).multinomial(r["n"], np.full(hi - lo, 1 / (hi - lo)))
                upto = np.cumsum(counts)
                for a in range(0, r["n"], EMIT):
                    k = np.arange(a, min(a + EMIT, r["n"]))
                    shard = lo + np.searchsorted(upto, k, side="right")
                    j = r["first"] + k
                    epoch, block = j // r["n_blocks"], np.empty(len(k), np.int64)
                    for e in range(epochs):
                        of = epoch == e
                        if of.any():
                            block[of] = permuted(j[of] % r["n_blocks"], r["n_blocks"], _key(seed, r["number"], e))
                    at = common.mix(j.astype(np.uint64) + np.uint64(_key(seed, r["number"], 3))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(at), pa.array(np.full(len(k), r["number"])), pa.array(block), pa.array(epoch.astype(np.int32))], ["shard", "at", "number", "block", "epoch"])

    dealt = plan.where("slots > 0").select("number", "n_blocks", "slots").mapInArrow(to_groups, "number long, n_blocks long, group long, first long, n long")
    return dealt.repartition("number", "group").mapInArrow(to_slots, "shard long, at long, number long, block long, epoch int")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """Documents in the order in which they are packed: `size`, `place`, and `run`, the words before; of the text only a hash is kept unless `more` names it."""
    size = size_of(F.col("text"))
    rows = common.cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tag"), *more))
    return common.ordered(rows, [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("tag")], F.col("size"))


def spans(ranked: DataFrame, plan: DataFrame, recipe: Recipe) -> DataFrame:
    """(place, number, block, skip, words): what each document has in each block; `skip` are its words before."""
    plan = plan.select(F.col("source").alias("of"), "number", "begin")
    rows = ranked.where("size > 0").join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("from", F.col("run") - F.col("begin"))
    until = F.col("from") + F.col("size")
    last = F.floor((until - 1) / recipe.block)
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / recipe.block), last)))
    low = F.greatest("from", F.col("block") * recipe.block)
    return rows.withColumn("skip", low - F.col("from")).withColumn("words", F.least(until, (F.col("block") + 1) * recipe.block) - low)


def sources(ranked: DataFrame, recipe: Recipe) -> DataFrame:
    """targets() of the sources of ranked documents, with `begin`, the words before each source."""
    return targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("run").alias("begin")), recipe)


def mix(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    ranked = sized(docs)
    plan = sources(ranked, recipe)
    times = draw(plan, recipe).groupBy("number", "block").agg(F.count("*").alias("times"))
    # sorted on both sides: runtime statistics may take `times` for small, and it grows with the blocks
    taken = spans(ranked, plan, recipe).join(times.hint("merge"), ["number", "block"]).groupBy("place").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    known = plan.select(F.col("source").alias("of"), "source_size", "target")
    out = ranked.join(taken.hint("merge"), "place", "left").join(known, F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The mixture itself: (shard, at, source, block, epoch, text), one row a slot, its words joined by spaces."""
    ranked = sized(docs, "text")
    plan = sources(ranked, recipe)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("skip") + 1).cast("int"), F.col("words").cast("int"))
    pieces = spans(ranked, plan, recipe).select("number", "block", F.struct("place", F.array_join(words, " ").alias("text")).alias("piece"))
    texts = pieces.groupBy("number", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["text"]), " ").alias("text"))
    named = plan.select("number", "source")
    return draw(plan, recipe).join(texts, ["number", "block"]).join(named, "number").select("shard", "at", "source", "block", "epoch", "text")
