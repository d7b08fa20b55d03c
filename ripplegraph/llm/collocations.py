"""Phrase collocations: contiguous phrases of two or three words, scored by how seldom their parts stand apart.

The texts are encoded once: a shard is the different (lang, word) names of some megabytes of text and the text as numbers
of them, with -1 between pieces. Level by level, for two and for three words:

1. Bound. Phrases whose parts are frequent (by a bitmap of fixed size) are counted by hash, in ranges of hashes of bounded
   size; the hashes that reach the support become the next bitmap. Equal hashes only add up, so no frequent phrase is
   lost: a candidate is Apriori-safe. A hot phrase is one number of each shard.
2. Candidates. The phrases at such hashes are gathered by their words, each from the shards of one crew that has it.
3. Counting. The candidates are dealt into slices of bounded number and bytes. Each slice becomes a double-array trie over
   the words it uses and is broadcast; in every shard the states of all text positions advance together, one word a step, and
   accepting states are bincounted. Sums over shards are exact counts.

A slice (about 2**19 phrases or 32 MB of words, whatever is less) is built by one task; the driver passes it on, compressed, one
at a time, and holds bitmaps of 2**26 bits. A slice costs a pass over the encoded shards, so passes grow with the
candidates; texts are read and split once.

Defined cases: a null text has no words, a null lang is `und`; a text may be of any length; words are compared by bytes;
counts are exact to 10**14; no documents, no rows; columns other than text and lang are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lineage
from . import common

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
APART = BREAK.copy()
APART[[32, 9]] = True
SHARD_BYTES = 4 << 20
BITS = 26
KEY_BITS = 36  # of a phrase's hash, in its bound
CREWS = 4  # shards are of one of these; a candidate is named by one crew
RANGE = 1 << 20  # phrases of a range of hashes, repeats counted, on average
SLICE, SLICE_BYTES = 1 << 19, 32 << 20
NAMES = ("x", "y", "z")


# -- shards --------------------------------------------------------------------------------------


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.slices(whole, "text", 1 << 20, SHARD_BYTES):
            data, offsets = common.bytes_of(common.column(batch, "text"))
            data = common.LOWER[data]
            starts, ends, rows = common.word_spans(data, offsets, APART)
            if len(starts) == 0:
                continue
            langs = common.column(batch, "lang").fill_null("und").dictionary_encode()
            words = common.distinct_spans(data, starts, ends)
            codes = np.asarray(langs.indices).astype(np.int64)[rows] * len(words.dictionary) + np.asarray(words.indices)
            different, ids = np.unique(codes, return_inverse=True)
            lang, word = np.divmod(different, len(words.dictionary))
            names = pc.binary_join_element_wise(langs.dictionary.cast(pa.large_binary()).take(pa.array(lang)), words.dictionary.take(pa.array(word)), pa.scalar(b"\n", pa.large_binary()))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names.to_pylist()), np.uint64, len(names))
            breaks = np.cumsum(BREAK[data], dtype=np.int32)[starts]
            apart = np.flatnonzero((np.diff(breaks) > 0) | (np.diff(rows) > 0)) + 1
            stream = np.insert(ids.astype(np.int32), apart, -1)
            tokens = common.write_batch(pa.RecordBatch.from_arrays([names.cast(pa.binary()), pa.array(hashes), pa.array(np.bincount(ids))], ["name", "hash", "n"]))
            text = common.write_batch(pa.RecordBatch.from_arrays([pa.array(stream)], ["ids"]))
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.binary()), pa.array([text], pa.binary())], ["tokens", "ids"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Names, hashes and counts of a shard, and its text with three further -1."""
    for batch in batches:
        for tokens, ids in zip(common.column(batch, "tokens"), common.column(batch, "ids"), strict=True):
            text = common.read_batch(ids.as_py()).column(0).to_numpy()
            yield common.read_batch(tokens.as_py()), np.concatenate([text, np.full(3, -1, np.int32)])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, hash, n) of the words of each shard; the name of no word counts all words of a lang."""
    for batch in batches:
        for blob in common.column(batch, "tokens"):
            tokens = common.read_batch(blob.as_py())
            name, n = tokens.column(0), tokens.column(2)
            yield pa.RecordBatch.from_arrays([name, pa.array(tokens.column(1).to_numpy().view(np.int64)), n], ["name", "hash", "n"])
            lang = pc.replace_substring_regex(name.cast(pa.string()), r"(?s)[^\n]*\z", "")
            sums = pa.table([lang, n], names=["lang", "n"]).group_by("lang").aggregate([("n", "sum")])
            yield pa.RecordBatch.from_arrays([sums["lang"].combine_chunks().cast(pa.binary()), pa.array(np.zeros(len(sums), np.int64)), sums["n_sum"].combine_chunks()], ["name", "hash", "n"])


# -- bounds and candidates -----------------------------------------------------------------------


def _bitmaps(hashes: DataFrame, bits: int, crews: int = 1) -> list[np.ndarray]:
    """The first `bits` bits of the hashes as a bitmap for each crew; they have one size for all inputs."""
    slot = F.shiftrightunsigned("hash", 64 - bits)
    maps = hashes.groupBy("crew", F.floor(slot / 32768).alias("part")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits"))
    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(crews)]
    for crew, part, bytes_ in maps.collect():
        out[crew][4096 * part : 4096 * part + 4096] = np.frombuffer(bytes_, np.uint8)[: len(out[crew])]
    return out


def _crew(tokens: pa.RecordBatch) -> int:
    """A number of a shard that follows from its words alone."""
    return int(common.mix(tokens.column(1).to_numpy()[:1])[0] >> np.uint64(32)) % CREWS


def _held(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _phrases(tokens: pa.RecordBatch, text: np.ndarray, maps: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases of len(maps) + 1 words whose parts are all in the bitmaps (maps[k] has those of k + 1 words)."""
    own = tokens.column(1).to_numpy()
    good = np.append(_held(maps[0], own, bits), False)[text]  # -1 is the last
    at = np.flatnonzero(good[:-1] & good[1:])
    hashes = np.append(own, np.uint64(0))
    name = lambda places: common.mix(hashes[text[places]] * np.uint64(0x9E3779B97F4A7C15) + hashes[text[places + 1]])
    found = name(at)
    if len(maps) == 1:
        return at, found
    good = _held(maps[1], found, bits)
    at, found = at[good], found[good]
    both = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[both], common.mix(found[both] * np.uint64(0xC2B2AE3D27D4EB4F) + found[both + 1])


def _hash_counts(shared: object, bits: int, support: int, parts: int):
    """Hashes of the phrases of each shard and how often they come, up to the support, by range of hashes: rising keys as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, text in _shards(batches):
            keys, n = np.unique(_phrases(tokens, text, shared.value, bits)[1] >> np.uint64(64 - KEY_BITS), return_counts=True)
            ranges = (keys >> np.uint64(KEY_BITS - 20)).astype(np.int64) * parts >> 20
            cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(keys) else np.empty(0, np.int64)
            crew, rows = _crew(tokens), [[], [], []]
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(keys)][: len(cuts)], strict=True):
                rows[0].append(int(ranges[lo]))
                rows[1].append(common.squeeze(keys[lo:hi]))
                rows[2].append(pa.compress(np.minimum(n[lo:hi], support).astype(np.uint16).tobytes(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), pa.array([crew] * len(rows[0]), pa.int32())], ["part", "keys", "n", "crew"])

    return run


def _frequent(support: int):
    """The keys of one range that come `support` times or more in all shards together, each with a crew that has it."""

    def run(table: pa.Table) -> pa.Table:
        keys = [common.stretch(k.as_py()) for k in table["keys"]]
        n = [np.frombuffer(pa.decompress(c.as_py(), 2 * len(k), "zstd"), np.uint16) for c, k in zip(table["n"], keys, strict=True)]
        different, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(which, weights=np.concatenate(n))
        crew = np.zeros(len(different), np.int32)
        crew[which] = np.repeat(table["crew"].to_numpy(), [len(k) for k in keys]).astype(np.int32)
        often = sums >= support
        return pa.table([pa.array((different[often] << np.uint64(64 - KEY_BITS)).view(np.int64)), pa.array(crew[often])], names=["hash", "crew"])

    return run


def _named(shared: object, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, text in _shards(batches):
            parts, crews = shared.value
            mine = crews[_crew(tokens)]
            at, hashes = _phrases(tokens, text, parts, bits)
            at = at[_held(mine, hashes, bits)]
            width = len(parts) + 1
            rows = np.unique(np.stack([text[at + k] for k in range(width)], axis=1), axis=0) if len(at) else np.empty((0, width), np.int32)
            yield pa.RecordBatch.from_arrays([tokens.column(0).take(pa.array(rows[:, k])) for k in range(width)], list(NAMES[:width]))

    return run


# -- double-array tries --------------------------------------------------------------------------


class Trie:
    """Phrases (rows of word numbers) as two arrays: the child of state s by word w is base[s] + w if check there is s."""

    def __init__(self, rows: np.ndarray, words: int, seed: int = 7) -> None:
        self.rng = np.random.default_rng(seed)
        self.words = words
        room = 1 + 2 * words + 3 * rows.size + 64
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.base[0], self.check[0] = 1, 0
        self.check[1 : 1 + words] = 0
        state = 1 + rows[:, 0].astype(np.int64)
        for k in range(1, rows.shape[1]):
            nodes, which = np.unique(state * words + rows[:, k], return_inverse=True)
            parent, word = np.divmod(nodes, max(words, 1))
            self._place(parent, word)
            state = (self.base[parent] + word)[which]
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[state] = np.arange(len(rows), dtype=np.int32)

    def _place(self, parent: np.ndarray, word: np.ndarray) -> None:
        """Find a base for every parent at which all its children's places are free; families of one size at a time, large ones first."""
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[first, len(parent)])
        for size in np.unique(sizes)[::-1]:
            todo, tries = first[sizes == size], 0
            while len(todo):
                lot = todo[: max(1, (1 << 20) // size)]
                bases = self.rng.integers(1, len(self.check) - self.words, len(lot))
                places = bases[:, None] + word[lot[:, None] + np.arange(size)]
                flat = places.ravel()
                claimed = np.zeros(len(flat), bool)
                claimed[np.unique(flat, return_index=True)[1]] = True  # of two families that want a place the first gets it
                fits = (claimed.reshape(places.shape) & (self.check[places] < 0)).all(axis=1)
                self.base[parent[lot[fits]]] = bases[fits]
                self.check[places[fits]] = parent[lot[fits]][:, None]
                todo = np.concatenate([lot[~fits], todo[len(lot) :]])
                tries += 1
                if tries % 64 == 0:  # crowded: more room
                    more = len(self.check) // 2
                    self.base, self.check = np.append(self.base, np.zeros(more, np.int32)), np.append(self.check, np.full(more, -1, np.int32))

    def count(self, text: np.ndarray, width: int) -> np.ndarray:
        """Numbers of the phrases of `width` words in a text of word numbers (-1: none), all positions at once."""
        at = np.flatnonzero(text >= 0)
        state = self.base[0] + text[at].astype(np.int64)
        for k in range(1, width):
            word = text[at + k]
            to = self.base[state].astype(np.int64) + np.maximum(word, 0)
            on = (word >= 0) & (self.check[to] == state)
            at, state = at[on], to[on]
        return self.accept[state]


def _pack(names: pa.Array, trie: Trie, cids: np.ndarray) -> bytes:
    """A slice's trie with the words that it numbers and the candidates that it accepts."""
    parts = [[names], [pa.array(trie.base), pa.array(trie.check), pa.array(trie.accept)], [pa.array(cids)]]
    return pickle.dumps([common.write_batch(pa.RecordBatch.from_arrays(p, list("abc")[: len(p)])) for p in parts])


def _unpack(blob: bytes) -> tuple[pa.Array, Trie, np.ndarray]:
    names, arrays, cids = (common.read_batch(b) for b in pickle.loads(blob))
    trie = Trie.__new__(Trie)
    trie.base, trie.check, trie.accept = (c.to_numpy() for c in arrays.columns)
    return names.column(0), trie, cids.column(0).to_numpy()


def _built(width: int):
    def run(table: pa.Table) -> pa.Table:
        ids = pa.chunked_array([c for name in NAMES[:width] for c in table[name].chunks], pa.binary()).combine_chunks().dictionary_encode()
        rows = np.asarray(ids.indices).reshape(width, -1).T
        blob = _pack(ids.dictionary, Trie(rows, len(ids.dictionary)), table["cid"].to_numpy())
        return pa.table([table["slice"].slice(0, 1), pa.array([blob], pa.binary())], names=["slice", "trie"])

    return run


def _count(shared: object, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trie, cids = _unpack(shared.value)
        values = pc.SetLookupOptions(value_set=names)
        sums = np.zeros(len(cids), np.int64)
        for tokens, text in _shards(batches):
            known = pc.index_in(tokens.column(0), options=values).fill_null(-1).to_numpy()
            found = trie.count(np.append(known, np.int32(-1))[text], width)
            sums += np.bincount(found[found >= 0], minlength=len(sums))
        some = np.flatnonzero(sums)
        for a in range(0, len(some), 1 << 16):
            b = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cids[b]), pa.array(sums[b])], ["cid", "n"])

    return run


def count_phrases(shards: DataFrame, candidates: DataFrame, width: int, slice_rows: int = SLICE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """candidates (cid, x, y[, z]) with `f`, how often each occurs; one pass over the shards for each slice."""
    names = list(NAMES[:width])
    size = sum((F.octet_length(c) for c in names), F.lit(0))
    n, total = candidates.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    slices = max(1, -(-n // slice_rows), -(-total // slice_bytes))
    dealt = candidates.withColumn("slice", F.pmod(F.xxhash64(*names), F.lit(slices)).cast("long"))
    tries = lineage.cut(dealt.groupBy("slice").applyInArrow(_built(width), "slice long, trie binary"))
    out = None
    for k in range(slices):
        blob = tries.where(F.col("slice") == k).select("trie").collect()
        if not blob:
            continue
        shared = shards.sparkSession.sparkContext.broadcast(bytes(blob[0][0]))
        sums = lineage.cut(shards.mapInArrow(_count(shared, width), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("f")))
        shared.destroy()
        out = sums if out is None else out.unionByName(sums)
    return candidates.drop("cid").withColumn("f", F.lit(0).cast("long")).limit(0) if out is None else candidates.join(out, "cid").drop("cid")


# -- scores --------------------------------------------------------------------------------------


def _lang(name: Column) -> Column:
    text = name.cast("string")
    return F.left(text, F.length(text) - F.length(_word(name)) - 1)


def _word(name: Column) -> Column:
    return F.substring_index(name.cast("string"), "\n", -1)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), in whole numbers of up to 37 digits."""
    wide = [c.cast("decimal(14,0)") for c in (a, left, right)]
    top = F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0]
    return F.call_function("div", top, wide[1] * wide[2])


def frequent_phrases(docs: DataFrame, support: int = 10, bits: int = BITS, slice_rows: int = SLICE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words (x, f), pairs (x, y, f) and triples (x, y, z, f) that occur `support` times at least, and words by lang (lang, n)."""
    spark = docs.sparkSession
    common.prepare(spark, rows=1 << 16)
    shards = lineage.cut(docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang").mapInArrow(_encode, "tokens binary, ids binary"))
    common.prepare(spark, rows=4)
    counts = shards.mapInArrow(_words, "name binary, hash long, n long").groupBy("name", "hash").agg(F.sum("n").alias("f"))
    total = F.col("name").cast("string").endswith("\n")
    counts = lineage.cut(counts.where((F.col("f") >= support) | total))
    words = counts.where(~total).select(F.col("name").alias("x"), "f")
    parts = min(1 << 20, -(-(counts.where(total).agg(F.sum("f")).first()[0] or 1) // RANGE))
    maps, found = _bitmaps(counts.where(~total).withColumn("crew", F.lit(0)), bits), []
    for width in (2, 3):
        shared = spark.sparkContext.broadcast(list(maps))
        keys = shards.mapInArrow(_hash_counts(shared, bits, support, parts), "part int, keys binary, n binary, crew int")
        crews = _bitmaps(keys.groupBy("part").applyInArrow(_frequent(support), "hash long, crew int"), bits, CREWS)
        shared.destroy()
        shared = spark.sparkContext.broadcast((list(maps), crews))
        schema = ", ".join(f"{c} binary" for c in NAMES[:width])
        candidates = lineage.cut(shards.mapInArrow(_named(shared, bits), schema).distinct().withColumn("cid", F.monotonically_increasing_id()))
        shared.destroy()
        held = lineage.cut(count_phrases(shards, candidates, width, slice_rows).where(F.col("f") >= support))
        found.append(held)
        if width == 2:
            maps.append(np.bitwise_or.reduce(crews))
    langs = counts.where(total).select(F.expr("left(cast(name as string), length(cast(name as string)) - 1)").alias("lang"), F.col("f").alias("n"))
    return words, found[0], found[1], langs


def mine(docs: DataFrame, support: int = 10, top: int = 2000, bits: int = BITS, slice_rows: int = SLICE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each lang, without those that a longer one holds half of the time."""
    words, pairs, triples, langs = frequent_phrases(docs, support, bits, slice_rows)
    one = lambda c, f: words.select(F.col("x").alias(c), F.col("f").alias(f))
    two = lambda c, d, f: pairs.select(F.col("x").alias(c), F.col("y").alias(d), F.col("f").alias(f))
    ends = [triples.select(F.col(a).alias("x"), F.col(b).alias("y"), F.col("f").alias("longer")) for a, b in (("x", "y"), ("y", "z"))]
    over = ends[0].unionByName(ends[1]).groupBy("x", "y").agg(F.max("longer").alias("longer"))
    own = pairs.join(over, ["x", "y"], "left").where("longer is null or 100 * longer < 50 * f").drop("longer")
    by2 = own.join(one("x", "l"), "x").join(one("y", "r"), "y")
    by2 = by2.select(_lang(F.col("x")).alias("lang"), F.concat_ws(" ", _word(F.col("x")), _word(F.col("y"))).alias("phrase"), F.col("f").alias("a"), "l", "r", score(F.col("f"), F.col("l"), F.col("r")).alias("score"))
    by3 = triples.join(one("x", "l1"), "x").join(two("y", "z", "r1"), ["y", "z"]).join(two("x", "y", "l2"), ["x", "y"]).join(one("z", "r2"), "z")
    by3 = by3.withColumn("s1", score(F.col("f"), F.col("l1"), F.col("r1"))).withColumn("s2", score(F.col("f"), F.col("l2"), F.col("r2")))
    low = lambda u, v: F.when(F.col("s1") <= F.col("s2"), F.col(u)).otherwise(F.col(v))
    phrase = F.concat_ws(" ", *[_word(F.col(c)) for c in NAMES])
    by3 = by3.select(_lang(F.col("x")).alias("lang"), phrase.alias("phrase"), F.col("f").alias("a"), low("l1", "l2").alias("l"), low("r1", "r2").alias("r"), low("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = by2.unionByName(by3).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
