"""Removal of repeated byte strings by column-wise construction over many fragments.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else. Two equal
strings of that length choose the same anchor inside them (the gram of smallest hash), so only the
surroundings of anchors whose gram occurs again can hold a repeat. Around each such anchor a fragment
is cut: length - gram bytes to its left, and length bytes from its start. In fragments of one gram, a
repeat lies in the same columns.

The collection of fragments of many grams is then built column by column, from the last to the first:
each round inserts one symbol per fragment, stably re-sorts the order of the suffixes by it (the rows'
next symbols are that order's Burrows-Wheeler column) and updates the common prefixes of neighbours
from those of the round before. After a round, a fragment has a repeat that starts in the column iff a
neighbour shares at least `length` symbols. Since fragments are aligned at their anchors, suffixes are
ordered among those of the same column only. The fragments come from Spark's sorted shuffle files and
are read in order, a bounded batch of whole grams at a time; order and prefixes are rewritten each round.

All repeats of a fragment contain its anchor, so the bytes they cover are one interval, given by the
first and the last column that has one. Equal fragments are collapsed before they are dealt out, first
in each batch, then for each gram: all their strings are repeats, and one of them stands for them.

A gram with more than `hot` different fragments is not gathered in one task: the hashes (128 bits) of
its fragments' strings are counted over all tasks instead, which gives the same intervals.

Defined cases: null text counts as empty and keeps its row. Repeated rows (and repeated ids) are rows
of their own, so each makes the other's long strings repeats. Texts shorter than `length` keep all.
Texts of any length are taken whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 200, 32
NO_ID = -(2**63)  # stands for a null id
SPARE = 256  # stands for bytes beyond a document's ends


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every position; never 0."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    data = np.ascontiguousarray(data)
    h = np.zeros(n, np.uint64)
    for i, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        h += np.ndarray((n,), "<u8", data, 8 * i, (1,)) * np.uint64(c)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h | np.uint64(1)


def _slide(x: np.ndarray, size: int, best) -> np.ndarray:
    """best(x[i:i+size]) for every i, by doubling."""
    done = 1
    while done * 2 <= size:
        x = best(x[: len(x) - done], x[done:])
        done *= 2
    return best(x[: len(x) - (size - done)], x[size - done :]) if done < size else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors of all strings of `length` bytes within documents."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data)
    size = length - GRAM + 1
    if len(h) < size:
        return none
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = _slide(short, size, np.minimum)
    starts = np.zeros(len(low), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            starts[a : b - length + 1] = True
    low = np.where(starts, low, np.uint32(0))
    padded = np.zeros(len(low) + 2 * (size - 1), np.uint32)
    padded[size - 1 : size - 1 + len(low)] = low
    at = np.flatnonzero(_slide(padded, size, np.maximum)[: len(short)] == short)
    return at, h[at]


def columns(matrix: np.ndarray, group: np.ndarray, length: int, last_start: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column (-1: none) at which a row shares `length` symbols with another row of its group.

    group is sorted; matrix[i, j] is the j-th symbol of row i. Strings that hold a SPARE do not count.
    """
    real = matrix != SPARE
    begin = real.argmax(axis=1)
    end = begin + real.sum(axis=1) - length
    n, width = matrix.shape
    first, last = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    order = np.arange(n)
    common_prefix = np.zeros(n + 1, np.int32)  # [i]: of the rows at i - 1 and i of the order; ends are 0
    key0 = group.astype(np.int64) * (SPARE + 1)
    by_column = np.ascontiguousarray(matrix.T)
    for j in range(width - 1, -1, -1):
        key = key0[order] + by_column[j][order]
        o = np.argsort(key, kind="stable")
        order = order[o]
        key = key[o]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        a, b = o[same - 1] + 1, o[same]
        low = common_prefix[b].copy()
        far = np.flatnonzero(b > a)
        if len(far):
            far = far[np.argsort(a[far], kind="stable")]
            cuts = np.empty(2 * len(far), np.int64)
            cuts[0::2], cuts[1::2] = a[far], b[far] + 1
            low[far] = np.minimum.reduceat(common_prefix, cuts)[0::2]
        common_prefix = np.zeros(n + 1, np.int32)
        common_prefix[same] = low + 1
        if j <= last_start:
            hit = order[np.maximum(common_prefix[:-1], common_prefix[1:]) >= length]
            hit = hit[(begin[hit] <= j) & (j <= end[hit])]
            first[hit] = j
            last[hit] = np.maximum(last[hit], j)
    return first, last


def _matrix(raw: np.ndarray, offsets: np.ndarray, lo: np.ndarray, length: int) -> np.ndarray:
    """Fragments as rows, anchors in column length - GRAM, SPARE where a document has no byte."""
    left, sizes = length - GRAM, np.diff(offsets)
    out = np.full((len(lo), left + length), SPARE, np.uint16)
    rows = np.repeat(np.arange(len(lo)), sizes)
    out[rows, np.arange(len(raw)) - np.repeat(offsets[:-1] - (left - lo), sizes)] = raw
    return out


FRAGMENT = "gram long, doc_id long, content long, lo int, pos long, fragment binary"
COVERED = "doc_id long, content long, start long, end long"


def _fragments(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Fragments around the places of each document."""
    joined = docs.join(places, ["doc_id", "content"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = common.bytes_of(common.column(b, "text"))
            spots = common.column(b, "spots").to_pylist()
            ids, contents = common.column(b, "doc_id").to_pylist(), common.column(b, "content").to_pylist()
            rows, pieces = [], []
            for i, found in enumerate(spots):
                doc = raw[offsets[i] : offsets[i + 1]]
                for s in found:
                    p = s["pos"]
                    a = max(0, p - (length - GRAM))
                    rows.append((s["gram"], ids[i], contents[i], p - a, p))
                    pieces.append(doc[a : p + length].tobytes())
                    if len(rows) >= 4000:
                        yield _batch(rows, pieces)
                        rows, pieces = [], []
            if rows:
                yield _batch(rows, pieces)

    def _batch(rows: list, pieces: list) -> pa.RecordBatch:
        gram, ids, contents, lo, pos = zip(*rows, strict=True)
        arrays = [pa.array(gram, pa.int64()), pa.array(ids, pa.int64()), pa.array(contents, pa.int64()), pa.array(lo, pa.int32()), pa.array(pos, pa.int64()), pa.array(pieces, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["gram", "doc_id", "content", "lo", "pos", "fragment"])

    return joined.select("doc_id", "text", "content", "spots").mapInArrow(cut_out, FRAGMENT)


def _by_columns(fragments: DataFrame, length: int, batch_rows: int = 12_000) -> DataFrame:
    """Covered intervals of the fragments of grams that are not hot."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            gram = t.column("gram").to_numpy()
            group = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
            lo = t.column("lo").to_numpy()
            first, last = columns(_matrix(*common.bytes_of(t.column("fragment")), lo, length), group, length, length - GRAM)
            hit = np.flatnonzero(first >= 0)
            if len(hit):
                base = t.column("pos").to_numpy()[hit] - (length - GRAM)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.column("doc_id").to_numpy()[hit]), t.column("content").take(pa.array(hit)).combine_chunks(), pa.array(base + first[hit]), pa.array(base + last[hit] + length)],
                    names=["doc_id", "content", "start", "end"],
                )

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < batch_rows:
                continue
            t = pa.Table.from_batches(held)
            gram = t.column("gram").to_numpy()
            edge = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
            if edge:
                yield from solved(t.slice(0, edge))
            held = t.slice(edge).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield from solved(pa.Table.from_batches(held))

    dealt = fragments.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(build, COVERED)


def _by_counts(fragments: DataFrame, length: int) -> DataFrame:
    """The same for hot grams: strings that are counted twice or more, by hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, content, lo, pos, frag in zip(*(common.column(b, c).to_pylist() for c in ("doc_id", "content", "lo", "pos", "fragment")), strict=True):
                for c in range(max(0, len(frag) - length + 1)):
                    if c <= lo and c + length >= lo + GRAM:
                        out[0].append(hashlib.blake2b(frag[c : c + length], digest_size=16).digest())
                        out[1].append(doc)
                        out[2].append(content)
                        out[3].append(pos - lo + c)
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["h", "doc_id", "content", "start"])
                    out = [[], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["h", "doc_id", "content", "start"])

    every = fragments.mapInArrow(strings, "h binary, doc_id long, content long, start long").distinct()
    again = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    hits = every.join(again, "h")
    return hits.select("doc_id", "content", "start", (F.col("start") + length).alias("end"))


def covered(source: DataFrame, length: int = LENGTH, hot: int = 50_000) -> DataFrame:
    """(doc_id, content, intervals): byte intervals of repeats, from (doc_id, text, content), content being the text's hash."""
    common.prepare(source.sparkSession)

    left = length - GRAM

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = common.bytes_of(common.column(b, "text"))
            at, gram = anchors(raw, offsets, length)
            row = np.searchsorted(offsets, at, side="right") - 1
            begin, end = np.maximum(offsets[row], at - left), np.minimum(offsets[row + 1], at + length)
            text = raw.tobytes()
            frag = np.fromiter((xxhash.xxh3_64_intdigest(text[a:z], p) for a, z, p in zip(begin.tolist(), end.tolist(), (at - begin).tolist(), strict=True)), np.uint64, len(at))
            order = np.lexsort((frag, gram))
            new = np.ones(len(order), bool)
            new[1:] = (gram[order][1:] != gram[order][:-1]) | (frag[order][1:] != frag[order][:-1])
            group = np.cumsum(new) - 1
            size = np.bincount(group) if len(order) else np.empty(0, np.int64)
            lead, copies = order[new], size
            # members of groups of a batch are settled; of other groups, and of one row of each, more is asked
            settled = np.zeros(len(at), bool)
            settled[order] = size[group] > 1 if len(order) else False
            keep = np.zeros(len(at), np.int64)
            keep[lead] = copies
            some = np.flatnonzero(keep)
            ids, contents = (common.column(b, c).to_numpy() for c in ("doc_id", "content"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row[some]]), pa.array(contents[row[some]]), pa.array(gram[some].view(np.int64)), pa.array(frag[some].view(np.int64)), pa.array(keep[some]), pa.array(at[some] - offsets[row[some]]), pa.array(end[some] - offsets[row[some]]), pa.array(begin[some] - offsets[row[some]])],
                names=names,
            )
            rest = np.flatnonzero(settled & (keep == 0))
            if len(rest):
                # their intervals, run together, under names of their own
                r = row[rest]
                first = np.ones(len(rest), bool)
                first[1:] = (r[1:] != r[:-1]) | (begin[rest][1:] > end[rest][:-1])
                a = np.flatnonzero(first)
                z = np.append(a[1:], len(rest)) - 1
                o, own = offsets[r[a]], common.mix(ids[r[a]].astype(np.uint64) * np.uint64(31) + at[rest][a].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r[a]]), pa.array(contents[r[a]]), pa.array(own), pa.array(own), pa.array(np.full(len(a), 2)), pa.array(begin[rest][a] - o), pa.array(end[rest][z] - o), pa.array(begin[rest][a] - o)],
                    names=names,
                )

    names = ["doc_id", "content", "gram", "frag", "n", "pos", "end", "start"]
    spots = source.mapInArrow(scan, "doc_id long, content long, gram long, frag long, n long, pos long, end long, start long")
    same = Window.partitionBy("gram", "frag")
    counted = (
        spots.repartition("gram")
        .withColumn("nth", F.row_number().over(same.orderBy("doc_id", "content", "pos")))
        .withColumn("copies", F.sum("n").over(same))
        .withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy("gram")))
    )
    known = common.cut(counted.where("copies > 1 or kinds > 1").select("doc_id", "content", "gram", "pos", "start", "end", "copies", "nth", "kinds"))
    asked = known.where("kinds > 1 and nth = 1")
    places = lambda rows: rows.groupBy("doc_id", "content").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("spots"))
    found = _by_columns(_fragments(source, places(asked.where(F.col("kinds") <= hot)), length), length).unionByName(known.where("copies > 1").select("doc_id", "content", "start", "end"))
    if asked.where(F.col("kinds") > hot).limit(1).count():
        found = found.unionByName(_by_counts(_fragments(source, places(asked.where(F.col("kinds") > hot)), length), length))
    return found.groupBy("doc_id", "content").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("intervals"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    joined = rows.join(covered(rows, length, hot), ["doc_id", "content"], "left").select("doc_id", "text", "intervals")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = common.bytes_of(common.column(b, "text"))
            kept, removed, spans = [], [], []
            for i, intervals in enumerate(common.column(b, "intervals").to_pylist()):
                doc = raw[offsets[i] : offsets[i + 1]]
                if not intervals:
                    kept.append(doc.tobytes())
                    removed.append(0)
                    spans.append(0)
                    continue
                delta = np.zeros(len(doc) + 1, np.int64)
                np.add.at(delta, [x["start"] for x in intervals], 1)
                np.add.at(delta, [x["end"] for x in intervals], -1)
                gone = np.cumsum(delta)[:-1] > 0
                kept.append(doc[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [common.column(b, "doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    out = joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def digest(stripped: DataFrame) -> DataFrame:
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
