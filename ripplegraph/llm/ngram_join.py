"""Jaccard self-join of word-shingle sets by T-occurrence search.

Two sets of sizes a and b have a Jaccard similarity of at least p/100 iff they share
T = ceil(p * (a + b) / (100 + p)) shingles, which is at least ceil(p/100 * size) for either size.

1. Document frequencies. Shingles of a batch of documents travel as packed numbers, dealt by hash
   range. Each range counts its shingles and returns, to the batches, those that occur in two or more
   documents with the class of their frequency (its logarithm). A set with fewer than T such shingles
   can have no partner and drops out. The number of ranges grows with the text.
2. Equal sets (by a signature of 128 bits) become one row, a class of documents.
3. Prefixes. In the order of rising frequency class, two partners must share one of their first
   size - T + 1 shingles, so long inverted lists are hardly ever used for candidates. Sets that meet
   in such a list form candidate groups; groups are cut into blocks of bounded cost by rising size.
4. Meetings. First every block meets itself and the next; then those pairs of blocks of compatible
   sizes meet whose sets are not all in one component yet. So a large group of copies is worked on in
   time that grows with its size, not with its square.
5. T-occurrence search in a meeting (DivideSkip): for each probe, rows of its own component are left
   out of its inverted lists and the L longest lists are set aside; the short ones are merged by a heap
   that skips ahead to rows which T - L lists can still hold; rows found are looked up in the long lists
   by binary search, and those that reach the required overlap are linked. Only links that join two
   components are returned.
6. Components of the links, labelled with the smallest id.

No pair of documents is ever a row; the search runs on packed sets, and skew of a shingle adds one
number per document to its range. Words are named by a hash of their bytes; shingle hashes have 64
bits, of which the search uses 48 or more (48 and the range number); set sizes are counts of distinct 64-bit hashes.

Defined cases: null, empty and blank texts have no shingles and link with nothing; shorter texts than
`words` words are one shingle. Repeated rows are rows of one class; a repeated id is answered for each
of its rows. Texts of any length are taken whole. An empty table gives an empty result. A null id never
names a component; its row is returned with the component of the smallest id they link to, null if none.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

WORDS, PERCENT = 5, 80
_MULTIPLIERS = common.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, rows) of a batch, sorted by row, then hash."""
    low = common.LOWER[raw]
    starts, ends, rows = common.word_spans(low, offsets)
    h = common.word_names(low, starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    out, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(h) >= words:
        whole = sum((h[k : len(h) - words + 1 + k] * _MULTIPLIERS[k] for k in range(words)), np.zeros(len(h) - words + 1, np.uint64))
        inside = rows[: len(rows) - words + 1] == rows[words - 1 :]
        out, owner = common.mix(whole[inside] + np.uint64(words)), rows[: len(rows) - words + 1][inside]
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        first = np.searchsorted(rows, few)
        total = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            has = counts[few] > k
            total[has] += h[first[has] + k] * _MULTIPLIERS[k]
        out = np.concatenate([out, common.mix(total + counts[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], owner[new]


def _frequencies(ids: DataFrame, bits: int, words: int, percent: int) -> DataFrame:
    """One row per document: doc_id, tag, n_shingles, sig and sig2 (name of the set) and, where a partner is possible, its shared shingles by rising frequency."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for some in common.slices(b, "text", 4096, 4 << 20):
                token, row = shingles(*common.bytes_of(common.column(some, "text")), words)
                n = len(some)
                size = np.bincount(row, minlength=n)
                sums = np.zeros((2, n), np.uint64)
                for i, salt in enumerate((0x51ED270B, 0x2545F491)):
                    total = np.zeros(len(token) + 1, np.uint64)
                    np.cumsum(common.mix(token ^ np.uint64(salt)), out=total[1:])
                    ends = np.cumsum(size)
                    sums[i] = common.mix(total[ends] - total[ends - size] + size.astype(np.uint64))
                part = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
                packed = ((token & np.uint64((1 << 48) - 1)) << np.uint64(16)) | row.astype(np.uint64)
                order = np.lexsort((packed, part))
                part, packed = part[order], packed[order]
                cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
                parts = np.flatnonzero(np.diff(cuts))
                payload = [common.squeeze(packed[cuts[p] : cuts[p + 1]], 16) for p in parts]
                doc = common.column(some, "doc_id")
                facts = [doc.fill_null(0).to_numpy(), np.asarray(doc.is_valid()), common.column(some, "tag").to_numpy(), size, *sums.view(np.int64)]
                about = b"".join(x.astype(np.int64).tobytes() for x in facts)
                away = ((chunk >> 32) + (chunk & 0xFFFFFFFF)) % (1 << bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*parts.tolist(), away], pa.int32()),
                        pa.array([chunk] * (len(parts) + 1)),
                        pa.array([False] * len(parts) + [True]),
                        pa.array([*payload, about], pa.binary()),
                    ],
                    names=["part", "chunk", "about", "payload"],
                )
                chunk += 1

    def count(key: tuple, table: pa.Table) -> pa.Table:
        about = np.asarray(table.column("about"))
        rest = table.filter(pa.array(about))
        table = table.filter(pa.array(~about))
        parts = [common.stretch(x.as_py(), 16) for x in table.column("payload")]
        packed = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        source = np.repeat(np.arange(len(table)), [len(x) for x in parts])
        order = np.argsort(packed >> np.uint64(16), kind="stable")
        token = packed[order] >> np.uint64(16)
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
        df = np.diff(edge)
        many = np.repeat(df >= 2, df)
        cls = np.repeat(np.floor(np.log2(np.maximum(df, 1))).astype(np.uint8), df)[many]
        order = order[many]
        back = np.argsort(source[order], kind="stable")
        order, cls = order[back], cls[back]
        counts = np.bincount(source[order], minlength=len(table))
        some = np.flatnonzero(counts)
        chunks = pa.concat_arrays([table.column("chunk").combine_chunks().take(pa.array(some)), rest.column("chunk").combine_chunks()])
        ends = np.cumsum(counts[some])
        payload = pa.array([common.squeeze(packed[order[e - c : e]], 16) for e, c in zip(ends.tolist(), counts[some].tolist(), strict=True)], pa.binary())
        classes = common.blobs(cls, counts[some])
        n, m = len(some), len(rest)
        return pa.table(
            {
                "chunk": chunks,
                "part": pa.array([int(key[0].as_py())] * n + [-1] * m, pa.int32()),
                "payload": pa.concat_arrays([payload, rest.column("payload").combine_chunks().cast(pa.binary())]),
                "classes": pa.concat_arrays([classes, pa.array([b""] * m, pa.binary())]),
            }
        )

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        about = np.frombuffer(table.column("payload")[int(np.flatnonzero(part < 0)[0])].as_py(), np.int64).reshape(6, -1)
        doc, valid, tag, size, sig, sig2 = about
        keep = np.flatnonzero(part >= 0)
        n = len(doc)
        if len(keep):
            packed = np.concatenate([common.stretch(table.column("payload")[int(i)].as_py(), 16) for i in keep])
            cls = np.concatenate([np.frombuffer(table.column("classes")[int(i)].as_py(), np.uint8) for i in keep])
            lengths = [len(table.column("classes")[int(i)].as_py()) for i in keep]
            token = (packed >> np.uint64(16)) | (np.repeat(part[keep].astype(np.uint64), lengths) << np.uint64(min(48, 64 - bits)))
            row = (packed & np.uint64(0xFFFF)).astype(np.int64)
        else:
            token, cls, row = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64)
        shared = np.bincount(row, minlength=n)
        need = -(-percent * size // 100)
        ok = (shared >= need) & (size > 0)
        pick = ok[row]
        token, cls, row = token[pick], cls[pick], row[pick]
        order = np.lexsort((token, cls, row))
        counts = np.where(ok, shared, 0)
        token, ends = token[order], np.cumsum(counts)
        tokens = pa.array([common.squeeze(token[e - c : e]) if fit else None for e, c, fit in zip(ends.tolist(), counts.tolist(), ok.tolist(), strict=True)], pa.binary())
        return pa.table(
            {
                "doc_id": pa.array(doc, mask=valid == 0),
                "tag": pa.array(tag),
                "n_shingles": pa.array(size),
                "sig": pa.array(sig),
                "sig2": pa.array(sig2),
                "tokens": tokens,
            }
        )

    dealt = ids.select("doc_id", "tag", "text").mapInArrow(deal, "part int, chunk long, about boolean, payload binary")
    counted = dealt.groupBy("part").applyInArrow(count, "chunk long, part int, payload binary, classes binary")
    return counted.groupBy("chunk").applyInArrow(gather, "doc_id long, tag long, n_shingles long, sig long, sig2 long, tokens binary")


def merge_skip(lists: list[list[int]], need: int) -> tuple[list[int], list[int]]:
    """Rows on `need` or more of the rising lists, and on how many; a heap holds the head of each list."""
    rows, counts = [], []
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        row, out = heap[0][0], []
        while heap and heap[0][0] == row:
            out.append(heapq.heappop(heap))
        if len(out) >= need:
            rows.append(row)
            counts.append(len(out))
            ahead = row + 1
        else:  # the lists left in the heap must hold the row that comes next
            while len(out) < need - 1:
                out.append(heapq.heappop(heap))
            ahead = heap[0][0]
        for _, i, at in out:
            at = bisect_left(lists[i], ahead, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return rows, counts


class Block:
    """Inverted lists of sets; rows are numbered by rising size."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.owner, self.sizes = owner[order], sizes
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))

    def search(self, probe: np.ndarray, size: int, wanted: np.ndarray, percent: int) -> np.ndarray:
        """Rows among the wanted ones whose sets reach the similarity with a set of `size` shingles, of which `probe` are shared with any other."""
        need = -(-percent * size // 100)
        wanted = wanted & (100 * np.minimum(self.sizes, size) >= percent * np.maximum(self.sizes, size))
        if not wanted.any() or not len(self.keys):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.keys, probe)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == probe]
        runs = self.first[at + 1] - self.first[at]
        entry = self.owner[common.ragged_index(self.first[at], runs)]
        keep = wanted[entry]
        which = np.repeat(np.arange(len(at)), runs)[keep]
        lists = np.split(entry[keep], np.flatnonzero(np.diff(which)) + 1) if len(which) else []
        if len(lists) < need:
            return np.empty(0, np.int64)
        lists.sort(key=len, reverse=True)
        n_long = 0 if len(lists[0]) <= 64 else min(need - 1, int(need / (0.0085 * math.log(len(lists[0])) + 1)), sum(len(x) > 64 for x in lists))
        rows, total = map(np.array, merge_skip([x.tolist() for x in lists[n_long:]], need - n_long))
        for x in lists[:n_long]:
            if not len(rows):
                break
            spot = np.minimum(np.searchsorted(x, rows), len(x) - 1)
            total = total + (x[spot] == rows)
        if not len(rows):
            return np.empty(0, np.int64)
        return rows[100 * total >= percent * (size + self.sizes[rows] - total)]


def _links(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Links of one meeting of two blocks, or of a block with itself, that join components which were apart.

    A link names the components (by their roots so far); each is linked to the smallest of those it was joined with.
    """
    table = table.sort_by([("n_shingles", "ascending"), ("node", "ascending")])
    left = np.asarray(table.column("left"))
    size, root = (table.column(c).to_numpy() for c in ("n_shingles", "root"))
    sets = [common.stretch(x.as_py()) for x in table.column("tokens")]
    index_rows = np.flatnonzero(left)
    same = bool(left.all())
    block = Block([sets[i] for i in index_rows], size[index_rows])
    _, part = np.unique(root, return_inverse=True)  # component of each row of the meeting
    lead: dict[int, int] = {}  # a row of each component that was met last

    def near(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= percent * int(size[i] + size[j] - both)

    def link(i: int, j: int) -> None:
        x, y = part[i], part[j]
        if x != y:
            part[part == x] = y
            lead[int(y)] = j
            lead.pop(int(x), None)

    if not same:
        for i in index_rows.tolist():
            lead[int(part[i])] = i
    for at, i in enumerate((index_rows if same else np.flatnonzero(~left)).tolist()):
        for j in list(lead.values())[-4:]:
            if part[i] != part[j] and near(i, j):
                link(i, j)
        apart = part[index_rows] != part[i]
        if same:
            apart[at:] = False
        for r in block.search(sets[i], int(size[i]), apart, percent).tolist() if apart.any() else ():
            link(i, int(index_rows[r]))
        if same:
            lead.pop(int(part[i]), None)
            lead[int(part[i])] = i
    joined = pa.table({"part": part, "root": root}).group_by("part").aggregate([("root", "min"), ("root", "distinct")])
    a = pc.list_flatten(joined.column("root_distinct"))
    b = joined.column("root_min").take(pc.list_parent_indices(joined.column("root_distinct")))
    return pa.table({"a": a, "b": b}).filter(pc.not_equal(a, b))


def components(
    docs: DataFrame, text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = 200_000, range_bytes: int = 8_000_000, tag_col: str | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, tag, group) of every document.

    `tag` is the long column `tag_col` (0 if not given), `group` names the component, also where no row has an id; null: linked with nothing.
    `block` bounds the shingles of a block.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(31, max(0, math.ceil(math.log2(max(1, size / range_bytes)))))
    tag = F.lit(0) if tag_col is None else F.col(tag_col)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag.cast("long").alias("tag"), F.col(text_col).alias("text"))
    files = common.files_of(spark, size)
    every = common.cut(_frequencies(ids, bits, words, percent), files)
    classes = every.where(F.col("tokens").isNotNull()).groupBy("sig", "sig2").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")
    )
    sets = common.cut(classes.withColumn("node", F.monotonically_increasing_id()), files)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = common.column(b, "n_shingles").to_numpy()
            held = [common.stretch(x.as_py()) for x in common.column(b, "tokens")]
            shared = np.array([len(x) for x in held], np.int64)
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(shared)])
            token = np.concatenate([*held, np.empty(0, np.uint64)]).view(np.int64)
            take = shared - (-(-percent * n // 100)) + 1
            entry = common.ragged_index(first[:-1], take)
            yield pa.RecordBatch.from_arrays([pa.array(token[entry]), pa.array(np.repeat(common.column(b, "node").to_numpy(), take))], names=["token", "node"])

    listed = common.cut(sets.select("node", "n_shingles", "tokens").mapInArrow(prefix, "token long, node long"), files)
    lead = common.cut(listed.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").drop("z"), files)
    met = listed.join(lead, "token").select("a", F.col("node").alias("b")).where("a != b").distinct()
    stars = graph.connected(met, files=files)
    groups = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "grp")
    grouped = common.cut(groups.join(sets.select("node", "n_shingles"), "node"), files)
    joined = graph.connected(_meetings(grouped, sets, block, percent, files), files=files)
    # the smallest id of each component, over classes of equal sets
    label = sets.select("node", "sig", "sig2", "doc_id", "copies").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = label.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    named = label.join(best, "root").select("sig", "sig2", "component_id", F.col("root").alias("group"))
    out = every.drop("tokens").join(named, ["sig", "sig2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "tag", "group")


def _meetings(grouped: DataFrame, sets: DataFrame, block: int, percent: int, files: int) -> DataFrame:
    """(a, b): links that join all that is similar, from all meetings of blocks of all groups."""
    # a row's block follows from counts of its group by size (in 16 shares), so no group is sorted in one task
    cost = F.greatest("n_shingles", F.lit(block // 500))
    salted = grouped.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16)))
    counts = salted.groupBy("grp", "n_shingles", "salt").agg(F.count("*").alias("n"))
    before = F.sum(F.col("n") * cost).over(Window.partitionBy("grp").orderBy("n_shingles", "salt")) - F.col("n") * cost
    counts = common.cut(counts.withColumn("before", before), files)
    blk = F.floor((F.col("before") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) * cost) / block)
    placed = common.cut(salted.join(counts, ["grp", "n_shingles", "salt"]).select("grp", "node", blk.alias("blk"), "n_shingles"), files)
    bounds = placed.groupBy("grp", "blk").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("blk"))  # over blocks
    bounds = common.cut(bounds.withColumn("nth", nth), files)
    x, y = bounds.alias("x"), bounds.alias("y")
    fits = (F.col("x.grp") == F.col("y.grp")) & (F.col("x.nth") <= F.col("y.nth")) & (F.col("y.low") * percent <= F.col("x.high") * 100)
    pairs = x.join(y, fits).select(F.col("x.grp").alias("grp"), F.col("x.blk").alias("i"), F.col("y.blk").alias("j"), (F.col("y.nth") - F.col("x.nth")).alias("gap"))

    def links(meet: DataFrame, rows: DataFrame) -> DataFrame:
        left = meet.select("grp", F.col("i").alias("blk"), "i", "j", F.lit(True).alias("left"))
        right = meet.where("i != j").select("grp", F.col("j").alias("blk"), "i", "j", F.lit(False).alias("left"))
        dealt = rows.join(left.unionByName(right), ["grp", "blk"]).select("grp", "i", "j", "left", "node", "root").join(sets.select("node", "n_shingles", "tokens"), "node")
        return dealt.groupBy("grp", "i", "j").applyInArrow(lambda key, table: _links(key, table, percent), "a long, b long")

    first = common.cut(links(pairs.where("gap <= 1"), placed.withColumn("root", F.col("node"))), files)
    later = pairs.where("gap > 1")
    if not later.limit(1).count():
        return first
    rooted = common.cut(placed.join(graph.connected(first, files=files), "node", "left").withColumn("root", F.coalesce("root", "node")), files)
    spread = rooted.groupBy("grp", "blk").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    i, j = (spread.select("grp", F.col("blk").alias(c), F.col("least").alias(f"least_{c}"), F.col("most").alias(f"most_{c}")) for c in "ij")
    apart = later.join(i, ["grp", "i"]).join(j, ["grp", "j"]).where("least(least_i, least_j) != greatest(most_i, most_j)")
    return first.unionByName(links(apart.select("grp", "i", "j"), rooted))
