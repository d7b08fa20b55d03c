"""Conversation structure repair: the cheapest edits after which a conversation's roles read system? (user assistant)+.

A row may be kept (K, free), given the role user or assistant (R, 1), deleted (D, 2; blank and repeated rows must be) or
preceded by an inserted empty turn (I, 5); a truncated row that stays adds 5. Among the cheapest edits the one of least
audit string is taken.

Costs to go are found from the last row to the first over four states (nothing yet, after system, user, assistant).
Edits that keep the least cost are the arcs of a graph of nodes (row, state). Nodes are then ranked by the first 1, 2,
4, ... letters of their least audit: the rank of the next power of two comes from a node's rank and that of the node its
doubled pointer leads to. Letters of a node's arcs differ, so the first ranks choose the arc; the last ones name
whole audits, of which each different one is spelled once; paths are unrolled through the doubled pointers.

A conversation may be of any length. All rows are put in order by range (`common.ordered`) and cut into blocks of
bounded bytes; a block is one group. Of conversations that go over several blocks each part is first a 4 x 4 table of
least costs, and pointer jumping over parts gives each one the costs behind it and the state it is entered in.

Defined cases: null role and text count as one space, null turns come first, null conv_id is a conversation of its own
that is returned as null; rows of one turn are ordered by role and text; no rows, no output; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 4 << 20
ROW_BYTES = 1024  # what a row counts for beside its text
FAR = 1 << 40
LETTERS = np.frombuffer(b"DIKR", np.uint8)
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The next user or assistant turn leads to NEXT.
NEXT = np.array([2, 2, 3, 2])
#: Where a kept row leads, by its initial (other, s, u, a) and the state; 4 is nowhere.
KEPT = np.array([[4, 4, 4, 4], [1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4]])
#: Cost from each state at the end of a conversation, and the turns that are inserted there.
FINAL = (0, 10, 5, 0)
CLOSING = ((), (2, 3), (3,), ())
NAMES = {2: b"user", 3: b"assistant"}
WHITE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` modulo 20 gives: 0 drops a row, 1 empties its text, 2 takes its [.!?] out, 3 repeats it, 4 makes it the user's."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    out = out.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("fault", "again")


def _marks(placed: DataFrame) -> DataFrame:
    """A short row for each: its initial, whether it is blank, repeated, truncated. The first of equal turns is found by group, so a hot turn is pre-aggregated."""
    text = F.col("text")
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), text), 256))
    last = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    rows = placed.select("conv_id", "place", "block", "turn", code.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), said.alias("said"))
    rows = common.cut(rows)
    firsts = rows.groupBy("conv_id", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = rows.drop("said").join(firsts, "place", "left").withColumn("repeated", F.col("first").isNull() & ~F.col("blank"))
    return common.cut(marked.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("repeated")).drop("first", "open"))


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _runs(table: pa.Table) -> np.ndarray:
    """First rows of the conversations of a table that is in order."""
    ids = table.column("conv_id").combine_chunks()
    if len(ids) == 0:
        return np.empty(0, np.int64)
    codes = np.asarray(ids.dictionary_encode(null_encoding="encode").indices)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def to_go(initial: np.ndarray, gone: np.ndarray, truncated: np.ndarray, starts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least cost from each row and state on, given after[part, variant, state] at the ends of the parts; by row, variant, state."""
    n, ends = len(initial), np.r_[starts[1:], len(initial)]
    best = np.full((n, after.shape[1], 4), FAR)
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    stay = np.where(gone, FAR, 5 * truncated)
    for d in range(1, int(sizes.max(initial=0)) + 1):
        live = order[: np.searchsorted(-sizes[order], -d, side="right")]
        r = ends[live] - d
        then = after[live] if d == 1 else best[r + 1]
        wide = np.concatenate([then, np.full((*then.shape[:2], 1), FAR)], axis=2)
        kept = np.take_along_axis(wide, np.broadcast_to(KEPT[initial[r]][:, None, :], then.shape), 2)
        cost = np.minimum(2 + then, stay[r][:, None, None] + np.minimum(kept, 1 + then[..., NEXT]))
        cost = np.minimum(FAR, np.minimum(cost, 5 + cost[..., NEXT]))
        cost[..., :2] = np.minimum(cost[..., :2], 5 + cost[..., 2:3])  # two inserted turns
        best[r] = cost
    return best


def walk(initial: np.ndarray, gone: np.ndarray, truncated: np.ndarray, starts: np.ndarray, after: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least of the cheapest paths of each part from its entry state: cost, exit state, rank of its audit, and the steps of all (part, node, letter)."""
    n, parts = len(initial), len(starts)
    best = to_go(initial, gone, truncated, starts, after[:, None, :])[:, 0, :]
    part = np.repeat(np.arange(parts), np.diff(np.r_[starts, n]))
    last = np.zeros(n, bool)
    last[np.r_[starts[1:], n] - 1] = True
    ahead = np.where(last[:, None], after[part], np.r_[best[1:], np.full((1, 4), FAR)])
    state = np.broadcast_to(np.arange(4), (n, 4))
    below = np.where(last[:, None], 4 * (n + part[:, None]), 4 * (np.arange(n)[:, None] + 1))  # node of state 0 of what follows
    kept = KEPT[initial]
    wide = np.concatenate([ahead, np.full((n, 1), FAR)], axis=1)
    stay = np.where(gone, FAR, 5 * truncated)[:, None]
    # the arcs of each node by letter: D, I, K, R
    costs = np.stack([2 + ahead, 5 + best[:, NEXT], stay + np.take_along_axis(wide, kept, 1), stay + 1 + ahead[:, NEXT]])
    goals = np.stack([below + state, 4 * np.arange(n)[:, None] + NEXT[None, :], below + np.minimum(kept, 3), below + NEXT[None, :]])
    fits = (costs == best) & (best < FAR)
    letter = fits.argmax(axis=0)
    ends = np.arange(4 * n, 4 * (n + parts))
    hop = np.where(fits.any(axis=0), np.take_along_axis(goals, letter[None], 0)[0], 4 * n).ravel()
    hops, rank = [np.r_[hop, ends]], np.r_[letter.ravel() + 1, np.zeros(4 * parts, np.int64)]
    at = 4 * starts + entry
    while (hops[-1][at] < 4 * n).any():  # ranks by twice as many letters, pointers of twice the length
        rank = np.unique(rank * (rank.max() + 1) + rank[hops[-1]], return_inverse=True)[1]
        hops.append(hops[-1][hops[-1]])
    node, owner = at, np.arange(parts)
    for h in reversed(hops[:-1]):
        node, owner = np.stack([node, h[node]], axis=1).ravel(), np.repeat(owner, 2)
        node, owner = node[node < 4 * n], owner[node < 4 * n]
    return best.ravel()[at], hops[-1][at] % 4, rank[at], owner, node, letter.ravel()[node]


def _tables(table: pa.Table) -> pa.Table:
    """Least costs of each part of a conversation in a block, from each state before it to each state behind it."""
    table = table.sort_by("place")
    starts = _runs(table)
    initial, blank, repeated, truncated, place = _numbers(table, "initial", "blank", "repeated", "truncated", "place")
    after = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(starts), 4, 4))
    best = to_go(initial, (blank | repeated) > 0, truncated, starts, after)
    ends = np.r_[starts[1:], len(table)] - 1
    costs = np.swapaxes(best[starts], 1, 2).reshape(len(starts), 16) if len(starts) else np.empty((0, 16), np.int64)
    pairs = initial[:-1] * 4 + initial[1:]
    bad = np.r_[0, np.where(np.isin(pairs, [6, 11, 14]), 0, 1)] if len(initial) else np.empty(0, np.int64)
    bad[starts] = 0
    illegal = np.add.reduceat(bad, starts) if len(starts) else bad
    block = table.column("block").combine_chunks().take(pa.array(starts))
    ids = table.column("conv_id").combine_chunks().take(pa.array(starts))
    lists = common.ragged(costs.ravel(), np.full(len(starts), 16), pa.int64())
    more = [place[starts], place[ends], illegal, initial[starts], initial[ends]]
    return pa.table([ids, block, lists, *map(pa.array, more)], names=["conv_id", "block", "costs", "first", "last", "illegal", "opens", "closes"])


def _exits(table: pa.Table) -> pa.Table:
    """Where each part leads from each of the four states, once the costs behind it are known."""
    table = table.sort_by("place")
    starts = _runs(table)
    initial, blank, repeated, truncated, place = _numbers(table, "initial", "blank", "repeated", "truncated", "place")
    after = np.array(table.column("after").combine_chunks().take(pa.array(starts)).flatten()).reshape(-1, 4)
    out = [walk(initial, (blank | repeated) > 0, truncated, starts, after, np.full(len(starts), s))[1] for s in range(4)]
    goes = common.ragged(np.stack(out, axis=1).ravel().astype(np.int64), np.full(len(starts), 4), pa.int64())
    return pa.table([pa.array(place[starts]), goes], names=["first", "goes"])


def _product(a: Column, b: Column) -> Column:
    """Least costs through two parts, one behind the other (4 x 4 tables as arrays of 16)."""
    return F.array(*[F.least(*[a[4 * i + k] + b[4 * k + j] for k in range(4)], F.lit(FAR)) for i in range(4) for j in range(4)])


def _linked(parts: DataFrame) -> DataFrame:
    """`after` and `entry` for each part of the conversations that go over several blocks, by pointer jumping over parts."""
    spans = parts.groupBy(F.col("conv_id").alias("c")).agg(F.min("first").alias("head"), F.max("last").alias("tail"))
    many = parts.join(spans, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").where("not (first = head and last = tail)")
    many = common.cut(many.withColumn("next", F.when(F.col("last") < F.col("tail"), F.col("last") + 1)))
    jump = many.select("first", "next", "costs")
    while jump.where("next is not null").limit(1).count():
        other = jump.select(F.col("first").alias("next"), F.col("next").alias("over"), F.col("costs").alias("more"))
        jump = jump.join(other, "next", "left")
        jump = common.cut(jump.select("first", F.col("over").alias("next"), F.when(F.col("more").isNull(), F.col("costs")).otherwise(_product(F.col("costs"), F.col("more"))).alias("costs")))
    ends = F.array(*[F.least(*[F.col("costs")[4 * i + j] + FINAL[j] for j in range(4)]) for i in range(4)])
    behind = jump.select(F.col("first").alias("next"), ends.alias("after"))
    done = F.array(*[F.lit(c).cast("long") for c in FINAL])
    return common.cut(many.select("block", "conv_id", "first", "next", "head").join(behind, "next", "left").withColumn("after", F.coalesce("after", done)))


def _entries(many: DataFrame, marks: DataFrame) -> DataFrame:
    """(first, entry): the state in which each part is entered, from where the parts before it lead."""
    rows = marks.join(many.select(F.col("block").alias("b"), F.col("conv_id").alias("c"), "after"), F.col("block").eqNullSafe(F.col("b")) & F.col("conv_id").eqNullSafe(F.col("c"))).drop("b", "c")
    goes = rows.groupBy("block").applyInArrow(_exits, "first long, goes array<long>")
    chain = common.cut(many.select("first", "next", "head").join(goes, "first"))
    before = chain.where("next is not null").select(F.col("next").alias("first"), F.col("first").alias("prior"), F.col("goes").alias("came"))
    jump = chain.select("first").join(before, "first", "left")  # came: state here by the state at `prior`
    while True:
        jump = common.cut(jump)
        other = jump.where("prior is not null").select(F.col("first").alias("prior"), F.col("prior").alias("older"), F.col("came").alias("earlier"))
        if not jump.join(other, "prior").limit(1).count():
            break
        jump = jump.join(other, "prior", "left").select("first", F.coalesce("older", "prior").alias("prior"), F.when(F.col("earlier").isNull(), F.col("came")).otherwise(F.transform("earlier", lambda s: F.col("came")[s.cast("int")])).alias("came"))
    return jump.select("first", F.coalesce(F.col("came")[0], F.lit(0)).alias("entry"))


def _repaired(texts: pa.Table, marks: pa.Table) -> pa.Table:
    """Edits and text of the parts of conversations in one block; the digest too where the block holds all of one."""
    texts, marks = texts.sort_by("place"), marks.sort_by("place")
    starts = _runs(marks)
    initial, blank, repeated, truncated, entry, place, ends, whole = _numbers(marks, "initial", "blank", "repeated", "truncated", "entry", "place", "ends", "whole")
    after = np.array(marks.column("after").combine_chunks().take(pa.array(starts)).flatten()).reshape(-1, 4)
    cost, leaves, rank, owner, node, letter = walk(initial, (blank | repeated) > 0, truncated, starts, after, entry[starts])
    bounds = np.searchsorted(owner, np.arange(len(starts) + 1))
    spelled: dict[int, str] = {}
    role, text = texts.column("role").combine_chunks().cast(pa.binary()), texts.column("text").combine_chunks().cast(pa.binary())
    audits, shas, bodies, lines_in = [], [], [], []
    for p in range(len(starts)):
        a, b = bounds[p], bounds[p + 1]
        if (r := int(rank[p])) not in spelled:
            spelled[r] = LETTERS[letter[a:b]].tobytes().decode()
        lines = []
        for v, k in zip(node[a:b].tolist(), letter[a:b].tolist(), strict=True):
            row, goal = v >> 2, int(NEXT[v & 3])
            if k == 1:
                lines.append(NAMES[goal] + b":")
            elif k:
                lines.append((role[row].as_py() if k == 2 else NAMES[goal]) + b":" + text[row].as_py())
        closing = CLOSING[leaves[p]] if ends[starts[p]] else ()
        lines += [NAMES[s] + b":" for s in closing]
        audits.append(spelled[r] + "I" * len(closing))
        body = b"\n".join(lines)
        shas.append(hashlib.sha256(body).hexdigest() if whole[starts[p]] else None)
        bodies.append(None if whole[starts[p]] else body)
        lines_in.append(len(lines))
    ids = marks.column("conv_id").combine_chunks().take(pa.array(starts))
    return pa.table(
        [ids, pa.array(place[starts]), pa.array(cost), pa.array(audits, pa.string()), pa.array(shas, pa.string()), pa.array(bodies, pa.binary()), pa.array(lines_in, pa.int64())],
        names=["conv_id", "first", "cost", "audit", "sha", "body", "lines"],
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations, in order, as one row each; only the digest of the text is held."""
    now, out = None, None
    names = ["conv_id", "cost", "audit", "sha"]

    def row(kind):
        return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([now[1]], pa.int64()), pa.array(["".join(now[2])]), pa.array([now[3].hexdigest()])], names)

    for batch in batches:
        out = common.column(batch, "conv_id").type
        for r in batch.to_pylist():
            if now is None or now[0] != r["conv_id"]:
                if now:
                    yield row(out)
                now = [r["conv_id"], r["cost"], [], hashlib.sha256(), False]
            now[2].append(r["audit"])
            if r["lines"]:
                now[3].update((b"\n" if now[4] else b"") + r["body"])
                now[4] = True
    if now:
        yield row(out)


def repair(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of rows (conv_id, turn, role, text without nulls)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    weight = F.octet_length("text") + F.octet_length("role") + ROW_BYTES
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = common.ordered(rows.select("conv_id", "turn", "role", "text"), order, weight)
    placed = placed.withColumn("block", F.floor(F.col("run") / block_bytes))
    marks = _marks(placed)
    schema = f"conv_id {kind}, block long, costs array<long>, first long, last long, illegal long, opens long, closes long"
    parts = common.cut(marks.groupBy("block").applyInArrow(_tables, schema))
    many = _linked(parts)
    entries = _entries(many, marks)
    links = many.join(entries, "first").select(F.col("block").alias("b"), F.col("conv_id").alias("c"), "after", "entry", F.col("next").isNull().alias("ends"), F.lit(False).alias("whole"))
    done = F.array(*[F.lit(c).cast("long") for c in FINAL])
    full = marks.join(links, F.col("block").eqNullSafe(F.col("b")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        *[F.col(c).alias(c) for c in ("conv_id", "block", "place")], "initial", "blank", "repeated", "truncated", F.coalesce("after", done).alias("after"),
        F.coalesce("entry", F.lit(0)).cast("long").alias("entry"), F.coalesce("ends", F.lit(True)).alias("ends"), F.coalesce("whole", F.lit(True)).alias("whole"),
    )
    texts = placed.select("block", "place", "role", "text")
    found = texts.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(_repaired, f"conv_id {kind}, first long, cost long, audit string, sha string, body binary, lines long")
    found = common.cut(found)
    split = found.where("sha is null").repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(_joined, f"conv_id {kind}, cost long, audit string, sha string")
    edits = found.where("sha is not null").select("conv_id", "cost", "audit", "sha").unionByName(split)
    beyond = many.join(parts.select(F.col("first").alias("next"), "opens"), "next").join(parts.select("first", "closes"), "first")
    between = beyond.select("conv_id", F.when((F.col("closes") * 4 + F.col("opens")).isin(6, 11, 14), 0).otherwise(1).cast("long").alias("illegal"))
    bad = parts.select("conv_id", "illegal").unionByName(between).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    turns = marks.groupBy("conv_id", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "repeated", "truncated")])
    counts = turns.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), F.sum("blank").alias("blank"), F.sum("repeated").alias("duplicate"), F.sum("truncated").alias("truncated")
    )
    out = counts
    for other in (bad, edits):
        other = other.withColumnRenamed("conv_id", "c")
        out = out.join(other, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", zero("gaps"), "blank", "duplicate", "truncated", zero("illegal"), "cost", "audit", F.col("sha").alias("repaired_sha256"))


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """Every conversation of `rows`, damaged and repaired; those of which no row is left have zeros, no edits and the digest of an empty text."""
    fixed = repair(damage(rows)).withColumnRenamed("conv_id", "c")
    out = rows.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
