"""Exact top-k search by inner product with a vector-approximation file.

Every block of vectors has an approximation file: each component is kept as one of at most `levels`
cells (one byte), with the length of what the cells leave out of the vector. With lo the lower edges of
a vector's cells, w the width of a cell less one and r the vector less the middle of its cells,

    q.lo + w * sum(min(q, 0))  <=  q.x  <=  q.lo + w * sum(max(q, 0))    and
    q.(lo + w/2) - |q||r|      <=  q.x  <=  q.(lo + w/2) + |q||r|.

A search scans the cells of a block, keeps the rows whose upper bound reaches the k-th best lower
bound, and reads exact vectors in the order of their upper bounds until the k-th exact score is above
the next bound; no other exact vector is unpacked. Rows are dealt into hash blocks of bounded size,
equal rows included; blocks of queries meet blocks of rows through an equi-join on the block number,
and every meeting returns at most k rows a query.

Defined cases: a null vector, or one holding a null or non-finite component, takes no part. Vectors
of different lengths never meet. Ties go to the smaller id. A row never meets rows of its own id.
Repeated rows count as rows of their own; a query repeated with the same vector is searched once.
Products of any size are exact (beyond 53 bits by integer arithmetic). Very long vectors are ordinary
vectors. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FOUND = "query_id long, q_hash long, vec_id long, score long"
FILE = "dims int, rb int, bits int, width int, ids binary, cells binary, base binary, left_out binary, exact binary"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """(id, v): components become floor(scale * x) with x as double; unusable vectors are dropped."""
    x = F.col(vector_col)
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return df.where(x.isNotNull() & ok & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v")
    )


def _blocks(rows: DataFrame, n: int, size: int, name: str) -> tuple[DataFrame, int]:
    """One row per (length, block): ids, vector hashes and flat components of about `size` vectors. rows have a `place`."""
    count = max(1, -(-n // size))
    block = F.pmod(F.xxhash64("id", "v", "place"), F.lit(count)).cast("int")
    one = F.collect_list(F.struct("id", F.xxhash64("id", "v").alias("h"), "v"))
    packed = rows.groupBy(F.size("v").alias("dims"), block.alias(name)).agg(one.alias("rows"))
    return packed.select("dims", name, F.col("rows.id").alias(f"{name}_ids"), F.col("rows.h").alias(f"{name}_h"), F.flatten("rows.v").alias(f"{name}_v")), count


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return np.asarray(common.column(batch, name)[row].values)


class Approximation:
    """Cells of a block of integer vectors."""

    def __init__(self, cells: np.ndarray, bits: int, base: np.ndarray, left_out: np.ndarray):
        self.cells, self.bits, self.base, self.left_out = cells, bits, base, left_out

    @classmethod
    def of(cls, x: np.ndarray, levels: int) -> Approximation:
        base = x.min(axis=0) if len(x) else np.zeros(x.shape[1], np.int64)
        span = int((x - base).max(initial=0))
        bits = max(0, (span // levels).bit_length())
        cells = ((x - base) >> bits).astype(np.uint8)
        rest = (x - base - (cells.astype(np.int64) << bits)) - ((1 << bits) - 1) / 2
        return cls(cells, bits, base, np.sqrt((rest * rest).sum(axis=1)))

    def bounds(self, q: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the products of queries (rows) with the vectors (columns), for exact products of type `kind`."""
        wide, w = q.astype(kind), (1 << self.bits) - 1
        cells = (self.cells.astype(kind) * (1 << self.bits)) if kind is not object else self.cells.astype(object) * (1 << self.bits)
        low = wide @ cells.T + (wide @ self.base.astype(kind))[:, None]
        low = low.astype(np.float64)
        real = q.astype(np.float64)
        middle = low + (w / 2) * real.sum(axis=1)[:, None]
        reach = np.sqrt((real * real).sum(axis=1))[:, None] * self.left_out[None, :]
        slack = 1 + 1e-9 * (np.abs(middle) + reach)
        lower = np.maximum(low + (w * np.minimum(real, 0).sum(axis=1))[:, None], middle - reach)
        upper = np.minimum(low + (w * np.maximum(real, 0).sum(axis=1))[:, None], middle + reach)
        return lower - slack, upper + slack


def product_type(q: np.ndarray, x: np.ndarray):
    """Type in which all products of two sets of vectors are exact."""
    most = lambda m: max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0))))
    size = most(q) * 2 * most(x) * max(1, x.shape[1])
    return np.float64 if size < 1 << 53 else np.int64 if size < 1 << 62 else object


def search_block(q: np.ndarray, q_ids: np.ndarray, about: Approximation, exact: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, scores) of the k best rows of a block for each query."""
    kind = product_type(q, exact)
    lower, upper = about.bounds(q, kind)
    for i in range(len(q)):
        rows = np.flatnonzero(x_ids != q_ids[i])
        if not len(rows):
            continue
        if len(rows) > k:
            near = lower[i, rows]
            rows = rows[upper[i, rows] >= np.partition(near, len(near) - k)[len(near) - k]]
        rows = rows[np.argsort(-upper[i, rows], kind="stable")]
        best_s, best_i = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(rows), 2 * k):
            some = rows[at : at + 2 * k]
            if len(best_s) == k and best_s[-1] > upper[i, some[0]]:
                break  # no unread row can reach the k-th score, ties included
            s = np.concatenate([best_s, (exact[some].astype(kind) @ q[i].astype(kind)).astype(np.int64)])
            ids = np.concatenate([best_i, x_ids[some]])
            order = np.lexsort((ids, -s))[:k]
            best_s, best_i = s[order], ids[order]
        yield i, best_i, best_s


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 20, levels: int = 32, row_block: int = 4096, query_block: int = 2048) -> DataFrame:
    """For each query (id, v) its k rows of largest inner product among rows (id, v): query_id, rank, vec_id, score."""
    common.prepare(rows.sparkSession)
    rows = common.cut(rows.select("id", "v").withColumn("place", F.monotonically_increasing_id()))
    queries = common.cut(queries.select("id", "v").distinct().withColumn("place", F.lit(0)))
    r, r_blocks = _blocks(rows, rows.count(), row_block, "rb")
    q, q_blocks = _blocks(queries, queries.count(), query_block, "qb")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                ids = _values(batch, "rb_ids", j)
                x = _values(batch, "rb_v", j).astype(np.int64).reshape(len(ids), -1)
                a = Approximation.of(x, levels)
                most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
                width = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
                parts = [ids.astype(np.int64).tobytes(), a.cells.tobytes(), a.base.astype(np.int64).tobytes(), a.left_out.tobytes(), x.astype(width).tobytes()]
                facts = [pa.array([int(common.column(batch, c)[j].as_py())], pa.int32()) for c in ("dims", "rb")] + [pa.array([v], pa.int32()) for v in (a.bits, np.dtype(width).itemsize)]
                yield pa.RecordBatch.from_arrays([*facts, *(pa.array([p], pa.binary()) for p in parts)], names=[c.split()[0] for c in FILE.split(", ")])

    pairs = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))).join(r.mapInArrow(approximate, FILE), ["dims", "rb"])
    pairs = pairs.repartition(max(1, min(r_blocks * q_blocks, 4096)), "dims", "rb", "qb")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                fact = lambda name: common.column(batch, name)[j].as_py()
                dims, width = fact("dims"), fact("width")
                qi, qh = _values(batch, "qb_ids", j), _values(batch, "qb_h", j)
                qv = _values(batch, "qb_v", j).astype(np.int64).reshape(len(qi), dims)
                xi = np.frombuffer(fact("ids"), np.int64)
                shape = (len(xi), dims)
                about = Approximation(np.frombuffer(fact("cells"), np.uint8).reshape(shape), fact("bits"), np.frombuffer(fact("base"), np.int64), np.frombuffer(fact("left_out"), np.float64))
                exact = np.frombuffer(fact("exact"), f"<i{width}").reshape(shape)
                for at in range(0, len(qi), 256):  # bounds of so many queries at once
                    out = list(search_block(qv[at : at + 256], qi[at : at + 256], about, exact, xi, k))
                    if out:
                        who = at + np.repeat([i for i, _, _ in out], [len(ids) for _, ids, _ in out])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(qi[who]), pa.array(qh[who]), pa.array(np.concatenate([x for _, x, _ in out])), pa.array(np.concatenate([s for *_, s in out]))],
                            names=["query_id", "q_hash", "vec_id", "score"],
                        )

    best = Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.mapInArrow(found, FOUND).withColumn("rank", F.row_number().over(best).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(id_col: str = "id", n: int = 20) -> Column:
    """The stated query set: rows whose id is divisible by n."""
    return F.col(id_col) % n == 0
