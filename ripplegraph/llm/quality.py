"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: its words hashed into `dims` columns (term frequencies scaled to unit length),
and statistics of its structure and size (case, digits, symbols, repeated words, lines, length). The
model has a weight and a vector of `rank` factors per column; all pairwise interactions are scored
in linear time by the identity  sum_{i<j} <v_i,v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

Training uses at most `sample` labelled rows per label (a documented bound of the fitted model), taken
in the order of an id hash; features are extracted on Spark, the fit runs on that bounded matrix.
Scoring reads every whole text once, in Arrow batches, without a shuffle.

Defined cases: null and empty texts have no words and score by the bias and statistics of an empty
text. With no labelled rows every score is 0.5. Rows are scored one by one; other columns are ignored,
and labels, lang, source and ids are never features. Labels other than 0 and 1, or null, are not used;
of differing labels of one id, 1 counts, and it counts for all rows of that id. Texts of any length are
read whole. An empty table gives an empty result; columns of clashing names are kept, but for `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STATS = 12
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[97:123] = _ALPHA[65:91] = _ALPHA[128:] = True


def features(data: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, columns, values, statistics) of a batch; columns are sorted within a row."""
    n = len(offsets) - 1
    low = common.LOWER[data]
    starts, ends, rows = common.word_spans(low, offsets)
    h = common.word_names(low, starts, ends)
    key = rows.astype(np.int64) * dims + (h % np.uint64(dims)).astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    row, col = key // dims, (key % dims).astype(np.int32)
    value = np.sqrt(tf.astype(np.float64))
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = (value / np.maximum(norm[row], 1e-9)).astype(np.float32)
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n), out=begin[1:])

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    size, words = np.diff(offsets).astype(float), np.bincount(rows, minlength=n).astype(float)
    some, tokens = np.maximum(size, 1), np.maximum(words, 1)
    letters, upper, digits, spaces, lines = (share(m).astype(float) for m in (_ALPHA[data], _UPPER[data], _DIGIT[data], common.SPACE[data], data == 10))
    plain = share((data == 44) | (data == 46)).astype(float)
    symbols = size - letters - digits - spaces - plain
    distinct = np.diff(begin).astype(float)
    length = np.bincount(rows, (ends - starts).astype(float), n)
    again = np.zeros(n)
    if len(rows) > 1:
        again = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=n).astype(float)
    stats = np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(words) / 8,
            np.minimum(length / tokens / 10, 3),
            upper / np.maximum(letters, 1),
            digits / some,
            np.minimum(symbols / tokens, 3),
            plain / tokens,
            distinct / tokens,
            again / tokens,
            np.minimum(lines / tokens * 10, 3),
            np.sqrt(np.minimum(symbols / some, 1)),
            np.sqrt(np.minimum(again / tokens, 1)),
        ],
        axis=1,
    )
    return begin, col, value, stats.astype(np.float32)


@dataclass
class Machine:
    """Weights of the factorisation machine; the last STATS columns are the statistics."""

    dims: int
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, begin: np.ndarray, col: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        s = (stats - self.mean) / self.scale
        n = len(s)
        rows = np.repeat(np.arange(n), np.diff(begin))
        linear = np.bincount(rows, self.w[col] * value, n) + s @ self.w[self.dims :]
        total = s @ self.v[self.dims :]
        squares = (s * s) @ (self.v[self.dims :] ** 2)
        for f in range(self.v.shape[1]):
            vx = self.v[col, f] * value
            total[:, f] += np.bincount(rows, vx, n)
            squares[:, f] += np.bincount(rows, vx * vx, n)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)


def train(begin, col, value, stats, y, dims: int, rank: int = 8, epochs: int = 8, rate: float = 0.1, ridge: float = 1e-5, batch: int = 128, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    n, size = len(y), dims + STATS
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    m = Machine(dims, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)), mean, scale)
    gw, gv, gb = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    s_all = np.clip((stats - mean) / scale, -6, 6)
    balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    extra = np.arange(dims, size)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            counts = begin[part + 1] - begin[part]
            entry = np.arange(counts.sum()) + np.repeat(begin[part] - (np.cumsum(counts) - counts), counts)
            rows = np.repeat(np.arange(len(part)), counts)
            rows = np.concatenate([rows, np.repeat(np.arange(len(part)), STATS)])
            cols = np.concatenate([col[entry], np.tile(extra, len(part))])
            x = np.concatenate([value[entry], s_all[part].ravel()])
            vx = m.v[cols] * x[:, None]
            total = np.zeros((len(part), rank))
            np.add.at(total, rows, vx)
            pair = 0.5 * ((total * total).sum(axis=1) - np.bincount(rows, (vx * vx).sum(axis=1), len(part)))
            z = m.bias + np.bincount(rows, m.w[cols] * x, len(part)) + pair
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * balance[part] / len(part) * 8
            uniq, inv = np.unique(cols, return_inverse=True)
            dw = np.bincount(inv, g[rows] * x, len(uniq)) + ridge * m.w[uniq]
            dv = np.zeros((len(uniq), rank))
            np.add.at(dv, inv, (g[rows] * x)[:, None] * (total[rows] - vx))
            dv += ridge * m.v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            gb += g.sum() ** 2
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= 0.3 * rate * dv / np.sqrt(gv[uniq])
            m.bias -= rate * g.sum() / np.sqrt(gb)
    return m


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", dims: int = 1 << 15, sample: int = 1500, learn: Column | None = None) -> Machine | None:
    """Machine trained on at most `sample` rows of each label; `learn` filters the label rows (doc_id)."""
    spark = docs.sparkSession
    common.prepare(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    if learn is not None:
        usable = usable.where(learn)
    usable = usable.withColumn("h", F.xxhash64("doc_id"))
    chosen = [r for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample).collect()]
    if not chosen:
        return None
    ids = spark.createDataFrame([(int(r["doc_id"]), int(r["y"])) for r in chosen], "doc_id long, y int").groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * sample ids

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, col, value, stats = features(*common.bytes_of(common.column(b, "text")), dims)
            counts = np.diff(begin)
            yield pa.RecordBatch.from_arrays(
                [common.column(b, "doc_id"), common.column(b, "y"), common.blobs(col, counts), common.blobs(value, counts), common.blobs(stats.ravel(), np.full(len(b), STATS))],
                names=["doc_id", "y", "col", "value", "stats"],
            )

    rows = picked.mapInArrow(extract, "doc_id long, y int, col binary, value binary, stats binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["stats"]), bytes(r["col"])))
    if not rows:
        return None
    cols = [np.frombuffer(r["col"], np.int32) for r in rows]
    begin = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(c) for c in cols], out=begin[1:])
    value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows])
    stats = np.stack([np.frombuffer(r["stats"], np.float32) for r in rows])
    return train(begin, np.concatenate(cols), value, stats, np.array([r["y"] for r in rows], float), dims)


def score(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """docs plus score: the machine's probability of label 1."""
    common.prepare(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = shared.value
            for some in common.slices(b, text_col):
                if m is None:
                    p = np.full(len(some), 0.5)
                else:
                    z = m.logits(*features(*common.bytes_of(common.column(some, text_col)), m.dims))
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(p, pa.float64())], names=[*some.schema.names, "score"])

    return docs.mapInArrow(scored, f"{schema}, score double")
