"""Embedding plans and exact cosine top-k over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import importable


def embedding_plan(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """V1: chunks with content_hash and whether a finished vector of that content exists."""
    done = embeddings.where((F.col("provider") == provider) & (F.col("model") == model)).select("chunk_id", "content_hash", F.lit("unchanged").alias("_s")).distinct()
    c = chunks.withColumn("content_hash", F.sha2("text", 256))
    return c.join(done, ["chunk_id", "content_hash"], "left").withColumn("state", F.coalesce("_s", F.lit("pending"))).drop("_s")


def cosine_top_k(queries: DataFrame, chunks: DataFrame, k: int, block: int = 512) -> DataFrame:
    """V2: (query_id, chunk_id, score, rank) of the k best chunks. Vectors of other lengths score -1, zero
    vectors 0; ties go to the smaller chunk id.

    Queries travel in blocks of `block`; every block meets every partition of chunks once, keeps a
    local top k by matrix product, and only those rows are shuffled.
    """
    importable(chunks.sparkSession)
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), "query_id", F.col("vector").cast("array<double>").alias("qv"))
    q = q.groupBy("block").agg(F.collect_list(F.struct("query_id", "qv")).alias("queries"))
    parts = max(1, -(-chunks.count() // 4096))
    c = chunks.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)))
    c = c.groupBy("part").agg(F.collect_list(F.struct("chunk_id", "vector")).alias("chunks"))
    pairs = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q, "block").select("queries", "chunks")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qs, cs in zip(frame["queries"], frame["chunks"], strict=True):
                ids = np.array([x["chunk_id"] for x in cs], dtype=object)
                sizes = np.array([len(x["vector"]) for x in cs])
                out = []
                for dim in {len(x["qv"]) for x in qs}:
                    mine = [x for x in qs if len(x["qv"]) == dim]
                    same = sizes == dim
                    m = np.array([x["vector"] if ok else np.zeros(dim) for x, ok in zip(cs, same, strict=True)], dtype=float).reshape(len(cs), dim)
                    v = np.array([x["qv"] for x in mine], dtype=float).reshape(len(mine), dim)
                    norm = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
                    s = np.divide(v @ m.T, norm, out=np.zeros((len(mine), len(cs))), where=norm > 0)
                    s[:, ~same] = -1.0
                    for x, row in zip(mine, s, strict=True):
                        top = sorted(range(len(row)), key=lambda i, row=row: (-row[i], ids[i]))[:k] if len(row) <= 4 * k else None
                        if top is None:
                            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                            top = sorted(near, key=lambda i, row=row: (-row[i], ids[i]))[:k]
                        out.append(pd.DataFrame({"query_id": [x["query_id"]] * len(top), "chunk_id": [ids[i] for i in top], "score": [float(row[i]) for i in top]}))
                if out:
                    yield pd.concat(out)

    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    found = pairs.mapInPandas(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def cosine(left, right):
    """Cosine of two array columns as an expression; -1 for other lengths, 0 for zero vectors."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(left) != F.size(right), F.lit(-1.0)).when((norm(left) == 0) | (norm(right) == 0), F.lit(0.0)).otherwise(dot / (norm(left) * norm(right)))
