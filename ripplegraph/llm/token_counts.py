"""Token counts for every context limit from one exact length histogram.

Every document is encoded once (Arrow batches, whole texts) and only its length goes on. Documents
are aggregated by length; from then on all work is on the histogram, which has at most as many rows
as there are distinct lengths. Suffix sums over it answer, for a context limit equal to each length:
how many documents fit, the total of the tokens kept when longer documents are truncated, how many
tokens truncation loses, and at which quantile the length stands.

The running sums are taken in two steps, first over bands of `band` lengths and then within a band,
so that no single task sorts the whole histogram.

Defined cases: a null or empty text has length 0 and counts as a document. Repeated rows count each.
An empty table gives an empty histogram (limits alone: no totals). Special tokens in a text are ordinary text.
Texts of any length are encoded whole. Only the text column is read, so other columns' names do not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_ENCODERS: dict[str, object] = {}


def encoder(ranks: bytes, pattern: str):
    """The byte-level encoder of a rank file, built once per Python worker."""
    import tiktoken

    key = f"{len(ranks)}:{hash(ranks)}:{pattern}"
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def encoded_lengths(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """One row (n_tokens long) per document. `ranks` is the content of a rank file (fixed size, under 1 MB)."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = encoder(shared.value, pattern)
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for some in common.slices(batch, text_col) for t in common.column(some, text_col).to_pylist()]
            n, c = np.unique(np.array(sizes, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(c.astype(np.int64))], names=["n_tokens", "n_docs"])

    return docs.select(text_col).mapInArrow(counted, "n_tokens long, n_docs long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length."""
    return lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_report(hist: DataFrame, limits: DataFrame | None = None, band: int = 256) -> DataFrame:
    """For every observed length, and every limit of `limits` (context_limit), as a context limit: totals, quantile and truncated totals."""
    if limits is not None:  # a limit that is no length is one of no documents
        asked = limits.select(F.col("context_limit").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs")).where("n_tokens >= 0")
        hist = histogram(hist.select("n_tokens", "n_docs").unionByName(asked))
    h = hist.withColumn("band", F.floor(F.col("n_tokens") / band)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = bands.select(
        "band",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("bd").over(every).alias("total_docs"),
        F.sum("bt").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer_docs = F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("docs_later")
    longer_tokens = F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("tokens_later")
    out = h.join(bands, "band").withColumn("longer_docs", longer_docs).withColumn("longer_tokens", longer_tokens)
    limit = F.col("n_tokens")
    return out.select(
        limit.alias("context_limit"),
        "n_docs",
        "total_docs",
        "total_tokens",
        (F.col("total_docs") - F.col("longer_docs")).alias("fitting_docs"),
        (F.col("total_tokens") - F.col("longer_tokens") + limit * F.col("longer_docs")).alias("truncated_tokens"),
        (F.col("longer_tokens") - limit * F.col("longer_docs")).alias("lost_tokens"),
        F.try_divide(F.col("total_docs") - F.col("longer_docs"), F.col("total_docs")).alias("quantile"),
    )


def lengths_at(report: DataFrame, quantiles: list[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least the share q of all documents do not exceed."""
    reached = F.filter(F.array(*map(F.lit, quantiles)), lambda q: q <= F.col("quantile"))
    return report.where("n_docs > 0").select(F.explode(reached).alias("q"), "context_limit").groupBy("q").agg(F.min("context_limit").alias("n_tokens"))
