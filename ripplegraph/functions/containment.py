"""Which texts lie within which others, without comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .workers import importable

#: A slice of the catalog: so many texts and characters at most, on average; it is what the driver and each task hold.
SLICE_ROWS, SLICE_CHARS = 1 << 17, 1 << 22


class Catalog:
    """Texts that are looked for, all at once: an Aho-Corasick automaton, made once in each worker."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.machine = None

    def __getstate__(self) -> dict:
        return {"texts": self.texts, "machine": None}

    def found_in(self, text: str) -> list[str]:
        """The different texts of the catalog that lie within a text, in one pass over its characters."""
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for i, t in enumerate(self.texts):
                self.machine.add_word(t, i)
            self.machine.make_automaton()
        return [self.texts[i] for i in sorted({i for _, i in self.machine.iter(text)})]


def _scan(shared: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalog = shared.value
        for batch in batches:
            inner, outer = [], []
            for text in batch.column(0).to_pylist():
                found = catalog.found_in(text)
                inner += found
                outer += [text] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(inner, pa.string()), pa.array(outer, pa.string())], ["inner", "outer"])

    return run


def pairs_within(inner: DataFrame, outer: DataFrame, slice_rows: int = SLICE_ROWS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(inner, outer): each distinct text of the column `text` of `inner` with the distinct texts of `outer` that contain it.

    The inner texts are dealt into slices of bounded size by hash; every outer text is read once for each slice, so the
    work is its length times the slices plus what is found, however alike the texts are. Empty texts lie in none.
    """
    spark = outer.sparkSession
    importable(spark)
    small = cut(inner.select("text").where("text <> ''").distinct())
    n, chars = small.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    slices = max(1, -(-n // slice_rows), -(-chars // slice_chars))
    big = outer.select("text").where("text <> ''").distinct()
    big, out = cut(big) if slices > 1 else big, None
    for k in range(slices):
        texts = [r[0] for r in small.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect()] if n else []
        if not texts:
            continue
        shared = spark.sparkContext.broadcast(Catalog(texts))
        found = big.mapInArrow(_scan(shared), "inner string, outer string")
        if slices > 1:  # one slice at a time is held
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return big.select(F.col("text").alias("inner"), F.col("text").alias("outer")).limit(0) if out is None else out
