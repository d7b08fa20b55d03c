from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from ripplegraph.functions import lineage
from ripplegraph.llm import common, graph, ngram_join


@pytest.mark.parametrize("local", [16, 1 << 18])
def test_forests_and_stars_agree_with_union(spark: SparkSession, local):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, 40)[rng.integers(0, 40, (45, 2))]] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:  # smallest labels spread until nothing changes
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = sorted(map(tuple, graph.connected(spark.createDataFrame(edges, "a long, b long"), local=local).collect()))
    assert got == sorted((x, r) for x, r in root.items() if x != r)
    assert graph.connected(spark.createDataFrame([], "a long, b long"), local=local).count() == 0


def test_few_jobs_link_the_documents(spark: SparkSession):
    # the driver keeps a record of every job and stage: one that links a few documents must not need hundreds
    text = [" ".join(f"w{i // 8}x{k * (i % 8 == 0) if k < 2 else k}" for k in range(60)) for i in range(80)]
    sc = spark.sparkContext
    sc.setJobGroup("few jobs", "components")
    try:
        found = ngram_join.components(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert all(r["component_id"] == r["doc_id"] // 8 * 8 for r in found)
    assert len(sc.statusTracker().getJobIdsForGroup("few jobs")) < 90


def test_rising_numbers_take_little_room():
    rng = np.random.default_rng(3)
    token, row = np.sort(rng.integers(0, 1 << 48, 11_000, dtype=np.uint64)), rng.integers(0, 2048, 11_000, dtype=np.uint64)
    values = (token << np.uint64(16)) | row
    assert (common.stretch(common.squeeze(values, 16), 16) == values).all()
    assert len(common.squeeze(values, 16)) < 6.5 * len(values)
    odd = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    for low in (0, 16):
        for some in (odd, odd[:1], odd[:0]):
            assert (common.stretch(common.squeeze(some, low), low) == some).all()


def test_small_tables_are_kept_in_few_files(spark: SparkSession, monkeypatch):
    # with 211 partitions each kept table was 211 files, most of them empty; an executor starts processes for each
    text = [" ".join(f"w{i // 8}x{k * (i % 8 == 0) if k < 2 else k}" for k in range(60)) for i in range(80)]
    kept = []

    def cut(df, *more, keep=lineage.cut):
        kept.append(keep(df, *more))
        return kept[-1]

    monkeypatch.setattr(lineage, "cut", cut)
    partitions, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(partitions)
    spark.conf.set(partitions, "211")
    spark.conf.set(coalesce, "false")
    try:
        found = ngram_join.components(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), block=500).collect()
    finally:
        spark.conf.set(partitions, before)
        spark.conf.unset(coalesce)
    assert all(r["component_id"] == r["doc_id"] // 8 * 8 for r in found)
    assert max(df.rdd.getNumPartitions() for df in kept) <= 6 * spark.sparkContext.defaultParallelism
    assert common.files_of(spark, 1 << 40) == 1 << 18  # many files where there is much
