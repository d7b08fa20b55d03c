"""The pipeline on planted cases, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from ripplegraph.llm import common

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = common.read(spark, SMALL, "documents")
    item = common.read(spark, SMALL, "benchmark").orderBy("item_id").first()["text"]
    clean = docs.join(common.read(spark, SMALL, "labels").where("quality = 1").select("doc_id"), "doc_id").where("n_chars between 800 and 3000 and lang = 'en'").orderBy("doc_id").first()
    row = clean.asDict()
    planted = [dict(row, doc_id=900_001), dict(row, doc_id=900_002, text=row["text"] + " tail"), dict(row, doc_id=900_003, text=row["text"][:300] + " " + item + " " + row["text"][100:700]), dict(row, doc_id=900_004, text="Mail me at a.b@example.com " + row["text"][400:])]
    df = docs.unionByName(spark.createDataFrame([tuple(p[c] for c in docs.columns) for p in planted], docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df = common.cut(stage(spark, df, SMALL))
        seen[name] = {r["doc_id"]: r for r in df.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == docs.columns
    good, once, safe, masked, _ = seen.values()
    assert {900_001, 900_002, 900_003, 900_004} <= set(good)
    assert row["doc_id"] in good and 900_001 not in once and 900_002 not in once
    assert 900_003 in once and 900_003 not in safe
    assert masked[900_004]["text"].startswith("Mail me at [EMAIL] ") and masked[900_004]["n_chars"] == len(masked[900_004]["text"])
    labels = {r["doc_id"]: r["quality"] for r in common.read(spark, SMALL, "labels").collect()}
    kept = [d for d in good if labels.get(d) == 1]
    assert len(kept) >= 0.98 * sum(v == 1 for v in labels.values())
    assert sum(labels.get(d) == 0 for d in good) <= 0.15 * sum(v == 0 for v in labels.values())


def test_empty_table(spark):
    df = common.read(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SMALL)
    assert df.count() == 0


def test_rows_not_ids_decide(spark):
    item = common.read(spark, SMALL, "benchmark").orderBy("item_id").first()["text"]
    good = [r["text"] for r in common.read(spark, SMALL, "documents").where("n_chars between 900 and 2500 and lang = 'en'").orderBy("doc_id").limit(6).collect()]
    long = " ".join(f"w{i} and then some" for i in range(60_000))
    rows = [(1, good[0], "x"), (1, good[1], "x"), (1, good[0], "x"), (2, good[0], "y"), (None, good[2], "x"), (None, good[2], "x"), (None, good[2], "y"), (3, f"{good[3]} {item}", "x"), (3, good[4], "x")]
    rows += [(None, f"{item} {good[5]}", "x"), (4, None, "x"), (4, None, "x"), (5, "", "x"), (6, long, "x"), (7, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("spans", F.lit(7)).withColumn("tag", F.lit("t")).withColumn("row_id", F.lit(1))
    df = df.withColumn("ids", F.lit("i")).withColumn("group", F.lit("g"))
    once = corpus_pipeline.drop_near_copies(spark, df, SMALL)
    assert once.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=str)
    assert left == sorted([(1, good[0]), (1, good[1]), (None, good[2]), rows[7][:2], (3, good[4]), rows[9][:2], (4, None), (4, None), (5, ""), (6, long)], key=str)
    safe = corpus_pipeline.drop_contaminated(spark, df, SMALL)
    gone = sorted(((r["doc_id"], r["text"]) for r in df.exceptAll(safe).collect()), key=str)
    assert safe.columns == df.columns and {rows[7][:2], rows[9][:2]} <= set(gone) and (3, good[4]) not in gone and safe.count() + len(gone) == len(rows)
    masked = corpus_pipeline.mask_personal_data(spark, df, SMALL)
    assert masked.columns == df.columns and masked.where("spans = 7 and score in ('x', 'y')").count() == len(rows)
    assert masked.where("text is null").count() == 2
    kept = corpus_pipeline.keep_quality(spark, df, SMALL)
    assert kept.columns == df.columns and kept.exceptAll(df).count() == 0
    assert corpus_pipeline.tokenize(spark, df, SMALL).where("n_tokens = 0").count() == 3
