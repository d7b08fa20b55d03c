"""Cleaning a document table in five stages, each one operator over all that the stage before it kept.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> personal data -> BPE.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of the documents they were given. No stage drops a row for its size, place or count.

Stages decide on rows, not on ids: a row is named by its id and a hash of all its columns, so different
texts of one id are judged apart, and rows without an id are judged like others. Rows that are equal in
every column share a name and a fate; of them the n-gram Jaccard join keeps one. Columns of the names that operators or
stages use themselves are left as they are. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import bpe, common, decontaminate, ngram_join, pii, quality

#: Documents are rejected under this score, as in the query of the classifier.
REJECT_BELOW = 0.7


def _aside(docs: DataFrame, name: str) -> tuple[DataFrame, list[Column]]:
    """docs with a column of this name renamed, and the columns that give it back."""
    other = name
    while other in docs.columns:
        other += "_"
    return docs.withColumnRenamed(name, other), [F.col(other if c == name else c).alias(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts are scored like any other; a label counts for all rows of its id.
    """
    machine = quality.fit(docs, common.read(spark, sf_dir, "labels"), learn=common.fold(F.col("doc_id")) != 2)
    held, columns = _aside(docs, "score")
    return quality.score(held, machine).where(F.col("score") >= REJECT_BELOW).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of every group of linked documents: the one of the smallest id (rows without id come last).

    Rows without words are linked with nothing and stay.
    """
    keyed, names = common.row_key(docs)
    found = ngram_join.components(keyed.select("doc_id", names[1], "text"), tag_col=names[1])
    one = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tag"))
    found = found.where(F.col("n_shingles") > 0)
    rows = found.select("group", one.alias("one"))
    lead = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("one").alias("lead"))
    others = rows.join(lead, "group").where("one <> lead").select(F.col("one.id").alias(names[0]), F.col("one.tag").alias(names[1]))
    again = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("tag").alias(names[1])).count().where("count > 1")
    marks = others.distinct().withColumn("gone", F.lit(True)).unionByName(again.select(*names, F.lit(False).alias("gone")))
    marks = common.cut(marks.groupBy(*names).agg(F.max("gone").alias("gone")).withColumnRenamed("gone", "is gone"))
    marked = keyed.join(marks, names, "left")
    kept = marked.where(F.col("is gone").isNull())
    if marks.where(~F.col("is gone")).limit(1).count():  # rows that are equal in every column: one stays
        kept = kept.unionByName(marked.where(~F.col("is gone")).dropDuplicates(names))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages; null and empty texts hold none."""
    keyed, names = common.row_key(docs)
    found = decontaminate.leaks(keyed.select(*names, "text"), common.read(spark, sf_dir, "benchmark"), id_cols=tuple(names))
    return keyed.join(found.select(*names).distinct(), names, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text where there is such a column. A null text stays null."""
    held, columns = _aside(docs, "spans")
    masked = pii.redact(pii.detect(held, pii.fit(held)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of ids and decoded text of every row; null and empty texts have no ids."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        tokens = bpe.Tokens(f.read())
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), tokens, keep=["doc_id"]), tokens)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("BPE encoding and decoding", tokenize),
]

#: A factorisation machine's scores and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written as a checkpoint and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.cut(docs)
    return docs
