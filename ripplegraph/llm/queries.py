"""Registered queries of the operators: each applies one operator, with its parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, common, decontaminate, langid, mixing, ngram_join, pii, quality, repair, repeats, token_counts, topk


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest integer inner product for every vector whose id is divisible by 20."""
    rows = topk.integer_vectors(common.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return topk.exact_top_k(rows.where(topk.every_nth("id", 20)), rows, k=20)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE_KINDS))
    counts = [pii.count_of(k).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    more = [pii.count_of(k).cast("long").alias(f"n_{k}") for k in pii.MORE_KINDS]
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), *more, every)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the rows that are not held out."""
    docs = common.read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.learnable()))
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (common.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and link component of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.components(docs).select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantile and truncated totals of the corpus for every context limit that is a length, and for powers of two."""
    import public_tokenizers

    with open(_file("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    lengths = token_counts.encoded_lengths(common.read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    limits = spark.range(7, 18).select(F.pow(F.lit(2), F.col("id")).cast("long").alias("context_limit"))
    return token_counts.context_report(common.cut(token_counts.histogram(lengths)), limits)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold (near) copies of windows of benchmark items."""
    return decontaminate.contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that occur again."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.digest(repeats.remove_repeats(docs))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.collapse_and_render(common.read(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from labelled rows that are not held out."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.fit(docs, common.read(spark, sf_dir, "labels"), learn=common.fold(F.col("doc_id")) != 2)
    scored = quality.score(docs, machine)
    return scored.select("doc_id", (common.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    with open(_file("word_bpe_49k.json")) as f:
        tokens = bpe.Tokens(f.read())
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, tokens, keep=["doc_id"]), tokens)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mixture takes, and its source's target."""
    return mixing.mix(common.read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of two or three words that hold together most, for each language."""
    return collocations.mine(common.read(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the rule of the contract and repaired by the cheapest edits."""
    return repair.damaged_and_repaired(common.read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_top_k, op2_pii, op3_language_id, op4_ngram_jaccard, op5_token_counts, op6_decontaminate, op7_repeated_bytes, op8_chat, op9_quality, op10_bpe, op11_mixing, op12_collocations, op13_repair)
}
