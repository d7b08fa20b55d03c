"""Chat formatting after collapsing cumulative snapshots.

Logs often hold one conversation many times, once after each exchange. A rolling hash of the turns
(role, text and place of every turn so far) names each prefix of each conversation. A conversation
is dropped if its whole hash is that of a shorter prefix of another one, or of an equal conversation
with a smaller id; two anti-joins do that, and only what remains is rendered.

A turn's digest is two 60-bit halves of a hash over (place, role, text); a prefix is named by its
length and the two sums of digests, taken in one window per conversation. Only ids and digests are
shuffled for the collapse; texts are read again for what is kept.

Defined cases: turns are ordered by turn number, then role and text; repeated turn numbers are turns
of their own, a null turn number counts as -1. A null text renders as empty, a null role as `unknown`;
null and empty are equal. Texts of any length are rendered whole. Rows without a conversation id are dropped. No rows: no conversations. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls settled."""
    return rows.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def prefixes(rows: DataFrame) -> DataFrame:
    """One row per conversation and turn: the length and hash of the prefix that ends there, and the whole length."""
    d = turns(rows).select("conv_id", "turn", "role", F.sha2("text", 256).alias("content"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    d = d.withColumn("at", F.row_number().over(order).cast("long"))
    name = F.sha2(F.concat_ws("|", F.col("at").cast("string"), F.length("role").cast("string"), "role", "content"), 256)
    half = lambda i: F.conv(F.substring(name, i, 15), 16, 10).cast("decimal(20,0)")
    d = d.select("conv_id", "at", half(1).alias("a"), half(16).alias("b"))
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("conv_id", "at", F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"), F.max("at").over(Window.partitionBy("conv_id")).alias("n_turns"))


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_collapsed, n_snapshots): conversations that are no prefix of others; equal ones keep the smallest id.

    n_collapsed counts the conversations equal to this one that it stands for, itself not included, and n_snapshots those
    that are a shorter prefix of it (a snapshot of two kept conversations counts for both).
    """
    p = common.cut(prefixes(rows))
    whole = p.where(F.col("at") == F.col("n_turns"))
    classes = common.cut(whole.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")))
    inner = p.where(F.col("at") < F.col("n_turns")).select(F.col("at").alias("n_turns"), "a", "b").distinct()
    top = common.cut(classes.join(inner, ["n_turns", "a", "b"], "left_anti"))
    shorter = p.where(F.col("at") < F.col("n_turns")).join(top.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.col("at").alias("n_turns"), "a", "b")
    seen = shorter.join(classes.select("n_turns", "a", "b", "n"), ["n_turns", "a", "b"]).groupBy("conv_id").agg(F.sum("n").alias("n_snapshots"))
    out = top.join(seen, "conv_id", "left")
    return out.select("conv_id", "n_turns", (F.col("n") - 1).alias("n_collapsed"), F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"))


def render(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations as text, one `<|role|>` block per turn and an end mark; columns of kept stay."""
    t = turns(rows).join(kept.select("conv_id"), "conv_id", "left_semi")
    lined = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.sha2("text", 256).alias("content"), "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda s: F.concat(F.lit("<|"), s["role"], F.lit("|>\n"), s["text"], F.lit("\n"))), "")
    return kept.join(lined, "conv_id").select(*kept.columns, F.concat(text, F.lit("<|end|>")).alias("text"))


def collapse_and_render(rows: DataFrame) -> DataFrame:
    return render(rows, maximal(rows))
