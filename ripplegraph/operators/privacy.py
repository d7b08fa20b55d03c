"""Redaction, sensitive-data scans and audit rows; regular expressions in one narrow pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import EDGE, END, SPACE, START

MASK = "[REDACTED]"
# What is redacted, in this order. White space, digits and word edges are those of Unicode; where the
# character at an edge is a letter or digit by the pattern, START or END stands for the edge.
REDACT = (
    rf"(?i)(?:氏名|名前|顧客名|口座名義|full[_ ]?name|customer[_ ]?name)[{SPACE}]*[:：=][{SPACE}]*[^\r\n,，。]{{2,80}}",
    rf"(?i)(?:顧客番号|会員番号|口座番号|customer[_ -]?id|account[_ -]?number)[{SPACE}]*[:：=][{SPACE}]*[A-Za-z0-9_-]{{4,40}}",
    rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{END}",
    rf"{START}0\p{{Nd}}{{1,4}}[- ]?\p{{Nd}}{{1,4}}[- ]?\p{{Nd}}{{3,4}}{END}",
    rf"https?://[^{SPACE})]+",
    rf"(?i){START}(?:sk-[A-Za-z0-9_\-]{{8,}}|pk_[A-Za-z0-9_\-]{{8,}}|(?:api[_-]?key|token|secret)[=:][A-Za-z0-9_\-]{{8,}}){EDGE}",
    rf"{START}\p{{Nd}}{{7,12}}{END}",
)
SENSITIVE_KEY = r"(?i)key|token|secret|password|full[_ ]?name|customer[_ ]?name|customer[_ ]?id|account[_ ]?number|email|phone"
CATEGORIES = {"email": REDACT[2], "phone": REDACT[3], "url": REDACT[4], "api_key": REDACT[5], "account_number": REDACT[6]}
JUDGEMENTS = ("impact", "no_impact", "unsure", "same", "related", "different")


def redact_text(text: Column) -> Column:
    """The seven patterns, one after the other."""
    for pattern in REDACT:
        text = F.regexp_replace(text, pattern, MASK)
    return text


def redact_map(fields: Column) -> Column:
    """Values of sensitive keys are masked, other values are redacted as text."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit(MASK)).otherwise(redact_text(v)))


def redact_list(values: Column) -> Column:
    return F.transform(values, redact_text)


def _masked(value: Column, kind: T.DataType) -> Column:
    """A value of which nothing shows: texts become the mask, at any depth; other values are null."""
    if isinstance(kind, T.StringType):
        return F.lit(MASK)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_masked(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _masked(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _masked(v, kind.valueType))
    return F.lit(None).cast(kind)


def redact_nested(value: Column, kind: T.DataType) -> Column:
    """P2 at any depth: an expression made from the type of the value. Structs and maps mask what stands under sensitive
    names and go on into the rest, arrays go on into their elements, texts are redacted, other values stay. Nulls stay null.
    """
    if isinstance(kind, T.StringType):
        return redact_text(value)
    if isinstance(kind, T.StructType):
        hidden = lambda f: re.search(SENSITIVE_KEY, f.name)
        fields = [(_masked if hidden(f) else redact_nested)(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: F.when(k.cast("string").rlike(SENSITIVE_KEY), _masked(v, kind.valueType)).otherwise(redact_nested(v, kind.valueType)))
    return value


def redact_columns(rows: DataFrame, *keep: str) -> DataFrame:
    """P2 for whole rows: every column but those of `keep` as a field of the payload."""
    return rows.select(*[F.col(f"`{f.name}`") if f.name in keep else (_masked if re.search(SENSITIVE_KEY, f.name) else redact_nested)(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def sensitive_counts(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """(category, chunks): chunks with a hit per category, in one pass; categories without hits are left out."""
    sums = chunks.agg(*[F.sum(F.when(F.col(text_col).rlike(p), 1).otherwise(0)).alias(k) for k, p in CATEGORIES.items()])
    pairs = ", ".join(f"'{k}', {k}" for k in CATEGORIES)
    return sums.selectExpr(f"stack({len(CATEGORIES)}, {pairs}) as (category, chunks)").where("chunks > 0")


def audit_rows(calls: DataFrame) -> DataFrame:
    """Hashes and sizes of model calls (run_id, purpose, provider, model, payload, answer, redacted), never their content."""
    return calls.select(
        "run_id",
        "purpose",
        "provider",
        "model",
        F.sha2("payload", 256).alias("payload_hash"),
        F.sha2("answer", 256).alias("answer_hash"),
        F.length("payload").alias("payload_chars"),
        F.coalesce("redacted", F.lit(False)).alias("redacted"),
    )


def answer_summary(answers: DataFrame) -> DataFrame:
    """Answers per judgement and run."""
    return answers.groupBy("run_id", "llm_judgement").agg(F.count("*").alias("answers"))


def latest(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The latest rows of an audit table (a limit of the report)."""
    return df.orderBy(F.desc(order)).limit(limit)
