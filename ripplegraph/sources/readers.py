"""Reading sources: documents, record collections, API descriptions, DDL, CSV, catalogs, reviews (workbooks: workbooks.py).

Files are read by Spark (text, csv, json). Only YAML decoding needs a small helper per file; a file that cannot be decoded becomes a row of an error column, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import EDGE, SPACE, WORD, lines_of, strip
from ..functions.workers import importable
from ..operators import markdown

METHODS = ("get", "post", "put", "patch", "delete")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Markdown and text files as document rows with their text."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return markdown.documents(raw.withColumn("source_key", F.substring_index("path", "/", -1)))


def read_collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A collection of JSON lines with its fixed schema; absent fields are null."""
    return spark.read.schema(schemas.COLLECTIONS[name]).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark is not part of the first name; all columns are text, quotes are doubled, quoted values may hold line ends."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def parse_openapi(text: str) -> list[tuple]:
    """(endpoint, method, operation_id, schemas, relation_type, field, line) rows of one API description in JSON or YAML."""
    positions: dict[tuple, int] = {}
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
        positions = dict(_yaml_lines(yaml.compose(text), ()))
    if not isinstance(data, dict):
        raise ValueError("an API description must be a mapping")
    names = sorted((data.get("components") or {}).get("schemas") or {})
    out = []
    for endpoint, item in (data.get("paths") or {}).items():
        for method, op in item.items():
            if str(method).lower() not in METHODS:
                continue
            containers = [("REQUEST_FIELD", op.get("requestBody") or {}, ("requestBody",))]
            containers += [("RESPONSE_FIELD", r, ("responses", str(status))) for status, r in (op.get("responses") or {}).items()]
            seen = set()
            for relation, box, at in containers:
                media = ((box.get("content") or {}).get("application/json") or {}).get("schema") or {}
                for field in sorted(media.get("properties") or {}):
                    if (relation, field) in seen:
                        continue
                    seen.add((relation, field))
                    where = ("paths", endpoint, str(method), *at, "content", "application/json", "schema", "properties", field)
                    out.append((endpoint, str(method).lower(), op.get("operationId"), names, relation, field, positions.get(where, 1)))
            if not seen:
                out.append((endpoint, str(method).lower(), op.get("operationId"), names, None, None, 1))
    return out


def _yaml_lines(node, path: tuple) -> Iterator[tuple[tuple, int]]:
    for key, value in getattr(node, "value", ()) if node is not None and node.id == "mapping" else ():
        here = (*path, str(key.value))
        yield here, key.start_mark.line + 1
        yield from _yaml_lines(value, here)


OPENAPI = "path string, endpoint string, method string, operation_id string, schemas array<string>, relation_type string, field string, line int, error string"


def openapi_fields(files: DataFrame) -> DataFrame:
    """S3: (path, text) to one row per operation field, with the line of the field; undecodable files give one row with the error."""
    importable(files.sparkSession)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    rows += [(path, *r, None) for r in parse_openapi(text or "")]
                except Exception as e:  # noqa: BLE001  any fault of a file is a row
                    rows.append((path, None, None, None, None, None, None, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OPENAPI.split(", ")])

    return files.select("path", "text").mapInPandas(parse, OPENAPI)


def ddl_columns(files: DataFrame) -> DataFrame:
    """(path, text) to (path, table_name, position, definition, column_name, column_type, is_constraint, constrained, line).

    Definitions are split on every comma, also inside parentheses.
    """
    head = rf"(?is)CREATE[{SPACE}]+TABLE[{SPACE}]+"
    statement = rf"{head}[{WORD}.]+[{SPACE}]*\(.*?\);"
    s = files.select("path", "text", F.regexp_extract_all("text", F.lit(statement), F.lit(0)).alias("_every"))
    # a statement stands behind the end of the one before it, so equal ones have places of their own
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    place = lambda acc, x: F.call_function("locate", x, F.col("text"), acc["next"])
    found = F.aggregate("_every", start, lambda acc, x: F.struct((place(acc, x) + F.length(x)).alias("next"), F.array_append(acc["at"], place(acc, x)).alias("at")))["at"]
    s = s.select("path", "text", F.explode(F.arrays_zip(F.col("_every").alias("s"), found.alias("at"))).alias("_one")).select("path", "text", "_one.s", F.col("_one.at").alias("_from"))
    body = F.regexp_extract("s", rf"{head}[{WORD}.]+[{SPACE}]*\((.*?)\);", 1)
    s = s.withColumn("table_name", F.regexp_extract("s", rf"{head}([{WORD}.]+)[{SPACE}]*\(", 1)).withColumn("body", body)
    s = s.withColumn("_at", F.expr("_from + locate('(', s)"))  # place of the body in the text, from 1
    parts = F.split("body", ",", -1)
    p = s.select("path", "text", "table_name", "_at", parts.alias("_all"), F.posexplode(parts).alias("position", "_raw"))
    before = F.length(F.array_join(F.slice("_all", 1, F.col("position")), ",")) + F.when(F.col("position") > 0, 1).otherwise(0)
    lead = F.length("_raw") - F.length(F.regexp_replace("_raw", f"^[{SPACE}]+", ""))
    upto = F.col("text").substr(F.lit(1), F.col("_at") - 1 + before + lead)
    definition = strip(F.col("_raw"))
    p = p.withColumn("definition", definition).withColumn("line", (F.length(F.regexp_replace(upto, "[^\n]", "")) + 1).cast("int")).where("definition <> ''")
    words = F.split("definition", f"[{SPACE}]+")
    table_level = F.col("definition").rlike(rf"(?i)^(PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK){EDGE}")
    own = F.upper("definition").rlike("PRIMARY KEY|NOT NULL|UNIQUE")
    return p.select(
        "path", "table_name", "position", "definition", F.when(~table_level, F.get(words, F.lit(0))).alias("column_name"),
        F.when(~table_level, F.coalesce(F.get(words, F.lit(1)), F.lit("unknown"))).alias("column_type"), table_level.alias("is_constraint"), (table_level | own).alias("constrained"), "line",
    )


def alias_catalog(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, canonical_type, aliases) exploded to (item_id, canonical_type, alias, seq); and the invalid entries with a reason."""
    known = (*markdown.TYPES.values(), "BusinessField")
    problem = F.when(F.coalesce("item_id", F.lit("")) == "", "missing id").when(~F.coalesce("canonical_type", F.lit("")).isin(*known, ""), "unknown type").when(F.col("aliases").isNull(), "missing aliases")
    e = entries.withColumn("problem", problem)
    good = e.where("problem is null").select("item_id", "canonical_type", F.posexplode("aliases").alias("seq", "alias")).where("alias <> ''")
    return good.select("item_id", "canonical_type", "alias", "seq"), e.where("problem is not null")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review results, a JSON list of artifact_id, decision, note."""
    return spark.read.option("multiLine", True).schema("artifact_id string, decision string, note string").json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def line_count(text) -> object:
    return F.size(lines_of(text))
