"""Pages of large ordered tables without sorting them for each page.

The table is written once in ranges of its order with an index of ranges (rows before it, rows in it, last key). A page
by number or after a key then opens the ranges that it lies in and no others.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(df: DataFrame, order: list[str], folder: str, ranges: int | None = None) -> None:
    """Store a table by ranges of `order` (ascending, nulls first; the borders are Spark's sampled ones).

    Equal keys share a range, so end `order` with an id; rows that are equal in all of it have no order among them.
    `ranges` is by default the session's number of shuffle partitions, which follows the size of the data.
    """
    if "_range" in df.columns:
        raise ValueError("the column _range is the table's own")
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    placed.sortWithinPartitions("_range", *order).write.mode("overwrite").partitionBy("_range").parquet(f"{folder}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    index = stored.groupBy("_range").agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    index.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")
    spark.createDataFrame([(order, placed.schema.json())], "keys array<string>, columns string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def _open(spark: SparkSession, folder: str, ranges: list[int]) -> tuple[DataFrame, list[str]]:
    """Rows of the given ranges (the folders of others are not opened) and the columns of the order."""
    about = spark.read.parquet(f"{folder}/about").head()
    rows = spark.read.schema(T.StructType.fromJson(json.loads(about["columns"]))).parquet(f"{folder}/rows")
    return rows.where(F.col("_range").isin(ranges)).drop("_range"), about["keys"]


def total(spark: SparkSession, folder: str) -> int:
    """Number of rows of the table, from the index."""
    return _index(spark, folder).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]


def page(spark: SparkSession, folder: str, offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the order; past the end there are none."""
    hit = _index(spark, folder).where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).select("_range", "start").collect()
    rows, order = _open(spark, folder, [r["_range"] for r in hit])
    first = min((r["start"] for r in hit), default=offset)
    return rows.orderBy(*order).offset(offset - first).limit(limit)


def page_after(spark: SparkSession, folder: str, after: dict[str, Any], limit: int) -> DataFrame:
    """The next rows after a row, which is named by its values of the order; it need not exist any more."""
    index = _index(spark, folder)
    types = index.schema["last"].dataType
    key = F.struct(*[F.lit(after[f.name]).cast(f.dataType).alias(f.name) for f in types])
    first = index.where(F.col("last") > key).agg(F.min(F.struct("_range", "start", "n")).alias("r")).head()["r"]
    if first is None:
        return _open(spark, folder, [])[0]
    enough = first["start"] + first["n"] + limit
    hit = index.where((F.col("_range") >= first["_range"]) & (F.col("start") < enough)).select("_range").collect()
    rows, order = _open(spark, folder, [r["_range"] for r in hit])
    return rows.where(F.struct(*order) > key).orderBy(*order).limit(limit)
