"""Cutting lineage where a table is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where Spark runs in one process may it be unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ripplegraph-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Materialise a table that later steps read more than once (reliable checkpoint), as `files` files at most."""
    checkpoint_folder(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint(eager=True)
