"""Python workers must be able to import this package, and give back memory that they no longer use."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Workers are reused by stage after stage: large blocks go back to the system when they are freed, Arrow's too.
MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Put the folder of this package on the path of Python workers that are started from now on.

    On a cluster where the folder is not there, the package is shipped with --py-files as usual.
    """
    here = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    for name, value in MEMORY.items():
        environment.setdefault(name, value)
    known = environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (here, known) if p)
