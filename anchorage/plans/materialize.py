"""Cutting lineage and numbering rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a temporary folder is used if everything runs
    in one process, as in tests; on a cluster this raises RuntimeError.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and forget how it came about."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str | Column], name: str = "id", start: int = 1) -> DataFrame:
    """``df`` with row numbers in the order of columns that tell its rows apart.

    The rows are range-partitioned and sorted; numbers come from the partition's
    offset, so no task holds more than its share and one count a partition
    reaches the driver.
    """
    ordered = cut(df.orderBy(*order))
    part = F.spark_partition_id()
    sizes = dict(ordered.groupBy(part.alias("part")).count().collect())
    offsets, before = [], start
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(F.lit(before).cast("long"))
        before += sizes.get(p, 0)
    if not offsets:
        return ordered.withColumn(name, F.lit(None).cast("long"))
    here = F.element_at(F.array(*offsets), part + 1)
    return ordered.withColumn(name, here + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
