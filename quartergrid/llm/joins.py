"""Joins that keep to a checked size or spread a hot key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
TASK_ROWS = 50_000


def look_up(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the label of ``key`` as ``found``; labels are copied once per salt.

    Merged, whatever the size: callers repeat it, and every broadcast would hold a memory page of
    each executor until the driver happens to collect its plan.
    """
    salted = labels.select(
        F.col("node").alias("key"),
        F.col("component").alias("found"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    other = next(c for c in ("b", "node") if c in rows.columns)
    return rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["key", "salt"])


def gathered(rows: DataFrame, n: float) -> DataFrame:
    """``rows``, some ``n`` narrow ones, in a task for each ``TASK_ROWS`` of them, but one for each core at least.

    A step that is repeated on a small table would else start a task, and write files, for each
    shuffle partition, however few rows there are. More tasks than partitions are never made.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS)))


def free(base: str, *frames: DataFrame) -> str:
    """``base``, lengthened until no frame has a column of that name in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keyed(rows: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a number of its own to every row. It is fixed only once the rows are written."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def sized(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Mark ``rows`` for broadcasting if it counts at most ``most`` narrow rows."""
    return F.broadcast(rows) if rows.count() <= most else rows
