"""Exact order statistics over data of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quartergrid.session import durable


# Most distinct values of a group that are sorted in one task.
SORTED = 1_000_000
# Most ranges into which one step cuts a range that is too large.
PIECES = 1_000


def order_statistic(
    frame: DataFrame,
    value: str,
    rank: Callable[[Column], Column],
    *,
    by: Sequence[str] = (),
    name: str = "order_statistic",
    weight: str | None = None,
    largest: int = SORTED,
) -> DataFrame:
    """Exact value at a zero-based rank per group; ``rank`` maps the row count to it.

    With ``weight``, a column of positive numbers, a row counts as that many rows. NULL values
    do not count, NULL groups are groups, and NaN or infinite values stop the job.

    Equal values are folded into weights first. The distinct values are then range
    partitioned and only weights per range cross partitions, so neither a hot group nor a hot
    value ends up in one task, and nothing is sampled. While the range that holds a rank has
    more than ``largest`` distinct values, it is cut into ranges again.
    """
    if largest < 1:
        raise ValueError("a task must be allowed one value")
    known = frame.where(F.col(value).isNotNull()).withColumn(value, _finite(F.col(value)))
    weights = known.groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_weight"))
    # Counted while the ranges are written; few values need no look at the ranges' sizes.
    seen = Observation()
    ranged = durable(_cut(weights.repartitionByRange(*by, value)).observe(seen, F.count(F.lit(1)).alias("values")))
    total = F.sum("_in_range").over(Window.partitionBy(*by))
    slices, located = _holding(ranged, by, rank(total).cast("double" if weight else "bigint"))
    while seen.get.get("values", 0) > largest and (most := _most(located)) > largest:
        pieces = min(PIECES, max(2, math.ceil(2 * most / largest)))
        ranged = durable(_cut(slices.repartitionByRange(pieces, *by, value)))
        slices, located = _holding(ranged, by, F.max("_wanted").over(Window.partitionBy(*by)))
    running = Window.partitionBy(*by).orderBy(value)
    return (
        slices.withColumn("_reached", F.sum("_weight").over(running) > F.col("_wanted"))
        .where("_reached")
        .groupBy(*by)
        .agg(F.min(value).alias(name))
    )


def _cut(values: DataFrame) -> DataFrame:
    return values.withColumn("_range", F.spark_partition_id())


def _holding(ranged: DataFrame, by: Sequence[str], wanted: Column) -> tuple[DataFrame, DataFrame]:
    """Values of each group's range that holds the wanted rank, and these ranges with their sizes.

    ``wanted`` is an expression over the ranges; ``_wanted`` of the result counts from the start
    of its range.
    """
    again = [F.first("_wanted").alias("_wanted")] if "_wanted" in ranged.columns else []
    ranges = ranged.groupBy(*by, "_range").agg(
        F.sum("_weight").alias("_in_range"), F.count(F.lit(1)).alias("_values"), *again
    )
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_in_range").over(earlier), F.lit(0))
    located = (
        ranges.withColumns({"_before": before, "_wanted": wanted})
        .where(
            (F.col("_before") <= F.col("_wanted"))
            & (F.col("_wanted") < F.col("_before") + F.col("_in_range"))
        )
        .withColumn("_wanted", F.col("_wanted") - F.col("_before"))
    )
    keys = [*by, "_range"]
    renamed = located.select("_wanted", *(F.col(c).alias(f"_of_{c}") for c in keys))
    values = ranged.drop(*["_wanted"] if again else [])
    same = [values[c].eqNullSafe(renamed[f"_of_{c}"]) for c in keys]
    return values.join(renamed, same).drop("_range", *(f"_of_{c}" for c in keys)), located


def _most(located: DataFrame) -> int:
    return located.agg(F.max("_values")).first()[0] or 0


def _finite(value: Column) -> Column:
    stop = F.raise_error(F.lit("order statistics need finite values")).cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), stop).otherwise(value)


def conformal_rank(coverage: float) -> Callable[[Column], Column]:
    """Finite-sample rank of a calibration score."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must be between 0 and 1")
    return lambda rows: F.least(rows - 1, F.ceil((rows + 1) * F.lit(coverage)) - 1)
