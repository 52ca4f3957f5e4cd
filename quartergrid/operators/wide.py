"""Long quarter values to wide, date-shifted feature rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartergrid.functions.numbers import non_finite
from quartergrid.market import MODEL_INPUT, QUARTERS, Difference, WideLayout


def placement_table(spark: SparkSession, layout: WideLayout) -> DataFrame:
    """The layout as rows. Its size is the number of columns, whatever the data."""
    rows = [(p.series, p.column, p.shift) for p in layout.placements]
    return spark.createDataFrame(rows, "series string, _column string, _shift int")


def place_series(
    intervals: DataFrame,
    layout: WideLayout = MODEL_INPUT,
    *,
    entity: Sequence[str] = (),
) -> DataFrame:
    """Copy each value to every (day, column) that uses it.

    Date shifts and calendar-day lags become extra copies of the narrow row, so
    the later pivot builds all blocks and lags at once instead of joining them.
    """
    placements = F.broadcast(placement_table(intervals.sparkSession, layout))
    return intervals.join(placements, "series").select(
        *entity,
        F.date_add("delivery_date", F.col("_shift")).alias("delivery_date"),
        "quarter_of_day",
        "_column",
        "value",
    )


def complete_cells(
    placed: DataFrame, required: Sequence[str], *, entity: Sequence[str] = ()
) -> DataFrame:
    """Keep days on which every required column has all 96 quarters.

    Decided on narrow rows before the pivot: a day is complete exactly when it holds
    96 values of each required column. A predicate over all wide columns would say
    the same, but Spark derives constraints from it for every column alias.
    """
    day = Window.partitionBy(*entity, "delivery_date")
    counted = F.col("_column").isin(*required) & ~non_finite(F.col("value"))
    return (
        placed.withColumn("_cells", F.count_if(counted).over(day))
        .where(F.col("_cells") == QUARTERS * len(required))
        .drop("_cells")
    )


def pivot_columns(
    placed: DataFrame, columns: Sequence[str], *, entity: Sequence[str] = ()
) -> DataFrame:
    """Pivot placed values to one row per day and quarter."""
    return (
        placed.groupBy(*entity, "delivery_date", "quarter_of_day")
        .pivot("_column", list(columns))
        .agg(F.max("value"))
    )


def add_differences(frame: DataFrame, differences: Sequence[Difference]) -> DataFrame:
    """Residual columns; NULL as soon as one operand is NULL."""
    for item in differences:
        value = F.col(item.minuend)
        for column in item.subtrahends:
            value = value - F.col(column)
        frame = frame.withColumn(item.column, value)
    return frame


def complete_days(frame: DataFrame, *, entity: Sequence[str] = ()) -> DataFrame:
    """Keep only days that still have all 96 quarters."""
    day = Window.partitionBy(*entity, "delivery_date")
    return (
        frame.withColumn("_quarters", F.count(F.lit(1)).over(day))
        .where(F.col("_quarters") == QUARTERS)
        .drop("_quarters")
    )


def wide_rows(
    intervals: DataFrame,
    layout: WideLayout = MODEL_INPUT,
    *,
    entity: Sequence[str] = (),
    through: date | Column | None = None,
) -> DataFrame:
    """Complete days of the wide table: every feature present, target may be missing."""
    placed = place_series(intervals, layout, entity=entity)
    if through is not None:
        last = through if isinstance(through, Column) else F.lit(through)
        placed = placed.where(F.col("delivery_date") <= last)
    # One shuffle by day serves the completeness window and the pivot.
    by_day = placed.repartition(*entity, "delivery_date")
    kept = complete_cells(by_day, layout.required, entity=entity)
    columns = [p.column for p in layout.placements]
    return add_differences(pivot_columns(kept, columns, entity=entity), layout.differences)


def calendar_lags(
    frame: DataFrame,
    value: str,
    lags: Sequence[int],
    name,
    *,
    key: Sequence[str] = ("delivery_date", "quarter_of_day"),
) -> DataFrame:
    """Values of the same quarter N calendar days earlier; rows without history drop.

    One shuffle: each row is copied to itself and to the days it serves, then the
    copies are folded per key.
    """
    offsets = F.array(*(F.lit(days) for days in (0, *lags)))
    day, *rest = key
    carried = [c for c in frame.columns if c not in key]
    copies = frame.withColumn("_lag", F.explode(offsets)).where(
        (F.col("_lag") == 0) | F.col(value).isNotNull()
    )
    here = F.col("_lag") == 0
    folded = copies.groupBy(F.date_add(day, F.col("_lag")).alias(day), *rest).agg(
        F.bool_or(here).alias("_present"),
        *(F.max(F.when(here, F.col(c))).alias(c) for c in carried),
        *(F.max(F.when(F.col("_lag") == days, F.col(value))).alias(name(days)) for days in lags),
    )
    return folded.where("_present").drop("_present").na.drop(subset=[name(days) for days in lags])
