"""Measurements to the stored wide model-input table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import local_date
from quartergrid.market import MODEL_INPUT, MODEL_INPUT_COLUMNS, PRICE_LAGS, WideLayout
from quartergrid.operators.calendar import calendar_columns
from quartergrid.operators.normalise import MARKET_POLICY, FillPolicy, normalise_quarters
from quartergrid.operators.quality import measurement_violations, require_none
from quartergrid.operators.wide import wide_rows
from quartergrid.session import use_utc


def tomorrow(now: Column | None = None) -> Column:
    return F.date_add(local_date(F.current_timestamp() if now is None else now), 1)


def model_input(
    measurements: DataFrame,
    holidays: DataFrame,
    *,
    through: date | Column | None = None,
    layout: WideLayout = MODEL_INPUT,
    policy: FillPolicy = MARKET_POLICY,
    entity: Sequence[str] = (),
    columns: Sequence[str] | None = MODEL_INPUT_COLUMNS,
    check: bool = True,
) -> DataFrame:
    """Complete model-input days from measurements.

    ``holidays`` has one row per calendar date (see ``holiday_calendar``). ``check``
    first raises on invalid measurements. ``through`` defaults to tomorrow.
    """
    use_utc(measurements.sparkSession)
    names = sorted({p.series for p in layout.placements})
    used = measurements.where(F.col("series").isin(names))
    if check:
        require_none(
            measurement_violations(used, entity=entity, policy=policy), "measurements"
        )
    intervals = normalise_quarters(used, entity=entity, policy=policy)
    last = tomorrow() if through is None else through
    rows = wide_rows(intervals, layout, entity=entity, through=last)
    # One row per calendar date: at most 366 a year. A date that occurs twice would repeat days.
    repeated = F.count(F.lit(1)).over(Window.partitionBy("delivery_date")) > 1
    stop = F.raise_error(F.lit("holidays hold a date twice")).cast("date")
    once = holidays.withColumn("delivery_date", F.when(repeated, stop).otherwise(F.col("delivery_date")))
    dated = calendar_columns(rows).join(F.broadcast(once), "delivery_date")
    return dated if columns is None else dated.select(*entity, *columns)


def affected_days(changed: DataFrame, *, entity: Sequence[str] = ()) -> DataFrame:
    """Delivery days whose features use a changed source day."""
    reach = F.array(*(F.lit(days) for days in (0, *PRICE_LAGS)))
    days = changed.select(*entity, "delivery_date").distinct()
    served = F.transform(reach, lambda shift: F.date_add("delivery_date", shift))
    return days.select(*entity, F.explode(served).alias("delivery_date")).distinct()
