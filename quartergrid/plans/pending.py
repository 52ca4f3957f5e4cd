"""Which days can be forecast or evaluated next."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import (
    distinct_quarters,
    epoch_millis_local_date,
    local_date,
    local_time,
)
from quartergrid.market import OPERATIONAL_CUTOFF_HOUR, QUARTERS, TARGET


def ready_days(wide: DataFrame, *, entity: Sequence[str] = ()) -> DataFrame:
    """Days on which each of the 96 quarters has one feature row."""
    return (
        wide.groupBy(*entity, "delivery_date")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            distinct_quarters(F.col("quarter_of_day")).alias("_quarters"),
        )
        .where((F.col("_rows") == QUARTERS) & (F.col("_quarters") == QUARTERS))
        .drop("_rows", "_quarters")
    )


def pending_forecasts(
    wide: DataFrame,
    published: DataFrame,
    *,
    start: date | Column | None = None,
    end: date | Column,
    entity: Sequence[str] = (),
) -> DataFrame:
    """Ready days that are not published yet. A published day is never replaced."""
    days = ready_days(wide, entity=entity).where(F.col("delivery_date") <= _lit(end))
    if start is not None:
        days = days.where(F.col("delivery_date") >= _lit(start))
    return days.join(
        published.select(*entity, "delivery_date"), [*entity, "delivery_date"], "left_anti"
    )


def default_start(published: DataFrame, registered_at_millis: Column) -> DataFrame:
    """First published day, or the local day on which the model was registered."""
    return published.agg(
        F.coalesce(F.min("delivery_date"), epoch_millis_local_date(registered_at_millis)).alias(
            "start"
        )
    )


def complete_quarters(
    frame: DataFrame, *, entity: Sequence[str] = (), required: str | None = None
) -> DataFrame:
    """Days on which all 96 quarters occur, counting rows with ``required`` only."""
    rows = frame if required is None else frame.where(F.col(required).isNotNull())
    return (
        rows.groupBy(*entity, "delivery_date")
        .agg(distinct_quarters(F.col("quarter_of_day")).alias("_quarters"))
        .where(F.col("_quarters") == QUARTERS)
        .drop("_quarters")
    )


def evaluation_days(
    forecasts: DataFrame,
    wide: DataFrame,
    evaluated: DataFrame,
    *,
    start: date | Column | None = None,
    end: date | Column | None = None,
    refresh: bool = False,
    target: str = TARGET,
    entity: Sequence[str] = (),
) -> DataFrame:
    """Days to evaluate: every eligible day from the earliest gap on.

    Later days are recomputed because their rolling metrics see the filled gap. The
    window runs on eligible days, one row per calendar date and entity.
    """
    key = [*entity, "delivery_date"]
    eligible = complete_quarters(_within(forecasts, start, end), entity=entity).join(
        complete_quarters(_within(wide, start, end), entity=entity, required=target),
        key,
        "left_semi",
    )
    done = evaluated.select(*key).distinct().withColumn("_done", F.lit(True))
    open_day = F.lit(True) if refresh else F.col("_done").isNull()
    first_gap = F.min(F.when(open_day, F.col("delivery_date"))).over(Window.partitionBy(*entity))
    return (
        eligible.join(done, key, "left")
        .withColumn("_first_gap", first_gap)
        .where(F.col("delivery_date") >= F.col("_first_gap"))
        .select(*key)
    )


def operational_state(runs: DataFrame, now: Column) -> DataFrame:
    """Whether tomorrow's operational forecast is ``early``, ``ready`` or ``missing``."""
    due = F.date_add(local_date(now), 1)
    found = F.count_if(
        (F.col("delivery_date") == due) & (F.col("forecast_kind") == "operational")
    )
    early = F.hour(local_time(now)) < OPERATIONAL_CUTOFF_HOUR
    return runs.agg(found.alias("operational_rows")).select(
        due.alias("delivery_date"),
        "operational_rows",
        F.when(F.col("operational_rows") > 0, "ready")
        .when(early, "early")
        .otherwise("missing")
        .alias("state"),
    )


def require_operational_forecast(runs: DataFrame, now: Column) -> None:
    """After the local cutoff, tomorrow must have an operational forecast."""
    found = operational_state(runs, now).first()
    if found["state"] == "missing":
        raise RuntimeError(
            f"no operational forecast exists for {found['delivery_date']} after the cutoff"
        )


def _lit(value: date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _within(frame: DataFrame, start, end) -> DataFrame:
    if start is not None:
        frame = frame.where(F.col("delivery_date") >= _lit(start))
    if end is not None:
        frame = frame.where(F.col("delivery_date") <= _lit(end))
    return frame
