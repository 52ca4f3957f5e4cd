"""Which source responses are needed, which are missing, and what to append."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.market import (
    ACTUAL_SERIES,
    EXAA_SERIES,
    FORECAST_SERIES,
    PRICE_LAGS,
    REQUEST_BATCH_DAYS,
    SDAC_SERIES,
    WEATHER_RUN_SERIES,
)
from quartergrid.operators.versions import changed_only
from quartergrid.sources.measurements import accepted_payloads

# series group, first and last day relative to the delivery range
OFFSETS = (
    (SDAC_SERIES, -max(PRICE_LAGS), 0),
    (EXAA_SERIES, 0, 0),
    (FORECAST_SERIES + WEATHER_RUN_SERIES, -1, -1),
    (ACTUAL_SERIES, -2, -2),
)


def request_plan(bounds: DataFrame, today: Column) -> DataFrame:
    """(delivery_date, series) needed for each delivery range, lagged inputs included.

    ``bounds`` has ``start`` and an optional ``end``; the end is at most tomorrow.
    Other columns are kept. A reversed range is an error.
    """
    carried = [c for c in bounds.columns if c not in ("start", "end")]
    tomorrow = F.date_add(today, 1)
    reversed_range = F.raise_error(F.lit("the first requested day lies behind the last")).cast("date")
    start = F.when(F.col("start") > F.col("end"), reversed_range).otherwise(F.col("start"))
    capped = bounds.select(
        *carried,
        start.alias("_start"),
        F.least(F.coalesce(F.col("end"), tomorrow), tomorrow).alias("_end"),
    ).where(F.col("_start") <= F.col("_end"))
    sources = F.array(
        *(
            F.struct(
                F.lit(series).alias("series"), F.lit(first).alias("first"), F.lit(last).alias("last")
            )
            for group, first, last in OFFSETS
            for series in group
        )
    )
    planned = capped.select(*carried, "_start", "_end", F.inline(sources))
    dates = F.sequence(
        F.date_add("_start", F.col("first")), F.date_add("_end", F.col("last"))
    )
    return planned.select(*carried, F.explode(dates).alias("delivery_date"), "series")


def missing_requests(
    plan: DataFrame, stored: DataFrame, keys: Sequence[str] = ("delivery_date", "series")
) -> DataFrame:
    """Planned keys without a stored response, in batches of days, newest first."""
    known = stored.select(*keys).distinct()
    missing = plan.join(known, list(keys), "left_anti")
    newest = Window.orderBy(F.col("delivery_date").desc())
    # One row per calendar date, at most 366 a year.
    batches = missing.select("delivery_date").distinct().withColumn(
        "batch",
        F.floor((F.row_number().over(newest) - 1) / REQUEST_BATCH_DAYS).cast("int"),
    )
    return missing.join(F.broadcast(batches), "delivery_date")


def new_versions(incoming: DataFrame, stored: DataFrame, *, refresh: bool = False) -> DataFrame:
    """Accepted responses to append.

    A refresh keeps only payloads that differ from the newest stored version; a normal
    run keeps only keys that are not stored at all.
    """
    keys = ("delivery_date", "series")
    accepted = accepted_payloads(incoming)
    if refresh:
        return changed_only(accepted, stored, keys, "payload", "ingested_at")
    return accepted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def require_refresh_bounds(refresh: bool, start: date | None, end: date | None) -> None:
    if refresh and (start is None or end is None):
        raise ValueError("a refresh names its first and its last day")
