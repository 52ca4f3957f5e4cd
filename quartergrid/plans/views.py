"""Read views over the stored tables, for all days at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.numbers import any_of, row_mean, split_reasons
from quartergrid.functions.timegrid import distinct_quarters, local_start_text
from quartergrid.market import (
    AUSTRIA,
    CALENDAR_COLUMNS,
    LOWER,
    MARKET_FEATURES,
    POINT,
    QUARTERS,
    REFERENCE,
    TARGET,
    UPPER,
    WEATHER_FIELDS,
    WEATHER_LOCATIONS,
)
from quartergrid.operators.metrics import DAILY_METRICS
from quartergrid.operators.monitoring import ROLLING

PAGE_ROWS = 8
MEAN_FIELDS = ("temperature_2m", "wind_speed_100m", "shortwave_radiation", "cloud_cover")
GENERATION = ("solar", "wind_onshore", "wind_offshore")


def day_index(
    forecasts: DataFrame, wide: DataFrame, metrics: DataFrame, *, target: str = TARGET
) -> DataFrame:
    """Days with a full forecast or a full set of inputs, with flags and metrics."""
    forecast_days = forecasts.groupBy("delivery_date").agg(
        F.max("model_version").alias("model_version"),
        F.max("predicted_at").alias("predicted_at"),
        F.count(F.lit(1)).alias("_forecast_quarters"),
    )
    actual_days = wide.groupBy("delivery_date").agg(
        F.count(target).alias("_settled_quarters"),
        F.count(F.lit(1)).alias("_quarters"),
    )
    settled = F.coalesce("_settled_quarters", F.lit(0)) == QUARTERS
    return (
        forecast_days.join(actual_days, "delivery_date", "full_outer")
        .where((F.col("_forecast_quarters") == QUARTERS) | (F.col("_quarters") == QUARTERS))
        .join(
            metrics.select("delivery_date", "evaluated_at", "mae", "picp", "monitoring_status"),
            "delivery_date",
            "left",
        )
        .select(
            "delivery_date",
            "model_version",
            "predicted_at",
            (F.coalesce("_forecast_quarters", F.lit(0)) == QUARTERS).alias("has_forecast"),
            settled.alias("has_actual"),
            F.col("evaluated_at").isNotNull().alias("has_metrics"),
            settled.alias("settled"),
            "mae",
            "picp",
            "monitoring_status",
        )
    )


def newest_days(days: DataFrame, limit: int) -> DataFrame:
    return days.orderBy(F.col("delivery_date").desc()).limit(limit)


def day_status(has_forecast: Column, settled: Column) -> Column:
    return (
        F.when(~has_forecast, "Historical observation")
        .when(settled, "Settled")
        .otherwise("Forecast only")
    )


def forecast_view(forecasts: DataFrame, wide: DataFrame, metrics: DataFrame) -> DataFrame:
    """Forecast quarters with the settled price, when known, and the day's metrics."""
    key = ["delivery_date", "quarter_of_day"]
    daily = metrics.select(
        "delivery_date",
        *DAILY_METRICS,
        *(f"normalized_96_{c}" for c in DAILY_METRICS),
        *ROLLING,
        "monitoring_status",
        split_reasons(F.col("monitoring_reasons")).alias("monitoring_reasons"),
        "evaluated_at",
    )
    actual = wide.select(*key, F.col(TARGET).alias("actual_price_eur_per_mwh"))
    return forecasts.join(actual, key, "left").join(daily, "delivery_date", "left")


def served_quality(
    rows: DataFrame, metadata: Sequence[str], *, actual: str = "actual_price_eur_per_mwh"
) -> DataFrame:
    """Whether each forecast day may be served: grid, metadata and settlement."""
    quarter = F.col("quarter_of_day")
    days = rows.groupBy("delivery_date").agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_quarters(quarter).alias("quarters"),
        F.count(actual).alias("settled_quarters"),
        *(
            (F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count(F.lit(1)))).alias(f"_one_{c}")
            for c in metadata
        ),
    )
    consistent = F.lit(True)
    for column in metadata:
        consistent = consistent & F.col(f"_one_{column}")
    return days.select(
        "delivery_date",
        "rows",
        "quarters",
        "settled_quarters",
        (F.col("settled_quarters") == QUARTERS).alias("settled"),
        F.when(F.col("rows") != QUARTERS, "incomplete")
        .when(F.col("quarters") != QUARTERS, "invalid grid")
        .when(~consistent, "inconsistent metadata")
        .when(~F.col("settled_quarters").isin(0, QUARTERS), "partial settlement")
        .otherwise("ok")
        .alias("status"),
    )


def feature_quality(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each input day may be served: full grid and no NULL."""
    days = rows.groupBy("delivery_date").agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_quarters(F.col("quarter_of_day")).alias("quarters"),
        F.count_if(any_of([F.col(c).isNull() for c in columns])).alias("null_rows"),
    )
    ok = (
        (F.col("rows") == QUARTERS) & (F.col("quarters") == QUARTERS) & (F.col("null_rows") == 0)
    )
    return days.withColumn("status", F.when(ok, "ok").otherwise("incomplete"))


def feature_view(wide: DataFrame) -> DataFrame:
    calendar = [c for c in CALENDAR_COLUMNS if c != "delivery_start_local"]
    start = local_start_text(F.col("delivery_date"), F.col("quarter_of_day"))
    return wide.select(*calendar, *MARKET_FEATURES, start.alias("delivery_start_local"))


def observation_view(wide: DataFrame) -> DataFrame:
    return wide.select(
        "delivery_date",
        "quarter_of_day",
        F.col(TARGET).alias("actual_price_eur_per_mwh"),
        REFERENCE,
        AUSTRIA,
    )


def grid_means(
    wide: DataFrame,
    *,
    locations: Sequence[str] = tuple(place[0] for place in WEATHER_LOCATIONS),
    fields: Sequence[str] = tuple(
        column for field, column, _ in WEATHER_FIELDS if field in MEAN_FIELDS
    ),
) -> DataFrame:
    """Mean of each weather field over all locations; NULL when one is missing."""
    return wide.select(
        "delivery_date",
        "quarter_of_day",
        *(
            row_mean([F.col(f"weather_{place}_{field}") for place in locations]).alias(field)
            for field in fields
        ),
    )


def weather_ranges(means: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Lowest and highest value of each field per day."""
    return means.groupBy("delivery_date").agg(
        *(F.min(c).alias(f"{c}_min") for c in fields),
        *(F.max(c).alias(f"{c}_max") for c in fields),
    )


def latest_state(forecasts: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Newest forecast and settlement days, model version and monitoring status."""
    operational = F.when(F.col("forecast_kind") == "operational", F.col("delivery_date"))
    newest = {
        "latest_forecast_date": (forecasts, F.max("delivery_date")),
        "latest_settlement_date": (metrics, F.max("delivery_date")),
        "model_version": (runs, F.max_by("model_version", "delivery_date")),
        "monitoring_status": (metrics, F.max_by("monitoring_status", operational)),
    }
    return forecasts.sparkSession.range(1).select(
        *(frame.agg(value).scalar().alias(name) for name, (frame, value) in newest.items())
    )


def price_points(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Actual, forecast, interval and both references per quarter, for one chart."""
    key = ["delivery_date", "quarter_of_day"]
    interval = F.when(F.col(LOWER).isNotNull(), F.array(LOWER, UPPER))
    return rows.join(features.select(*key, REFERENCE, AUSTRIA), key, "left").select(
        *key,
        F.col("actual_price_eur_per_mwh").alias("actual"),
        F.col(POINT).alias("forecast"),
        interval.alias("interval"),
        F.col(REFERENCE).alias("exaa"),
        F.col(AUSTRIA).alias("austria"),
    )


def fundamentals(features: DataFrame, sources: Sequence[str] = GENERATION) -> DataFrame:
    """Load and the selected generation in GW, forecast and two days earlier."""
    kinds = {"forecast": "forecast_delivery_d_minus_1_mw", "prior": "actual_d_minus_2_mw"}
    columns = []
    for name, tail in kinds.items():
        columns.append((F.col(f"load_{tail}") / 1000.0).alias(f"load_{name}_gw"))
        total = F.col(f"{sources[0]}_{tail}")
        for source in sources[1:]:
            total = total + F.col(f"{source}_{tail}")
        columns.append((total / 1000.0).alias(f"generation_{name}_gw"))
    return features.select("delivery_date", "quarter_of_day", *columns)


def table_page(rows: DataFrame, page: int, order: Sequence[str] = ("quarter_of_day",)) -> DataFrame:
    """One page of a day's rows."""
    return rows.orderBy(*order).offset(page * PAGE_ROWS).limit(PAGE_ROWS)
