"""Forecasts against settled prices, on the physical and on the 96-quarter grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.numbers import any_of, reasons
from quartergrid.functions.timegrid import (
    distinct_quarters,
    forecast_kind,
    physical_slots,
    quarter_of_day,
)
from quartergrid.market import (
    LAG_7D,
    LOWER,
    POINT,
    QUARTERS,
    REFERENCE,
    TARGET,
    TARGET_COVERAGE,
    UPPER,
)
from quartergrid.operators.metrics import DAILY_METRICS, market_metrics
from quartergrid.operators.monitoring import ROLLING, assess_drift
from quartergrid.plans.refresh import months_of
from quartergrid.session import durable
from quartergrid.sources.tables import DayTable

TARGET_PRICE = "de_lu.price.sdac"
REFERENCE_PRICE = "de_lu.price.exaa"
RUN_COLUMNS = ("model_version", "predicted_at", "forecast_kind")


def forecast_rows(
    forecasts: DataFrame, wide: DataFrame, *, entity: Sequence[str] = ()
) -> DataFrame:
    """Forecasts with the settled price and references of the same quarter."""
    key = [*entity, "delivery_date", "quarter_of_day"]
    return forecasts.select(*key, *RUN_COLUMNS, POINT, LOWER, UPPER).join(
        wide.select(*key, TARGET, REFERENCE, LAG_7D), key
    )


def published_quality(rows: DataFrame, *, entity: Sequence[str] = ()) -> DataFrame:
    """State of each joined day: ``waiting``, ``invalid`` with reasons, or ``ready``."""
    values = (*RUN_COLUMNS, POINT, LOWER, UPPER, TARGET, REFERENCE, LAG_7D)
    days = rows.groupBy(*entity, "delivery_date").agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_quarters(F.col("quarter_of_day")).alias("quarters"),
        F.count_if(any_of([F.col(c).isNull() for c in values])).alias("nulls"),
        *(F.min(c).alias(c) for c in RUN_COLUMNS),
        *(F.max(c).alias(f"_last_{c}") for c in RUN_COLUMNS),
    )
    differs = {c: F.col(c) != F.col(f"_last_{c}") for c in RUN_COLUMNS}
    problems = reasons(
        {
            "invalid quarter grid": (F.col("rows") != QUARTERS)
            | (F.col("quarters") != QUARTERS),
            "multiple model versions": differs["model_version"],
            "multiple prediction times": differs["predicted_at"],
            "invalid forecast kind": differs["forecast_kind"]
            | ~F.col("forecast_kind").isin("operational", "retrospective"),
            "kind conflicts with creation time": F.col("forecast_kind")
            != forecast_kind(F.col("delivery_date"), F.col("predicted_at")),
        }
    )
    waiting = (F.col("rows") < QUARTERS) | (F.col("nulls") > 0)
    return (
        days.withColumn("problems", F.when(waiting, F.array().cast("array<string>")).otherwise(problems))
        .withColumn(
            "state",
            F.when(waiting, "waiting").when(F.size("problems") > 0, "invalid").otherwise("ready"),
        )
        .drop(*(f"_last_{c}" for c in RUN_COLUMNS))
    )


def physical_rows(
    measurements: DataFrame,
    rows: DataFrame,
    *,
    entity: Sequence[str] = (),
    target_series: str = TARGET_PRICE,
    reference_series: str = REFERENCE_PRICE,
) -> DataFrame:
    """Physical price intervals with the forecast of their wall-clock quarter.

    Both prices come from one conditional aggregation. A repeated autumn quarter
    meets its forecast twice.
    """
    key = [*entity, "delivery_date"]
    series = F.col("series")
    prices = (
        measurements.where(series.isin(target_series, reference_series))
        .groupBy(*key, "delivery_start_utc")
        .agg(
            F.max(F.when(series == target_series, F.col("value"))).alias(TARGET),
            F.max(F.when(series == reference_series, F.col("value"))).alias(REFERENCE),
        )
        .where(F.col(TARGET).isNotNull() & F.col(REFERENCE).isNotNull())
        .withColumn("quarter_of_day", quarter_of_day(F.col("delivery_start_utc")))
    )
    return prices.join(
        rows.select(*key, "quarter_of_day", LAG_7D, POINT, LOWER, UPPER),
        [*key, "quarter_of_day"],
    )


def grid_metrics(
    physical: DataFrame,
    rows: DataFrame,
    *,
    entity: Sequence[str] = (),
    coverage: float = TARGET_COVERAGE,
) -> DataFrame:
    """Daily metrics on both grids; those of the 96-quarter grid are prefixed."""
    key = [*entity, "delivery_date"]
    normalised = rows.groupBy(*key).agg(*market_metrics(coverage))
    normalised = normalised.withColumnsRenamed({c: f"normalized_96_{c}" for c in DAILY_METRICS})
    counted = physical.groupBy(*key).agg(
        *market_metrics(coverage), F.count(F.lit(1)).alias("physical_rows")
    )
    return counted.join(normalised, key).withColumn(
        "expected_rows", physical_slots(F.col("delivery_date"))
    )


def evaluate_days(
    days: DataFrame,
    forecasts: DataFrame,
    wide: DataFrame,
    measurements: DataFrame,
    runs: DataFrame,
    model_mae: DataFrame,
    history: DataFrame,
    *,
    entity: Sequence[str] = (),
    coverage: float = TARGET_COVERAGE,
) -> DataFrame:
    """One metric row per requested day, monitoring included.

    ``runs`` supplies drift values per day, ``model_mae`` the test MAE per model
    version as ``reference_mae``, and ``history`` earlier metric rows. All days are
    evaluated at once, so the rolling values do not depend on an order of runs. An
    inconsistent day stops the evaluation. Rows of other days are left before any
    aggregation or join.
    """
    key = [*entity, "delivery_date"]
    asked = days.select(*key)
    forecasts, wide, measurements = (
        frame.join(asked, key, "left_semi") for frame in (forecasts, wide, measurements)
    )
    rows = forecast_rows(forecasts, wide, entity=entity)
    quality = published_quality(rows, entity=entity).where(F.col("state") != "waiting")
    ready = quality.select(
        *key,
        F.when(F.col("state") == "ready", F.col("model_version"))
        .otherwise(_stop("inconsistent forecast", F.array_join("problems", ", ")))
        .alias("model_version"),
        "forecast_kind",
    )
    usable = rows.join(ready.select(*key), key, "left_semi")
    physical = physical_rows(measurements, usable, entity=entity)
    metrics = grid_metrics(physical, usable, entity=entity, coverage=coverage)
    complete = F.col("physical_rows") == F.col("expected_rows")
    fresh = (
        ready.join(metrics, key, "left")
        .withColumn(
            "mae",
            F.when(complete, F.col("mae")).otherwise(
                _stop("incomplete physical day", F.col("delivery_date").cast("string")).cast("double")
            ),
        )
        .drop("physical_rows", "expected_rows")
    )
    monitored = _monitoring(fresh, runs, model_mae, history, entity, coverage)
    return fresh.join(monitored, key, "left").withColumns(
        {
            "monitoring_status": F.coalesce("monitoring_status", F.lit("not_applicable")),
            "monitoring_reasons": F.coalesce("monitoring_reasons", F.lit("")),
            "evaluated_at": F.current_timestamp(),
        }
    )


def evaluate_stored(
    days: DataFrame,
    forecasts: DayTable,
    wide: DayTable,
    measured: DayTable,
    runs: DataFrame,
    model_mae: DataFrame,
    metrics: DayTable,
    **options,
) -> DataFrame:
    """Evaluate days of stored tables and merge the metric rows; returns these.

    Only the months of the requested days are read from the three large tables. The metric
    table has one row per day and gives the rolling values their history.
    """
    months = months_of(days)
    found = durable(
        evaluate_days(
            days,
            *(table.read(months=months) for table in (forecasts, wide, measured)),
            runs,
            model_mae,
            metrics.read(),
            **options,
        )
    )
    metrics.merge(found, [*options.get("entity", ()), "delivery_date"])
    return found


def _monitoring(fresh, runs, model_mae, history, entity, coverage) -> DataFrame:
    """Rolling values and drift over operational days, old and new together."""
    key = [*entity, "delivery_date"]
    columns = [*key, "model_version", "mae", "baseline_exaa_mae", "picp"]
    operational = F.col("forecast_kind") == "operational"
    kept = history.where(operational).join(fresh.select(*key), key, "left_anti")
    series = (
        kept.select(*columns)
        .withColumn("_fresh", F.lit(False))
        .unionByName(fresh.where(operational).select(*columns).withColumn("_fresh", F.lit(True)))
    )
    run_values = runs.select(*key, "data_outlier_rate", "prediction_mean_z", F.lit(True).alias("_run"))
    drift = series.join(run_values, key, "left").join(
        model_mae.select("model_version", "reference_mae"), "model_version", "left"
    )
    missing = F.col("_fresh") & F.col("_run").isNull()
    drift = drift.withColumn(
        "mae",
        F.when(missing, _stop("no run row", F.col("delivery_date").cast("string")).cast("double"))
        .otherwise(F.col("mae")),
    ).drop("_run")
    assessed = assess_drift(drift, entity=entity, target_coverage=coverage)
    return assessed.where("_fresh").select(
        *key, *ROLLING, "monitoring_status", "monitoring_reasons"
    )


def _stop(message: str, detail):
    return F.raise_error(F.concat(F.lit(f"{message}: "), detail))
