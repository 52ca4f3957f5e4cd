"""Score all pending days at once and publish forecasts, runs last."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import forecast_kind, local_start
from quartergrid.market import LOWER, MODEL_DATA_VERSION, POINT, UPPER
from quartergrid.operators.quality import invalid_intervals, require_none
from quartergrid.plans.forecaster import ConformalForecaster
from quartergrid.plans.pending import default_start, pending_forecasts
from quartergrid.session import durable
from quartergrid.sources.tables import DayTable


def forecast_frames(
    model: ConformalForecaster,
    rows: DataFrame,
    *,
    version: str,
    predicted_at: Column,
    input_version: int,
) -> tuple[DataFrame, DataFrame]:
    """Forecast rows and one run row per day for fully prepared input rows."""
    predicted = durable(model.predict(rows))
    require_none(invalid_intervals(predicted, POINT, LOWER, UPPER), "forecasts")
    day = F.col("delivery_date")
    stamp = {
        "model_version": F.lit(version),
        "predicted_at": predicted_at,
        "forecast_kind": forecast_kind(day, predicted_at),
    }
    forecasts = predicted.select(
        "delivery_date",
        local_start(day, F.col("quarter_of_day")).alias("delivery_start_local"),
        "quarter_of_day",
        POINT,
        LOWER,
        UPPER,
        F.lit(model.coverage).alias("nominal_coverage"),
        *(value.alias(name) for name, value in stamp.items()),
    )
    drift = model.drift(predicted, ["delivery_date"])
    runs = drift.select(
        "delivery_date",
        *(value.alias(name) for name, value in stamp.items()),
        F.lit(MODEL_DATA_VERSION).alias("model_data_version"),
        F.lit(input_version).cast("bigint").alias("gold_table_version"),
        "data_outlier_rate",
        "max_feature_mean_z",
        "prediction_mean_z",
    )
    return forecasts, runs


def publish_pending(
    model: ConformalForecaster,
    inputs: DataFrame,
    forecast_table: DayTable,
    run_table: DayTable,
    *,
    version: str,
    predicted_at: Column,
    input_version: int,
    end: date | Column,
    start: date | Column | None = None,
    registered_at_millis: Column | None = None,
    prepare=lambda rows: rows,
    keys: Sequence[str] = ("delivery_date", "quarter_of_day"),
) -> int:
    """Publish every ready day without a run. Run rows mark a day as published.

    Without ``start`` nothing before the first published day is published, or before the
    day on which the model was registered if none is.
    """
    run_table.create()
    published = run_table.read()
    if start is None:
        registered = F.lit(None).cast("bigint") if registered_at_millis is None else registered_at_millis
        start = default_start(published, registered).first()["start"]
    days = pending_forecasts(inputs, published, start=start, end=end)
    rows = prepare(inputs.join(days, "delivery_date", "left_semi"))
    if rows.isEmpty():
        return 0
    forecasts, runs = forecast_frames(
        model, rows, version=version, predicted_at=predicted_at, input_version=input_version
    )
    forecast_table.merge(forecasts, keys)
    run_table.merge(runs, ("delivery_date",))
    return runs.count()
