"""Rolling accuracy and drift rules over daily rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.functions.numbers import join_reasons, reasons
from quartergrid.market import DRIFT_REASONS, TARGET_COVERAGE

ROLLING = ("rolling_7d_mae", "rolling_7d_baseline_exaa_mae", "rolling_28d_picp")


def rolling_metrics(history: DataFrame, *, entity: Sequence[str] = ()) -> DataFrame:
    """Means over the last 7 and 28 evaluated days, and how many days there are.

    Counts rows, not calendar days. ``history`` has one row per evaluated day and
    entity, so a window partition grows by at most 366 rows a year.
    """
    days = Window.partitionBy(*entity).orderBy("delivery_date")
    week, month = days.rowsBetween(-6, 0), days.rowsBetween(-27, 0)
    return history.withColumns(
        {
            "rolling_7d_mae": F.avg("mae").over(week),
            "rolling_7d_baseline_exaa_mae": F.avg("baseline_exaa_mae").over(week),
            "rolling_28d_picp": F.avg("picp").over(month),
            "history_days": F.count(F.lit(1)).over(
                days.rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )


def drift_reasons(target_coverage: float = TARGET_COVERAGE) -> Column:
    """Reasons for an alert on a row with rolling metrics and run drift values.

    Performance rules wait for 7 days of history, the coverage rule for 14. A
    missing ``reference_mae`` silences only its own rule.
    """
    days = F.col("history_days")
    mae = F.col("rolling_7d_mae")
    return reasons(
        {
            DRIFT_REASONS["inputs"]: F.col("data_outlier_rate") > 0.2,
            DRIFT_REASONS["output"]: F.abs("prediction_mean_z") > 4,
            DRIFT_REASONS["model"]: (days >= 7) & (mae > 1.5 * F.col("reference_mae")),
            DRIFT_REASONS["reference"]: (days >= 7)
            & (mae > F.col("rolling_7d_baseline_exaa_mae")),
            DRIFT_REASONS["coverage"]: (days >= 14)
            & (F.col("rolling_28d_picp") < target_coverage - 0.1),
        }
    )


def assess_drift(
    history: DataFrame,
    *,
    entity: Sequence[str] = (),
    target_coverage: float = TARGET_COVERAGE,
) -> DataFrame:
    """Add rolling metrics, ``monitoring_status`` and ``monitoring_reasons``."""
    found = rolling_metrics(history, entity=entity).withColumn(
        "_reasons", drift_reasons(target_coverage)
    )
    return found.withColumns(
        {
            "monitoring_status": F.when(F.size("_reasons") > 0, "alert").otherwise("ok"),
            "monitoring_reasons": join_reasons(F.col("_reasons")),
        }
    ).drop("_reasons")


def feature_statistics(features: dict[str, Column]) -> list[Column]:
    """Population mean and scale per feature; a near-constant feature gets scale 1."""
    stats = []
    for name, value in features.items():
        scale = F.stddev_pop(value)
        stats.append(F.avg(value).alias(f"{name}__mean"))
        stats.append(F.when(scale < 1e-6, 1.0).otherwise(scale).alias(f"{name}__scale"))
    return stats


def input_drift(
    frame: DataFrame,
    features: dict[str, Column],
    statistics: dict[str, tuple[Column, Column]],
    by: Sequence[str],
    *,
    point: Column | None = None,
    target_statistics: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Share of cells beyond four deviations, largest mean z, and output mean z.

    Cells are counted across columns of the row and means are kept per column, so
    the frame is never stacked to one row per cell.
    """
    z = {
        name: (value - statistics[name][0]) / statistics[name][1]
        for name, value in features.items()
    }
    outliers = sum((F.abs(score) > 4).cast("int") for score in z.values())
    aggregates = [
        (F.sum(outliers) / (F.count(F.lit(1)) * len(z))).alias("data_outlier_rate"),
        _largest([F.abs(F.avg(score)) for score in z.values()]).alias("max_feature_mean_z"),
    ]
    if point is not None and target_statistics is not None:
        mean, scale = target_statistics
        aggregates.append(F.avg((point - mean) / scale).alias("prediction_mean_z"))
    return frame.groupBy(*by).agg(*aggregates)


def _largest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)
