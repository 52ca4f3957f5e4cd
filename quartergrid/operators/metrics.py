"""Point and interval forecast metrics as aggregates over any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.numbers import any_of, non_finite
from quartergrid.market import LAG_7D, LOWER, POINT, REFERENCE, TARGET, TARGET_COVERAGE, UPPER

FORECAST_METRICS = ("mae", "rmse", "picp", "mpiw", "interval_score")
BASELINE_METRICS = ("bias", "baseline_exaa_mae", "baseline_7d_mae")
DAILY_METRICS = FORECAST_METRICS + BASELINE_METRICS


def mean_absolute(difference: Column) -> Column:
    return F.avg(F.abs(difference))


def root_mean_square(difference: Column) -> Column:
    return F.sqrt(F.avg(difference * difference))


def interval_score(actual: Column, lower: Column, upper: Column, coverage: float) -> Column:
    """Width plus a penalty of 2/alpha per unit outside the interval."""
    penalty = 2 / (1 - coverage)
    below = F.when(actual < lower, penalty * (lower - actual)).otherwise(0.0)
    above = F.when(actual > upper, penalty * (actual - upper)).otherwise(0.0)
    return upper - lower + below + above


def forecast_metrics(
    target: str, point: str, lower: str, upper: str, *, coverage: float = TARGET_COVERAGE
) -> list[Column]:
    """The five forecast aggregates, for use in one ``agg``.

    Rows with a missing or non-finite value, or with reversed bounds, stop the job: they
    would enter some of the averages only.
    """
    if not 0 < coverage < 1:
        raise ValueError("coverage must be between 0 and 1")
    actual, predicted, low, high = (F.col(c) for c in (target, point, lower, upper))
    faulty = any_of([non_finite(c) for c in (actual, predicted, low, high)]) | (low > high)
    actual = F.when(
        faulty, F.raise_error(F.lit("metrics need finite values and ordered bounds")).cast("double")
    ).otherwise(actual)
    inside = ((actual >= low) & (actual <= high)).cast("double")
    return [
        mean_absolute(predicted - actual).alias("mae"),
        root_mean_square(predicted - actual).alias("rmse"),
        F.avg(inside).alias("picp"),
        F.avg(high - low).alias("mpiw"),
        F.avg(interval_score(actual, low, high, coverage)).alias("interval_score"),
    ]


def baseline_metrics(target: str, point: str, reference: str, lag: str) -> list[Column]:
    actual = F.col(target)
    return [
        F.avg(F.col(point) - actual).alias("bias"),
        mean_absolute(F.col(reference) - actual).alias("baseline_exaa_mae"),
        mean_absolute(F.col(lag) - actual).alias("baseline_7d_mae"),
    ]


def market_metrics(coverage: float = TARGET_COVERAGE) -> list[Column]:
    """All daily metrics on the stored column names."""
    return [
        *forecast_metrics(TARGET, POINT, LOWER, UPPER, coverage=coverage),
        *baseline_metrics(TARGET, POINT, REFERENCE, LAG_7D),
    ]


def metrics_by(frame: DataFrame, by: Sequence[str], coverage: float = TARGET_COVERAGE) -> DataFrame:
    return frame.groupBy(*by).agg(*market_metrics(coverage))
