"""Chronological day splits, sample weights and encoded features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import cyclical
from quartergrid.market import (
    BOOLEAN_FEATURES,
    CYCLICAL_FEATURES,
    FEATURE_NAMES,
    MATERIAL_WEIGHT,
    NUMERIC_FEATURES,
)


def day_index(frame: DataFrame, *, entity: Sequence[str] = ()) -> DataFrame:
    """Distinct days with their position and the total number of days.

    The windows run on distinct calendar dates, at most 366 rows a year.
    """
    days = frame.select(*entity, "delivery_date").distinct()
    order = Window.partitionBy(*entity).orderBy("delivery_date")
    return days.withColumns(
        {
            "day_index": F.row_number().over(order) - 1,
            "days": F.count(F.lit(1)).over(Window.partitionBy(*entity)).cast("int"),
        }
    )


def temporal_roles(
    days: DataFrame,
    *,
    validation_days: int = 28,
    test_days: int = 28,
    minimum_train_days: int = 120,
) -> DataFrame:
    """Train, validation and test by day order."""
    if min(validation_days, test_days, minimum_train_days) < 1:
        raise ValueError("split sizes must be positive")
    total = _enough("days", minimum_train_days + validation_days + test_days)
    test_start = total - test_days
    return days.withColumn(
        "role",
        F.when(F.col("day_index") >= test_start, "test")
        .when(F.col("day_index") >= test_start - validation_days, "validation")
        .otherwise("train"),
    )


def walk_forward_roles(
    days: DataFrame,
    *,
    folds: int = 3,
    validation_days: int = 28,
    test_days: int = 28,
    minimum_train_days: int = 120,
) -> DataFrame:
    """Expanding folds and one final test, one row per (fold, day) that takes part.

    Fold ``folds`` is the final one: everything before the test trains, and the
    last ``test_days`` days are its test. Only day rows are copied per fold.
    """
    if min(folds, validation_days, test_days, minimum_train_days) < 1:
        raise ValueError("split sizes must be positive")
    total = _enough("days", minimum_train_days + folds * validation_days + test_days)
    index, fold = F.col("day_index"), F.col("fold")
    first = total - test_days - folds * validation_days
    start = first + fold * validation_days
    final = fold == folds
    role = (
        F.when(index < start, "train")
        .when(final, "test")
        .when(index < start + validation_days, "validation")
    )
    return (
        days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds))))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
    )


def _enough(column: str, required: int) -> Column:
    message = f"split needs at least {required} complete days"
    return F.when(
        F.col(column) < required, F.raise_error(F.lit(message)).cast("int")
    ).otherwise(F.col(column))


def consecutive_days(days: DataFrame) -> DataFrame:
    """Days with the distance to the previous one; anything above 1 is a gap."""
    order = Window.orderBy("delivery_date")
    previous = F.lag("delivery_date").over(order)
    return days.withColumn("step_days", F.datediff("delivery_date", previous))


def sample_weights(
    spread: Column, *, threshold: float, material_weight: float = MATERIAL_WEIGHT
) -> Column:
    if threshold <= 0 or material_weight < 1:
        raise ValueError("threshold must be positive and weight at least one")
    return F.when(F.abs(spread) >= threshold, float(material_weight)).otherwise(1.0)


def spread(target: str, reference: str) -> Column:
    return F.col(target) - F.col(reference)


def encoded_features(
    frame: DataFrame,
    *,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    flags: Sequence[str] = BOOLEAN_FEATURES,
) -> DataFrame:
    """Add cyclical columns and turn flags into 0/1. The feature order is fixed."""
    encoded = cyclical(F.col("quarter_of_day"), F.col("day_of_week"), F.col("month"))
    return frame.withColumns(
        {
            **{c: F.col(c).cast("double") for c in numeric},
            **{c: F.col(c).cast("double") for c in flags},
            **encoded,
        }
    )


def feature_order(
    numeric: Sequence[str] = NUMERIC_FEATURES, flags: Sequence[str] = BOOLEAN_FEATURES
) -> tuple[str, ...]:
    if numeric is NUMERIC_FEATURES and flags is BOOLEAN_FEATURES:
        return FEATURE_NAMES
    return (*numeric, *flags, *CYCLICAL_FEATURES)


def day_arrays(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per day with each column as an array in quarter order (96 long)."""
    row = F.struct("quarter_of_day", *columns)
    grouped = frame.groupBy("delivery_date").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return grouped.select("delivery_date", *(F.col(f"_rows.{c}").alias(c) for c in columns))
