"""Data-quality rules as frames of violations, and gates that raise on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.numbers import any_of, non_finite, reasons
from quartergrid.functions.timegrid import (
    day_start,
    distinct_quarters,
    on_physical_grid,
    physical_slots,
)
from quartergrid.market import QUARTERS
from quartergrid.operators.normalise import MARKET_POLICY, FillPolicy
from quartergrid.session import durable


def null_profile(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and NULLs per column, in one pass."""
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns),
    )


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of copies."""
    return (
        frame.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def grid_profile(
    measurements: DataFrame,
    *,
    entity: Sequence[str] = (),
    policy: FillPolicy = MARKET_POLICY,
) -> DataFrame:
    """Per (day, series): how its timestamps compare with the physical grid.

    Counting distinct aligned timestamps replaces collected timestamp sets, so a
    group keeps a few counters however many rows it holds.
    """
    key = [*entity, "delivery_date", "series"]
    step = policy.step_seconds(F.col("series"))
    day = F.col("delivery_date")
    instants = measurements.groupBy(*key, "delivery_start_utc").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.count_if(non_finite(F.col("value"))).alias("_bad"),
    )
    return (
        instants.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("found"),
            F.count_if(on_physical_grid(F.col("delivery_start_utc"), day, step)).alias("aligned"),
            F.min("delivery_start_utc").alias("_first"),
            F.count_if(F.col("_copies") > 1).alias("duplicated"),
            F.sum("_bad").alias("non_finite"),
        )
        .withColumn("expected", physical_slots(day, step))
        .withColumn(
            "late_start_allowed",
            policy.late_start(F.col("series"))
            & (F.col("expected") == 100)
            & (F.col("found") == QUARTERS)
            & (F.col("aligned") == QUARTERS)
            & (F.col("_first") >= day_start(day) + F.expr("INTERVAL 1 HOUR")),
        )
        .drop("_first")
    )


def measurement_violations(
    measurements: DataFrame,
    *,
    entity: Sequence[str] = (),
    policy: FillPolicy = MARKET_POLICY,
) -> DataFrame:
    """All (day, series) groups that may not enter the wide table, with reasons."""
    exact = (F.col("found") == F.col("expected")) & (F.col("aligned") == F.col("expected"))
    found = reasons(
        {
            "non-finite value": F.col("non_finite") > 0,
            "duplicate key": F.col("duplicated") > 0,
            "incomplete or misaligned day": ~exact & ~F.col("late_start_allowed"),
        }
    )
    return (
        grid_profile(measurements, entity=entity, policy=policy)
        .withColumn("reasons", found)
        .where(F.size("reasons") > 0)
    )


def day_profile(
    frame: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    flags: Sequence[str] = (),
    entity: Sequence[str] = (),
) -> DataFrame:
    """Counters behind every wide-table day rule."""
    quarter = F.col("quarter_of_day")
    return frame.groupBy(*entity, "delivery_date").agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_quarters(quarter).alias("quarters"),
        F.min(quarter).alias("first_quarter"),
        F.max(quarter).alias("last_quarter"),
        F.count_if(~non_finite(F.col(target))).alias("targets"),
        F.count_if(any_of([non_finite(F.col(c)) for c in features])).alias("bad_features"),
        F.count_if(
            any_of([F.col(c).isNull() for c in flags]) if flags else F.lit(False)
        ).alias("missing_flags"),
    )


def day_quality(
    frame: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    flags: Sequence[str] = (),
    entity: Sequence[str] = (),
    require_targets: bool = True,
) -> DataFrame:
    """Verdict per day: ``complete``, ``unlabelled``, ``partial`` or ``invalid``."""
    profile = day_profile(frame, features, target, flags=flags, entity=entity)
    full = (
        (F.col("rows") == QUARTERS)
        & (F.col("quarters") == QUARTERS)
        & (F.col("first_quarter") == 0)
        & (F.col("last_quarter") == QUARTERS - 1)
        & (F.col("bad_features") == 0)
        & (F.col("missing_flags") == 0)
    )
    verdict = F.when(~full, "invalid")
    if require_targets:
        verdict = verdict.when(F.col("targets") == 0, "unlabelled").when(
            F.col("targets") < QUARTERS, "partial"
        )
    return profile.withColumn("verdict", verdict.otherwise("complete"))


def training_days(
    frame: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    flags: Sequence[str] = (),
) -> DataFrame:
    """Rows of fully labelled days. Partial or invalid days raise; unlabelled ones drop."""
    # One row per day, kept so that the wide table is profiled only once.
    quality = durable(day_quality(frame, features, target, flags=flags))
    require_none(quality.where(F.col("verdict").isin("partial", "invalid")), "training days")
    days = quality.where(F.col("verdict") == "complete").select("delivery_date")
    return frame.join(days, "delivery_date", "left_semi")


def scoring_days(
    frame: DataFrame, features: Sequence[str], target: str, *, flags: Sequence[str] = ()
) -> DataFrame:
    """Rows of days that can be scored, whether their target is known or not."""
    quality = day_quality(frame, features, target, flags=flags, require_targets=False)
    require_none(quality.where(F.col("verdict") == "invalid"), "scoring days")
    return frame


def snapshot_problems(quality: DataFrame, through) -> DataFrame:
    """Gaps between days, incomplete days and a wrong last day, in one row."""
    days = F.datediff(F.max("delivery_date"), F.min("delivery_date")) + 1
    return quality.agg(
        F.max("delivery_date").alias("last_day"),
        (F.max("delivery_date") == F.lit(through).cast("date")).alias("ends_on_cutoff"),
        (days - F.count_distinct("delivery_date")).cast("bigint").alias("missing_days"),
        F.count_if(F.col("verdict") != "complete").alias("incomplete_days"),
    )


def invalid_intervals(frame: DataFrame, point: str, lower: str, upper: str) -> DataFrame:
    """Rows with non-finite or reversed prediction bounds."""
    bounds = [F.col(c) for c in (point, lower, upper)]
    return frame.where(any_of([non_finite(c) for c in bounds]) | (bounds[1] > bounds[2]))


def require_none(violations: DataFrame, subject: str) -> None:
    """Raise with a few examples when there is any violation."""
    examples = violations.limit(3).collect()
    if examples:
        shown = "; ".join(str(row.asDict()) for row in examples)
        raise ValueError(f"invalid {subject}: {shown}")
