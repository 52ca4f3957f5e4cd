"""Metrics of a predicted correction against the observed one, and its gain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.market import BOOTSTRAP_SAMPLES, MATERIAL_SHIFT
from quartergrid.operators.metrics import mean_absolute, root_mean_square

# Samples of a bootstrap that one task draws from one copy of the gains.
BLOCK = 250


def shift_metrics(
    actual: str, predicted: str, *, material_shift: float = MATERIAL_SHIFT
) -> list[Column]:
    """Aggregates on the size, direction and value of a correction.

    Direction counts non-zero observed shifts, the material metrics those of at
    least ``material_shift``; without any such row they are NULL.
    """
    if material_shift <= 0:
        raise ValueError("material shift must be positive")
    observed, guess = F.col(actual), F.col(predicted)
    error = F.abs(guess - observed)
    material = F.abs(observed) >= material_shift
    agrees = F.signum(guess) == F.signum(observed)
    detected = agrees & (F.abs(guess) >= material_shift)
    return [
        F.avg(error).alias("mae"),
        root_mean_square(guess - observed).alias("rmse"),
        _share(F.when(observed != 0, agrees)).alias("direction_accuracy_pct"),
        F.avg(F.when(material, error)).alias("material_mae"),
        _share(F.when(material, detected)).alias("material_recall_pct"),
        _share(error < F.abs(observed)).alias("beat_exaa_pct"),
        mean_absolute(guess).alias("mean_absolute_correction"),
    ]


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def daily_gains(
    frame: DataFrame, actual: str, predicted: str, *, by: Sequence[str] = ()
) -> DataFrame:
    """Mean absolute error saved per day by applying the correction."""
    observed = F.col(actual)
    gain = F.abs(observed) - F.abs(F.col(predicted) - observed)
    return frame.groupBy(*by, "delivery_date").agg(F.avg(gain).alias("gain"))


def slot_hash(sample: Column, slot: Column, seed: int) -> Column:
    """Uniform 32-bit number per (sample, slot), the same on every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), sample.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def gain_interval(
    gains: DataFrame,
    *,
    by: Sequence[str] = (),
    samples: int = BOOTSTRAP_SAMPLES,
    seed: int = 42,
) -> DataFrame:
    """Mean daily gain with a 95% interval from resampling whole days.

    ``gains`` has one row per day and group, so a group's gains form an array of at
    most 366 numbers per year. Each sample draws as many days as there are, by a hash
    of (sample, slot): the draws need no join and do not depend on partitioning. The
    array travels once per block of samples, and a block returns one mean per sample.
    """
    if samples < 1:
        raise ValueError("samples must be positive")
    ordered = F.array_sort(F.collect_list(F.struct("delivery_date", "gain")))
    groups = gains.groupBy(*by).agg(
        F.transform(ordered, lambda day: day["gain"]).alias("_gains"),
        F.avg("gain").alias("mae_gain"),
    )
    days = F.size("_gains")

    def mean(sample):
        drawn = F.aggregate(
            F.sequence(F.lit(0), days - 1),
            F.lit(0.0),
            lambda total, slot: total
            + F.get(F.col("_gains"), (slot_hash(sample, slot, seed) % days).cast("int")),
        )
        return drawn / days

    first = F.col("_block") * BLOCK
    block = F.sequence(first, F.least(first + BLOCK, F.lit(samples)) - 1)
    means = (
        groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // BLOCK))))
        .repartition(*by, "_block")
        .select(*by, "mae_gain", F.explode(F.transform(block, mean)).alias("_mean"))
    )
    bounds = F.percentile("_mean", F.array(F.lit(0.025), F.lit(0.975)))
    return (
        means.groupBy(*by)
        .agg(F.first("mae_gain").alias("mae_gain"), bounds.alias("_bounds"))
        .select(
            *by,
            "mae_gain",
            F.col("_bounds")[0].alias("mae_gain_ci_low"),
            F.col("_bounds")[1].alias("mae_gain_ci_high"),
        )
    )


def shrinkage_errors(
    frame: DataFrame, correction: str, residual: str, *, steps: int = 101, by: Sequence[str] = ()
) -> DataFrame:
    """Mean absolute error of each correction strength from 0 to 1.

    The error of strength s is the weighted distance of s to residual / correction.
    Rows are summed per interval between neighbouring strengths, and running totals
    over these few intervals give the exact error of every strength. The work per row
    does not depend on the number of strengths.
    """
    if steps < 2:
        raise ValueError("the grid of strengths needs both of its ends")
    last = steps - 1
    c, r = F.col(correction), F.col(residual)
    # Interval k holds ratios in (strength k - 1, strength k]; last + 1 lies above all.
    position = F.least(F.greatest(F.ceil(r / c * last), F.lit(0)), F.lit(last + 1)).cast("int")
    sums = (
        frame.groupBy(*by, F.when(c == 0, 0).otherwise(position).alias("_interval"))
        .agg(
            F.sum(F.abs(c)).alias("_weight"),
            F.sum(F.signum(c) * r).alias("_moment"),
            F.sum(F.when(c == 0, F.abs(r)).otherwise(0.0)).alias("_constant"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    intervals = sums.groupBy(*by).agg(
        F.collect_list(F.struct("_interval", "_weight", "_moment")).alias("_intervals"),
        F.sum("_weight").alias("_weights"),
        F.sum("_moment").alias("_moments"),
        F.sum("_constant").alias("_constants"),
        F.sum("_rows").alias("_count"),
    )
    step = F.col("step")
    below = F.filter("_intervals", lambda item: item["_interval"] <= step)
    weight = F.aggregate(below, F.lit(0.0), lambda total, item: total + item["_weight"])
    moment = F.aggregate(below, F.lit(0.0), lambda total, item: total + item["_moment"])
    strength = step / float(last)
    error = (
        strength * (2 * weight - F.col("_weights"))
        - (2 * moment - F.col("_moments"))
        + F.col("_constants")
    )
    return (
        intervals.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .select(*by, "step", (error / F.col("_count")).alias("mae"))
        .withColumn("shrinkage", strength)
    )


def best_shrinkage(errors: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Strength with the least error; the lowest one wins a tie."""
    return errors.groupBy(*by).agg(
        F.min_by("shrinkage", F.struct("mae", "step")).alias("shrinkage"),
        F.min("mae").alias("mae"),
    )
