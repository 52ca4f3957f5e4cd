"""Physical intervals of 23 to 25 hour days onto 96 wall-clock quarters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.functions.numbers import circular_degrees, resultant
from quartergrid.functions.timegrid import quarter_of_day
from quartergrid.market import AUTUMN_96_SERIES, QUARTERS

UNDEFINED_DIRECTION = 1e-12


@dataclass(frozen=True)
class FillPolicy:
    """Which series are hourly, which hold an angle, and which may start late."""

    hourly: Callable[[Column], Column]
    angular: Callable[[Column], Column]
    late_start: Callable[[Column], Column]

    def step_seconds(self, series: Column) -> Column:
        return F.when(self.hourly(series), 3600).otherwise(900)


MARKET_POLICY = FillPolicy(
    hourly=lambda series: series.startswith("weather."),
    angular=lambda series: series.endswith(".wind_direction_100m"),
    late_start=lambda series: series.isin(*AUTUMN_96_SERIES),
)


def quarter_values(
    measurements: DataFrame,
    *,
    entity: Sequence[str] = (),
    policy: FillPolicy = MARKET_POLICY,
    on_gap: str = "error",
) -> DataFrame:
    """One value per local quarter; a repeated autumn quarter becomes a mean.

    Angles use the circular mean, and only where a quarter really repeats. Opposite
    angles have none: that is an error, or NULL with ``on_gap="null"``. A quarter without
    a value stays as NULL, so that its day is not lost. The aggregation combines on the
    map side, so a hot series or day is reduced to at most 96 rows per task before it is
    shuffled.
    """
    series = F.col("series")
    angular = policy.angular(series)
    value = F.col("value")
    grouped = (
        measurements.withColumn("quarter_of_day", quarter_of_day(F.col("delivery_start_utc")))
        .groupBy(*entity, "delivery_date", "series", "quarter_of_day")
        .agg(
            F.avg(value).alias("_mean"),
            F.avg(F.when(angular, F.sin(F.radians(value)))).alias("_sin"),
            F.avg(F.when(angular, F.cos(F.radians(value)))).alias("_cos"),
            F.count(value).alias("_copies"),
        )
    )
    repeated_angle = angular & (F.col("_copies") > 1)
    undefined = F.lit(None).cast("double")
    if on_gap == "error":
        message = "repeated angles have an undefined circular mean"
        undefined = F.raise_error(F.lit(message)).cast("double")
    direction = F.when(
        resultant(F.col("_sin"), F.col("_cos")) < UNDEFINED_DIRECTION, undefined
    ).otherwise(circular_degrees(F.col("_sin"), F.col("_cos")))
    return grouped.select(
        *entity,
        "delivery_date",
        "series",
        "quarter_of_day",
        F.when(repeated_angle, direction).otherwise(F.col("_mean")).alias("value"),
    )


def fill_quarters(
    quarters: DataFrame,
    *,
    entity: Sequence[str] = (),
    policy: FillPolicy = MARKET_POLICY,
    on_gap: str = "error",
) -> DataFrame:
    """Densify every (day, series) to 96 quarters and fill what is missing.

    Each stored quarter carries its successor from one window, then expands into
    the slots up to that successor. Predecessor and successor are both at hand in
    the expanded row, so no spine, join or second window is needed. A window
    partition holds at most 96 rows because ``quarters`` is unique per quarter.

    A quarter whose value is NULL counts as missing; a day with no other keeps its 96 slots.
    ``on_gap`` is ``"error"`` to fail on a slot that cannot be filled, or ``"null"``.
    """
    if on_gap not in ("error", "null"):
        raise ValueError("on_gap must be 'error' or 'null'")
    key = [*entity, "delivery_date", "series"]
    known = F.col("value").isNotNull()
    # Quarters without a value come last, so one is first only where a day has no value at all.
    day = Window.partitionBy(*key).orderBy(known.desc(), "quarter_of_day")
    linked = quarters.select(
        *key,
        F.col("quarter_of_day").alias("_q"),
        F.col("value").alias("_v"),
        F.lag("quarter_of_day").over(day).isNull().alias("_first"),
        F.lead(F.when(known, F.col("quarter_of_day"))).over(day).alias("_next_q"),
        F.lead("value").over(day).alias("_next_v"),
    ).where(F.col("_v").isNotNull() | F.col("_first"))
    slots = linked.withColumn(
        "quarter_of_day",
        F.explode(
            F.sequence(
                F.when(F.col("_first"), 0).otherwise(F.col("_q")),
                F.coalesce(F.col("_next_q"), F.lit(QUARTERS)) - 1,
            )
        ),
    )
    slot, here, value = F.col("quarter_of_day"), F.col("_q"), F.col("_v")
    stored = F.when(slot == here, value)
    held = F.when(slot > here, value)
    following = F.when(slot < here, value).when(slot > here, F.col("_next_v"))
    ramp = F.when(
        slot > here,
        value + (F.col("_next_v") - value) * (slot - here) / (F.col("_next_q") - here),
    )
    series = F.col("series")
    same_hour = F.floor(slot / 4) == F.floor(here / 4)
    hourly = F.when(policy.angular(series) | same_hour, held).otherwise(ramp)
    filled = (
        F.when(policy.hourly(series), F.coalesce(stored, hourly, following))
        .when(policy.late_start(series), F.coalesce(stored, ramp, following))
        .otherwise(F.coalesce(stored, ramp))
    )
    if on_gap == "error":
        message = F.concat(
            F.lit("quarter cannot be filled: "), F.col("delivery_date").cast("string"),
            F.lit(" "), series,
        )
        filled = F.coalesce(filled, F.raise_error(message).cast("double"))
    return slots.select(
        *entity, "delivery_date", "quarter_of_day", "series", filled.alias("value")
    )


def normalise_quarters(
    measurements: DataFrame,
    *,
    entity: Sequence[str] = (),
    policy: FillPolicy = MARKET_POLICY,
    on_gap: str = "error",
) -> DataFrame:
    """Measurements to exactly 96 filled quarters per (day, series)."""
    values = quarter_values(measurements, entity=entity, policy=policy, on_gap=on_gap)
    return fill_quarters(values, entity=entity, policy=policy, on_gap=on_gap)
