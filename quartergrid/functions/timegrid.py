"""Local-day and quarter-hour expressions. They assume a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartergrid.market import OPERATIONAL_CUTOFF_HOUR, QUARTERS, TIME_ZONE

NAIVE_PATTERN = "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]"
ISO_PATTERNS = (f"{NAIVE_PATTERN}XXX", f"{NAIVE_PATTERN}XX")


def local_time(instant: Column) -> Column:
    return F.from_utc_timestamp(instant, TIME_ZONE)


def local_date(instant: Column) -> Column:
    return F.to_date(local_time(instant))


def day_start(day: Column) -> Column:
    """UTC instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), TIME_ZONE)


def day_end(day: Column) -> Column:
    return day_start(F.date_add(day, 1))


def day_seconds(day: Column) -> Column:
    return F.unix_timestamp(day_end(day)) - F.unix_timestamp(day_start(day))


def quarter_of_day(instant: Column) -> Column:
    """Wall-clock quarter 0..95 of a UTC instant."""
    local = local_time(instant)
    return (F.hour(local) * 4 + F.floor(F.minute(local) / F.lit(15))).cast("int")


def local_start(day: Column, quarter: Column) -> Column:
    """Wall-clock start of a quarter, without a zone."""
    minutes = (quarter * 15).cast("int")
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def local_start_text(day: Column, quarter: Column) -> Column:
    return F.format_string(
        "%sT%02d:%02d:00",
        day.cast("string"),
        F.floor(quarter / 4).cast("int"),
        (quarter % 4 * 15).cast("int"),
    )


def physical_slots(day: Column, step_seconds: Column | int = 900) -> Column:
    """Number of physical intervals in a local day: 92, 96 or 100 quarters."""
    step = F.lit(step_seconds) if isinstance(step_seconds, int) else step_seconds
    return (day_seconds(day) / step).cast("int")


def physical_grid(day: Column, step_seconds: Column | int = 900) -> Column:
    """All physical interval starts of a local day, as UTC instants."""
    step = F.lit(step_seconds) if isinstance(step_seconds, int) else step_seconds
    begin = F.unix_timestamp(day_start(day))
    seconds = F.sequence(begin, begin + day_seconds(day) - step, step.cast("bigint"))
    return F.transform(seconds, lambda second: F.timestamp_seconds(second))


def on_physical_grid(instant: Column, day: Column, step_seconds: Column) -> Column:
    begin = day_start(day)
    offset = F.unix_micros(instant) - F.unix_micros(begin)
    return (
        (instant >= begin)
        & (instant < day_end(day))
        & (F.pmod(offset, step_seconds.cast("bigint") * F.lit(1_000_000)) == 0)
    )


def iso_instant(text: Column) -> Column:
    """ISO-8601 text with an offset as an instant; text without an offset is NULL."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ISO_PATTERNS))


def epoch_millis_local_date(millis: Column) -> Column:
    return local_date(F.timestamp_millis(millis))


def previous_month_end(day: Column) -> Column:
    return F.last_day(F.add_months(day, -1))


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def operational_cutoff(day: Column) -> Column:
    """Noon local time on the day before delivery."""
    noon = F.date_add(day, -1).cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(OPERATIONAL_CUTOFF_HOUR)
    )
    return F.to_utc_timestamp(noon, TIME_ZONE)


def forecast_kind(day: Column, predicted_at: Column) -> Column:
    return F.when(
        predicted_at.cast("timestamp") <= operational_cutoff(day), "operational"
    ).otherwise("retrospective")


def cyclical(quarter: Column, day_of_week: Column, month: Column) -> dict[str, Column]:
    angles = {
        "quarter": quarter / float(QUARTERS),
        "weekday": day_of_week / 7.0,
        "month": (month - 1) / 12.0,
    }
    encoded = {}
    for name, turn in angles.items():
        encoded[f"{name}_sin"] = F.sin(2 * F.pi() * turn)
        encoded[f"{name}_cos"] = F.cos(2 * F.pi() * turn)
    return encoded


def distinct_quarters(quarter: Column) -> Column:
    """Aggregate: number of different quarters 0..95, from two 64-bit masks.

    Unlike a distinct count it needs one shuffle and two numbers per group.
    """
    low = F.when(quarter < 48, _bit(quarter)).otherwise(F.lit(0).cast("bigint"))
    high = F.when(quarter >= 48, _bit(quarter - 48)).otherwise(F.lit(0).cast("bigint"))
    return F.bit_count(F.bit_or(low)) + F.bit_count(F.bit_or(high))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))
