"""Calendar columns, day spines and public holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import local_start, season, weekday
from quartergrid.market import QUARTERS


def calendar_columns(frame: DataFrame) -> DataFrame:
    """Add calendar fields; all follow from the day and quarter, so no join is needed."""
    day, quarter = F.col("delivery_date"), F.col("quarter_of_day")
    return frame.withColumns(
        {
            "delivery_start_local": local_start(day, quarter),
            "hour": F.floor(quarter / 4).cast("int"),
            "quarter": (quarter % 4).cast("int"),
            "day_of_week": weekday(day),
            "month": F.month(day),
            "is_weekend": weekday(day) >= 5,
            "season": season(F.month(day)),
        }
    )


def days_between(bounds: DataFrame, start: str, end: str, name: str = "delivery_date") -> DataFrame:
    """Explode each row into the days of its inclusive range."""
    return bounds.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end))))


def calendar_spine(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """All quarters of all days in each range, with calendar fields."""
    days = days_between(bounds, start, end).drop(start, end)
    quarters = F.sequence(F.lit(0), F.lit(QUARTERS - 1))
    return calendar_columns(days.withColumn("quarter_of_day", F.explode(quarters)))


def reversed_ranges(holidays: DataFrame) -> DataFrame:
    return holidays.where(F.col("start_date") > F.col("end_date"))


def holiday_dates(holidays: DataFrame) -> DataFrame:
    """Holiday ranges to one row per covered date with a flag per country.

    ``holidays`` has ``country``, ``start_date``, ``end_date`` and ``nationwide``.
    German holidays count only when nationwide. A reversed range is an error.
    """
    valid_end = F.when(
        F.col("start_date") > F.col("end_date"),
        F.raise_error(F.lit("holiday range ends before it starts")).cast("date"),
    ).otherwise(F.col("end_date"))
    counted = holidays.where((F.col("country") != "DE") | F.col("nationwide"))
    dates = counted.select(
        "country", F.explode(F.sequence(F.col("start_date"), valid_end)).alias("delivery_date")
    )
    return dates.groupBy("delivery_date").agg(
        _any(F.col("country") == "DE").alias("is_holiday_de_nationwide"),
        _any(F.col("country") == "LU").alias("is_holiday_lu"),
    )


def _any(condition: Column) -> Column:
    return F.bool_or(condition)


def holiday_calendar(bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """Both flags for every date of the whole years that a range touches.

    The result has one row per calendar date, at most 366 per year.
    """
    years = bounds.select(
        F.trunc("start", "year").alias("_from"),
        F.date_add(F.add_months(F.trunc("end", "year"), 12), -1).alias("_to"),
    )
    days = days_between(years, "_from", "_to").select("delivery_date").distinct()
    flags = ("is_holiday_de_nationwide", "is_holiday_lu")
    return days.join(holiday_dates(holidays), "delivery_date", "left").select(
        "delivery_date", *(F.coalesce(F.col(flag), F.lit(False)).alias(flag) for flag in flags)
    )


def uncovered_years(bounds: DataFrame, stored: DataFrame) -> DataFrame:
    """Ranges of whole years of which some requested date is not stored; neighbours form one range.

    ``bounds`` has inclusive ``start`` and ``end`` dates, ``stored`` a ``delivery_date``. The
    window sees one row per year.
    """
    days = days_between(bounds.select("start", "end"), "start", "end").select("delivery_date").distinct()
    missing = days.join(stored.select("delivery_date"), "delivery_date", "left_anti")
    years = missing.select(F.year("delivery_date").alias("year")).distinct()
    island = F.col("year") - F.row_number().over(Window.orderBy("year"))
    return (
        years.withColumn("_island", island)
        .groupBy("_island")
        .agg(
            F.make_date(F.min("year"), F.lit(1), F.lit(1)).alias("start"),
            F.make_date(F.max("year"), F.lit(12), F.lit(31)).alias("end"),
        )
        .drop("_island")
    )
