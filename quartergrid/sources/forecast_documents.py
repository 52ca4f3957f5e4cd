"""JSON hourly weather runs: one payload per (run day, cell) to next-day values.

As with curves, each payload is checked and expanded inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import NAIVE_PATTERN, iso_instant, local_date
from quartergrid.market import (
    WEATHER_FALLBACK_MODEL,
    WEATHER_FIELDS,
    WEATHER_LOCATIONS,
    WEATHER_MODEL,
)
from quartergrid.sources.curve_documents import INCOMPLETE, status_of

HOURS = 48
COORDINATE_TOLERANCE = 0.25
TEMPERATURE = "temperature_2m"
RADIATION = "shortwave_radiation"


def _names(field: str) -> tuple[str, str, str]:
    return field, f"{field}_{WEATHER_MODEL}", f"{field}_{WEATHER_FALLBACK_MODEL}"


# A suffixed list may be missing, and then another one counts, or present as NULL, and then
# the document is wrong. VARIANT keeps the two apart.
_HOURLY = ", ".join(
    f"{plain}: ARRAY<DOUBLE>, {first}: VARIANT, {second}: VARIANT"
    for plain, first, second in (_names(field) for field, _, _ in WEATHER_FIELDS)
)
_NUMBER_LIST = r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)|VOID)>$"
_LOCATION = (
    "STRUCT<latitude: STRING, longitude: STRING, timezone: STRING, "
    "utc_offset_seconds: DOUBLE, hourly_units: MAP<STRING, STRING>, "
    f"hourly: STRUCT<time: ARRAY<STRING>, {_HOURLY}>>"
)
DOCUMENT_SCHEMA = (
    f"primary ARRAY<{_LOCATION}>, temperature_fallback ARRAY<{_LOCATION}>, "
    "_corrupt_record STRING"
)


def parse_weather(raw: DataFrame, payload: Column | None = None) -> DataFrame:
    """Add ``intervals`` (series, start, value, unit), ``status`` and ``reason``.

    ``delivery_date`` of the input is the run day; values are for the day after it.
    """
    text = F.trim(F.col("payload") if payload is None else payload)
    wrapped = F.when(text.startswith("["), F.concat(F.lit('{"primary":'), text, F.lit("}")))
    decoded = F.from_json(
        wrapped.otherwise(text),
        DOCUMENT_SCHEMA,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    cell = F.element_at(F.split("series", r"\."), -1)
    expected = F.when(cell == "land", _locations("land")).when(cell == "sea", _locations("sea"))
    frame = (
        raw.withColumn("_doc", decoded)
        .withColumn("_expected", expected)
        .withColumn("_run", F.unix_timestamp(F.col("delivery_date").cast("timestamp")))
    )
    located = frame.withColumn(
        "_located",
        F.when(
            F.size("_doc.primary") == F.size("_expected"),
            F.transform("_expected", _location_row),
        ),
    )
    checked = located.withColumn("_found", F.transform("_located", _location_reason))
    return (
        checked.withColumn("reason", _reason())
        .withColumn("status", status_of(F.col("reason")))
        .withColumn(
            "intervals",
            F.when(
                F.col("reason").isNull(), F.flatten(F.transform("_located", _location_values))
            ),
        )
        .drop("_doc", "_expected", "_run", "_located", "_found")
    )


def missing_temperatures(raw: DataFrame) -> DataFrame:
    """Number of missing primary temperatures per payload; above 0 a fallback is needed."""
    schema = f"ARRAY<{_LOCATION}>"
    locations = F.from_json(F.trim("payload"), schema)
    nulls = F.transform(
        locations,
        lambda place: F.size(F.filter(place["hourly"][TEMPERATURE], lambda v: v.isNull())),
    )
    return raw.withColumn(
        "missing_temperatures", F.aggregate(nulls, F.lit(0), lambda total, n: total + n)
    )


def _locations(cell: str) -> Column:
    places = ", ".join(
        f"struct('{name}' AS name, {latitude}D AS latitude, {longitude}D AS longitude)"
        for name, latitude, longitude, at in WEATHER_LOCATIONS
        if at == cell
    )
    return F.expr(f"array({places})")


def _location_row(expected: Column, i: Column) -> Column:
    place = F.get(F.col("_doc.primary"), i)
    spare = F.get(F.col("_doc.temperature_fallback"), i)
    fields = F.array(
        *(_field(place, spare["hourly"][TEMPERATURE], *field) for field in WEATHER_FIELDS)
    )
    return F.struct(
        expected["name"].alias("name"),
        _place_reason(place, expected).alias("place_reason"),
        F.when(spare.isNotNull(), _spare_reason(spare, expected)).alias("spare_reason"),
        F.transform(fields, _checked_field).alias("fields"),
    )


def _field(place: Column, spare: Column, field: str, _column: str, unit: str) -> Column:
    """One field as published: its values, their unit, and what may replace NULLs."""
    plain, primary_name, fallback_name = _names(field)
    hourly, units = place["hourly"], place["hourly_units"]
    suffixed, inline = hourly[primary_name], hourly[fallback_name]
    inline_used = inline.isNotNull() & ~F.is_variant_null(inline)
    # What is no list of numbers counts as one of the wrong length.
    no_list = F.array().cast("array<double>")
    fallback = F.when(inline_used, F.coalesce(_numbers(inline), no_list))
    if field == TEMPERATURE:
        fallback, inline_used = F.coalesce(spare, fallback), inline_used & spare.isNull()
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(unit).alias("unit"),
        F.lit(3600 if field == RADIATION else 0).alias("back"),
        F.when(suffixed.isNotNull(), _numbers(suffixed)).otherwise(hourly[plain]).alias("primary"),
        F.when(suffixed.isNotNull(), units[primary_name])
        .otherwise(units[plain])
        .alias("primary_unit"),
        fallback.alias("fallback"),
        F.when(inline_used, F.coalesce(units[fallback_name], F.lit(""))).alias("fallback_unit"),
    )


def _numbers(found: Column) -> Column:
    """A list of numbers and NULLs, or NULL where anything else is found."""
    listed = F.schema_of_variant(found).rlike(_NUMBER_LIST)
    return F.when(listed, F.try_variant_get(found, "$", "array<double>"))


def _checked_field(item: Column) -> Column:
    """Values after repair, with the first problem of the lists or of a value."""
    field, unit, fallback = item["field"], item["unit"], item["fallback"]
    repaired = F.transform(item["primary"], lambda value, i: _repair(field, value, fallback, i))
    listing = (
        F.when(~F.size(item["primary"]).eqNullSafe(F.lit(HOURS)), "values are not 48 in")
        .when(~item["primary_unit"].eqNullSafe(unit), "unexpected unit of")
        .when(F.size(fallback) != HOURS, "fallback values are not 48 in")
        .when(item["fallback_unit"] != unit, "unexpected fallback unit of")
    )
    values = F.filter(F.transform(repaired, _value_reason), lambda reason: reason.isNotNull())
    problem = F.coalesce(listing, F.get(values, F.lit(0)))
    return F.struct(
        field.alias("field"),
        unit.alias("unit"),
        item["back"].alias("back"),
        F.concat_ws(" ", problem, F.when(problem.isNotNull(), field)).alias("reason"),
        repaired.alias("values"),
    )


def _repair(field: Column, value: Column, fallback: Column, i: Column) -> Column:
    return F.coalesce(
        value,
        F.when(field == TEMPERATURE, F.get(fallback, i)),
        F.when((field == RADIATION) & (i == 0), 0.0),
    )


def _value_reason(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(INCOMPLETE + "unpublished")).when(
        F.isnan(value) | (F.abs(value) == float("inf")), F.lit("non-finite")
    )


def _place_reason(place: Column, expected: Column) -> Column:
    times = place["hourly"]["time"]
    instants = F.transform(times, _instant)
    # Coordinates may be published as numbers or as numeric text.
    latitude = place["latitude"].try_cast("double")
    longitude = place["longitude"].try_cast("double")
    run = F.col("_run")
    wanted = F.transform(
        F.sequence(run, run + (HOURS - 1) * 3600, F.lit(3600).cast("bigint")),
        lambda second: F.timestamp_seconds(second),
    )
    return (
        F.when(place.isNull(), "location is not an object")
        .when(
            ~place["timezone"].eqNullSafe(F.lit("GMT"))
            | ~place["utc_offset_seconds"].eqNullSafe(F.lit(0.0)),
            "timestamps are not GMT",
        )
        .when(place["hourly"].isNull() | place["hourly_units"].isNull(), "no hourly values")
        .when(~place["hourly_units"]["time"].eqNullSafe(F.lit("iso8601")), "times are not ISO 8601")
        .when(latitude.isNull() | longitude.isNull(), "no coordinates")
        .when(
            (F.abs(latitude - expected["latitude"]) > COORDINATE_TOLERANCE)
            | (F.abs(longitude - expected["longitude"]) > COORDINATE_TOLERANCE),
            "location order changed",
        )
        .when(times.isNull(), "no timestamps")
        .when(F.size(times) != HOURS, F.lit(INCOMPLETE + "not all 48 hours are published"))
        .when(~instants.eqNullSafe(wanted), "hours are not the 48 consecutive run hours")
    )


def _instant(text: Column) -> Column:
    naive = F.try_to_timestamp(text, F.lit(NAIVE_PATTERN))
    return F.coalesce(naive, iso_instant(text))


def _spare_reason(spare: Column, expected: Column) -> Column:
    values = spare["hourly"][TEMPERATURE]
    return F.coalesce(
        _place_reason(spare, expected),
        F.when(
            ~F.size(values).eqNullSafe(F.lit(HOURS))
            | ~spare["hourly_units"][TEMPERATURE].eqNullSafe(F.lit("°C")),
            "temperature fallback is not 48 values in °C",
        ),
    )


def _location_reason(row: Column) -> Column:
    fields = F.filter(
        F.transform(row["fields"], lambda field: field["reason"]),
        lambda reason: reason != "",
    )
    return F.coalesce(row["place_reason"], row["spare_reason"], F.get(fields, F.lit(0)))


def _reason() -> Column:
    spare = F.col("_doc.temperature_fallback")
    first = F.get(F.filter("_found", lambda reason: reason.isNotNull()), F.lit(0))
    return (
        F.when(F.col("_expected").isNull(), "unknown cell")
        .when(
            F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull(),
            "unreadable document",
        )
        .when(
            ~F.size("_doc.primary").eqNullSafe(F.size("_expected")), "unexpected location count"
        )
        .when(
            spare.isNotNull() & (F.size(spare) != F.size("_expected")),
            "unexpected fallback location count",
        )
        .otherwise(first)
    )


def _location_values(row: Column) -> Column:
    """Hourly values of one location. A preceding-hour mean belongs one hour earlier,
    and that shift comes before the local delivery day is selected."""
    day = F.date_add("delivery_date", 1)
    run = F.col("_run")
    series = F.transform(
        row["fields"],
        lambda field: F.transform(
            field["values"],
            lambda value, i: F.struct(
                F.concat_ws(".", F.lit("weather"), row["name"], field["field"]).alias("series"),
                F.timestamp_seconds(run + i * 3600 - field["back"]).alias("start"),
                value.alias("value"),
                field["unit"].alias("unit"),
            ),
        ),
    )
    return F.filter(F.flatten(series), lambda item: local_date(item["start"]) == day)
