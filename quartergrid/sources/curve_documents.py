"""XML curve documents: one payload per (delivery day, series) to quarter values.

Every payload stays in its own row: the points are expanded and checked with array
expressions, so parsing a log of any length needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import day_end, day_start, iso_instant, physical_grid
from quartergrid.market import AUTUMN_96_SERIES, CURVE_SERIES, PRICE_SERIES

# The corrupt-record field has to come last for the parser to keep the other fields.
DOCUMENT_SCHEMA = """
TimeSeries ARRAY<STRUCT<
  `currency_Unit.name`: STRING,
  `price_Measure_Unit.name`: STRING,
  `quantity_Measure_Unit.name`: STRING,
  curveType: STRING,
  Period: ARRAY<STRUCT<
    timeInterval: STRUCT<start: STRING, end: STRING>,
    resolution: STRING,
    Point: ARRAY<STRUCT<position: STRING, `price.amount`: STRING, quantity: STRING>>
  >>
>>,
_corrupt_record STRING
"""
INCOMPLETE = "incomplete: "
STEP = 900


def parse_curves(raw: DataFrame, payload: Column | None = None) -> DataFrame:
    """Add ``intervals`` (array of start, value), ``unit``, ``status`` and ``reason``.

    ``status`` is ``accepted``, ``incomplete`` or ``malformed``. Rejected payloads
    have no intervals. The first problem in document order decides.
    """
    payload = F.col("payload") if payload is None else payload
    document = F.from_xml(
        payload, F.lit(DOCUMENT_SCHEMA), {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
    )
    is_price = F.col("series").isin(*PRICE_SERIES)
    decoded = raw.withColumn("_doc", document).withColumn(
        "_broken",
        F.col("_doc").isNull()
        | F.col("_doc._corrupt_record").isNotNull()
        | (F.trim(payload) == "")
        | ~_one_root(payload),
    )
    typed = decoded.withColumn(
        "_series",
        F.transform("_doc.TimeSeries", lambda item: _typed_series(item, is_price)),
    )
    checked = typed.withColumn("_series", F.transform("_series", _checked_series))
    return (
        checked.withColumn("_kept", _without_copies(F.col("_series")))
        .withColumn(
            "_found", _first_problem(F.col("_series"), F.col("_kept"), "conflicting time series")
        )
        .withColumn("_grid", physical_grid(F.col("delivery_date")))
        .withColumn(
            "_points", F.array_sort(F.flatten(F.transform("_kept", lambda item: item["values"])))
        )
        .withColumn("_starts", _starts(F.col("_points")))
        .withColumn("reason", _reason())
        .withColumn("status", status_of(F.col("reason")))
        .withColumn("unit", F.when(is_price, "EUR/MWh").otherwise("MW"))
        .withColumn("intervals", F.when(F.col("reason").isNull(), F.col("_points")))
        .drop("_doc", "_broken", "_series", "_kept", "_found", "_grid", "_points", "_starts")
    )


def status_of(reason: Column) -> Column:
    return (
        F.when(reason.isNull(), "accepted")
        .when(reason.startswith(INCOMPLETE), "incomplete")
        .otherwise("malformed")
    )


def _text(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def _typed_series(item: Column, is_price: Column) -> Column:
    unit = F.when(is_price, item["price_Measure_Unit.name"]).otherwise(
        item["quantity_Measure_Unit.name"]
    )
    wanted = F.when(is_price, "MWH").otherwise("MAW")
    curve = _text(item["curveType"])
    head = (
        F.when(_text(unit).isNull(), "unit is missing")
        .when(_text(unit) != wanted, "unexpected unit")
        .when(
            is_price & ~_text(item["currency_Unit.name"]).eqNullSafe(F.lit("EUR")),
            "unexpected currency",
        )
        .when(curve.isNull(), "curve type is missing")
    )
    periods = F.transform(item["Period"], lambda period: _typed_period(period, is_price))
    return F.struct(head.alias("head"), curve.alias("curve"), periods.alias("periods"))


def _typed_period(period: Column, is_price: Column) -> Column:
    start = iso_instant(_text(period["timeInterval"]["start"]))
    end = iso_instant(_text(period["timeInterval"]["end"]))
    points = F.transform(
        F.coalesce(period["Point"], F.array()),
        lambda point: F.struct(
            _position(point["position"]).alias("position"),
            _number(F.when(is_price, point["price.amount"]).otherwise(point["quantity"])).alias(
                "value"
            ),
        ),
    )
    day = F.col("delivery_date")
    span = F.unix_micros(end) - F.unix_micros(start)
    head = (
        F.when(start.isNull() | end.isNull(), "period bounds are missing or have no offset")
        .when(~_text(period["resolution"]).eqNullSafe(F.lit("PT15M")), "unexpected resolution")
        .when((start < day_start(day)) | (end > day_end(day)), "period leaves the delivery day")
        .when(
            (span <= 0) | (F.pmod(span, F.lit(STEP * 1_000_000)) != 0),
            "period is not a whole number of intervals",
        )
    )
    return F.struct(
        head.alias("head"),
        F.unix_timestamp(start).alias("begin"),
        F.floor(span / (STEP * 1_000_000)).cast("int").alias("size"),
        F.array_sort(points).alias("points"),
    )


def _one_root(payload: Column) -> Column:
    """Nothing but white space and comments follows the first element, which closes once."""
    body = F.regexp_replace(payload, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    name = F.regexp_extract(body, r"<([^\s/>!?]+)", 1)
    closing = F.concat(F.lit(r"</\Q"), name, F.lit(r"\E\s*>"))
    parts = F.split(body, closing)
    empty = F.regexp_like(body, F.lit(r"^\s*<[^<>]*/>\s*$"))
    return empty | ((F.size(parts) == 2) & (F.trim(F.regexp_replace(F.get(parts, F.lit(1)), r"\s", "")) == ""))


def _number(text: Column) -> Column:
    """A decimal number; Java's type suffixes are not part of one."""
    plain = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf(inity)?)\s*$"
    return F.when(text.rlike(plain), text).try_cast("double")


def _position(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text)).try_cast("int")


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _checked_series(item: Column) -> Column:
    """Reason and interval values of one TimeSeries, its periods checked in order.

    Every step is a transform over the finished elements of the step before.
    """
    curve = item["curve"]
    periods = F.transform(item["periods"], _with_positions)
    periods = F.transform(periods, lambda period: _with_reason(period, curve))
    periods = F.transform(periods, _with_values)
    return _bind(
        _bind(periods, lambda found: _series_outcome(item, found)),
        lambda outcome: F.struct(
            outcome["reason"].alias("reason"),
            curve.alias("curve"),
            F.when(outcome["reason"].isNull(), outcome["values"]).alias("values"),
        ),
    )


def _series_outcome(item: Column, periods: Column) -> Column:
    reason = F.coalesce(
        item["head"],
        _first_problem(periods, _placed(periods), "duplicate interval"),
        F.when(F.coalesce(F.size(periods), F.lit(0)) <= 0, "no period"),
    )
    values = F.flatten(F.transform(periods, lambda period: period["values"]))
    return F.struct(reason.alias("reason"), F.array_sort(values).alias("values"))


def _with_positions(period: Column) -> Column:
    positions = F.transform(period["points"], lambda point: point["position"])
    return F.struct(
        *(period[c].alias(c) for c in ("head", "begin", "size", "points")),
        positions.alias("positions"),
    )


def _with_reason(period: Column, curve: Column) -> Column:
    """First broken point rule of a period."""
    points, positions, size = period["points"], period["positions"], period["size"]
    reason = (
        F.when(period["head"].isNotNull(), period["head"])
        .when(
            F.exists(points, lambda p: p["position"].isNull() | p["value"].isNull()),
            "unreadable point",
        )
        .when(
            F.exists(positions, lambda p: (p < 1) | (p > size)), "position outside the period"
        )
        .when(F.size(F.array_distinct(positions)) < F.size(positions), "duplicate position")
        .when(
            F.exists(points, lambda p: F.isnan(p["value"]) | (F.abs(p["value"]) == float("inf"))),
            "non-finite value",
        )
        .when(
            (curve == "A01") & (F.size(points) < size),
            F.lit(INCOMPLETE + "curve lacks interval positions"),
        )
        .when(
            (curve == "A03") & ~F.coalesce(F.array_contains(positions, 1), F.lit(False)),
            "curve does not start at position 1",
        )
        .when(~curve.isin("A01", "A03"), "unsupported curve type")
    )
    return F.struct(
        reason.alias("reason"),
        *(period[c].alias(c) for c in ("begin", "size", "points", "positions")),
    )


def _with_values(period: Column) -> Column:
    """Spread the points over the intervals: a point holds until the next one.

    A complete curve has every point, so the same rule reads it unchanged.
    """
    held = F.transform(
        period["points"],
        lambda point, i: F.transform(
            F.sequence(
                point["position"],
                F.coalesce(F.get(period["positions"], i + 1), period["size"] + 1) - 1,
            ),
            lambda position: F.struct(
                F.timestamp_seconds(period["begin"] + (position - 1) * STEP).alias("start"),
                point["value"].alias("value"),
            ),
        ),
    )
    reason = period["reason"]
    return F.struct(
        reason.alias("reason"), F.when(reason.isNull(), F.flatten(held)).alias("values")
    )


def _starts(values: Column) -> Column:
    return F.transform(values, lambda value: value["start"])


def _placed(items: Column) -> Column:
    """Values of the usable items, each with its place in the document."""
    placed = F.transform(items, lambda item, i: F.struct(i.alias("at"), item["values"].alias("values")))
    return F.filter(placed, lambda item: item["values"].isNotNull())


def _without_copies(items: Column) -> Column:
    """Usable TimeSeries with their places, the first of each group of identical ones.

    Sorting by a digest and then by content brings copies together.
    """
    usable = F.filter(
        F.transform(
            items,
            lambda item, i: F.struct(
                F.xxhash64(item["curve"], item["values"]).alias("digest"),
                item["curve"].alias("curve"),
                item["values"].alias("values"),
                i.alias("at"),
            ),
        ),
        lambda item: item["values"].isNotNull(),
    )

    def first_of_its_kind(ordered):
        def differs(item, k):
            before = F.get(ordered, k - 1)
            return (k == 0) | ~(
                (before["digest"] == item["digest"])
                & before["curve"].eqNullSafe(item["curve"])
                & (before["values"] == item["values"])
            )

        return F.filter(ordered, differs)

    return _bind(F.array_sort(usable), first_of_its_kind)


def _first_clash(placed: Column) -> Column:
    """Place of the first item that repeats an interval of an earlier one.

    One sweep over all intervals by start and place; items are not compared in pairs.
    """
    intervals = F.flatten(
        F.transform(
            placed,
            lambda item: F.transform(
                item["values"],
                lambda value: F.struct(value["start"].alias("start"), item["at"].alias("at")),
            ),
        )
    )

    def repeated(ordered):
        def clashes(interval, k):
            before = F.get(ordered, k - 1)
            return (k > 0) & (before["start"] == interval["start"]) & (before["at"] < interval["at"])

        return F.array_min(F.transform(F.filter(ordered, clashes), lambda interval: interval["at"]))

    return _bind(F.array_sort(intervals), repeated)


def _first_problem(items: Column, placed: Column, clash: str) -> Column:
    """First problem in order: an item's own reason, or ``clash`` where it repeats an interval."""
    own = F.array_min(F.transform(items, lambda item, i: F.when(item["reason"].isNotNull(), i)))
    return _bind(
        F.struct(own.alias("own"), _first_clash(placed).alias("clash")),
        lambda at: F.when(
            at["clash"].isNotNull() & (at["own"].isNull() | (at["clash"] < at["own"])), clash
        ).otherwise(F.get(items, at["own"])["reason"]),
    )


def _reason() -> Column:
    grid, starts = F.col("_grid"), F.col("_starts")
    late_start = (
        F.col("series").isin(*AUTUMN_96_SERIES)
        & (F.size(grid) == 100)
        & F.forall("_series", lambda item: item["curve"] == "A03")
        & (starts == F.slice(grid, 5, 96))
    )
    missing = F.size(F.array_except(grid, starts))
    return (
        F.when(~F.col("series").isin(*CURVE_SERIES), "unknown series")
        .when(F.col("_broken"), "unreadable document")
        .when(F.coalesce(F.size("_series"), F.lit(0)) <= 0, "no time series")
        .when(F.col("_found").isNotNull(), F.col("_found"))
        .when(F.size(F.array_except(starts, grid)) > 0, "interval off the delivery grid")
        .when(
            (missing > 0) & ~late_start,
            F.concat(F.lit(INCOMPLETE), missing.cast("string"), F.lit(" intervals missing")),
        )
    )
