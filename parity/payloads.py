"""Payload documents built from events, and the rows and states they must give."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from parity import supplied as s
from parity.registry import query, with_ctes
from quartergrid.functions.timegrid import day_end, day_start
from quartergrid.market import (
    CURVE_SERIES,
    PRICE_SERIES,
    WEATHER_FALLBACK_MODEL,
    WEATHER_FIELDS,
    WEATHER_LOCATIONS,
    WEATHER_MODEL,
)
from quartergrid.plans.requests import new_versions
from quartergrid.sources import measurements as m
from quartergrid.sources.forecast_documents import missing_temperatures

# Variants of a document, by (day of year + series position) % 8.
FINE, CUT, UNIT, COMPLETE_CURVE, COPY, NO_START, LATE = (0, 1), 2, 3, 4, 5, 6, 7


def _points(spark, folder):
    kind = F.array_position(s.text_array(s.EVENT_TYPES), F.col("event_type")) - 1
    index = F.pmod(kind * 29 + F.col("user_id"), F.lit(len(CURVE_SERIES))).cast("int")
    seconds = F.unix_timestamp("delivery_start_utc") - F.unix_timestamp(
        day_start(F.col("delivery_date"))
    )
    return (
        s.events(spark, folder, s.SPRING)
        .select(
            "delivery_date",
            index.alias("idx"),
            (F.floor(seconds / 900) + 1).cast("int").alias("position"),
            "value",
        )
        .groupBy("delivery_date", "idx", "position")
        .agg(F.floor(F.avg("value")).cast("bigint").alias("value"))
    )


def curve_log(spark, folder):
    """Raw log of curve documents; every key also has an older, wrong version."""
    names = s.text_array(CURVE_SERIES)
    docs = (
        _points(spark, folder)
        .groupBy("delivery_date", "idx")
        .agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("points"))
        .withColumn("series", F.get(names, F.col("idx")))
        .withColumn("variant", F.pmod(F.dayofyear("delivery_date") + F.col("idx"), F.lit(8)))
    )
    variant, day = F.col("variant"), F.col("delivery_date")
    zero = F.array(F.struct(F.lit(1).alias("position"), F.lit(0).cast("bigint").alias("value")))
    first = F.get(F.col("points"), F.lit(0))["position"]
    started = F.when(first == 1, F.col("points")).otherwise(F.concat(zero, "points"))
    shown = (
        F.when(variant == NO_START, F.filter("points", lambda p: p["position"] > 1))
        .when(variant == LATE, zero)
        .otherwise(started)
    )
    price = F.col("series").isin(*PRICE_SERIES)
    tag = F.when(price, "price.amount").otherwise("quantity")
    unit = F.when(variant == UNIT, "KWT").otherwise(F.when(price, "MWH").otherwise("MAW"))
    unit_tag = F.when(price, "price_Measure_Unit.name").otherwise("quantity_Measure_Unit.name")
    iso = "yyyy-MM-dd'T'HH:mm'Z'"
    begin = F.when(variant == LATE, day_start(day) + F.expr("INTERVAL 1 HOUR")).otherwise(
        day_start(day)
    )
    text = F.array_join(
        F.transform(
            shown,
            lambda p: F.format_string(
                "<Point><position>%d</position><%s>%d</%s></Point>",
                p["position"], tag, p["value"], tag,
            ),
        ),
        "",
    )
    body = F.concat(
        F.lit("<TimeSeries><currency_Unit.name>EUR</currency_Unit.name><"), unit_tag, F.lit(">"),
        unit, F.lit("</"), unit_tag, F.lit("><curveType>"),
        F.when(variant == COMPLETE_CURVE, "A01").otherwise("A03"),
        F.lit("</curveType><Period><timeInterval><start>"), F.date_format(begin, iso),
        F.lit("</start><end>"), F.date_format(day_end(day), iso),
        F.lit("</end></timeInterval><resolution>PT15M</resolution>"), text,
        F.lit("</Period></TimeSeries>"),
    )
    doubled = F.when(variant == COPY, F.concat(body, body)).otherwise(body)
    document = F.concat(F.lit('<Document xmlns="urn:curve:1">'), doubled, F.lit("</Document>"))
    payload = F.when(variant == CUT, F.substring(document, 1, 200)).otherwise(document)
    newest = docs.select("delivery_date", "series", payload.alias("payload")).withColumn(
        "ingested_at", F.lit("2024-06-02 00:00:00").cast("timestamp")
    )
    older = newest.withColumns(
        {
            "payload": F.lit("<broken>"),
            "ingested_at": F.lit("2024-06-01 00:00:00").cast("timestamp"),
        }
    )
    return newest.unionByName(older)


_NAMES = ", ".join(f"'{n}'" for n in CURVE_SERIES)
_TYPES = ", ".join(f"'{t}'" for t in s.EVENT_TYPES)
_PRICES = ", ".join(f"'{n}'" for n in PRICE_SERIES)
CURVE_CTE = f"""{s.events_cte(s.SPRING)},
points AS (
  SELECT delivery_date, ((list_position([{_TYPES}], event_type) - 1) * 29 + user_id) % 12 AS idx,
    (epoch_us(start_utc) - epoch_us({s.day_start_sql('delivery_date')})) // 900000000 + 1 AS position,
    floor(avg(value)) AS value
  FROM ev GROUP BY ALL),
docs AS (
  SELECT delivery_date, idx, [{_NAMES}][idx + 1] AS series,
    (dayofyear(delivery_date) + idx) % 8 AS variant, count(*) AS n, max(position) AS last_position,
    {s.slots_sql('delivery_date')} AS slots,
    count(*) FILTER (WHERE position = 1) AS has_first FROM points GROUP BY ALL),
judged AS (
  SELECT *, CASE variant WHEN 2 THEN 'unreadable document' WHEN 3 THEN 'unexpected unit'
    WHEN 4 THEN CASE WHEN n + 1 - has_first < slots
      THEN 'incomplete: curve lacks interval positions' END
    WHEN 6 THEN 'curve does not start at position 1'
    WHEN 7 THEN 'incomplete: 4 intervals missing' END AS reason FROM docs),
states AS (SELECT *, CASE WHEN reason IS NULL THEN 'accepted'
  WHEN reason LIKE 'incomplete: %' THEN 'incomplete' ELSE 'malformed' END AS status FROM judged)"""


@query(
    "xml_curve_expand",
    "P1 P2 P6 P9 P20 S19 W8 X7 W1 T6",
    with_ctes(
        CURVE_CTE,
        f"""grid AS (
  SELECT d.*, unnest(generate_series(1, slots)) AS position FROM states d WHERE status = 'accepted'),
filled AS (
  SELECT g.delivery_date, g.series, g.position, coalesce(last_value(p.value IGNORE NULLS) OVER (
    PARTITION BY g.delivery_date, g.idx ORDER BY g.position
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS value
  FROM grid g LEFT JOIN points p
    ON p.delivery_date = g.delivery_date AND p.idx = g.idx AND p.position = g.position)""",
        select=f"""SELECT delivery_date, {s.day_start_sql('delivery_date')}
    + (position - 1) * INTERVAL 15 MINUTE AS delivery_start_utc, series, value::DOUBLE AS value,
  CASE WHEN series IN ({_PRICES}) THEN 'EUR/MWh' ELSE 'MW' END AS unit,
  TIMESTAMP '2024-06-02' AS source_ingested_at FROM filled""",
    ),
)
def xml_curve_expand(spark, folder):
    return m.measurements(curve_log(spark, folder))


@query(
    "xml_statuses",
    "P1 P3 P4 P5 P6 P7 P8 P18 T2",
    with_ctes(
        CURVE_CTE,
        select="""SELECT delivery_date, series, TIMESTAMP '2024-06-02' AS ingested_at, status, reason
FROM states""",
    ),
)
def xml_statuses(spark, folder):
    return m.payload_status(m.latest_payloads(curve_log(spark, folder)))


@query(
    "payload_quarantine",
    "P18 P19 P8",
    with_ctes(
        CURVE_CTE,
        select="""SELECT status, reason, series, count(*) AS n FROM states WHERE status <> 'accepted'
GROUP BY ALL UNION ALL SELECT 'malformed', 'unreadable document', series, count(*) FROM states GROUP BY series""",
    ),
)
def payload_quarantine(spark, folder):
    """Old versions are broken, so every series has them besides its rejected variants."""
    bad = m.quarantine(curve_log(spark, folder))
    broken = F.col("payload") == "<broken>"
    return bad.groupBy("status", "reason", "series", broken.alias("_old")).agg(
        F.count(F.lit(1)).alias("n")
    ).drop("_old")


@query(
    "accepted_batch",
    "P19 I3",
    with_ctes(
        CURVE_CTE,
        select="""SELECT delivery_date, series FROM states WHERE status = 'accepted'
  AND delivery_date >= DATE '2024-03-20'""",
    ),
)
def accepted_batch(spark, folder):
    """Earlier days are stored already; the good payloads of later ones are new."""
    log = curve_log(spark, folder).where(F.col("payload") != "<broken>")
    stored = log.where(F.col("delivery_date") < F.lit(date(2024, 3, 20)))
    return new_versions(log, stored).select("delivery_date", "series")


def _places(cell: str):
    rows = ", ".join(
        f"struct({p[1]}D AS latitude, {p[2]}D AS longitude)"
        for p in WEATHER_LOCATIONS
        if p[3] == cell
    )
    return F.expr(f"array({rows})")


def _weather_log(spark, folder, listed=False):
    """Hourly documents: event counts per hour plus a location and field number."""
    hour = F.hour("instant")
    counts = s.events(spark, folder, s.WINTER).groupBy(F.to_date("instant").alias("delivery_date")).agg(
        *(F.count_if(hour == h).alias(f"h{h}") for h in range(24))
    )
    day = F.col("delivery_date")
    hourly = F.array(*(F.col(f"h{h}") for h in range(24)))
    cells = [F.struct(F.lit(c).alias("cell")) for c in ("land", "sea")]
    docs = counts.select("delivery_date", hourly.alias("n"), F.inline(F.array(*cells)))
    hours = F.sequence(F.lit(0), F.lit(47))
    times = F.transform(
        hours,
        lambda i: F.date_format(
            F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + i * 3600),
            "yyyy-MM-dd'T'HH:mm",
        ),
    )
    gap = F.dayofyear(day) % 2 == 0

    def values(j, f, name):
        def one(i):
            value = (F.get(F.col("n"), i % 24) + j * 10 + f).cast("double")
            if name == "temperature_2m":
                return F.when(~(gap & (i == 30)), value)
            if name == "shortwave_radiation":
                return F.when(i != 0, value)
            return value

        return F.transform(hours, one)

    units = ", ".join(f"'{unit}' AS {name}" for name, _, unit in WEATHER_FIELDS)

    def location(place, fields):
        return F.struct(
            (place["latitude"] + 0.1).alias("latitude"),
            (place["longitude"] - 0.1).alias("longitude"),
            F.lit("GMT").alias("timezone"),
            F.lit(0).alias("utc_offset_seconds"),
            F.expr(f"struct('iso8601' AS time, {units})").alias("hourly_units"),
            F.struct(times.alias("time"), *fields).alias("hourly"),
        )

    def primary(place, j):
        fields = [values(j, f, n).alias(n) for f, (n, _, _) in enumerate(WEATHER_FIELDS)]
        return location(place, fields)

    def spare(place):
        field = F.transform(hours, lambda i: (i + 100).cast("double")).alias("temperature_2m")
        return location(place, [field])

    places = F.when(F.col("cell") == "land", _places("land")).otherwise(_places("sea"))
    main, backup = F.transform(places, primary), F.transform(places, spare)
    options = {"ignoreNullFields": "false"}
    wrapped = F.to_json(
        F.struct(main.alias("primary"), F.when(gap, backup).alias("temperature_fallback")), options
    )
    bare = F.to_json(main, options)
    payload = bare if listed else F.when(gap, wrapped).otherwise(bare)
    return docs.select(
        "delivery_date",
        F.concat(F.lit("weather.ecmwf_ifs."), "cell").alias("series"),
        payload.alias("payload"),
        F.lit("2024-06-02 00:00:00").cast("timestamp").alias("ingested_at"),
    )


def _values_rows() -> str:
    rows = []
    for cell in ("land", "sea"):
        places = [p for p in WEATHER_LOCATIONS if p[3] == cell]
        for j, place in enumerate(places):
            for f, (name, _, unit) in enumerate(WEATHER_FIELDS):
                rows.append(f"('{place[0]}', '{name}', '{unit}', {j * 10 + f})")
    return ", ".join(rows)


@query(
    "json_weather_rows",
    "P10 P13 P14 P15 P16 S20",
    with_ctes(
        f"""counts AS (SELECT CAST(ts AS DATE) AS run, extract(hour FROM ts) AS h, count(*) AS n
  FROM events GROUP BY 1, 2)""",
        f"fields AS (SELECT * FROM (VALUES {_values_rows()}) v(place, field, unit, base))",
        """hours AS (SELECT run, unnest(range(48)) AS i FROM (SELECT DISTINCT run FROM counts)),
cells AS (
  SELECT t.run + 1 AS delivery_date, 'weather.' || place || '.' || field AS series, unit,
    CAST(t.run AS TIMESTAMP) + (i - CASE WHEN field = 'shortwave_radiation' THEN 1 ELSE 0 END)
      * INTERVAL 1 HOUR AS delivery_start_utc,
    CASE WHEN field = 'temperature_2m' AND dayofyear(t.run) % 2 = 0 AND i = 30 THEN 130
      WHEN field = 'shortwave_radiation' AND i = 0 THEN 0
      ELSE coalesce(n, 0) + base END::DOUBLE AS value
  FROM hours t LEFT JOIN counts c ON c.run = t.run AND c.h = i % 24 CROSS JOIN fields)""",
        select=f"""SELECT *, TIMESTAMP '2024-06-02' AS source_ingested_at FROM cells
WHERE CAST({s.berlin('delivery_start_utc')} AS DATE) = delivery_date""",
    ),
)
def json_weather_rows(spark, folder):
    return m.measurements(_weather_log(spark, folder))


# Faults of a weather document, by (day of year + 5 at sea) % 16: what to look for, what to put
# in its place, and the reason that must be given. None: the document is accepted.
_HOURLY_AT, _UNITS_AT = '"hourly":\\{', '"hourly_units":\\{'
_LISTED = ",".join(["1"] * 48)
_NAMED = f'"cloud_cover_{WEATHER_MODEL}":'
_WEATHER_FAULTS = (
    ((), None),
    (((_HOURLY_AT, f'"hourly":{{"temperature_2m_{WEATHER_MODEL}":null,'),),
     "values are not 48 in temperature_2m"),
    (((_HOURLY_AT, f'"hourly":{{"cloud_cover_{WEATHER_FALLBACK_MODEL}":null,'),), None),
    (((_HOURLY_AT, f'"hourly":{{"wind_speed_100m_{WEATHER_FALLBACK_MODEL}":[1],'),),
     "fallback values are not 48 in wind_speed_100m"),
    ((('"timezone":"GMT"', '"timezone":"Europe/Berlin"'),), "timestamps are not GMT"),
    (((',"[^"]*T23:00"\\]', "]"),), "incomplete: not all 48 hours are published"),
    ((('"iso8601"', '"unixtime"'),), "times are not ISO 8601"),
    ((('"latitude":', '"latitude":1'),), "location order changed"),
    ((("T00:00", "T00:30"),), "hours are not the 48 consecutive run hours"),
    ((('"latitude":', '"lat":'),), "no coordinates"),
    ((("(?s)^(.{200}).*$", "$1"),), "unreadable document"),
    ((('"cloud_cover":"%"', '"cloud_cover":"1"'),), "unexpected unit of cloud_cover"),
    (((_HOURLY_AT, f'"hourly":{{{_NAMED}[{_LISTED}],'), (_UNITS_AT, f'"hourly_units":{{{_NAMED}"%",')), None),
    (((_HOURLY_AT, f'"hourly":{{{_NAMED}[{_LISTED}],'),), "unexpected unit of cloud_cover"),
    (((_HOURLY_AT, f'"hourly":{{{_NAMED}[true,{_LISTED[2:]}],'), (_UNITS_AT, f'"hourly_units":{{{_NAMED}"%",')),
     "values are not 48 in cloud_cover"),
    ((('"latitude":([0-9.]+)', '"latitude":"$1"'),), None),
)
_FAULT_ROWS = ", ".join(
    f"({i}, {'NULL' if reason is None else repr(reason)})" for i, (_, reason) in enumerate(_WEATHER_FAULTS)
)


@query(
    "weather_statuses",
    "P10 P11 P12 P13 P15 P18 Q1",
    f"""SELECT run AS delivery_date, cell AS series, CASE WHEN reason IS NULL THEN 'accepted'
    WHEN reason LIKE 'incomplete: %' THEN 'incomplete' ELSE 'malformed' END AS status, reason
FROM (SELECT DISTINCT CAST(ts AS DATE) AS run FROM events)
CROSS JOIN (VALUES ('weather.ecmwf_ifs.land', 0), ('weather.ecmwf_ifs.sea', 5)) c(cell, later)
JOIN (VALUES {_FAULT_ROWS}) f(fault, reason) ON fault = (dayofyear(run) + later) % 16""",
)
def weather_statuses(spark, folder):
    """Every weather document with one of sixteen changes, and what is said about it."""
    later = F.when(F.col("series").endswith("sea"), 5).otherwise(0)
    fault = F.pmod(F.dayofyear("delivery_date") + later, F.lit(len(_WEATHER_FAULTS)))
    payload = F.col("payload")
    for i, (edits, _) in enumerate(_WEATHER_FAULTS):
        changed = F.col("payload")
        for pattern, put in edits:
            changed = F.regexp_replace(changed, pattern, put)
        if edits:
            payload = F.when(fault == i, changed).otherwise(payload)
    log = _weather_log(spark, folder).withColumn("payload", payload)
    return m.payload_status(log).select("delivery_date", "series", "status", "reason")


@query(
    "missing_temperatures",
    "P17",
    """SELECT DISTINCT CAST(ts AS DATE) AS delivery_date, series,
  CASE WHEN dayofyear(ts) % 2 = 0 THEN CASE WHEN series LIKE '%land' THEN 20 ELSE 5 END ELSE 0 END
    AS missing_temperatures
FROM events CROSS JOIN (VALUES ('weather.ecmwf_ifs.land'), ('weather.ecmwf_ifs.sea')) v(series)""",
)
def missing_temperatures_query(spark, folder):
    log = missing_temperatures(_weather_log(spark, folder, listed=True))
    return log.select("delivery_date", "series", "missing_temperatures")


@query(
    "event_properties",
    "S20 X14",
    """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""",
)
def event_properties(spark, folder):
    props = F.from_json("props", "k bigint")
    return s.table(spark, folder, "events").groupBy(props["k"].alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
