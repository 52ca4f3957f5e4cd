from datetime import date, datetime, timedelta

import pytest
from documents import INGESTED, document, time_series, weather_payload

from quartergrid.market import WEATHER_FALLBACK_MODEL, WEATHER_MODEL
from quartergrid.sources import measurements as m
from quartergrid.sources.curve_documents import parse_curves
from quartergrid.sources.forecast_documents import missing_temperatures

DAY = date(2026, 1, 1)
FULL = ("2025-12-31T23:00Z", "2026-01-01T23:00Z")
LOAD = "de_lu.load.forecast"
FLAT = [(1, 1)]
RUN = date(2026, 6, 23)
SEA = "weather.ecmwf_ifs.sea"


def _period(points):
    return time_series(points, *FULL)


CURVES = {
    "filled": (DAY, LOAD, document(_period([(1, 10), (3, 20)])), "accepted", 96),
    "complete": (
        DAY,
        "de_lu.price.sdac",
        document(time_series([(i, float(i)) for i in range(1, 97)], *FULL, curve="A01", price=True)),
        "accepted",
        96,
    ),
    "spring": (
        date(2026, 3, 29),
        LOAD,
        document(time_series(FLAT, "2026-03-28T23:00Z", "2026-03-29T22:00Z")),
        "accepted",
        92,
    ),
    "autumn": (
        date(2025, 10, 26),
        LOAD,
        document(time_series(FLAT, "2025-10-25T22:00Z", "2025-10-26T23:00Z")),
        "accepted",
        100,
    ),
    "offset": (
        DAY,
        "at.price.sdac",
        document(
            time_series(FLAT, "2026-01-01T00:00+01:00", "2026-01-02T00:00+01:00", price=True)
        ),
        "accepted",
        96,
    ),
    "copy": (DAY, "de_lu.load.actual", document(_period(FLAT), _period(FLAT)), "accepted", 96),
    "late series": (
        date(2025, 10, 26),
        "de_lu.generation.solar.forecast",
        document(time_series(FLAT, "2025-10-25T23:00Z", "2025-10-26T23:00Z")),
        "accepted",
        96,
    ),
    "late start": (
        DAY,
        "de_lu.generation.wind_offshore.forecast",
        document(time_series(FLAT, "2026-01-01T00:00Z", FULL[1])),
        "incomplete",
        0,
    ),
    "short complete curve": (
        DAY,
        "de_lu.generation.solar.actual",
        document(time_series([(1, 1), (2, 2)], *FULL, curve="A01")),
        "incomplete",
        0,
    ),
    "no start": (DAY, "at.price.exaa", document(time_series([(2, 1)], *FULL, price=True)), "malformed", 0),
    "empty": (DAY, "de_lu.price.exaa", document(), "malformed", 0),
    "broken": (DAY, "de_lu.generation.wind_onshore.actual", "<broken>", "malformed", 0),
    "nan": (
        DAY, "de_lu.generation.wind_offshore.actual", document(_period([(1, "NaN")])), "malformed", 0,
    ),
    "conflict": (
        DAY,
        "de_lu.generation.wind_onshore.forecast",
        document(_period(FLAT), _period([(1, 2)])),
        "malformed",
        0,
    ),
    "duplicate position": (
        date(2026, 1, 2),
        LOAD,
        document(time_series([(1, 1), (1, 1)], "2026-01-01T23:00Z", "2026-01-02T23:00Z")),
        "malformed",
        0,
    ),
    "naive time": (
        date(2026, 1, 3),
        LOAD,
        document(time_series(FLAT, "2026-01-02T23:00", "2026-01-03T23:00")),
        "malformed",
        0,
    ),
    "outside": (
        date(2026, 1, 4),
        LOAD,
        document(time_series(FLAT, "2026-01-03T22:45Z", "2026-01-04T23:00Z")),
        "malformed",
        0,
    ),
    "unit": (
        date(2026, 1, 5),
        LOAD,
        document(time_series(FLAT, "2026-01-04T23:00Z", "2026-01-05T23:00Z", unit="KWT")),
        "malformed",
        0,
    ),
    "resolution": (
        date(2026, 1, 6),
        LOAD,
        document(
            time_series(FLAT, "2026-01-05T23:00Z", "2026-01-06T23:00Z", resolution="PT60M")
        ),
        "malformed",
        0,
    ),
    "unknown": (DAY, "de_lu.other", document(_period(FLAT)), "malformed", 0),
}


@pytest.fixture(scope="module")
def curves(spark):
    rows = [(day, series, text, INGESTED) for day, series, text, _, _ in CURVES.values()]
    raw = spark.createDataFrame(rows, m.RAW_SCHEMA)
    states = {
        (r["delivery_date"], r["series"]): r["status"] for r in m.payload_status(raw).collect()
    }
    return raw, states, m.measurements(raw).collect()


@pytest.mark.parametrize("name", CURVES)
def test_curve_case(curves, name):
    day, series, _, status, count = CURVES[name]
    _, states, rows = curves
    assert states[day, series] == status
    assert sum(r["series"] == series and r["delivery_date"] == day for r in rows) == count


def test_curve_values_and_types(curves):
    _, _, rows = curves
    filled = sorted(
        (r["delivery_start_utc"], r["value"])
        for r in rows
        if r["series"] == LOAD and r["delivery_date"] == DAY
    )
    assert [value for _, value in filled[:4]] == [10, 10, 20, 20]
    assert filled[0][0] == datetime(2025, 12, 31, 23)
    prices = [r for r in rows if r["series"] == "de_lu.price.sdac"]
    assert max(r["value"] for r in prices) == 96.0
    assert {r["unit"] for r in prices} == {"EUR/MWh"}
    late = [r["delivery_start_utc"] for r in rows if "solar.forecast" in r["series"]]
    assert min(late) == datetime(2025, 10, 25, 23)


def test_strict_and_quarantine(curves):
    raw, states, _ = curves
    with pytest.raises(ValueError, match="payloads"):
        m.measurements(raw, strict=True)
    assert m.quarantine(raw).count() == sum(s != "accepted" for s in states.values())
    assert m.accepted_payloads(raw).count() == sum(s == "accepted" for s in states.values())


def test_newest_version_wins_even_when_incomplete(spark):
    good = document(_period(FLAT))
    late = document(time_series(FLAT, "2026-01-01T00:00Z", FULL[1]))
    raw = spark.createDataFrame(
        [(DAY, LOAD, good, INGESTED), (DAY, LOAD, late, INGESTED + timedelta(hours=1))],
        m.RAW_SCHEMA,
    )
    assert m.measurements(raw).count() == 0


def test_raw_log_must_be_filled(spark):
    with pytest.raises(ValueError, match="empty"):
        m.require_raw(spark.createDataFrame([], m.RAW_SCHEMA))
    nulls = spark.createDataFrame(
        [(DAY, LOAD, None, INGESTED)],
        "delivery_date date, series string, payload string, ingested_at timestamp",
    )
    with pytest.raises(ValueError, match="payload"):
        m.require_raw(nulls)


def _drop_hour(places):
    places[1]["hourly"]["time"].pop()


def _null_cloud(places):
    places[2]["hourly"]["cloud_cover"][5] = None


def _true_cloud(places):
    places[2]["hourly"]["cloud_cover"][5] = True


def _null_named(places):
    places[0]["hourly"][f"temperature_2m_{WEATHER_MODEL}"] = None


def _null_spare(places):
    places[0]["hourly"][f"cloud_cover_{WEATHER_FALLBACK_MODEL}"] = None


def _number_spare(places):
    places[0]["hourly"][f"cloud_cover_{WEATHER_FALLBACK_MODEL}"] = 7


def _text_spare(places):
    places[0]["hourly"][f"temperature_2m_{WEATHER_FALLBACK_MODEL}"] = ["1"] * 48
    places[0]["hourly_units"][f"temperature_2m_{WEATHER_FALLBACK_MODEL}"] = "°C"


def _text_place(places):
    places[0]["latitude"] = str(places[0]["latitude"])


def _seconds(places):
    places[0]["hourly"]["time"] = [f"{hour}:00" for hour in places[0]["hourly"]["time"]]


def _move(places):
    places[0]["latitude"] += 1


def _fewer(places):
    places.pop()


def _zone(places):
    places[3]["timezone"] = "CET"


def _unit(places):
    places[3]["hourly_units"]["wind_speed_100m"] = "km/h"


def _shift_hours(places):
    places[0]["hourly"]["time"] = places[0]["hourly"]["time"][1:] + ["2026-07-30T00:00"]


WEATHER = [
    (None, "accepted"),
    (_drop_hour, "incomplete"),
    (_null_cloud, "incomplete"),
    (_true_cloud, "malformed"),
    (_null_named, "malformed"),
    (_null_spare, "accepted"),
    (_number_spare, "malformed"),
    (_text_spare, "malformed"),
    (_text_place, "accepted"),
    (_seconds, "accepted"),
    (_move, "malformed"),
    (_fewer, "malformed"),
    (_zone, "malformed"),
    (_unit, "malformed"),
    (_shift_hours, "malformed"),
]


def test_weather_states(spark):
    rows = []
    for i, (change, _) in enumerate(WEATHER):
        run = RUN + timedelta(days=i)
        rows.append((run, SEA, weather_payload(run, "sea", change=change), INGESTED))
    raw = spark.createDataFrame(rows, m.RAW_SCHEMA)
    states = [r["status"] for r in m.payload_status(raw).orderBy("delivery_date").collect()]
    assert states == [status for _, status in WEATHER]


def test_weather_rows(spark):
    raw = spark.createDataFrame(
        [
            (RUN, SEA, weather_payload(RUN, "sea", null_temperature=True), INGESTED),
            (RUN + timedelta(days=1), SEA,
             weather_payload(RUN + timedelta(days=1), "sea", wrapped=True), INGESTED),
        ],
        m.RAW_SCHEMA,
    )
    rows = m.measurements(raw).collect()
    first = [r for r in rows if r["delivery_date"] == date(2026, 6, 24)]
    assert len(first) == 5 * 5 * 24 == len(rows) - len(first)
    temperature = {
        r["delivery_start_utc"]: r["value"] for r in first if r["series"].endswith("temperature_2m")
    }
    assert temperature[datetime(2026, 6, 23, 22)] == 122.0
    radiation = sorted(
        (r["delivery_start_utc"], r["value"])
        for r in first
        if r["series"] == "weather.baltic_west.shortwave_radiation"
    )
    assert radiation[0] == (datetime(2026, 6, 23, 22), 23.0)


def test_missing_temperatures(spark):
    def blank(places):
        places[0]["hourly"]["temperature_2m"][3:6] = [None] * 3

    raw = spark.createDataFrame(
        [(RUN, SEA, weather_payload(RUN, "sea", change=blank), INGESTED)], m.RAW_SCHEMA
    )
    assert missing_temperatures(raw).first()["missing_temperatures"] == 3


def _quarters(value, count=96, first=0):
    """One TimeSeries per quarter of the day."""
    begin = datetime(2025, 12, 31, 23)
    return [
        time_series(
            [(1, value)],
            f"{begin + timedelta(minutes=15 * q):%Y-%m-%dT%H:%MZ}",
            f"{begin + timedelta(minutes=15 * (q + 1)):%Y-%m-%dT%H:%MZ}",
        )
        for q in range(first, first + count)
    ]


def test_documents_of_thousands_of_time_series(spark):
    copies = _quarters(1) * 40
    payloads = {
        "copies": document(*copies),
        "conflict at the end": document(*copies, *_quarters(2, 1, 50)),
        "own reason first": document(*copies[:96], time_series([(2, 1)], *FULL), *_quarters(2, 1)),
        "conflict first": document(*copies[:96], *_quarters(2, 1), time_series([(2, 1)], *FULL)),
        "same values, other curve": document(_period(FLAT), time_series([(i, 1) for i in range(1, 97)], *FULL, curve="A01")),
    }
    rows = [(DAY, LOAD, name, payload) for name, payload in payloads.items()]
    raw = spark.createDataFrame(rows, "delivery_date date, series string, name string, payload string")
    found = {r["name"]: (r["status"], r["reason"], len(r["intervals"] or [])) for r in parse_curves(raw).collect()}
    conflict = ("malformed", "conflicting time series", 0)
    assert found == {
        "copies": ("accepted", None, 96),
        "conflict at the end": conflict,
        "own reason first": ("malformed", "curve does not start at position 1", 0),
        "conflict first": conflict,
        "same values, other curve": conflict,
    }
