import math
import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quartergrid.functions import timegrid as t
from quartergrid.functions.numbers import split_reasons
from quartergrid.operators.calendar import calendar_spine, holiday_calendar, holiday_dates
from quartergrid.operators.normalise import fill_quarters, normalise_quarters
from quartergrid.operators.quality import measurement_violations, require_none

BERLIN = ZoneInfo("Europe/Berlin")
SCHEMA = "delivery_date date, delivery_start_utc timestamp, series string, value double"
LOAD = "de_lu.load.actual"
SOLAR = "de_lu.generation.solar.forecast"
WARM = "weather.kiel.temperature_2m"
WIND = "weather.kiel.wind_direction_100m"
SPRING, AUTUMN, PLAIN = date(2026, 3, 29), date(2025, 10, 26), date(2026, 1, 1)


def instants(day, step):
    moment = datetime(day.year, day.month, day.day, tzinfo=BERLIN).astimezone(timezone.utc)
    after = day + timedelta(days=1)
    end = datetime(after.year, after.month, after.day, tzinfo=BERLIN).astimezone(timezone.utc)
    while moment < end:
        yield moment.replace(tzinfo=None)
        moment += step


def rows_of(day, series, value):
    step = timedelta(hours=1) if series.startswith("weather.") else timedelta(minutes=15)
    return [(day, at, series, value(i)) for i, at in enumerate(instants(day, step))]


def filled(spark, rows):
    frame = normalise_quarters(spark.createDataFrame(rows, SCHEMA), on_gap="null")
    found = {}
    for row in frame.collect():
        day = found.setdefault((row["delivery_date"], row["series"]), {})
        day[row["quarter_of_day"]] = row["value"]
    return found


def test_physical_slots(spark):
    days = spark.createDataFrame([(PLAIN,), (SPRING,), (AUTUMN,)], "d date")
    rows = days.select(
        t.physical_slots(F.col("d")).alias("q"),
        t.physical_slots(F.col("d"), 3600).alias("h"),
        F.size(t.physical_grid(F.col("d"))).alias("n"),
    ).collect()
    assert [tuple(r) for r in rows] == [(96, 24, 96), (92, 23, 92), (100, 25, 100)]


def test_spring_hour_ramps_and_hours_hold(spark):
    rows = rows_of(SPRING, WARM, float) + rows_of(SPRING, LOAD, float)
    found = filled(spark, rows)
    warm = found[SPRING, WARM]
    # The hour from 02:00 is missing: 01:00 has value 1, 03:00 has value 2.
    assert [warm[q] for q in range(4, 13)] == [1, 1, 1, 1, 1.5, 1.625, 1.75, 1.875, 2]
    load = found[SPRING, LOAD]
    assert [load[q] for q in range(7, 13)] == pytest.approx([7, 7.2, 7.4, 7.6, 7.8, 8])
    assert all(len(day) == 96 and None not in day.values() for day in found.values())


def test_autumn_hour_is_averaged_and_angles_are_circular(spark):
    rows = rows_of(AUTUMN, LOAD, float)
    rows += rows_of(AUTUMN, WIND, lambda i: {2: 350.0, 3: 10.0}.get(i, 90.0))
    found = filled(spark, rows)
    load = found[AUTUMN, LOAD]
    # Physical 8..11 and 12..15 share the wall-clock quarters 8..11.
    assert [load[q] for q in range(7, 13)] == [7, 10, 11, 12, 13, 16]
    wind = found[AUTUMN, WIND]
    assert wind[8] == pytest.approx(0, abs=1e-9) and wind[9] == wind[8]
    assert wind[0] == 90.0


def test_opposite_angles_are_an_error(spark):
    rows = rows_of(AUTUMN, WIND, lambda i: {2: 0.0, 3: 180.0}.get(i, 90.0))
    frame = normalise_quarters(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(Exception, match="undefined circular mean"):
        frame.collect()


def test_a_day_without_any_value_keeps_its_quarters(spark):
    at = datetime(2026, 1, 1, 9)
    rows = [(PLAIN, at, WIND, 0.0), (PLAIN, at, WIND, 180.0), (PLAIN, at, LOAD, None)]
    rows += [(PLAIN, at, WARM, None), (PLAIN, at + timedelta(hours=2), WARM, 5.0)]
    found = filled(spark, rows)
    assert set(found) == {(PLAIN, WIND), (PLAIN, LOAD), (PLAIN, WARM)}
    nothing = dict.fromkeys(range(96))
    assert found[PLAIN, WIND] == nothing and found[PLAIN, LOAD] == nothing
    # An hour without a value is a gap like one that is not there.
    warm = found[PLAIN, WARM]
    assert [warm[q] for q in (0, 40, 48, 51)] == [5.0] * 4 and warm[52] is None
    with pytest.raises(Exception, match="cannot be filled"):
        normalise_quarters(spark.createDataFrame(rows[2:3], SCHEMA)).collect()


def test_gaps_by_series_class(spark):
    rows = [r for r in rows_of(PLAIN, LOAD, float) if r[3] not in (0.0, 50.0, 95.0)]
    rows += [r for r in rows_of(PLAIN, SOLAR, float) if r[3] >= 4]
    found = filled(spark, rows)
    load, solar = found[PLAIN, LOAD], found[PLAIN, SOLAR]
    assert load[0] is None and load[95] is None and load[50] == 50.0
    assert [solar[q] for q in range(5)] == [4.0] * 5
    with pytest.raises(Exception, match="cannot be filled"):
        normalise_quarters(spark.createDataFrame(rows, SCHEMA)).collect()


def brute_fill(known, kind):
    """Slot by slot, as the rules are stated."""
    out = {}
    for q in range(96):
        before = [k for k in known if k < q]
        after = [k for k in known if k > q]
        p, n = (max(before) if before else None), (min(after) if after else None)
        ramp = None
        if p is not None and n is not None:
            ramp = known[p] + (known[n] - known[p]) * (q - p) / (n - p)
        follow = None if n is None else known[n]
        if q in known:
            out[q] = known[q]
        elif kind == "angle":
            out[q] = known[p] if p is not None else follow
        elif kind == "hourly":
            held = known[p] if p is not None and p // 4 == q // 4 else ramp
            out[q] = held if held is not None else follow
        elif kind == "late":
            out[q] = ramp if ramp is not None else follow
        else:
            out[q] = ramp
    return out


def test_fill_matches_brute_force(spark):
    rng = random.Random(5)
    kinds = {WARM: "hourly", WIND: "angle", SOLAR: "late", LOAD: "plain"}
    rows, expected = [], {}
    for offset in range(12):
        day = PLAIN + timedelta(days=offset)
        for series, kind in kinds.items():
            known = {q: rng.random() for q in rng.sample(range(96), rng.randint(1, 40))}
            rows += [(day, q, series, v) for q, v in known.items()]
            expected[day, series] = brute_fill(known, kind)
    frame = spark.createDataFrame(
        rows, "delivery_date date, quarter_of_day int, series string, value double"
    )
    found = {}
    for row in fill_quarters(frame, on_gap="null").collect():
        found.setdefault((row["delivery_date"], row["series"]), {})[row["quarter_of_day"]] = row["value"]
    assert found == expected


def test_grid_gate(spark):
    rows = rows_of(PLAIN, LOAD, float)
    rows += [r for r in rows_of(AUTUMN, SOLAR, float) if r[3] >= 4]
    assert measurement_violations(spark.createDataFrame(rows, SCHEMA)).isEmpty()
    bad = [
        *rows_of(SPRING, LOAD, float)[1:],
        *[r for r in rows_of(AUTUMN, LOAD, float) if r[3] >= 4],
        *rows_of(SPRING, WARM, lambda i: math.inf if i == 3 else 1.0),
        *rows_of(PLAIN, WARM, float),
        rows_of(PLAIN, WARM, float)[0],
    ]
    frame = spark.createDataFrame(bad, SCHEMA)
    found = {
        (r["delivery_date"], r["series"]): r["reasons"]
        for r in measurement_violations(frame).collect()
    }
    grid = ["incomplete or misaligned day"]
    assert found == {
        (SPRING, LOAD): grid,
        (AUTUMN, LOAD): grid,
        (SPRING, WARM): ["non-finite value"],
        (PLAIN, WARM): ["duplicate key"],
    }
    with pytest.raises(ValueError, match="measurements"):
        require_none(measurement_violations(frame), "measurements")


def test_forecast_kind_cutoff_is_inclusive(spark):
    rows = [
        (PLAIN, datetime(2025, 12, 31, 11, 0)),
        (PLAIN, datetime(2025, 12, 31, 11, 0, 1)),
        (date(2026, 7, 2), datetime(2026, 7, 1, 10, 0)),
        (date(2026, 7, 2), datetime(2026, 7, 6)),
    ]
    frame = spark.createDataFrame(rows, "d date, at timestamp")
    kinds = [r[0] for r in frame.select(t.forecast_kind(F.col("d"), F.col("at"))).collect()]
    assert kinds == ["operational", "retrospective", "operational", "retrospective"]


def test_calendar_spine_and_dates(spark):
    bounds = spark.createDataFrame([(date(2026, 2, 28), date(2026, 3, 1))], "start date, end date")
    rows = calendar_spine(bounds).orderBy("delivery_date", "quarter_of_day").collect()
    assert len(rows) == 192
    last = rows[-1]
    assert (last["hour"], last["quarter"], last["day_of_week"]) == (23, 3, 6)
    assert last["season"] == "spring" and rows[0]["season"] == "winter" and last["is_weekend"]
    assert last["delivery_start_local"] == datetime(2026, 3, 1, 23, 45)
    texts = spark.range(1).select(
        t.previous_month_end(F.lit("2026-03-15").cast("date")),
        t.local_start_text(F.lit("2026-03-15").cast("date"), F.lit(35)),
        split_reasons(F.lit("a; b")),
        split_reasons(F.lit(None).cast("string")),
    ).first()
    assert tuple(texts) == (date(2026, 2, 28), "2026-03-15T08:45:00", ["a", "b"], [])


def test_holidays(spark):
    ranges = spark.createDataFrame(
        [
            ("DE", date(2026, 1, 1), date(2026, 1, 1), True),
            ("DE", date(2026, 1, 6), date(2026, 1, 6), False),
            ("LU", date(2026, 1, 1), date(2026, 1, 2), True),
        ],
        "country string, start_date date, end_date date, nationwide boolean",
    )
    bounds = spark.createDataFrame([(date(2026, 5, 1), date(2026, 6, 1))], "start date, end date")
    flags = {r["delivery_date"]: tuple(r)[1:] for r in holiday_calendar(bounds, ranges).collect()}
    assert len(flags) == 365
    assert flags[date(2026, 1, 1)] == (True, True)
    assert flags[date(2026, 1, 2)] == (False, True)
    assert flags[date(2026, 1, 6)] == (False, False)
    turned = ranges.withColumns({"start_date": F.col("end_date"), "end_date": F.date_add("start_date", -1)})
    with pytest.raises(Exception, match="ends before it starts"):
        holiday_dates(turned).collect()
