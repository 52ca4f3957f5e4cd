from datetime import date, datetime, timedelta

import pytest
from documents import document, time_series

from quartergrid.plans import refresh
from quartergrid.sources import measurements as m
from quartergrid.sources.tables import DayTable

LOAD, SOLAR = "de_lu.load.forecast", "de_lu.generation.solar.forecast"
FIRST = datetime(2026, 3, 1)
DAYS = [date(2026, 1, 10), date(2026, 1, 11), date(2026, 2, 5)]


def curve(day, value):
    start = datetime(day.year, day.month, day.day) - timedelta(hours=1)
    ends = [f"{x:%Y-%m-%dT%H:%MZ}" for x in (start, start + timedelta(days=1))]
    return document(time_series([(1, value)], *ends))


def responses(spark, *rows):
    return spark.createDataFrame(
        [(day, series, payload, FIRST + timedelta(hours=hour)) for day, series, payload, hour in rows], m.RAW_SCHEMA
    )


@pytest.fixture
def stored(spark, tmp_path):
    log = DayTable(spark, str(tmp_path / "log"), m.RAW_SCHEMA)
    log.append(responses(spark, *((day, LOAD, curve(day, 5), 0) for day in DAYS)))
    table = DayTable(spark, str(tmp_path / "measurements"), m.MEASUREMENT_SCHEMA)
    table.append(m.measurements(log.read()))
    return log, DayTable(spark, str(tmp_path / "state"), refresh.STATE_SCHEMA), table


def parts(table, month):
    return [part for part in table._manifest()["parts"] if part.endswith(month)]


def test_only_changed_payloads_are_appended(spark, stored):
    log, state, _ = stored
    batch = responses(
        spark, (DAYS[0], LOAD, curve(DAYS[0], 5), 1), (DAYS[1], LOAD, curve(DAYS[1], 6), 1),
        (DAYS[1], SOLAR, curve(DAYS[1], 7), 1), (DAYS[2], LOAD, "<broken>", 1),
    )
    appended = refresh.append_changed(log, state, batch)
    found = sorted((r["delivery_date"], r["series"]) for r in appended.collect())
    assert found == [(DAYS[1], SOLAR), (DAYS[1], LOAD)]
    assert refresh.append_changed(log, state, batch).isEmpty()
    assert log.version() == 1 and log.read().count() == 5


def test_a_lost_state_write_is_made_good(spark, stored):
    log, state, _ = stored
    refresh.catch_up(log, state)
    late = responses(spark, (DAYS[1], LOAD, curve(DAYS[1], 6), 1))
    log.append(late)  # The job ended before the state was written.
    assert refresh.append_changed(log, state, late).isEmpty()
    assert state.read().count() == 3


def test_state_of_other_months_and_payloads_are_not_read(spark, stored):
    log, state, _ = stored
    refresh.catch_up(log, state)
    january = parts(state, "2026-01")
    refresh.append_changed(log, state, responses(spark, (DAYS[2], LOAD, curve(DAYS[2], 6), 1)))
    assert parts(state, "2026-01") == january
    plan = state.read(months=["2026-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(delivery_month" in plan
    assert "payload:" not in plan.split("ReadSchema")[1]


def test_refreshed_measurements_equal_a_full_build(spark, stored):
    log, _, table = stored
    february = parts(table, "2026-02")
    before = log.version()
    log.append(
        responses(
            spark, (DAYS[0], LOAD, curve(DAYS[0], 8), 2), (DAYS[1], LOAD, "<broken>", 2), (DAYS[1], SOLAR, curve(DAYS[1], 7), 2),
            (DAYS[0], LOAD, curve(DAYS[0], 9), 1),
        )
    )
    changed = refresh.refresh_measurements(log, table, before)
    assert changed.count() == 3
    assert parts(table, "2026-02") == february
    full = m.measurements(log.read())
    assert table.read().exceptAll(full).isEmpty() and full.exceptAll(table.read()).isEmpty()
    assert refresh.refresh_measurements(log, table, log.version()).isEmpty()


def test_a_month_may_lose_all_its_rows(spark, stored):
    log, _, table = stored
    before = log.version()
    log.append(responses(spark, (DAYS[2], LOAD, "<broken>", 1)))
    refresh.refresh_measurements(log, table, before)
    assert {r[0] for r in table.read().select("delivery_date").distinct().collect()} == set(DAYS[:2])


def test_weather_payloads_hold_the_next_days_series(spark):
    keys = spark.createDataFrame(
        [(DAYS[0], "weather.ecmwf_ifs.sea"), (DAYS[0], LOAD), (DAYS[0], "weather.ecmwf_ifs.moon")],
        "delivery_date date, series string",
    )
    rows = refresh.measured_keys(keys).collect()
    assert (DAYS[0], LOAD) in rows and len(rows) == 1 + 25
    assert {r[0] for r in rows if r[1] != LOAD} == {DAYS[1]}


def test_served_days_follow_every_shift(spark):
    changed = spark.createDataFrame(
        [(DAYS[0], "de_lu.price.sdac"), (DAYS[0], LOAD)], "delivery_date date, series string"
    )
    days = {(r[0] - DAYS[0]).days for r in refresh.served_days(changed).collect()}
    assert days == {0, 1, 2, 7}
