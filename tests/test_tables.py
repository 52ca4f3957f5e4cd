from datetime import date, datetime, timedelta

import pytest
from documents import INGESTED, document, time_series
from pyspark.sql import functions as F

from quartergrid.operators.versions import changed_only, check_updates, latest_version, upsert
from quartergrid.plans.requests import (
    missing_requests,
    new_versions,
    request_plan,
    require_refresh_bounds,
)
from quartergrid.sources import measurements as m
from quartergrid.operators.calendar import uncovered_years
from quartergrid.sources import tables

SCHEMA = "delivery_date date, quarter_of_day int, value double"
KEYS = ("delivery_date", "quarter_of_day")
DAY = date(2026, 1, 31)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_day_table_lifecycle(spark, tmp_path):
    table = tables.DayTable(spark, str(tmp_path / "t"), SCHEMA)
    assert not table.exists()
    table.create()
    assert table.exists() and table.read().isEmpty() and table.version() == 0
    table.append(frame(spark, [(DAY, 0, 1.0), (DAY + timedelta(days=1), 0, 2.0)]))
    table.merge(frame(spark, [(DAY, 0, 5.0), (DAY, 1, 6.0)]), KEYS)
    once = stored(table)
    assert once == [(DAY, 0, 5.0), (DAY, 1, 6.0), (DAY + timedelta(days=1), 0, 2.0)]
    table.merge(frame(spark, [(DAY, 0, 5.0), (DAY, 1, 6.0)]), KEYS)
    assert stored(table) == once and table.version() == 3
    table.replace_months(frame(spark, [(DAY, 9, 9.0)]))
    assert stored(table) == [(DAY, 9, 9.0), (DAY + timedelta(days=1), 0, 2.0)]
    assert not table.overwrite(frame(spark, []))
    assert len(stored(table)) == 2
    assert table.overwrite(table.read().where(F.col("value") > 5))
    assert stored(table) == [(DAY, 9, 9.0)]


def test_day_table_reads_only_needed_months(spark, tmp_path):
    table = tables.DayTable(spark, str(tmp_path / "t"), SCHEMA)
    table.append(frame(spark, [(DAY, 0, 1.0), (DAY + timedelta(days=1), 0, 2.0)]))
    months = table._stored().where(F.col(tables.MONTH) == "2026-01")
    plan = months._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(delivery_month" in plan


def test_merge_refuses_bad_updates(spark, tmp_path):
    table = tables.DayTable(spark, str(tmp_path / "t"), SCHEMA)
    with pytest.raises(ValueError, match="empty"):
        table.merge(frame(spark, []), KEYS)
    with pytest.raises(ValueError, match="update keys"):
        table.merge(frame(spark, [(DAY, 0, 1.0), (DAY, 0, 2.0)]), KEYS)
    with pytest.raises(ValueError, match="delivery_date"):
        table.merge(frame(spark, [(DAY, 0, 1.0)]), ("quarter_of_day",))
    with pytest.raises(ValueError, match="identifiers"):
        check_updates(frame(spark, [(DAY, 0, 1.0)]), ("quarter-of-day",))


def test_upsert_matches_null_keys(spark):
    schema = "k string, v int"
    target = spark.createDataFrame([(None, 1), ("a", 1)], schema)
    updates = spark.createDataFrame([(None, 2), ("b", 2)], schema)
    rows = {(r["k"], r["v"]) for r in upsert(target, updates, ["k"]).collect()}
    assert rows == {(None, 2), ("a", 1), ("b", 2)}


def test_latest_version_limits_before_the_shuffle(spark):
    schema = "k string, at int, payload string"
    hot = spark.range(2000).select(
        F.lit("hot").alias("k"), F.col("id").cast("int").alias("at"), F.lit("p").alias("payload")
    )
    rows = hot.unionByName(spark.createDataFrame([("b", 1, "x"), ("b", 1, "y")], schema))
    newest = latest_version(rows, ["k"], "at", ["payload"])
    assert "WindowGroupLimit" in newest._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in newest.collect()} == {("hot", 1999, "p"), ("b", 1, "y")}


def test_changed_only(spark):
    schema = "k string, payload string, at int"
    old = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], schema)
    new = spark.createDataFrame([("a", "1", 3), ("b", "1", 3), ("c", "9", 3)], schema)
    kept = changed_only(new, old, ["k"], "payload", "at")
    assert {r["k"] for r in kept.collect()} == {"a", "c"}


def test_request_plan_offsets(spark):
    bounds = spark.createDataFrame([(date(2026, 9, 8), date(2026, 9, 20))], "start date, end date")
    rows = request_plan(bounds, F.lit("2026-09-08").cast("date")).collect()
    days = {}
    for row in rows:
        days.setdefault(row["series"], []).append(row["delivery_date"])
    spans = {series: (min(d), max(d), len(d)) for series, d in days.items()}
    assert len(spans) == 14
    assert spans["de_lu.price.sdac"] == (date(2026, 9, 1), date(2026, 9, 9), 9)
    assert spans["at.price.exaa"] == (date(2026, 9, 8), date(2026, 9, 9), 2)
    assert spans["weather.ecmwf_ifs.sea"] == (date(2026, 9, 7), date(2026, 9, 8), 2)
    assert spans["de_lu.load.actual"] == (date(2026, 9, 6), date(2026, 9, 7), 2)


def test_request_plan_rejects_reversed_and_skips_future(spark):
    today = F.lit("2026-09-08").cast("date")
    turned = spark.createDataFrame([(date(2026, 9, 9), date(2026, 9, 8))], "start date, end date")
    with pytest.raises(Exception, match="lies behind the last"):
        request_plan(turned, today).collect()
    future = spark.createDataFrame([(date(2027, 1, 1), None)], "start date, end date")
    assert request_plan(future, today).isEmpty()
    with pytest.raises(ValueError, match="first and its last"):
        require_refresh_bounds(True, DAY, None)


def test_missing_requests_are_batched_newest_first(spark):
    plan = spark.range(20).select(
        F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("delivery_date"), F.lit("s").alias("series")
    )
    have = plan.where(F.col("delivery_date") == F.lit(DAY + timedelta(days=19)))
    batches = {r["delivery_date"]: r["batch"] for r in missing_requests(plan, have).collect()}
    assert len(batches) == 19
    assert batches[DAY + timedelta(days=18)] == 0 == batches[DAY + timedelta(days=12)]
    assert batches[DAY + timedelta(days=11)] == 1 and batches[DAY] == 2


def test_new_versions_and_refresh(spark):
    def log(*values, at=INGESTED):
        text = [
            document(time_series([(1, v)], "2025-12-31T23:00Z", "2026-01-01T23:00Z")) for v in values
        ]
        names = ("de_lu.load.actual", "de_lu.load.forecast")
        rows = [(date(2026, 1, 1), n, p, at) for n, p in zip(names, text)]
        return spark.createDataFrame(rows, m.RAW_SCHEMA)

    old, later = log(1), INGESTED + timedelta(hours=1)
    fresh = new_versions(log(9, 2, at=later), old).collect()
    assert [r["series"] for r in fresh] == ["de_lu.load.forecast"]
    changed = new_versions(log(9, 2, at=later), log(1, 2), refresh=True).collect()
    assert [r["series"] for r in changed] == ["de_lu.load.actual"]


def test_snapshot_and_csv(spark, tmp_path):
    rows = frame(spark, [(DAY + timedelta(days=d), q, float(q)) for d in range(3) for q in (1, 0)])
    path = str(tmp_path / "snapshot")
    for _ in range(2):
        tables.extract_snapshot(rows, path, DAY + timedelta(days=1))
    assert spark.read.parquet(path).count() == 4
    assert tables.read_snapshot(spark, path, DAY).count() == 2
    tables.export_csv(rows, str(tmp_path / "csv"), DAY)
    text = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert text.columns == ["delivery_date", "quarter_of_day", "value"]
    assert [r["quarter_of_day"] for r in text.collect()] == ["0", "1"]
    tables.export_results(rows, str(tmp_path / "results"))
    assert len(list((tmp_path / "results").glob("*.csv"))) == 1


def test_model_log_and_holiday_cover(spark, tmp_path):
    path = str(tmp_path / "models")
    row = {
        "path": "p", "model_data_version": 2, "feature_count": 3, "target_coverage": 0.9,
        "training_through": DAY, "point_shrinkage": 1.0, "baseline_exaa_mae": 2.0,
        "test_metrics": {"mae": 1.0}, "published_at": datetime(2026, 1, 1),
    }
    for version, reasons in ((1, []), (2, []), (3, ["worse"])):
        tables.log_model_version(spark, path, {**row, "version": version, "promotion_reasons": reasons})
    assert tables.production_version(spark.read.parquet(path)).first()["version"] == 2
    days = spark.createDataFrame([(DAY,), (DAY + timedelta(days=1),)], "delivery_date date")
    assert tables.holidays_covered(days, DAY, DAY + timedelta(days=1))
    assert not tables.holidays_covered(days, DAY, DAY + timedelta(days=2))


def test_holiday_cache_extends_only_years_with_holes(spark, tmp_path):
    def bounds(*ranges):
        return spark.createDataFrame(list(ranges), "start date, end date")

    rows = [("DE", date(2024, 5, 1), date(2024, 5, 1), True), ("LU", date(2026, 6, 23), date(2026, 6, 23), True)]
    ranges = spark.createDataFrame(rows, "country string, start_date date, end_date date, nationwide boolean")
    cache = tables.DayTable(spark, str(tmp_path / "h"), tables.HOLIDAY_SCHEMA)
    asked = bounds((date(2024, 4, 30), date(2024, 5, 2)))
    assert tables.cover_holidays(cache, asked.limit(0), ranges).isEmpty()
    found = {r[0]: r[1] for r in tables.cover_holidays(cache, asked, ranges).collect()}
    assert found == {date(2024, 4, 30): False, date(2024, 5, 1): True, date(2024, 5, 2): False}
    assert cache.read().count() == 366 and (before := cache.version())
    tables.cover_holidays(cache, asked, ranges.limit(0))
    assert cache.version() == before
    # 2025 has a hole, 2024 keeps its stored flag, 2026 is not asked for.
    tables.cover_holidays(cache, bounds((date(2024, 12, 31), date(2025, 1, 1))), ranges.limit(0))
    assert cache.read().count() == 366 + 365
    assert cache.read().where("is_holiday_de_nationwide").count() == 1
    gaps = uncovered_years(bounds((date(2023, 6, 1), date(2027, 2, 1))), cache.read())
    assert sorted(map(tuple, gaps.collect())) == [
        (date(2023, 1, 1), date(2023, 12, 31)),
        (date(2026, 1, 1), date(2027, 12, 31)),
    ]
