import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_grid import SCHEMA as MEASUREMENTS
from test_grid import instants

from quartergrid.market import LAG_7D, LOWER, POINT, REFERENCE, TARGET, UPPER
from quartergrid.operators import quality, wide
from quartergrid.plans import evaluate, pending, views
from quartergrid.plans.forecaster import (
    BoostingConfig,
    ConformalForecaster,
    fit_forecaster,
)
from quartergrid.plans.publish import publish_pending
from quartergrid.plans.training import evaluate_candidate
from quartergrid.sources.tables import DayTable

AUTUMN = date(2025, 10, 26)
FORECAST = (
    "delivery_date date, quarter_of_day int, model_version string, predicted_at timestamp, "
    f"forecast_kind string, {POINT} double, {LOWER} double, {UPPER} double"
)
INPUTS = f"delivery_date date, quarter_of_day int, {TARGET} double, {REFERENCE} double, {LAG_7D} double"
RUNS = "delivery_date date, data_outlier_rate double, prediction_mean_z double"
HISTORY = (
    "delivery_date date, model_version string, forecast_kind string, mae double, "
    "baseline_exaa_mae double, picp double"
)


class Market:
    """One day of forecasts at 50, references at 49 and prices at 51."""

    def __init__(self, spark, day, *, repeated=51.0, kind="operational", quarters=96):
        at = datetime(day.year, day.month, day.day) - timedelta(hours=20 if kind == "operational" else -5)
        self.forecasts = spark.createDataFrame(
            [(day, q, "1", at, kind, 50.0, 40.0, 60.0) for q in range(quarters)], FORECAST
        )
        self.inputs = spark.createDataFrame(
            [(day, q, 51.0, 49.0, 48.0) for q in range(96)], INPUTS
        )
        step = timedelta(minutes=15)
        prices = []
        for i, at_utc in enumerate(instants(day, step)):
            price = repeated if 12 <= i < 16 else 51.0
            prices.append((day, at_utc, "de_lu.price.sdac", price))
            prices.append((day, at_utc, "de_lu.price.exaa", 49.0))
        self.prices = spark.createDataFrame(prices, MEASUREMENTS)
        self.runs = spark.createDataFrame([(day, 0.0, 0.0)], RUNS)
        self.mae = spark.createDataFrame([("1", 8.0)], "model_version string, reference_mae double")
        self.spark = spark
        self.day = day

    def evaluate(self, history=()):
        days = self.spark.createDataFrame([(self.day,)], "delivery_date date")
        past = self.spark.createDataFrame(list(history), HISTORY)
        return evaluate.evaluate_days(
            days, self.forecasts, self.inputs, self.prices, self.runs, self.mae, past
        ).collect()


def test_physical_hour_counts_twice(spark):
    row = Market(spark, AUTUMN, repeated=100.0).evaluate()[0]
    assert row["mae"] == pytest.approx(2.96)
    assert row["normalized_96_mae"] == 1.0
    assert row["rolling_7d_mae"] == pytest.approx(2.96) and row["monitoring_status"] == "ok"


def test_stored_tables_are_read_only_in_the_months_asked(spark, tmp_path, monkeypatch):
    day, other = date(2026, 2, 1), date(2026, 3, 9)
    one, two = Market(spark, day), Market(spark, other)
    stored = []
    for name in ("forecasts", "inputs", "prices"):
        rows = getattr(one, name).unionByName(getattr(two, name))
        stored.append(DayTable(spark, str(tmp_path / name), rows.schema))
        stored[-1].append(rows)
    read, plain = [], evaluate.evaluate_days

    def seen(days, *frames, **options):
        read.extend(frame._jdf.queryExecution().executedPlan().toString() for frame in frames[:3])
        return plain(days, *frames, **options)

    runs = one.runs.unionByName(two.runs)
    days = spark.createDataFrame([(day,)], "delivery_date date")
    past = spark.createDataFrame([], HISTORY)
    whole = plain(days, one.forecasts, one.inputs, one.prices, runs, one.mae, past)
    metrics = DayTable(spark, str(tmp_path / "metrics"), whole.schema)
    monkeypatch.setattr(evaluate, "evaluate_days", seen)
    for at in (day, other):
        days = spark.createDataFrame([(at,)], "delivery_date date")
        evaluate.evaluate_stored(days, *stored, runs, one.mae, metrics)
        month = f"{at:%Y-%m}"
        filters = [plan.split("PartitionFilters: [")[1].split("]")[0] for plan in read]
        assert len(filters) == 3 and all(month in text for text in filters)
        read.clear()
    found = metrics.read().orderBy("delivery_date").collect()
    assert [(r["delivery_date"], r["mae"]) for r in found] == [(day, 1.0), (other, 1.0)]


def test_rolling_values_use_operational_history_only(spark):
    day = date(2026, 2, 1)
    history = [
        (day - timedelta(days=1), "1", "operational", 3.0, 2.0, 0.5),
        (day - timedelta(days=2), "1", "retrospective", 90.0, 90.0, 0.0),
    ]
    row = Market(spark, day).evaluate(history)[0]
    assert (row["mae"], row["rolling_7d_mae"], row["rolling_28d_picp"]) == (1.0, 2.0, 0.75)


def test_retrospective_is_not_monitored(spark):
    row = Market(spark, date(2026, 2, 1), kind="retrospective").evaluate()[0]
    assert row["monitoring_status"] == "not_applicable" and row["monitoring_reasons"] == ""
    assert row["rolling_7d_mae"] is None and row["mae"] == 1.0


def test_short_day_waits_and_inconsistent_day_stops(spark):
    assert Market(spark, date(2026, 2, 1), quarters=95).evaluate() == []
    market = Market(spark, date(2026, 2, 1))
    market.forecasts = market.forecasts.withColumn(
        "model_version", F.when(F.col("quarter_of_day") == 3, "2").otherwise("1")
    )
    with pytest.raises(Exception, match="multiple model versions"):
        market.evaluate()


def test_missing_physical_interval_stops(spark):
    market = Market(spark, date(2026, 2, 1))
    market.prices = market.prices.where(F.col("delivery_start_utc") != F.lit(datetime(2026, 2, 1, 5)))
    with pytest.raises(Exception, match="incomplete physical day"):
        market.evaluate()


def test_evaluation_restarts_at_the_first_gap(spark):
    days = [date(2026, 3, d) for d in range(1, 7)]
    grid = spark.createDataFrame([(d, q, 1.0) for d in days for q in range(96)],
                                 f"delivery_date date, quarter_of_day int, {TARGET} double")
    done = spark.createDataFrame([(d,) for d in days if d.day not in (3, 6)], "delivery_date date")
    partial = grid.where((F.dayofmonth("delivery_date") != 5) | (F.col("quarter_of_day") > 0))
    found = pending.evaluation_days(grid, partial, done)
    assert sorted(r[0].day for r in found.collect()) == [3, 4, 6]
    assert pending.evaluation_days(grid, partial, done, refresh=True).count() == 5


def test_operational_forecast_is_required_after_noon(spark):
    runs = spark.createDataFrame([(date(2026, 1, 2), "retrospective")],
                                 "delivery_date date, forecast_kind string")
    morning = F.lit("2026-01-01 10:30:00").cast("timestamp")
    pending.require_operational_forecast(runs, morning)
    noon = F.lit("2026-01-01 11:00:00").cast("timestamp")
    with pytest.raises(RuntimeError, match="2026-01-02"):
        pending.require_operational_forecast(runs, noon)
    pending.require_operational_forecast(
        runs.withColumn("forecast_kind", F.lit("operational")), noon
    )


def test_wide_table_drops_days_with_a_missing_cell(spark):
    layout_rows = [
        (date(2026, 1, 1) + timedelta(days=d), q, s, float(d * 100 + q))
        for d in range(12) for q in range(96) for s in ("a", "b")
        if not (s == "b" and d == 10 and q == 4)
    ]
    rows = spark.createDataFrame(
        layout_rows, "delivery_date date, quarter_of_day int, series string, value double"
    )
    from quartergrid.market import Placement, WideLayout

    layout = WideLayout(
        target="t",
        target_placements=(Placement("a", "t"), *(Placement("a", f"lag{n}", n) for n in (1, 2, 7))),
        features=(Placement("b", "f", 1),),
    )
    found = wide.wide_rows(rows, layout, through=date(2026, 1, 13)).collect()
    days = sorted({r["delivery_date"].day for r in found})
    # Lag 7 starts on the 8th; the 12th lacks its shifted feature; the 13th has no target.
    assert days == [8, 9, 10, 11, 13]
    last = [r for r in found if r["delivery_date"].day == 13]
    assert all(r["t"] is None for r in last) and len(last) == 96
    one = next(r for r in found if r["delivery_date"].day == 9 and r["quarter_of_day"] == 5)
    assert (one["t"], one["lag1"], one["lag2"], one["lag7"], one["f"]) == (805, 705, 605, 105, 705)


def test_training_days_rules(spark):
    def rows(targets):
        return spark.createDataFrame(
            [(date(2026, 1, 1) + timedelta(days=d), q, 1.0, t if q else first)
             for d, (t, first) in enumerate(targets) for q in range(96)],
            "delivery_date date, quarter_of_day int, f double, t double",
        )

    kept = quality.training_days(rows([(1.0, 1.0), (None, None)]), ["f"], "t")
    assert kept.count() == 96
    with pytest.raises(ValueError, match="training days"):
        quality.training_days(rows([(1.0, None)]), ["f"], "t")
    assert quality.scoring_days(rows([(1.0, None)]), ["f"], "t").count() == 96
    with pytest.raises(ValueError, match="scoring days"):
        quality.scoring_days(rows([(1.0, 1.0)]).where("quarter_of_day > 0"), ["f"], "t")


QUICK = BoostingConfig(rounds=4, depth=3, min_rows=5)
FEATURES = (REFERENCE, "x", "quarter")


@pytest.fixture(scope="module")
def training(spark):
    slot = F.col("id") % 96
    day = F.floor(F.col("id") / 96).cast("int")
    x = F.sin(F.col("id") * 12.9898) * 10
    noise = F.sin(F.col("id") * 78.233)
    return (
        spark.range(40 * 96)
        .select(
            F.date_add(F.lit("2026-01-01").cast("date"), day).alias("delivery_date"),
            slot.cast("int").alias("quarter_of_day"),
            slot.cast("double").alias("quarter"),
            x.alias("x"),
            (slot + 50.0).alias(REFERENCE),
            (slot + 50.0 + F.signum(x) * 8 + noise).alias(TARGET),
        )
        .cache()
    )


@pytest.fixture(scope="module")
def model(training):
    return fit_forecaster(training, FEATURES, calibration_days=8, config=QUICK)


def test_model_intervals_are_ordered_and_calibrated(model, training):
    rows = model.predict(training)
    found = rows.agg(
        F.count_if(F.col(LOWER) > F.col(POINT)), F.count_if(F.col(POINT) > F.col(UPPER)),
        F.avg(((F.col(TARGET) >= F.col(LOWER)) & (F.col(TARGET) <= F.col(UPPER))).cast("double")),
        F.avg(F.abs(F.col(POINT) - F.col(TARGET))), F.avg(F.abs(F.col(REFERENCE) - F.col(TARGET))),
    ).first()
    assert found[0] == found[1] == 0
    assert found[2] > 0.87
    assert found[3] < found[4]


def test_model_round_trip(spark, model, training, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    loaded = ConformalForecaster.load(spark, str(tmp_path / "m"))
    both = model.predict(training).select("delivery_date", "quarter_of_day", POINT, LOWER).exceptAll(
        loaded.predict(training).select("delivery_date", "quarter_of_day", POINT, LOWER)
    )
    assert both.isEmpty()
    assert model.with_shrinkage(0.0).predict(training).where(
        F.abs(F.col(POINT) - F.col(REFERENCE)) > 1e-9
    ).isEmpty()
    with pytest.raises(ValueError):
        model.with_shrinkage(1.5)


def test_candidate_is_promoted_and_refitted(training):
    result = evaluate_candidate(
        training, FEATURES, calibration_days=6, config=QUICK,
        folds=2, validation_days=5, test_days=5, minimum_train_days=10,
    )
    assert result.promotion_reasons == () and result.test_metrics["mae"] < result.baseline_mae
    assert len(result.fold_metrics) == 2 and 0 < result.point_shrinkage <= 1


def test_publication_is_first_writer_wins(spark, model, training, tmp_path):
    forecasts = DayTable(
        spark, str(tmp_path / "f"),
        f"delivery_date date, delivery_start_local timestamp_ntz, quarter_of_day int, {POINT} double, "
        f"{LOWER} double, {UPPER} double, nominal_coverage double, model_version string, "
        "predicted_at timestamp, forecast_kind string",
    )
    runs = DayTable(
        spark, str(tmp_path / "r"),
        "delivery_date date, model_version string, predicted_at timestamp, forecast_kind string, "
        "model_data_version int, gold_table_version bigint, data_outlier_rate double, "
        "max_feature_mean_z double, prediction_mean_z double",
    )
    inputs = training.where((F.col("delivery_date") > "2026-02-06")
                            & ((F.col("delivery_date") != "2026-02-08") | (F.col("quarter") > 0)))

    def publish(version):
        return publish_pending(
            model, inputs, forecasts, runs, version=version, input_version=7,
            predicted_at=F.lit("2026-02-06 10:00:00").cast("timestamp"), end=date(2026, 2, 9),
        )

    assert publish("1") == 2
    assert publish("2") == 0
    stored = runs.read().orderBy("delivery_date").collect()
    assert [(r["delivery_date"].day, r["model_version"], r["forecast_kind"]) for r in stored] == [
        (7, "1", "operational"), (9, "1", "operational")
    ]
    assert forecasts.read().count() == 192 and stored[0]["gold_table_version"] == 7
    assert all(math.isfinite(r["prediction_mean_z"]) for r in stored)


def test_latest_state_of_empty_tables(spark):
    empty = spark.createDataFrame([], "delivery_date date, model_version string, "
                                      "forecast_kind string, monitoring_status string")
    assert tuple(views.latest_state(empty, empty, empty).first()) == (None,) * 4
