import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartergrid.operators import splits
from quartergrid.operators.metrics import forecast_metrics
from quartergrid.operators.monitoring import assess_drift, feature_statistics, input_drift
from quartergrid.operators.shifts import (
    BLOCK,
    best_shrinkage,
    daily_gains,
    gain_interval,
    shift_metrics,
    shrinkage_errors,
)
from quartergrid.operators.statistics import conformal_rank, order_statistic
from quartergrid.plans.forecaster import assemble_interval, conformal_adjustment

DAY = date(2026, 1, 1)


def metrics(spark, rows, coverage):
    frame = spark.createDataFrame(rows, "y double, p double, lo double, hi double")
    return frame.agg(*forecast_metrics("y", "p", "lo", "hi", coverage=coverage)).first()


def test_point_and_interval_metrics(spark):
    found = metrics(spark, [(1.0, 2.0, 0.0, 4.0), (3.0, 2.0, 1.0, 3.0)], 0.9)
    assert tuple(found) == (1, 1, 1, 3, 3)
    missed = metrics(spark, [(5.0, 2.0, 1.0, 3.0)], 0.8)
    assert missed["picp"] == 0 and missed["interval_score"] == pytest.approx(22)
    with pytest.raises(ValueError):
        forecast_metrics("y", "p", "lo", "hi", coverage=1)


def test_shift_metrics(spark):
    pairs = list(zip([-20, -5, 0, 5, 20], [-12, -4, 0, -3, 25]))
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, p double")
    found = frame.agg(*shift_metrics("a", "p", material_shift=10)).first()
    assert tuple(found) == pytest.approx((4.4, math.sqrt(30.8), 75, 6.5, 100, 60, 8.8))


def test_sample_weights(spark):
    frame = spark.createDataFrame([(float(v),) for v in (-20, -5, 0, 5, 20)], "s double")
    weights = frame.select(splits.sample_weights(F.col("s"), threshold=10.0)).collect()
    assert [w[0] for w in weights] == [5, 1, 1, 1, 5]
    with pytest.raises(ValueError):
        splits.sample_weights(F.col("s"), threshold=0)


def test_bootstrap_of_equal_days(spark):
    rows = [(DAY, 2.0, 1.0), (DAY, -2.0, -1.0), (DAY + timedelta(1), 4.0, 1.0), (DAY + timedelta(1), -4.0, -1.0)]
    frame = spark.createDataFrame(rows, "delivery_date date, a double, p double")
    found = gain_interval(daily_gains(frame, "a", "p"), samples=200).first()
    assert tuple(found) == (1, 1, 1)


def test_bootstrap_is_plausible_and_repeatable(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(0.5, 1, 60)
    rows = [(DAY + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    gains = spark.createDataFrame(rows, "delivery_date date, gain double")
    found = gain_interval(gains, samples=4000).first()
    again = gain_interval(gains.repartition(7), samples=4000).first()
    assert tuple(found) == pytest.approx(tuple(again))
    error = values.std() / math.sqrt(60)
    assert found["mae_gain"] == pytest.approx(values.mean())
    assert found["mae_gain_ci_low"] == pytest.approx(values.mean() - 1.96 * error, abs=0.25 * error)
    assert found["mae_gain_ci_high"] == pytest.approx(values.mean() + 1.96 * error, abs=0.25 * error)


def test_shrinkage_example_and_ties(spark):
    rows = [(2.0, 1.0), (2.0, 1.0), (-2.0, -1.0), (-2.0, -1.0)]
    frame = spark.createDataFrame(rows, "c double, r double")
    assert best_shrinkage(shrinkage_errors(frame, "c", "r")).first()["shrinkage"] == 0.5
    flat = spark.createDataFrame([(0.0, 1.0)], "c double, r double")
    assert best_shrinkage(shrinkage_errors(flat, "c", "r")).first()["shrinkage"] == 0.0


def test_conformal_example(spark):
    frame = spark.createDataFrame([(float(y), -1.0, 1.0) for y in range(10)], "y double, lo double, hi double")
    assert conformal_adjustment(frame, "y", "lo", "hi", coverage=0.8).first()["adjustment"] == 7.0
    wide = spark.createDataFrame([(0.0, -9.0, 9.0)], "y double, lo double, hi double")
    assert conformal_adjustment(wide, "y", "lo", "hi", coverage=0.9).first()["adjustment"] == -9.0


@pytest.mark.parametrize("coverage", [0.05, 0.5, 0.9, 0.999])
def test_order_statistic_matches_numpy_with_hot_values(spark, coverage):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), [-1e12, 1e12]])
    groups = {"all": data, "one": data[:1]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(8)
    found = order_statistic(frame, "v", conformal_rank(coverage), by=["g"]).collect()
    for row in found:
        values = np.sort(groups[row["g"]])
        rank = min(len(values) - 1, math.ceil((len(values) + 1) * coverage) - 1)
        assert row["order_statistic"] == values[rank]
    assert len(found) == 2


def test_order_statistic_cuts_large_ranges_again(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(size=6000), None: rng.normal(size=40), "one": np.array([3.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    frame = spark.createDataFrame(rows, "g string, v double")
    for share in (0.37, 1.0):
        rank = lambda count: F.floor((count - 1) * F.lit(share))
        found = order_statistic(frame, "v", rank, by=["g"], largest=150).collect()
        assert {row["g"]: row["order_statistic"] for row in found} == {
            g: np.sort(vs)[math.floor((len(vs) - 1) * share)] for g, vs in groups.items()
        }
    assert order_statistic(frame.limit(0), "v", rank, by=["g"], largest=150).isEmpty()
    assert order_statistic(frame, "v", rank, largest=150).first()[0] == max(v for _, v in rows)


def test_bootstrap_ships_the_gains_once_per_block(spark):
    gains = spark.createDataFrame([(DAY, 1.0), (DAY + timedelta(1), 4.0)], "delivery_date date, gain double")
    found = gain_interval(gains, samples=BLOCK + 1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.first()["mae_gain"] == 2.5
    assert plan.count("explode") >= 2
    exact = [
        sum((1.0, 4.0)[int(hashlib.md5(f"42:{s}:{d}".encode()).hexdigest()[:8], 16) % 2] for d in range(2)) / 2
        for s in range(BLOCK + 1)
    ]
    assert found.first()["mae_gain_ci_low"] == pytest.approx(np.quantile(exact, 0.025))
    assert found.first()["mae_gain_ci_high"] == pytest.approx(np.quantile(exact, 0.975))


def test_interval_contains_the_point(spark):
    columns = assemble_interval(*(F.lit(float(v)) for v in (5, 1, -1, -3, 100)))
    assert tuple(spark.range(1).select(*columns).first()) == (105, 102, 105)


def history(spark, days, mae, base, picp, outliers, z, reference=10.0):
    rows = [
        (DAY + timedelta(days=i), mae, base, picp, outliers, z, reference) for i in range(days)
    ]
    frame = spark.createDataFrame(
        rows,
        "delivery_date date, mae double, baseline_exaa_mae double, picp double, "
        "data_outlier_rate double, prediction_mean_z double, reference_mae double",
    )
    return assess_drift(frame).orderBy("delivery_date").collect()


def test_healthy_history(spark):
    last = history(spark, 14, 5.0, 8.0, 0.9, 0.01, 0.5)[-1]
    assert last["monitoring_status"] == "ok" and last["monitoring_reasons"] == ""


def test_all_rules_and_their_gates(spark):
    rows = history(spark, 14, 20.0, 10.0, 0.7, 0.3, 5.0)
    counts = [len(r["monitoring_reasons"].split("; ")) for r in rows]
    assert counts == [2] * 6 + [4] * 7 + [5]
    silent = history(spark, 7, 20.0, 30.0, 0.7, 0.0, 0.0, reference=None)[-1]
    assert silent["monitoring_status"] == "ok" and silent["rolling_7d_mae"] == 20


def test_input_drift(spark):
    train = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0)], "a double, b double")
    columns = {c: F.col(c) for c in ("a", "b")}
    row = train.agg(*feature_statistics(columns)).first()
    assert row["a__scale"] == 1 and row["b__scale"] == 1
    fixed = {c: (F.lit(row[f"{c}__mean"]), F.lit(row[f"{c}__scale"])) for c in columns}
    day = spark.createDataFrame([("d", 1.0, 15.0), ("d", 7.0, 5.0)], "k string, a double, b double")
    found = input_drift(day, columns, fixed, ["k"], point=F.col("a"), target_statistics=fixed["a"]).first()
    assert tuple(found) == ("d", 0.5, 5.0, 3.0)


def days_frame(spark, n):
    rows = [(DAY + timedelta(days=i),) for i in range(n)]
    return splits.day_index(spark.createDataFrame(rows, "delivery_date date"))


def test_walk_forward_expands(spark):
    roles = splits.walk_forward_roles(
        days_frame(spark, 12), folds=3, validation_days=2, test_days=2, minimum_train_days=4
    ).collect()
    trained = {f: sum(r["fold"] == f and r["role"] == "train" for r in roles) for f in range(4)}
    assert trained == {0: 4, 1: 6, 2: 8, 3: 10}
    assert sum(r["role"] == "test" for r in roles) == 2
    with pytest.raises(Exception, match="at least 202"):
        splits.walk_forward_roles(days_frame(spark, 12), folds=2, validation_days=27).collect()


def test_temporal_roles(spark):
    roles = splits.temporal_roles(
        days_frame(spark, 10), validation_days=2, test_days=3, minimum_train_days=5
    )
    counts = {r["role"]: r["count"] for r in roles.groupBy("role").count().collect()}
    assert counts == {"train": 5, "validation": 2, "test": 3}
