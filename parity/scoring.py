"""Metric, monitoring, shift and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import supplied as s
from parity.registry import query, with_ctes
from quartergrid.market import BOOTSTRAP_SAMPLES, DRIFT_REASONS, PROMOTION_REASONS
from quartergrid.operators.metrics import (
    baseline_metrics,
    forecast_metrics,
    mean_absolute,
)
from quartergrid.operators.monitoring import (
    assess_drift,
    feature_statistics,
    input_drift,
    rolling_metrics,
)
from quartergrid.operators.shifts import (
    best_shrinkage,
    daily_gains,
    gain_interval,
    shift_metrics,
    shrinkage_errors,
)
from quartergrid.operators.statistics import conformal_rank, order_statistic
from quartergrid.plans.forecaster import assemble_interval, conformal_adjustment
from quartergrid.plans.training import loss_comparison, promotion_reasons

# A line item as a forecast: quantity is the price, the other columns shape the forecast.
FORECAST_CTE = f"""{s.LINEITEM_CTE},
f AS (
  SELECT *, value AS target, (l_partkey % 50)::DOUBLE AS point,
    (l_partkey % 50 - l_suppkey % 20)::DOUBLE AS lower, (l_partkey % 50 + l_orderkey % 25)::DOUBLE AS upper,
    (l_orderkey % 50)::DOUBLE AS reference, (l_suppkey % 50)::DOUBLE AS lag7 FROM li)"""


def _forecasts(spark, folder):
    point = F.col("l_partkey") % 50
    return s.lineitem_quarters(spark, folder).select(
        "*",
        F.col("value").alias("target"),
        point.cast("double").alias("point"),
        (point - F.col("l_suppkey") % 20).cast("double").alias("lower"),
        (point + F.col("l_orderkey") % 25).cast("double").alias("upper"),
        (F.col("l_orderkey") % 50).cast("double").alias("reference"),
        (F.col("l_suppkey") % 50).cast("double").alias("lag7"),
    )


def _rounded(frame, columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


FIVE = ("mae", "rmse", "picp", "mpiw", "interval_score")
_FIVE_SQL = """round(avg(abs(point - target)), 6) AS mae,
  round(sqrt(avg((point - target) * (point - target))), 6) AS rmse,
  round(avg(CASE WHEN target BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS picp,
  round(avg(upper - lower), 6) AS mpiw,
  round(avg(upper - lower
    + CASE WHEN target < lower THEN 2 / (1 - 0.9::DOUBLE) * (lower - target) ELSE 0 END
    + CASE WHEN target > upper THEN 2 / (1 - 0.9::DOUBLE) * (target - upper) ELSE 0 END), 6)
    AS interval_score"""


@query(
    "forecast_metrics_daily",
    "M1 M2 M3 M4 M5 A13 X14",
    with_ctes(FORECAST_CTE, select=f"SELECT delivery_date, {_FIVE_SQL} FROM f GROUP BY 1"),
)
def forecast_metrics_daily(spark, folder):
    metrics = forecast_metrics("target", "point", "lower", "upper", coverage=0.9)
    return _rounded(_forecasts(spark, folder).groupBy("delivery_date").agg(*metrics), FIVE)


@query(
    "baselines_bias",
    "M6 A13",
    with_ctes(
        FORECAST_CTE,
        select="""SELECT delivery_date, round(avg(point - target), 6) AS bias,
  round(avg(abs(reference - target)), 6) AS baseline_exaa_mae,
  round(avg(abs(lag7 - target)), 6) AS baseline_7d_mae FROM f GROUP BY 1""",
    ),
)
def baselines_bias(spark, folder):
    metrics = baseline_metrics("target", "point", "reference", "lag7")
    daily = _forecasts(spark, folder).groupBy("delivery_date").agg(*metrics)
    return _rounded(daily, ["bias", "baseline_exaa_mae", "baseline_7d_mae"])


DAILY_CTE = f"""{FORECAST_CTE},
daily AS (
  SELECT l_suppkey % 4 AS zone, delivery_date, avg(abs(point - target)) AS mae,
    avg(abs(reference - target)) AS baseline_exaa_mae,
    avg(CASE WHEN target BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS picp,
    max(l_partkey) % 30 / 100.0::DOUBLE AS data_outlier_rate,
    (max(l_partkey) % 11 - 5)::DOUBLE AS prediction_mean_z,
    CASE WHEN max(l_orderkey) % 3 = 0 THEN NULL ELSE (max(l_orderkey) % 20)::DOUBLE END AS reference_mae
  FROM f GROUP BY 1, 2)"""


def _daily(spark, folder):
    rows = _forecasts(spark, folder).withColumn("zone", F.col("l_suppkey") % 4)
    inside = (F.col("target") >= F.col("lower")) & (F.col("target") <= F.col("upper"))
    part, order = F.max("l_partkey"), F.max("l_orderkey")
    return rows.groupBy("zone", "delivery_date").agg(
        mean_absolute(F.col("point") - F.col("target")).alias("mae"),
        mean_absolute(F.col("reference") - F.col("target")).alias("baseline_exaa_mae"),
        F.avg(inside.cast("double")).alias("picp"),
        (part % 30 / 100.0).alias("data_outlier_rate"),
        (part % 11 - 5).cast("double").alias("prediction_mean_z"),
        F.when(order % 3 != 0, (order % 20).cast("double")).alias("reference_mae"),
    )


_ROLLING_CTE = """rolled AS (
  SELECT *, avg(mae) OVER w7 AS r7, avg(baseline_exaa_mae) OVER w7 AS b7, avg(picp) OVER w28 AS c28,
    count(*) OVER wall AS history_days FROM daily WINDOW
    w7 AS (PARTITION BY zone ORDER BY delivery_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w28 AS (PARTITION BY zone ORDER BY delivery_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW),
    wall AS (PARTITION BY zone ORDER BY delivery_date ROWS UNBOUNDED PRECEDING))"""
ROLLING = ("rolling_7d_mae", "rolling_7d_baseline_exaa_mae", "rolling_28d_picp")


@query(
    "rolling_monitoring",
    "W5 W6 W7 M9 O5",
    with_ctes(
        DAILY_CTE,
        _ROLLING_CTE,
        select="""SELECT zone, delivery_date, history_days, round(r7, 6) AS rolling_7d_mae,
  round(b7, 6) AS rolling_7d_baseline_exaa_mae, round(c28, 6) AS rolling_28d_picp FROM rolled""",
    ),
)
def rolling_monitoring(spark, folder):
    rolled = rolling_metrics(_daily(spark, folder), entity=["zone"])
    return _rounded(rolled, ROLLING).select("zone", "delivery_date", "history_days", *ROLLING)


@query(
    "drift_rules",
    "M10 X15",
    with_ctes(
        DAILY_CTE,
        _ROLLING_CTE,
        f"""found AS (SELECT zone, delivery_date, concat_ws('; ',
    CASE WHEN data_outlier_rate > 0.2::DOUBLE THEN '{DRIFT_REASONS["inputs"]}' END,
    CASE WHEN abs(prediction_mean_z) > 4 THEN '{DRIFT_REASONS["output"]}' END,
    CASE WHEN history_days >= 7 AND r7 > 1.5 * reference_mae THEN '{DRIFT_REASONS["model"]}' END,
    CASE WHEN history_days >= 7 AND r7 > b7 THEN '{DRIFT_REASONS["reference"]}' END,
    CASE WHEN history_days >= 14 AND c28 < 0.9::DOUBLE - 0.1::DOUBLE
      THEN '{DRIFT_REASONS["coverage"]}' END) AS monitoring_reasons FROM rolled)""",
        select="""SELECT *, CASE WHEN monitoring_reasons = '' THEN 'ok' ELSE 'alert' END
  AS monitoring_status FROM found""",
    ),
)
def drift_rules(spark, folder):
    assessed = assess_drift(_daily(spark, folder), entity=["zone"])
    return assessed.select("zone", "delivery_date", "monitoring_status", "monitoring_reasons")


DIMENSIONS = 64


def _vectors(spark, folder):
    names = {f"e{i}": F.col("embedding")[i].cast("double") for i in range(DIMENSIONS)}
    return s.table(spark, folder, "embeddings").select(
        "vec_id", "label", *(value.alias(name) for name, value in names.items())
    )


@query(
    "input_drift",
    "M11 A12 A18 X14",
    """WITH cells AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i
  FROM embeddings),
stats AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END AS s
  FROM cells WHERE label = 0 GROUP BY 1),
z AS (SELECT label, i, (v - m) / s AS z FROM cells JOIN stats USING (i)),
per AS (SELECT label, i, avg(z) AS mean_z, count(*) FILTER (WHERE abs(z) > 4) AS far, count(*) AS n
  FROM z GROUP BY 1, 2)
SELECT label, round(sum(far) / sum(n), 6) AS data_outlier_rate,
  round(max(abs(mean_z)), 6) AS max_feature_mean_z,
  round(max(CASE WHEN i = 0 THEN mean_z END), 6) AS prediction_mean_z FROM per GROUP BY 1""",
)
def input_drift_query(spark, folder):
    """Vectors of one label are the training rows, every label is a day to score."""
    rows = _vectors(spark, folder)
    columns = {f"e{i}": F.col(f"e{i}") for i in range(DIMENSIONS)}
    trained = rows.where(F.col("label") == 0).agg(*feature_statistics(columns)).first()
    fixed = {
        name: (F.lit(trained[f"{name}__mean"]), F.lit(trained[f"{name}__scale"]))
        for name in columns
    }
    drift = input_drift(
        rows, columns, fixed, ["label"], point=F.col("e0"), target_statistics=fixed["e0"]
    )
    return _rounded(drift, ["data_outlier_rate", "max_feature_mean_z", "prediction_mean_z"])


# Observed and predicted shifts in whole units.
SHIFT_CTE = f"""{s.LINEITEM_CTE},
sh AS (SELECT *, value - l_partkey % 50 AS actual, (l_suppkey % 41 - 20)::DOUBLE AS predicted FROM li)"""


def _shifts(spark, folder):
    return s.lineitem_quarters(spark, folder).select(
        "*",
        (F.col("value") - F.col("l_partkey") % 50).alias("actual"),
        (F.col("l_suppkey") % 41 - 20).cast("double").alias("predicted"),
    )


SHIFT = (
    "mae",
    "rmse",
    "direction_accuracy_pct",
    "material_mae",
    "material_recall_pct",
    "beat_exaa_pct",
    "mean_absolute_correction",
)
_SHIFT_SQL = """round(avg(abs(predicted - actual)), 6) AS mae,
  round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse,
  round(avg(CASE WHEN actual <> 0 THEN (sign(predicted) = sign(actual))::INT END) * 100, 6)
    AS direction_accuracy_pct,
  round(avg(CASE WHEN abs(actual) >= 10 THEN abs(predicted - actual) END), 6) AS material_mae,
  round(avg(CASE WHEN abs(actual) >= 10
    THEN (sign(predicted) = sign(actual) AND abs(predicted) >= 10)::INT END) * 100, 6)
    AS material_recall_pct,
  round(avg((abs(predicted - actual) < abs(actual))::INT) * 100, 6) AS beat_exaa_pct,
  round(avg(abs(predicted)), 6) AS mean_absolute_correction"""


@query(
    "shift_metrics",
    "M12 K11 A13",
    with_ctes(SHIFT_CTE, select=f"SELECT l_suppkey, {_SHIFT_SQL} FROM sh GROUP BY 1"),
)
def shift_metrics_query(spark, folder):
    rows = _shifts(spark, folder).groupBy("l_suppkey").agg(*shift_metrics("actual", "predicted"))
    return _rounded(rows, SHIFT)


@query(
    "daily_gain",
    "M14",
    with_ctes(
        SHIFT_CTE,
        select="""SELECT series, round(avg(gain), 6) AS mae_gain, count(*) AS days FROM (
  SELECT series, delivery_date, avg(abs(actual) - abs(predicted - actual)) AS gain FROM sh GROUP BY 1, 2)
GROUP BY 1""",
    ),
)
def daily_gain(spark, folder):
    gains = daily_gains(_shifts(spark, folder), "actual", "predicted", by=["series"])
    return gains.groupBy("series").agg(
        F.round(F.avg("gain"), 6).alias("mae_gain"), F.count(F.lit(1)).alias("days")
    )


SAMPLES = BOOTSTRAP_SAMPLES
EVENT_SHIFT_CTE = f"""{s.events_cte(s.WINTER)},
sh AS (SELECT event_type, delivery_date, floor(value / 100) - user_id % 50 AS actual,
  (event_id % 41 - 20)::DOUBLE AS predicted FROM ev)"""


def _event_shifts(spark, folder):
    return s.events(spark, folder, s.WINTER).select(
        "event_type",
        "delivery_date",
        (F.floor(F.col("value") / 100) - F.col("user_id") % 50).cast("double").alias("actual"),
        (F.col("event_id") % 41 - 20).cast("double").alias("predicted"),
    )


def _bootstrap_sql(source: str, by: str, name: str = "ci") -> str:
    return f"""{name}_days AS (
  SELECT {by}, gain, row_number() OVER (PARTITION BY {by} ORDER BY delivery_date) - 1 AS slot,
    count(*) OVER (PARTITION BY {by}) AS n FROM (
      SELECT {by}, delivery_date, avg(abs(actual) - abs(predicted - actual)) AS gain
      FROM {source} GROUP BY ALL)),
{name}_draws AS (
  SELECT d.{by}, r.sample, ('0x' || substr(md5('42:' || r.sample || ':' || d.slot), 1, 8))::BIGINT % d.n
    AS pick FROM {name}_days d CROSS JOIN range({SAMPLES}) r(sample)),
{name}_means AS (
  SELECT w.{by}, w.sample, avg(d.gain) AS m FROM {name}_draws w
  JOIN {name}_days d ON d.{by} = w.{by} AND d.slot = w.pick GROUP BY 1, 2),
{name} AS (
  SELECT {by}, round((SELECT avg(gain) FROM {name}_days d WHERE d.{by} = m.{by}), 6) AS mae_gain,
    round(quantile_cont(m, 0.025), 6) AS mae_gain_ci_low,
    round(quantile_cont(m, 0.975), 6) AS mae_gain_ci_high FROM {name}_means m GROUP BY 1)"""


@query(
    "bootstrap_gain_ci",
    "M13 A14",
    with_ctes(EVENT_SHIFT_CTE, _bootstrap_sql("sh", "event_type"), select="SELECT * FROM ci"),
)
def bootstrap_gain_ci(spark, folder):
    gains = daily_gains(_event_shifts(spark, folder), "actual", "predicted", by=["event_type"])
    interval = gain_interval(gains, by=["event_type"], samples=SAMPLES)
    return _rounded(interval, ["mae_gain", "mae_gain_ci_low", "mae_gain_ci_high"])


@query(
    "loss_table",
    "M15 M13 M12 T5",
    with_ctes(
        EVENT_SHIFT_CTE.replace("event_type, delivery_date", "event_type AS point_loss, delivery_date"),
        """hold AS (SELECT * FROM sh WHERE delivery_date >= DATE '2024-01-16')""",
        _bootstrap_sql("hold", "point_loss"),
        f"metrics AS (SELECT point_loss, {_SHIFT_SQL} FROM hold GROUP BY 1)",
        """cv AS (SELECT point_loss, round(avg(abs(predicted - actual)), 6) AS cv_mae FROM sh
  WHERE delivery_date < DATE '2024-01-16' GROUP BY 1)""",
        select="""SELECT point_loss, cv_mae, mae AS holdout_sdac_mae, rmse AS holdout_rmse,
  direction_accuracy_pct, material_mae, material_recall_pct, beat_exaa_pct, mean_absolute_correction,
  mae_gain AS mae_gain_vs_exaa, mae_gain_ci_low, mae_gain_ci_high
FROM cv JOIN metrics USING (point_loss) JOIN ci USING (point_loss)""",
    ),
)
def loss_table(spark, folder):
    early = F.col("delivery_date") < F.lit("2024-01-16").cast("date")
    rows = _event_shifts(spark, folder).select(
        F.col("event_type").alias("point_loss"),
        F.when(early, "validation").otherwise("holdout").alias("split"),
        "delivery_date",
        "actual",
        "predicted",
    )
    table = loss_comparison(rows, samples=SAMPLES)
    return _rounded(table, [c for c in table.columns if c != "point_loss"])


_SCORE = "greatest(lower - target, target - upper)"


@query(
    "conformal_adjustment",
    "L3 A15",
    with_ctes(
        FORECAST_CTE,
        f"""ranked AS (SELECT series, {_SCORE} AS score,
  row_number() OVER (PARTITION BY series ORDER BY {_SCORE}) - 1 AS r,
  count(*) OVER (PARTITION BY series) AS n FROM f)""",
        select="""SELECT series, score AS adjustment FROM ranked
WHERE r = least(n - 1, CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT) - 1)""",
    ),
)
def conformal_adjustment_query(spark, folder):
    return conformal_adjustment(
        _forecasts(spark, folder), "target", "lower", "upper", coverage=0.9, by=["series"]
    )


@query(
    "order_statistic",
    "A15 A14",
    """SELECT price AS order_statistic FROM (SELECT l_extendedprice AS price,
  row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem)
WHERE r = least(n - 1, CAST(ceil((n + 1) * 0.95::DOUBLE) AS BIGINT) - 1)""",
)
def order_statistic_query(spark, folder):
    return order_statistic(
        s.table(spark, folder, "lineitem"), "l_extendedprice", conformal_rank(0.95)
    )


_SHRINK_CTE = """errors AS (SELECT series, step, round(avg(abs(step / 100.0::DOUBLE * predicted - actual)), 6)
  AS mae FROM sh CROSS JOIN range(101) r(step) GROUP BY 1, 2)"""


@query(
    "shrinkage_grid",
    "L6 L5",
    with_ctes(
        SHIFT_CTE,
        _SHRINK_CTE,
        select="SELECT series, step, mae, step / 100.0::DOUBLE AS shrinkage FROM errors",
    ),
)
def shrinkage_grid(spark, folder):
    errors = shrinkage_errors(_shifts(spark, folder), "predicted", "actual", by=["series"])
    return _rounded(errors, ["mae"])


@query(
    "best_shrinkage",
    "L6 O6",
    with_ctes(
        SHIFT_CTE,
        _SHRINK_CTE,
        select="""SELECT series, step / 100.0::DOUBLE AS shrinkage, mae FROM errors
QUALIFY row_number() OVER (PARTITION BY series ORDER BY mae, step) = 1""",
    ),
)
def best_shrinkage_query(spark, folder):
    errors = shrinkage_errors(_shifts(spark, folder), "predicted", "actual", by=["series"])
    return best_shrinkage(_rounded(errors, ["mae"]), by=["series"])


@query(
    "interval_assembly",
    "L4 L5 X14",
    with_ctes(
        FORECAST_CTE,
        select="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reference + point * 0.5 AS p,
  reference + least(least(lower, upper - 30) - (l_suppkey % 7 - 3), point * 0.5) AS lo,
  reference + greatest(greatest(lower, upper - 30) + (l_suppkey % 7 - 3), point * 0.5) AS hi FROM f""",
    ),
)
def interval_assembly(spark, folder):
    columns = assemble_interval(
        F.col("point") * 0.5,
        F.col("lower"),
        F.col("upper") - 30,
        F.col("l_suppkey") % 7 - 3,
        F.col("reference"),
    )
    names = zip(("p", "lo", "hi"), columns, strict=True)
    return _forecasts(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c.alias(n) for n, c in names)
    )


_GATE = PROMOTION_REASONS


@query(
    "promotion_gate",
    "L9 X15 M5",
    with_ctes(
        FORECAST_CTE,
        """candidate AS (SELECT l_suppkey, avg(abs(point - target)) AS mae,
  avg(CASE WHEN target BETWEEN lower - 30 AND upper + 20 THEN 1.0::DOUBLE ELSE 0 END) AS picp,
  avg(upper - lower) AS score, avg(abs(reference - target)) AS base,
  CASE WHEN l_suppkey % 3 > 0 THEN avg(abs(lag7 - target)) END AS pmae,
  CASE WHEN l_suppkey % 3 > 0 THEN (l_suppkey % 40)::DOUBLE END AS pscore FROM f GROUP BY 1)""",
        select=f"""SELECT l_suppkey, concat_ws('; ', CASE WHEN mae >= base THEN '{_GATE["reference"]}' END,
  CASE WHEN picp < 0.9::DOUBLE - 0.02::DOUBLE THEN '{_GATE["coverage"]}' END,
  CASE WHEN mae >= pmae THEN '{_GATE["mae"]}' END,
  CASE WHEN score >= pscore THEN '{_GATE["interval"]}' END) AS reasons FROM candidate""",
    ),
)
def promotion_gate(spark, folder):
    target = F.col("target")
    inside = (target >= F.col("lower") - 30) & (target <= F.col("upper") + 20)
    compared = F.col("l_suppkey") % 3 > 0
    models = _forecasts(spark, folder).groupBy("l_suppkey").agg(
        mean_absolute(F.col("point") - target).alias("mae"),
        F.avg(inside.cast("double")).alias("picp"),
        F.avg(F.col("upper") - F.col("lower")).alias("interval_score"),
        mean_absolute(F.col("reference") - target).alias("base"),
        mean_absolute(F.col("lag7") - target).alias("production"),
    )
    found = promotion_reasons(
        {c: F.col(c) for c in ("mae", "picp", "interval_score")},
        F.col("base"),
        {
            "mae": F.when(compared, F.col("production")),
            "interval_score": F.when(compared, (F.col("l_suppkey") % 40).cast("double")),
        },
    )
    return models.select("l_suppkey", F.array_join(found, "; ").alias("reasons"))
