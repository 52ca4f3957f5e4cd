"""Evaluation and read-view queries on a published forecast history."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from parity import supplied as s
from parity import features
from parity.registry import CATALOG as ALL
from parity.registry import query, with_ctes
from quartergrid.market import (
    AUSTRIA,
    CALENDAR_COLUMNS,
    DRIFT_REASONS,
    LAG_7D,
    LOWER,
    MARKET_FEATURES,
    POINT,
    REFERENCE,
    TARGET,
    UPPER,
    WEATHER_FIELDS,
    WEATHER_LOCATIONS,
    Placement,
    WideLayout,
)
from quartergrid.operators.metrics import DAILY_METRICS
from quartergrid.operators.monitoring import ROLLING
from quartergrid.operators.normalise import normalise_quarters
from quartergrid.operators.wide import pivot_columns, place_series
from quartergrid.plans import evaluate as e
from quartergrid.plans import views as v
from quartergrid.session import durable, shared_folder
from quartergrid.sources.tables import DayTable

PRICES = ("de_lu.price.sdac", "de_lu.price.exaa")
PRICE_LAYOUT = WideLayout(
    target=TARGET,
    target_placements=(Placement(PRICES[0], TARGET),),
    features=(Placement(PRICES[1], REFERENCE),),
)


def _prices(spark, folder):
    return s.measurements(spark, folder, s.AUTUMN, PRICES)


def _wide(spark, folder, prices=None):
    """Settled prices on the 96-quarter grid; every ninth day is not settled yet."""
    intervals = normalise_quarters(_prices(spark, folder) if prices is None else prices)
    wide = pivot_columns(place_series(intervals, PRICE_LAYOUT), [TARGET, REFERENCE])
    settled = F.dayofyear("delivery_date") % 9 != 0
    lag = F.col("quarter_of_day") * 3 + F.dayofmonth("delivery_date")
    return wide.withColumns(
        {
            TARGET: F.when(settled, F.col(TARGET)),
            LAG_7D: lag.cast("double"),
            AUSTRIA: F.col(REFERENCE) - 5,
        }
    )


def _forecasts(spark, folder, wide=None):
    """Published forecasts; none are made for Sundays, and every fourth day is late."""
    wide = _wide(spark, folder) if wide is None else wide
    day, quarter = F.col("delivery_date"), F.col("quarter_of_day")
    doy = F.dayofyear(day)
    late = doy % 4 == 0
    hour = F.unix_timestamp(F.date_add(day, F.when(late, 1).otherwise(-1)).cast("timestamp"))
    point = F.floor(F.col(REFERENCE)) + quarter % 7 - 3
    return (
        wide.where(F.weekday(day) != 6)
        .select(
            "delivery_date",
            "quarter_of_day",
            point.cast("double").alias(POINT),
            (point - quarter % 11).cast("double").alias(LOWER),
            (point + quarter % 13 * 2).cast("double").alias(UPPER),
            F.lit(0.9).alias("nominal_coverage"),
            F.concat(F.lit("v"), doy % 3).alias("model_version"),
            F.timestamp_seconds(hour + 9 * 3600).alias("predicted_at"),
            F.when(late, "retrospective").otherwise("operational").alias("forecast_kind"),
        )
    )


def _published(spark, folder):
    """Prices, inputs and forecasts as stored tables, which is what an evaluation reads."""
    prices = durable(_prices(spark, folder))
    wide = durable(_wide(spark, folder, prices))
    return prices, wide, durable(_forecasts(spark, folder, wide))


SETTLED_CTE = f"""{s.measurements_cte(s.AUTUMN, PRICES)},
{s.normalised_cte()},
wide AS (
  SELECT delivery_date, quarter_of_day,
    CASE WHEN dayofyear(delivery_date) % 9 <> 0
      THEN max(CASE WHEN series = '{PRICES[0]}' THEN value END) END AS {TARGET},
    max(CASE WHEN series = '{PRICES[1]}' THEN value END) AS {REFERENCE},
    (quarter_of_day * 3 + day(delivery_date))::DOUBLE AS {LAG_7D},
    max(CASE WHEN series = '{PRICES[1]}' THEN value END) - 5 AS {AUSTRIA}
  FROM filled GROUP BY 1, 2),
fc AS (
  SELECT delivery_date, quarter_of_day, p::DOUBLE AS {POINT}, (p - quarter_of_day % 11)::DOUBLE AS {LOWER},
    (p + quarter_of_day % 13 * 2)::DOUBLE AS {UPPER}, 0.9::DOUBLE AS nominal_coverage,
    'v' || dayofyear(delivery_date) % 3 AS model_version,
    CAST(delivery_date AS TIMESTAMP) + CASE WHEN dayofyear(delivery_date) % 4 = 0 THEN INTERVAL 33 HOUR
      ELSE INTERVAL '-15' HOUR END AS predicted_at,
    CASE WHEN dayofyear(delivery_date) % 4 = 0 THEN 'retrospective' ELSE 'operational' END
      AS forecast_kind
  FROM (SELECT *, floor({REFERENCE}) + quarter_of_day % 7 - 3 AS p FROM wide
    WHERE isodow(delivery_date) <> 7))"""


def _metric_sql(prefix: str = "") -> str:
    return f"""avg(abs({POINT} - {TARGET})) AS {prefix}mae,
  sqrt(avg(({POINT} - {TARGET}) * ({POINT} - {TARGET}))) AS {prefix}rmse,
  avg(CASE WHEN {TARGET} BETWEEN {LOWER} AND {UPPER} THEN 1.0::DOUBLE ELSE 0 END) AS {prefix}picp,
  avg({UPPER} - {LOWER}) AS {prefix}mpiw,
  avg({UPPER} - {LOWER}
    + CASE WHEN {TARGET} < {LOWER} THEN 2 / (1 - 0.9::DOUBLE) * ({LOWER} - {TARGET}) ELSE 0 END
    + CASE WHEN {TARGET} > {UPPER} THEN 2 / (1 - 0.9::DOUBLE) * ({TARGET} - {UPPER}) ELSE 0 END)
    AS {prefix}interval_score,
  avg({POINT} - {TARGET}) AS {prefix}bias,
  avg(abs({REFERENCE} - {TARGET})) AS {prefix}baseline_exaa_mae,
  avg(abs({LAG_7D} - {TARGET})) AS {prefix}baseline_7d_mae"""


GRIDS_CTE = f"""{SETTLED_CTE},
joined AS (
  SELECT fc.*, {TARGET}, {REFERENCE}, {LAG_7D} FROM fc JOIN wide USING (delivery_date, quarter_of_day)
  WHERE {TARGET} IS NOT NULL),
physical AS (
  SELECT t.delivery_date, t.value AS {TARGET}, x.value AS {REFERENCE}, {LAG_7D}, {POINT}, {LOWER}, {UPPER}
  FROM src t JOIN src x ON t.delivery_date = x.delivery_date AND t.start_utc = x.start_utc
    AND t.series = '{PRICES[0]}' AND x.series = '{PRICES[1]}'
  JOIN joined j ON j.delivery_date = t.delivery_date
    AND j.quarter_of_day = {s.quarter_sql('t.start_utc')}),
both_grids AS (
  SELECT * FROM (SELECT delivery_date, {_metric_sql()}, count(*) AS physical_rows FROM physical GROUP BY 1)
  JOIN (SELECT delivery_date, {_metric_sql('normalized_96_')} FROM joined GROUP BY 1)
  USING (delivery_date))"""
ALL_METRICS = (*DAILY_METRICS, *(f"normalized_96_{c}" for c in DAILY_METRICS))
_ROUNDED_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in ALL_METRICS)


@query(
    "physical_vs_normalised",
    "M7 M8 J12 J13 Q11",
    with_ctes(
        GRIDS_CTE,
        select=f"""SELECT delivery_date, {_ROUNDED_SQL}, physical_rows,
  {s.slots_sql('delivery_date')} AS expected_rows FROM both_grids""",
    ),
)
def physical_vs_normalised(spark, folder):
    prices, wide, forecasts = _published(spark, folder)
    rows = e.forecast_rows(forecasts, wide).where(F.col(TARGET).isNotNull())
    metrics = e.grid_metrics(e.physical_rows(prices, rows), rows)
    return metrics.withColumns({c: F.round(c, 6) for c in ALL_METRICS})


def _history(spark, folder):
    """Earlier daily metrics, forty days before each event day."""
    days = s.events(spark, folder, s.AUTUMN).select("delivery_date").distinct()
    doy = F.dayofyear("delivery_date")
    return days.select(
        F.date_add("delivery_date", -40).alias("delivery_date"),
        F.lit("v0").alias("model_version"),
        F.when(doy % 5 == 0, "retrospective").otherwise("operational").alias("forecast_kind"),
        (doy % 20).cast("double").alias("mae"),
        (doy % 13).cast("double").alias("baseline_exaa_mae"),
        (doy % 10 / 10.0).alias("picp"),
    )


def _model_runs(forecasts):
    doy = F.dayofyear("delivery_date")
    return forecasts.groupBy("delivery_date").agg(
        F.min("model_version").alias("model_version"),
        F.min("forecast_kind").alias("forecast_kind"),
        F.first(doy % 10 / 30.0).alias("data_outlier_rate"),
        F.first((doy % 11 - 5).cast("double")).alias("prediction_mean_z"),
    )


def _model_mae(spark, folder):
    return s.table(spark, folder, "region").select(
        F.concat(F.lit("v"), F.col("r_regionkey")).alias("model_version"),
        (F.col("r_regionkey") * 150 + 40).cast("double").alias("reference_mae"),
    ).where(F.col("model_version") != "v1")


@query(
    "evaluate_days",
    "M8 M9 M10 J12 J13 W5 W6 W7 A16 T4 Q10",
    with_ctes(
        GRIDS_CTE,
        f"""fresh AS (SELECT b.*, r.model_version, r.forecast_kind, r.o, r.z FROM both_grids b JOIN (
  SELECT delivery_date, min(model_version) AS model_version, min(forecast_kind) AS forecast_kind,
    dayofyear(delivery_date) % 10 / 30.0::DOUBLE AS o, dayofyear(delivery_date) % 11 - 5 AS z
  FROM fc GROUP BY 1) r USING (delivery_date)),
series_ AS (
  SELECT delivery_date, 'v0' AS model_version, mae, baseline_exaa_mae, picp, NULL AS o, NULL AS z,
    false AS is_new FROM (
    SELECT delivery_date - 40 AS delivery_date, (dayofyear(delivery_date) % 20)::DOUBLE AS mae,
      (dayofyear(delivery_date) % 13)::DOUBLE AS baseline_exaa_mae,
      dayofyear(delivery_date) % 10 / 10.0::DOUBLE AS picp FROM days
    WHERE dayofyear(delivery_date) % 5 <> 0)
  UNION ALL SELECT delivery_date, model_version, mae, baseline_exaa_mae, picp, o, z, true FROM fresh
  WHERE forecast_kind = 'operational'),
rolled AS (
  SELECT *, avg(mae) OVER w7 AS r7, avg(baseline_exaa_mae) OVER w7 AS b7, avg(picp) OVER w28 AS c28,
    count(*) OVER wall AS n FROM series_ LEFT JOIN (
      SELECT 'v' || r_regionkey AS model_version, (r_regionkey * 150 + 40)::DOUBLE AS ref FROM region
      WHERE r_regionkey <> 1) USING (model_version) WINDOW
    w7 AS (ORDER BY delivery_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w28 AS (ORDER BY delivery_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW),
    wall AS (ORDER BY delivery_date ROWS UNBOUNDED PRECEDING)),
judged AS (SELECT delivery_date, round(r7, 6) AS rolling_7d_mae,
  round(b7, 6) AS rolling_7d_baseline_exaa_mae, round(c28, 6) AS rolling_28d_picp,
  concat_ws('; ', CASE WHEN o > 0.2::DOUBLE THEN '{DRIFT_REASONS["inputs"]}' END,
    CASE WHEN abs(z) > 4 THEN '{DRIFT_REASONS["output"]}' END,
    CASE WHEN n >= 7 AND r7 > 1.5 * ref THEN '{DRIFT_REASONS["model"]}' END,
    CASE WHEN n >= 7 AND r7 > b7 THEN '{DRIFT_REASONS["reference"]}' END,
    CASE WHEN n >= 14 AND c28 < 0.9::DOUBLE - 0.1::DOUBLE THEN '{DRIFT_REASONS["coverage"]}' END)
    AS found FROM rolled WHERE is_new)""",
        select=f"""SELECT f.delivery_date, f.model_version, f.forecast_kind, {_ROUNDED_SQL},
  rolling_7d_mae, rolling_7d_baseline_exaa_mae, rolling_28d_picp,
  coalesce(found, '') AS monitoring_reasons,
  CASE WHEN found IS NULL THEN 'not_applicable' WHEN found = '' THEN 'ok' ELSE 'alert' END
    AS monitoring_status FROM fresh f LEFT JOIN judged USING (delivery_date)""",
    ),
)
def evaluate_days(spark, folder):
    prices, wide, forecasts = _published(spark, folder)
    evaluated = e.evaluate_days(
        forecasts.select("delivery_date").distinct(),
        forecasts,
        wide,
        prices,
        _model_runs(forecasts),
        _model_mae(spark, folder),
        _history(spark, folder),
    )
    columns = (*ALL_METRICS, *ROLLING)
    return evaluated.drop("evaluated_at").withColumns({c: F.round(c, 6) for c in columns})


@query("evaluate_stored_days", "M7 M8 M9 J12 S8 S9", ALL["evaluate_days"].sql)
def evaluate_stored_days(spark, folder):
    """Stored tables evaluated in two runs, the second with the first one's rows as history."""
    prices, wide, forecasts = _published(spark, folder)
    base = f"{shared_folder(spark)}/{uuid4().hex}"
    tables = []
    for name, rows in (("forecasts", forecasts), ("wide", wide), ("prices", prices)):
        tables.append(DayTable(spark, f"{base}/{name}", rows.schema))
        tables[-1].append(rows)
    others = _model_runs(forecasts), _model_mae(spark, folder)
    history = _history(spark, folder)
    days = tables[0].read().select("delivery_date").distinct()
    schema = e.evaluate_days(days, *(table.read() for table in tables), *others, history).schema
    metrics = DayTable(spark, f"{base}/metrics", schema)
    metrics.append(spark.createDataFrame([], schema).unionByName(history, allowMissingColumns=True))
    middle = days.agg(F.min("delivery_date"), F.max("delivery_date")).first()
    early = F.col("delivery_date") < F.lit(middle[0] + (middle[1] - middle[0]) / 2)
    for part in (early, ~early):
        e.evaluate_stored(days.where(part), *tables, *others, metrics)
    found = metrics.read().join(days, "delivery_date", "left_semi").drop("evaluated_at")
    return found.withColumns({c: F.round(c, 6) for c in (*ALL_METRICS, *ROLLING)})


def _metrics(spark, folder):
    """Stored daily metrics of working days."""
    days = s.events(spark, folder, s.AUTUMN).select("delivery_date").distinct()
    doy = F.dayofyear("delivery_date")
    names = (*ALL_METRICS, *ROLLING)
    return days.where(F.weekday("delivery_date") < 5).select(
        "delivery_date",
        *((doy + i).cast("double").alias(c) for i, c in enumerate(names)),
        F.when(doy % 4 == 0, "retrospective").otherwise("operational").alias("forecast_kind"),
        F.when(doy % 4 == 0, "not_applicable").when(doy % 3 == 0, "ok").otherwise("alert").alias(
            "monitoring_status"
        ),
        F.when(doy % 3 == 0, "").otherwise("first; second").alias("monitoring_reasons"),
        F.date_add("delivery_date", 1).cast("timestamp").alias("evaluated_at"),
    )


METRICS_CTE = f"""{SETTLED_CTE},
metrics AS (
  SELECT delivery_date, {", ".join(f"(dayofyear(delivery_date) + {i})::DOUBLE AS {c}"
    for i, c in enumerate((*ALL_METRICS, *ROLLING)))},
    CASE WHEN dayofyear(delivery_date) % 4 = 0 THEN 'retrospective' ELSE 'operational' END
      AS forecast_kind,
    CASE WHEN dayofyear(delivery_date) % 4 = 0 THEN 'not_applicable'
      WHEN dayofyear(delivery_date) % 3 = 0 THEN 'ok' ELSE 'alert' END AS monitoring_status,
    CASE WHEN dayofyear(delivery_date) % 3 = 0 THEN '' ELSE 'first; second' END AS monitoring_reasons,
    CAST(delivery_date + 1 AS TIMESTAMP) AS evaluated_at
  FROM days WHERE isodow(delivery_date) <= 5)"""

DAYS_SQL = f"""indexed AS (
  SELECT coalesce(f.delivery_date, a.delivery_date) AS delivery_date, f.model_version, f.predicted_at,
    coalesce(f.n, 0) = 96 AS has_forecast, coalesce(a.settled, 0) = 96 AS has_actual,
    m.evaluated_at IS NOT NULL AS has_metrics, coalesce(a.settled, 0) = 96 AS settled,
    m.mae, m.picp, m.monitoring_status
  FROM (SELECT delivery_date, max(model_version) AS model_version, max(predicted_at) AS predicted_at,
      count(*) AS n FROM fc GROUP BY 1) f
  FULL JOIN (SELECT delivery_date, count({TARGET}) AS settled, count(*) AS n FROM wide GROUP BY 1) a
    USING (delivery_date)
  LEFT JOIN metrics m ON m.delivery_date = coalesce(f.delivery_date, a.delivery_date)
  WHERE f.n = 96 OR a.n = 96)"""


def _index(spark, folder):
    return v.day_index(_forecasts(spark, folder), _wide(spark, folder), _metrics(spark, folder))


@query(
    "day_index",
    "V1 A11 J9 J10 F14",
    with_ctes(METRICS_CTE, DAYS_SQL, select="SELECT * FROM indexed"),
)
def day_index(spark, folder):
    return _index(spark, folder)


@query(
    "newest_days",
    "O3 X19 V1",
    with_ctes(
        METRICS_CTE,
        DAYS_SQL,
        select="""SELECT delivery_date, CASE WHEN NOT has_forecast THEN 'Historical observation'
  WHEN settled THEN 'Settled' ELSE 'Forecast only' END AS status FROM indexed
ORDER BY delivery_date DESC LIMIT 14""",
    ),
)
def newest_days(spark, folder):
    days = v.newest_days(_index(spark, folder), 14)
    status = v.day_status(F.col("has_forecast"), F.col("settled"))
    return days.select("delivery_date", status.alias("status"))


@query(
    "forecast_day_view",
    "V2 J11 X15",
    with_ctes(
        METRICS_CTE,
        select=f"""SELECT fc.*, {TARGET} AS actual_price_eur_per_mwh,
  {", ".join((*ALL_METRICS, *ROLLING))}, monitoring_status,
  replace(monitoring_reasons, '; ', '|') AS monitoring_reasons, evaluated_at
FROM fc LEFT JOIN wide USING (delivery_date, quarter_of_day)
LEFT JOIN (SELECT * EXCLUDE (forecast_kind) FROM metrics) USING (delivery_date)""",
    ),
)
def forecast_day_view(spark, folder):
    rows = v.forecast_view(
        _forecasts(spark, folder), _wide(spark, folder), _metrics(spark, folder)
    )
    return rows.withColumn("monitoring_reasons", F.array_join("monitoring_reasons", "|"))


@query(
    "observation_view",
    "V5 F1",
    with_ctes(
        SETTLED_CTE,
        select=f"""SELECT delivery_date, quarter_of_day, {TARGET} AS actual_price_eur_per_mwh, {REFERENCE},
  {AUSTRIA} FROM wide""",
    ),
)
def observation_view(spark, folder):
    return v.observation_view(_wide(spark, folder))


@query(
    "price_points",
    "V8 J16",
    with_ctes(
        SETTLED_CTE,
        select=f"""SELECT delivery_date, quarter_of_day, {TARGET} AS actual, {POINT} AS forecast,
  {LOWER} AS low, {UPPER} AS high, CASE WHEN quarter_of_day < 80 THEN {REFERENCE} END AS exaa,
  CASE WHEN quarter_of_day < 80 THEN {AUSTRIA} END AS austria
FROM fc LEFT JOIN wide USING (delivery_date, quarter_of_day)""",
    ),
)
def price_points(spark, folder):
    wide = _wide(spark, folder)
    rows = v.forecast_view(_forecasts(spark, folder), wide, _metrics(spark, folder))
    points = v.price_points(rows, wide.where(F.col("quarter_of_day") < 80))
    return points.select(
        "*", F.col("interval")[0].alias("low"), F.col("interval")[1].alias("high")
    ).drop("interval")


@query(
    "latest_state",
    "V6 I10 J15 O4",
    with_ctes(
        METRICS_CTE,
        select="""SELECT (SELECT max(delivery_date) FROM fc) AS latest_forecast_date,
  (SELECT max(delivery_date) FROM metrics) AS latest_settlement_date,
  (SELECT model_version FROM fc ORDER BY delivery_date DESC LIMIT 1) AS model_version,
  (SELECT monitoring_status FROM metrics WHERE forecast_kind = 'operational'
    ORDER BY delivery_date DESC LIMIT 1) AS monitoring_status""",
    ),
)
def latest_state(spark, folder):
    forecasts = _forecasts(spark, folder)
    return v.latest_state(forecasts, _model_runs(forecasts), _metrics(spark, folder))


# Wide market inputs for the feature views.
NAMES = ("load", "solar", "wind_onshore", "wind_offshore")
TAILS = ("forecast_delivery_d_minus_1_mw", "actual_d_minus_2_mw")
POWER = [f"{name}_{tail}" for tail in TAILS for name in NAMES]
PLACES = [p[0] for p in WEATHER_LOCATIONS]
SHOWN = [(field, column) for field, column, _ in WEATHER_FIELDS if field in v.MEAN_FIELDS]
FIELDS = tuple(column for _, column in SHOWN)


def _power_series(i: int) -> str:
    return s.FEATURE_SERIES[3 + i]


@query(
    "fundamentals_gw",
    "V9 X18",
    with_ctes(
        s.measurements_cte(s.AUTUMN),
        s.normalised_cte(),
        f"""power AS (SELECT delivery_date, quarter_of_day, {", ".join(
            f"max(CASE WHEN series = '{_power_series(i)}' THEN value END) AS {c}"
            for i, c in enumerate(POWER))} FROM filled GROUP BY 1, 2)""",
        select="SELECT delivery_date, quarter_of_day, "
        + ", ".join(
            f"load_{tail} / 1000 AS load_{kind}_gw, (solar_{tail} + wind_onshore_{tail} "
            f"+ wind_offshore_{tail}) / 1000 AS generation_{kind}_gw"
            for kind, tail in zip(("forecast", "prior"), TAILS, strict=True)
        )
        + " FROM power",
    ),
)
def fundamentals_gw(spark, folder):
    intervals = normalise_quarters(s.measurements(spark, folder, s.AUTUMN))
    layout = WideLayout(
        target=POWER[0],
        target_placements=(Placement(_power_series(0), POWER[0]),),
        features=tuple(Placement(_power_series(i), c) for i, c in enumerate(POWER) if i),
    )
    return v.fundamentals(pivot_columns(place_series(intervals, layout), POWER))


WEATHER = {
    f"weather_{place}_{column}": f"weather.{place}.{field}"
    for place in PLACES
    for field, column in SHOWN
}
MEANS_CTE = f"""{s.measurements_cte(s.AUTUMN)},
{s.normalised_cte()},
cells AS (SELECT delivery_date, quarter_of_day, {", ".join(
    f"max(CASE WHEN series = '{series}' THEN value END) AS {c}" for c, series in WEATHER.items())}
  FROM filled GROUP BY 1, 2),
means AS (SELECT delivery_date, quarter_of_day, {", ".join(
    "round((" + " + ".join(f"weather_{p}_{f}" for p in PLACES) + f") / 25, 6) AS {f}"
    for f in FIELDS)} FROM cells)"""


def _means(spark, folder):
    intervals = normalise_quarters(s.measurements(spark, folder, s.AUTUMN))
    first, *rest = WEATHER.items()
    layout = WideLayout(
        target=first[0],
        target_placements=(Placement(first[1], first[0]),),
        features=tuple(Placement(series, c) for c, series in rest),
    )
    wide = pivot_columns(place_series(intervals, layout), list(WEATHER))
    means = v.grid_means(wide, locations=PLACES, fields=FIELDS)
    return means.withColumns({c: F.round(c, 6) for c in FIELDS})


@query("grid_means", "V4 A17", with_ctes(MEANS_CTE, select="SELECT * FROM means"))
def grid_means(spark, folder):
    return _means(spark, folder)


@query(
    "weather_ranges",
    "V10 A18",
    with_ctes(
        MEANS_CTE,
        select="SELECT delivery_date, "
        + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in FIELDS)
        + " FROM means GROUP BY 1",
    ),
)
def weather_ranges(spark, folder):
    return v.weather_ranges(_means(spark, folder), FIELDS)


@query(
    "feature_view",
    "V3 F1 X3",
    f"""SELECT * EXCLUDE (delivery_start_local),
  strftime(delivery_start_local, '%Y-%m-%dT%H:%M:%S') AS delivery_start_local
FROM (SELECT {", ".join((*CALENDAR_COLUMNS, *MARKET_FEATURES))} FROM ({ALL["flagship_model_input"].sql}))""",
)
def feature_view(spark, folder):
    return v.feature_view(features.flagship_model_input(spark, folder))


@query(
    "table_page",
    "O7",
    with_ctes(
        s.LINEITEM_CTE,
        select="""SELECT delivery_date, quarter_of_day, n FROM (
  SELECT delivery_date, quarter_of_day, count(*) AS n FROM li GROUP BY 1, 2)
ORDER BY delivery_date, quarter_of_day OFFSET 16 LIMIT 8""",
    ),
)
def table_page(spark, folder):
    rows = s.lineitem_quarters(spark, folder).groupBy("delivery_date", "quarter_of_day").agg(
        F.count(F.lit(1)).alias("n")
    )
    return v.table_page(rows, 2, ("delivery_date", "quarter_of_day"))
