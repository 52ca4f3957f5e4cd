"""Wide table, lag, split and weight queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from parity import supplied as s
from parity.registry import query, with_ctes
from quartergrid.market import (
    MODEL_INPUT,
    MODEL_INPUT_COLUMNS,
    WEATHER_COLUMNS,
    Difference,
    Placement,
    WideLayout,
    weather_column,
)
from quartergrid.operators.calendar import holiday_calendar
from quartergrid.operators.splits import (
    consecutive_days,
    day_arrays,
    day_index,
    sample_weights,
    temporal_roles,
    walk_forward_roles,
)
from quartergrid.operators.wide import (
    add_differences,
    calendar_lags,
    complete_days,
    pivot_columns,
    place_series,
)
from quartergrid.plans.model_input import affected_days, model_input
from quartergrid.sources.tables import named_query

DIRECTIONS = [c for c in WEATHER_COLUMNS if c.endswith("_degrees")]
THROUGH = date(2024, 11, 3)


def _flagship_sql() -> str:
    blocks = ",\n  ".join(
        f"max(CASE WHEN series = '{p.series}' AND shift = {p.shift} THEN value END) AS {p.column}"
        for p in MODEL_INPUT.placements
    )
    shifts = {}
    for p in MODEL_INPUT.placements:
        shifts.setdefault(p.series, []).append(p.shift)
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in shifts.items())
    required = " AND ".join(f"{c} IS NOT NULL" for c in MODEL_INPUT.required)
    derived = ", ".join(
        f"{d.minuend} - {' - '.join(d.subtrahends)} AS {d.column}" for d in MODEL_INPUT.differences
    )
    calendar = """w.quarter_of_day // 4 AS hour, w.quarter_of_day % 4 AS quarter,
  CAST(delivery_date AS TIMESTAMP) + w.quarter_of_day * INTERVAL 15 MINUTE AS delivery_start_local,
  extract(isodow FROM delivery_date) - 1 AS day_of_week, extract(month FROM delivery_date) AS month,
  extract(isodow FROM delivery_date) >= 6 AS is_weekend,
  CASE WHEN extract(month FROM delivery_date) IN (12, 1, 2) THEN 'winter'
    WHEN extract(month FROM delivery_date) IN (3, 4, 5) THEN 'spring'
    WHEN extract(month FROM delivery_date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season"""
    columns = ", ".join(
        f"round({c}, 6) AS {c}" if c in DIRECTIONS else c for c in MODEL_INPUT_COLUMNS
    )
    return with_ctes(
        s.measurements_cte(s.AUTUMN),
        s.normalised_cte(),
        f"""moved AS (
  SELECT delivery_date AS source_date, quarter_of_day, series, value,
    unnest(CASE series {cases} END) AS shift FROM filled),
wide AS (
  SELECT source_date + CAST(shift AS INTEGER) AS delivery_date, quarter_of_day,
  {blocks}
  FROM moved GROUP BY 1, 2),
kept AS (
  SELECT *, count(*) OVER (PARTITION BY delivery_date) AS quarters FROM wide
  WHERE {required} AND delivery_date <= DATE '{THROUGH}')""",
        s.HOLIDAY_CTE,
        f"""dated AS (SELECT w.*, {derived}, {calendar}, is_holiday_de_nationwide, is_holiday_lu
  FROM kept w JOIN holidays USING (delivery_date) WHERE quarters = 96)""",
        select=f"SELECT {columns} FROM dated",
    )


@query(
    "flagship_model_input",
    "K7 K8 A6 J1 J2 J3 J4 J5 W4 F2 F4 F8 X13 X16 K2",
    _flagship_sql(),
)
def flagship_model_input(spark, folder):
    holidays = holiday_calendar(
        s.year_bounds(spark, folder, s.AUTUMN), s.holiday_ranges(spark, folder)
    )
    rows = model_input(
        s.measurements(spark, folder, s.AUTUMN), holidays, through=THROUGH
    )
    return rows.withColumns({c: F.round(c, 6) for c in DIRECTIONS})


PAIRS = ("AF", "AO", "NF", "NO", "RF", "RO")
COLUMNS = tuple(f"series_{p.lower()}" for p in PAIRS)


def _quarter_means(spark, folder):
    return (
        s.lineitem_quarters(spark, folder)
        .groupBy("delivery_date", "quarter_of_day", "series")
        .agg(F.avg("value").alias("value"))
    )


MEANS_CTE = f"""{s.LINEITEM_CTE},
means AS (SELECT delivery_date, quarter_of_day, series, avg(value) AS value FROM li GROUP BY ALL)"""


def _pivot_sql() -> str:
    return ", ".join(
        f"max(CASE WHEN series = '{pair}' THEN value END) AS {column}"
        for pair, column in zip(PAIRS, COLUMNS, strict=True)
    )


WIDE_CTE = f"""{MEANS_CTE},
wide AS (SELECT delivery_date, quarter_of_day, {_pivot_sql()} FROM means GROUP BY ALL)"""

FLAT = WideLayout(
    target=COLUMNS[0],
    target_placements=(Placement(PAIRS[0], COLUMNS[0]),),
    features=tuple(Placement(p, c) for p, c in zip(PAIRS[1:], COLUMNS[1:], strict=True)),
)


def _wide(spark, folder):
    placed = place_series(_quarter_means(spark, folder), FLAT)
    return pivot_columns(placed, COLUMNS)


@query(
    "wide_pivot",
    "A6 F1 F2",
    with_ctes(WIDE_CTE, select="SELECT * FROM wide"),
)
def wide_pivot(spark, folder):
    return _wide(spark, folder)


@query(
    "shifted_blocks",
    "K7 J1 J2 X4",
    with_ctes(
        MEANS_CTE,
        """moved AS (SELECT delivery_date + CASE series WHEN 'AF' THEN 0 WHEN 'NO' THEN 1 ELSE 2 END
  AS delivery_date, quarter_of_day, series, value FROM means WHERE series IN ('AF', 'NO', 'RF'))""",
        select="""SELECT delivery_date, quarter_of_day, max(CASE WHEN series = 'AF' THEN value END) AS price,
  max(CASE WHEN series = 'NO' THEN value END) AS load_forecast,
  max(CASE WHEN series = 'RF' THEN value END) AS load_actual
FROM moved GROUP BY ALL
HAVING max(CASE WHEN series = 'NO' THEN value END) IS NOT NULL
  AND max(CASE WHEN series = 'RF' THEN value END) IS NOT NULL""",
    ),
)
def shifted_blocks(spark, folder):
    layout = WideLayout(
        target="price",
        target_placements=(Placement("AF", "price"),),
        features=(Placement("NO", "load_forecast", 1), Placement("RF", "load_actual", 2)),
    )
    columns = [p.column for p in layout.placements]
    wide = pivot_columns(place_series(_quarter_means(spark, folder), layout), columns)
    return wide.na.drop(subset=list(layout.required))


@query(
    "calendar_lags",
    "J3 F7",
    with_ctes(
        s.LINEITEM_CTE,
        "q AS (SELECT delivery_date, quarter_of_day, avg(value) AS price FROM li GROUP BY ALL)",
        select="""SELECT q.*, a.price AS lag_1d, b.price AS lag_2d, c.price AS lag_7d FROM q
JOIN q a ON a.delivery_date + 1 = q.delivery_date AND a.quarter_of_day = q.quarter_of_day
JOIN q b ON b.delivery_date + 2 = q.delivery_date AND b.quarter_of_day = q.quarter_of_day
JOIN q c ON c.delivery_date + 7 = q.delivery_date AND c.quarter_of_day = q.quarter_of_day""",
    ),
)
def calendar_lags_query(spark, folder):
    prices = (
        s.lineitem_quarters(spark, folder)
        .groupBy("delivery_date", "quarter_of_day")
        .agg(F.avg("value").alias("price"))
    )
    return calendar_lags(prices, "price", (1, 2, 7), lambda days: f"lag_{days}d")


@query(
    "residual_load",
    "X13 F7",
    with_ctes(
        WIDE_CTE,
        select="""SELECT delivery_date, quarter_of_day, series_af - series_ao - series_nf - series_no
  AS residual FROM wide""",
    ),
)
def residual_load(spark, folder):
    difference = Difference("residual", COLUMNS[0], COLUMNS[1:4])
    wide = add_differences(_wide(spark, folder), [difference])
    return wide.select("delivery_date", "quarter_of_day", "residual")


@query(
    "complete_days",
    "W4 F8 F5",
    with_ctes(
        s.events_cte(s.AUTUMN),
        f"""q AS (SELECT delivery_date, {s.quarter_sql('start_utc')} AS quarter_of_day,
  sum(value) AS total FROM ev GROUP BY ALL)""",
        select="""SELECT * FROM q QUALIFY count(*) OVER (PARTITION BY delivery_date) = 96""",
    ),
)
def complete_days_query(spark, folder):
    from quartergrid.functions.timegrid import quarter_of_day

    rows = (
        s.events(spark, folder, s.AUTUMN)
        .withColumn("quarter_of_day", quarter_of_day(F.col("delivery_start_utc")))
        .groupBy("delivery_date", "quarter_of_day")
        .agg(F.sum("value").alias("total"))
    )
    return complete_days(rows.na.drop(subset=["total"]))


@query(
    "day_arrays",
    "K10 O1",
    with_ctes(
        s.events_cte(s.WINTER),
        f"""q AS (SELECT delivery_date, {s.quarter_sql('start_utc')} AS quarter_of_day,
  CAST(sum(value) AS BIGINT) AS total FROM ev GROUP BY ALL)""",
        select="""SELECT delivery_date, string_agg(CAST(total AS VARCHAR), ',' ORDER BY quarter_of_day)
  AS totals, count(*) AS n FROM q GROUP BY 1""",
    ),
)
def day_arrays_query(spark, folder):
    from quartergrid.functions.timegrid import quarter_of_day

    rows = (
        s.events(spark, folder, s.WINTER)
        .withColumn("quarter_of_day", quarter_of_day(F.col("delivery_start_utc")))
        .groupBy("delivery_date", "quarter_of_day")
        .agg(F.sum("value").cast("bigint").alias("total"))
    )
    return day_arrays(rows, ["total"]).select(
        "delivery_date",
        F.array_join(F.col("total").cast("array<string>"), ",").alias("totals"),
        F.size("total").cast("bigint").alias("n"),
    )


DAYS_CTE = f"""{s.LINEITEM_CTE},
days AS (SELECT delivery_date, row_number() OVER (ORDER BY delivery_date) - 1 AS day_index,
  count(*) OVER () AS days, items FROM (
    SELECT delivery_date, count(*) AS items FROM li GROUP BY 1))"""


@query(
    "temporal_split_roles",
    "K12 W9",
    with_ctes(
        DAYS_CTE,
        select="""SELECT delivery_date, day_index, days, CASE WHEN day_index >= days - 28 THEN 'test'
  WHEN day_index >= days - 56 THEN 'validation' ELSE 'train' END AS role FROM days""",
    ),
)
def temporal_split_roles(spark, folder):
    return temporal_roles(day_index(s.lineitem_quarters(spark, folder)))


@query(
    "walk_forward_roles",
    "K13 W9 T5",
    with_ctes(
        DAYS_CTE,
        """folds AS (SELECT *, days - 112 + fold * 28 AS start FROM days CROSS JOIN range(4) r(fold))""",
        select="""SELECT delivery_date, day_index, days, fold, CASE WHEN day_index < start THEN 'train'
  WHEN fold = 3 THEN 'test' ELSE 'validation' END AS role FROM folds
WHERE day_index < start + 28""",
    ),
)
def walk_forward_roles_query(spark, folder):
    return walk_forward_roles(day_index(s.lineitem_quarters(spark, folder)))


@query(
    "consecutive_days",
    "W10",
    with_ctes(
        DAYS_CTE,
        select="""SELECT delivery_date, delivery_date - lag(delivery_date) OVER (ORDER BY delivery_date)
  AS step_days FROM days""",
    ),
)
def consecutive_days_query(spark, folder):
    days = s.lineitem_quarters(spark, folder).select("delivery_date").distinct()
    return consecutive_days(days)


@query(
    "sample_weights",
    "K11 K14 X14",
    with_ctes(
        s.LINEITEM_CTE,
        select="""SELECT l_suppkey, CASE WHEN abs(value - l_partkey % 40) >= 10 THEN 5.0::DOUBLE
  ELSE 1.0::DOUBLE END AS weight, count(*) AS n, sum(value - l_partkey % 40) AS spread
FROM li GROUP BY ALL""",
    ),
)
def sample_weights_query(spark, folder):
    spread = F.col("value") - F.col("l_partkey") % 40
    return (
        s.lineitem_quarters(spark, folder)
        .groupBy("l_suppkey", sample_weights(spread, threshold=10.0).alias("weight"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(spread).alias("spread"))
    )


@query(
    "affected_days",
    "I6 X4 A7",
    with_ctes(
        s.LINEITEM_CTE,
        select="""SELECT DISTINCT l_suppkey, delivery_date + CAST(unnest([0, 1, 2, 7]) AS INTEGER)
  AS delivery_date FROM li WHERE l_linenumber = 1""",
    ),
)
def affected_days_query(spark, folder):
    changed = s.lineitem_quarters(spark, folder).where(F.col("l_linenumber") == 1)
    return affected_days(changed, entity=["l_suppkey"])


@query(
    "weather_names",
    "X16 F9 J12",
    with_ctes(
        s.measurements_cte(s.WINTER),
        select="""SELECT series, 'weather_' || split_part(series, '.', 2) || '_' || CASE split_part(series, '.', 3)
    WHEN 'temperature_2m' THEN 'temperature_2m_c' WHEN 'wind_speed_100m' THEN 'wind_speed_100m_m_s'
    WHEN 'wind_direction_100m' THEN 'wind_direction_100m_degrees'
    WHEN 'shortwave_radiation' THEN 'shortwave_radiation_w_m2' ELSE 'cloud_cover_pct' END AS name,
  count(*) AS n, sum(value) AS total FROM src WHERE starts_with(series, 'weather.') GROUP BY ALL""",
    ),
)
def weather_names(spark, folder):
    rows = s.measurements(spark, folder, s.WINTER).where(F.col("series").startswith("weather."))
    names = [x for n in s.WEATHER_SERIES for x in (F.lit(n), F.lit(weather_column(n)))]
    return rows.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).withColumn("name", F.create_map(*names)[F.col("series")])


@query(
    "named_parameters",
    "S17 F4 F6",
    with_ctes(
        s.LINEITEM_CTE,
        select="""SELECT series, count(*) AS n, sum(value) AS total FROM li
WHERE delivery_date <= DATE '1999-06-30' AND series IN ('AF', 'NO') GROUP BY 1""",
    ),
)
def named_parameters(spark, folder):
    return named_query(
        spark,
        """SELECT series, count(*) AS n, sum(value) AS total FROM {items}
        WHERE delivery_date <= :through AND array_contains(:series, series) GROUP BY series""",
        {"through": date(1999, 6, 30), "series": F.array(F.lit("AF"), F.lit("NO"))},
        items=s.lineitem_quarters(spark, folder),
    )
