"""The supplied tables seen as quarter-hour market data, in Spark and in SQL.

Values are whole numbers where they can be, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartergrid.functions.timegrid import day_start, local_date, physical_grid, physical_slots
from quartergrid.market import AUTUMN_96_SERIES, CURVE_SERIES, WEATHER_SERIES

WINTER, SPRING, AUTUMN = 0, 70, 280
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_SERIES = {
    "purchase": "de_lu.price.sdac",
    "view": "de_lu.generation.solar.forecast",
    "click": "weather.berlin.temperature_2m",
    "signup": "weather.berlin.wind_direction_100m",
    "error": "de_lu.load.actual",
}
FEATURE_SERIES = tuple(
    s for s in (*CURVE_SERIES, *WEATHER_SERIES) if s != "at.price.sdac"
)


def text_array(values: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def floor_to(instant: Column, seconds: Column | int) -> Column:
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    unix = F.unix_timestamp(instant)
    return F.timestamp_seconds(unix - F.pmod(unix, step))


def events(spark: SparkSession, folder: str, shift: int) -> DataFrame:
    """Events moved by ``shift`` days, with value in whole cents."""
    moved = F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {shift} DAYS")
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        moved.alias("instant"),
        floor_to(moved, 900).alias("delivery_start_utc"),
        local_date(moved).alias("delivery_date"),
        F.floor(F.col("value") * 100).cast("double").alias("value"),
    )


def events_cte(shift: int) -> str:
    return f"""ev AS (
  SELECT event_id, user_id, event_type, ts + INTERVAL {shift} DAY AS instant,
    make_timestamp((epoch_us(ts + INTERVAL {shift} DAY) // 900000000) * 900000000) AS start_utc,
    CAST({berlin(f'ts + INTERVAL {shift} DAY')} AS DATE) AS delivery_date,
    CAST(floor(value * 100) AS DOUBLE) AS value
  FROM events)"""


def berlin(instant: str) -> str:
    return f"timezone('Europe/Berlin', timezone('UTC', {instant}))"


def utc(local: str) -> str:
    return f"timezone('UTC', timezone('Europe/Berlin', {local}))"


def day_start_sql(day: str) -> str:
    return utc(f"CAST({day} AS TIMESTAMP)")


def quarter_sql(instant: str) -> str:
    local = berlin(instant)
    return f"(extract(hour FROM {local}) * 4 + extract(minute FROM {local}) // 15)"


def slots_sql(day: str, step: str = "900") -> str:
    return (
        f"((epoch_us({day_start_sql(f'{day} + 1')}) - epoch_us({day_start_sql(day)})) "
        f"// 1000000 // {step})"
    )


def event_series(spark: SparkSession, folder: str, shift: int) -> DataFrame:
    """Each event type as one market series; the hourly ones start on the hour."""
    names = F.create_map(*(F.lit(x) for pair in EVENT_SERIES.items() for x in pair))
    frame = events(spark, folder, shift).withColumn("series", names[F.col("event_type")])
    hourly = F.col("series").startswith("weather.")
    start = F.when(hourly, floor_to(F.col("delivery_start_utc"), 3600)).otherwise(
        F.col("delivery_start_utc")
    )
    return frame.withColumn("delivery_start_utc", start)


def event_series_cte(shift: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SERIES.items())
    return f"""{events_cte(shift)},
named AS (SELECT *, CASE event_type {cases} END AS series FROM ev),
src AS (
  SELECT user_id, delivery_date, series, value,
    CASE WHEN series LIKE 'weather.%' THEN date_trunc('hour', start_utc) ELSE start_utc END
      AS start_utc
  FROM named)"""


def measurements(
    spark: SparkSession,
    folder: str,
    shift: int,
    series: Sequence[str] = FEATURE_SERIES,
) -> DataFrame:
    """Full physical days for every series: event slots where present, else a pattern.

    On the 100-quarter day the two late-starting series lack their first hour.
    """
    moved = events(spark, folder, shift)
    kind = F.array_position(text_array(EVENT_TYPES), F.col("event_type")) - 1
    index = F.pmod(kind * 29 + F.col("user_id"), F.lit(len(series)))
    names = text_array(series)
    hourly = F.col("series").startswith("weather.")
    step = F.when(hourly, 3600).otherwise(900)
    slots = (
        moved.withColumn("series", F.get(names, index.cast("int")))
        .groupBy("delivery_date", "series", floor_to(F.col("instant"), step).alias("start"))
        .agg(F.floor(F.avg("value")).cast("double").alias("slot_value"))
    )
    spine = (
        moved.select("delivery_date")
        .distinct()
        .select("delivery_date", F.posexplode(names).alias("index", "series"))
        .withColumn("start", F.explode(physical_grid(F.col("delivery_date"), step)))
    )
    tick = F.expr("unix_timestamp(start) div 900")
    pattern = F.pmod(tick * 7 + F.col("index") * 131, F.lit(997)).cast("double")
    late = (
        F.col("series").isin(*AUTUMN_96_SERIES)
        & (physical_slots(F.col("delivery_date")) == 100)
        & (F.col("start") < day_start(F.col("delivery_date")) + F.expr("INTERVAL 1 HOUR"))
    )
    return (
        spine.where(~late)
        .join(slots, ["delivery_date", "series", "start"], "left")
        .select(
            "delivery_date",
            F.col("start").alias("delivery_start_utc"),
            "series",
            F.coalesce("slot_value", pattern).alias("value"),
        )
    )


def measurements_cte(shift: int, series: Sequence[str] = FEATURE_SERIES) -> str:
    listed = ", ".join(f"'{s}'" for s in series)
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    autumn = ", ".join(f"'{s}'" for s in AUTUMN_96_SERIES)
    step = "(CASE WHEN series LIKE 'weather.%' THEN 3600 ELSE 900 END)"
    return f"""{events_cte(shift)},
names AS (SELECT unnest([{listed}]) AS series, unnest(range({len(series)})) AS idx),
keyed AS (
  SELECT delivery_date, instant, value, n.series
  FROM ev JOIN names n
    ON n.idx = ((list_position([{types}], event_type) - 1) * 29 + user_id) % {len(series)}),
slots AS (
  SELECT delivery_date, series,
    make_timestamp((epoch_us(instant) // ({step} * 1000000::BIGINT)) * {step} * 1000000::BIGINT)
      AS start_utc,
    floor(avg(value)) AS slot_value
  FROM keyed GROUP BY ALL),
days AS (SELECT DISTINCT delivery_date FROM ev),
spine AS (
  SELECT delivery_date, series, idx,
    unnest(generate_series({day_start_sql('delivery_date')},
      {day_start_sql('delivery_date + 1')} - {step} * INTERVAL 1 SECOND,
      {step} * INTERVAL 1 SECOND)) AS start_utc
  FROM days CROSS JOIN names),
src AS (
  SELECT s.delivery_date, s.start_utc, s.series,
    coalesce(v.slot_value, CAST(((epoch_us(s.start_utc) // 900000000) * 7 + s.idx * 131) % 997
      AS DOUBLE)) AS value
  FROM spine s LEFT JOIN slots v
    ON s.delivery_date = v.delivery_date AND s.series = v.series AND s.start_utc = v.start_utc
  WHERE NOT (s.series IN ({autumn}) AND {slots_sql('s.delivery_date')} = 100
    AND s.start_utc < {day_start_sql('s.delivery_date')} + INTERVAL 1 HOUR))"""


def normalised_cte(
    source: str = "src",
    *,
    entity: str = "",
    name: str = "filled",
    hourly: str = "series LIKE 'weather.%'",
    angular: str = "series LIKE '%.wind_direction_100m'",
) -> str:
    """Densify by spine join and fill by windows; independent of the Spark plan."""
    key = f"{entity}delivery_date, series"
    autumn = ", ".join(f"'{s}'" for s in AUTUMN_96_SERIES)
    before = f"(PARTITION BY {key} ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"(PARTITION BY {key} ORDER BY q ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""{name}_values AS (
  SELECT {key}, {quarter_sql('start_utc')} AS q, avg(value) AS mean, count(*) AS n,
    avg(sin(radians(value))) AS ms, avg(cos(radians(value))) AS mc
  FROM {source} GROUP BY ALL),
{name}_circular AS (
  SELECT *, ((degrees(atan2(ms, mc)) % 360) + 360) % 360 AS angle FROM {name}_values),
{name}_quarters AS (
  SELECT {key}, q, CASE WHEN {angular} AND n > 1
    THEN CASE WHEN sqrt(ms * ms + mc * mc) < 1e-12 THEN NULL
      WHEN angle > 360 - 1e-9 THEN 0 ELSE angle END ELSE mean END AS value
  FROM {name}_circular),
{name}_grid AS (
  SELECT g.*, v.value FROM (
    SELECT {key}, unnest(range(96)) AS q FROM (SELECT DISTINCT {key} FROM {source})) g
  LEFT JOIN {name}_quarters v USING ({key}, q)),
{name}_around AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN q END IGNORE NULLS) OVER {before} AS pq,
    last_value(value IGNORE NULLS) OVER {before} AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN q END IGNORE NULLS) OVER {after} AS nq,
    first_value(value IGNORE NULLS) OVER {after} AS nv
  FROM {name}_grid),
{name} AS (
  SELECT {key}, q AS quarter_of_day,
    CASE WHEN {hourly} THEN coalesce(value,
        CASE WHEN {angular} THEN pv WHEN q // 4 = pq // 4 THEN pv
          ELSE pv + (nv - pv) * (q - pq) / (nq - pq) END, nv)
      WHEN series IN ({autumn}) THEN coalesce(value, pv + (nv - pv) * (q - pq) / (nq - pq), nv)
      ELSE coalesce(value, pv + (nv - pv) * (q - pq) / (nq - pq)) END AS value
  FROM {name}_around)"""


def lineitem_quarters(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as quarter values: one series per flag and status."""
    return table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("delivery_date"),
        F.pmod("l_partkey", F.lit(96)).cast("int").alias("quarter_of_day"),
        F.concat("l_returnflag", "l_linestatus").alias("series"),
        F.col("l_quantity").alias("value"),
        "l_suppkey",
        "l_linenumber",
        "l_partkey",
        "l_orderkey",
    )


LINEITEM_CTE = """li AS (
  SELECT CAST(l_shipdate AS DATE) AS delivery_date, l_partkey % 96 AS quarter_of_day,
    l_returnflag || l_linestatus AS series, l_quantity AS value,
    l_suppkey, l_linenumber, l_partkey, l_orderkey
  FROM lineitem)"""


def holiday_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as holiday ranges of one to three days in two countries."""
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("s_suppkey") * 7, F.lit(366)).cast("int"))
    return table(spark, folder, "supplier").select(
        F.when(F.col("s_suppkey") % 2 == 0, "DE").otherwise("LU").alias("country"),
        start.alias("start_date"),
        F.date_add(start, F.col("s_nationkey") % 3).alias("end_date"),
        (F.col("s_acctbal") > 4000).alias("nationwide"),
    )


HOLIDAY_CTE = """hol AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'DE' ELSE 'LU' END AS country,
    DATE '2024-01-01' + CAST(s_suppkey * 7 % 366 AS INTEGER) AS start_date,
    DATE '2024-01-01' + CAST(s_suppkey * 7 % 366 AS INTEGER) + s_nationkey % 3 AS end_date,
    s_acctbal > 4000 AS nationwide
  FROM supplier),
covered AS (
  SELECT DISTINCT country, CAST(unnest(generate_series(CAST(start_date AS TIMESTAMP),
    CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS delivery_date
  FROM hol WHERE country <> 'DE' OR nationwide),
holidays AS (
  SELECT y.delivery_date,
    coalesce(bool_or(c.country = 'DE'), false) AS is_holiday_de_nationwide,
    coalesce(bool_or(c.country = 'LU'), false) AS is_holiday_lu
  FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31',
    INTERVAL 1 DAY)) AS DATE) AS delivery_date) y
  LEFT JOIN covered c USING (delivery_date) GROUP BY 1)"""


def year_bounds(spark: SparkSession, folder: str, shift: int) -> DataFrame:
    return events(spark, folder, shift).agg(
        F.min("delivery_date").alias("start"), F.max("delivery_date").alias("end")
    )
