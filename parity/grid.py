"""Time grid, calendar and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import supplied as s
from parity.registry import query, with_ctes
from quartergrid.functions import timegrid as t
from quartergrid.functions.numbers import circular_degrees, resultant
from quartergrid.operators.calendar import calendar_spine, holiday_calendar
from quartergrid.operators.normalise import (
    MARKET_POLICY,
    FillPolicy,
    fill_quarters,
    normalise_quarters,
)
from quartergrid.operators.quality import measurement_violations
from quartergrid.operators.splits import encoded_features


@query(
    "local_time_parts",
    "S1 F1 F3 X1 X2 X3 X5",
    with_ctes(
        s.events_cte(s.AUTUMN),
        select=f"""SELECT event_id, delivery_date, {s.quarter_sql('instant')} AS quarter_of_day,
  {s.quarter_sql('instant')} // 4 AS hour, {s.quarter_sql('instant')} % 4 AS quarter,
  strftime(delivery_date, '%Y-%m-%d') || 'T' || lpad(CAST({s.quarter_sql('instant')} // 4
    AS VARCHAR), 2, '0') || ':' || lpad(CAST({s.quarter_sql('instant')} % 4 * 15 AS VARCHAR), 2, '0')
    || ':00' AS start_text,
  CAST(delivery_date AS TIMESTAMP) + {s.quarter_sql('instant')} * INTERVAL 15 MINUTE
    AS delivery_start_local,
  extract(isodow FROM delivery_date) - 1 AS day_of_week,
  extract(month FROM delivery_date) AS month
FROM ev""",
    ),
)
def local_time_parts(spark, folder):
    quarter = t.quarter_of_day(F.col("instant"))
    day = F.col("delivery_date")
    return s.events(spark, folder, s.AUTUMN).select(
        "event_id",
        "delivery_date",
        quarter.alias("quarter_of_day"),
        F.floor(quarter / 4).cast("int").alias("hour"),
        (quarter % 4).alias("quarter"),
        t.local_start_text(day, quarter).alias("start_text"),
        t.local_start(day, quarter).alias("delivery_start_local"),
        t.weekday(day).alias("day_of_week"),
        F.month(day).alias("month"),
    )


@query(
    "physical_grid_counts",
    "Q11 X9 X10 A7",
    f"""SELECT d AS delivery_date, {s.slots_sql('d')} AS quarters, {s.slots_sql('d', '3600')} AS hours,
  {s.day_start_sql('d')} AS first_start,
  {s.day_start_sql('d + 1')} - INTERVAL 15 MINUTE AS last_start, n AS items
FROM (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def physical_grid_counts(spark, folder):
    day = F.col("delivery_date")
    grid = t.physical_grid(day)
    return (
        s.lineitem_quarters(spark, folder)
        .groupBy("delivery_date")
        .agg(F.count(F.lit(1)).alias("items"))
        .select(
            "delivery_date",
            F.size(grid).alias("quarters"),
            t.physical_slots(day, 3600).alias("hours"),
            F.element_at(grid, 1).alias("first_start"),
            F.element_at(grid, -1).alias("last_start"),
            "items",
        )
    )


@query(
    "time_conversions",
    "X4 X6 X7 X8",
    f"""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) - 1 AS month_end,
  o_orderdate - INTERVAL 2 HOUR AS parsed, CAST({s.berlin('o_orderdate + INTERVAL 23 HOUR')} AS DATE)
  AS registered_day, CAST(o_orderdate AS DATE) + 2 AS shifted, true AS naive_rejected FROM orders""",
)
def time_conversions(spark, folder):
    instant = F.col("o_orderdate").cast("timestamp")
    text = F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm"), F.lit("+02:00"))
    millis = (F.unix_timestamp(instant) + 23 * 3600) * 1000
    return s.table(spark, folder, "orders").select(
        "o_orderkey",
        t.previous_month_end(F.to_date("o_orderdate")).alias("month_end"),
        t.iso_instant(text).alias("parsed"),
        t.epoch_millis_local_date(millis).alias("registered_day"),
        F.date_add(F.to_date("o_orderdate"), 2).alias("shifted"),
        t.iso_instant(F.substring(text, 1, 16)).isNull().alias("naive_rejected"),
    )


_VIOLATIONS_SQL = with_ctes(
    s.event_series_cte(s.SPRING),
    f"""stamps AS (
  SELECT n.delivery_date, n.series, n.instant AS st, count(*) AS copies,
    count(*) FILTER (WHERE value IS NULL) AS bad FROM (
      SELECT delivery_date, series, value,
        CASE WHEN event_id % 3 = 0 THEN start_utc ELSE instant END AS instant FROM named) n
  GROUP BY ALL),
profile AS (
  SELECT delivery_date, series, count(*) AS found, count(*) FILTER (WHERE
      st >= {s.day_start_sql('delivery_date')} AND st < {s.day_start_sql('delivery_date + 1')}
      AND (epoch_us(st) - epoch_us({s.day_start_sql('delivery_date')}))
        % (CASE WHEN series LIKE 'weather.%' THEN 3600000000 ELSE 900000000 END) = 0) AS aligned,
    count(*) FILTER (WHERE copies > 1) AS duplicated, sum(bad)::BIGINT AS non_finite
  FROM stamps GROUP BY ALL)""",
    select=f"""SELECT *, CASE WHEN duplicated > 0 THEN 'duplicate key; ' ELSE '' END
  || 'incomplete or misaligned day' AS reasons FROM (
  SELECT *, CASE WHEN series LIKE 'weather.%' THEN {s.slots_sql('delivery_date', '3600')}
    ELSE {s.slots_sql('delivery_date')} END AS expected FROM profile)
WHERE NOT (found = expected AND aligned = expected)""",
)


@query("grid_violations", "Q2 Q3 A2 A5 F10 F11 T3", _VIOLATIONS_SQL)
def grid_violations(spark, folder):
    names = s.event_series(spark, folder, s.SPRING)
    start = F.when(
        F.col("event_id") % 3 == 0, s.floor_to(F.col("instant"), 900)
    ).otherwise(F.col("instant"))
    found = measurement_violations(names.withColumn("delivery_start_utc", start))
    return found.withColumn("reasons", F.array_join("reasons", "; ")).drop("late_start_allowed")


@query(
    "grid_accepts_full_days",
    "Q3 S2",
    with_ctes(
        s.measurements_cte(s.AUTUMN),
        select="""SELECT count(*) AS measurements, count(DISTINCT delivery_date) AS days,
  CAST(0 AS BIGINT) AS violations FROM src""",
    ),
)
def grid_accepts_full_days(spark, folder):
    rows = s.measurements(spark, folder, s.AUTUMN)
    bad = measurement_violations(rows)
    return rows.agg(
        F.count(F.lit(1)).alias("measurements"),
        F.count_distinct("delivery_date").alias("days"),
    ).withColumn("violations", bad.agg(F.count(F.lit(1))).scalar())


def _normalise(shift):
    def build(spark, folder):
        filled = normalise_quarters(s.event_series(spark, folder, shift), on_gap="null")
        return filled.withColumn("value", F.round("value", 6))

    sql = with_ctes(
        s.event_series_cte(shift),
        s.normalised_cte(),
        select="SELECT delivery_date, series, quarter_of_day, round(value, 6) AS value FROM filled",
    )
    return build, sql


for _name, _shift in (("winter", s.WINTER), ("spring", s.SPRING), ("autumn", s.AUTUMN)):
    _build, _sql = _normalise(_shift)
    query(f"normalise_96_{_name}", "K2 K3 K4 K5 A3 A4 J4 W2 W3 F9 F12 X11", _sql)(_build)



@query(
    "normalise_by_user",
    "K2 K3 A3",
    with_ctes(
        s.event_series_cte(s.SPRING),
        s.normalised_cte(entity="user_id, "),
        """steady AS (SELECT * REPLACE (CASE WHEN series LIKE '%direction_100m'
  THEN round(value, 6) ELSE value END AS value) FROM filled)""",
        select="""SELECT user_id, delivery_date, series, count(value) AS filled,
  min(value) AS lowest, max(value) AS highest,
  CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total
FROM steady GROUP BY ALL""",
    ),
)
def normalise_by_user(spark, folder):
    rows = s.event_series(spark, folder, s.SPRING)
    filled = normalise_quarters(rows, entity=["user_id"], on_gap="null")
    angle = F.col("series").endswith("direction_100m")
    value = F.when(angle, F.round("value", 6)).otherwise(F.col("value"))
    return (
        filled.withColumn("value", value)
        .groupBy("user_id", "delivery_date", "series")
        .agg(
            F.count("value").alias("filled"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
            F.sum(F.floor(F.col("value") * 1000)).alias("total"),
        )
    )


HOURLY = FillPolicy(
    hourly=lambda series: F.lit(True),
    angular=MARKET_POLICY.angular,
    late_start=MARKET_POLICY.late_start,
)


@query(
    "hourly_hold_fill",
    "K4 K5 W2 W3",
    with_ctes(
        s.LINEITEM_CTE,
        """hours AS (
  SELECT delivery_date, series, quarter_of_day // 4 * 4 AS q, avg(value) AS value
  FROM li GROUP BY ALL),
grid AS (
  SELECT g.*, h.value FROM (
    SELECT delivery_date, series, unnest(range(96)) AS q
    FROM (SELECT DISTINCT delivery_date, series FROM li)) g
  LEFT JOIN hours h USING (delivery_date, series, q)),
around AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN q END IGNORE NULLS) OVER b AS pq,
    last_value(value IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN q END IGNORE NULLS) OVER a AS nq,
    first_value(value IGNORE NULLS) OVER a AS nv
  FROM grid WINDOW
    b AS (PARTITION BY delivery_date, series ORDER BY q
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY delivery_date, series ORDER BY q
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT delivery_date, series, q, coalesce(value, CASE WHEN q // 4 = pq // 4 THEN pv
    ELSE pv + (nv - pv) * (q - pq) / (nq - pq) END, nv) AS value FROM around)""",
        select="""SELECT delivery_date, series, count(value) AS filled, min(value) AS lowest,
  max(value) AS highest, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total
FROM filled GROUP BY ALL""",
    ),
)
def hourly_hold_fill(spark, folder):
    hours = (
        s.lineitem_quarters(spark, folder)
        .withColumn("quarter_of_day", (F.floor(F.col("quarter_of_day") / 4) * 4).cast("int"))
        .groupBy("delivery_date", "series", "quarter_of_day")
        .agg(F.avg("value").alias("value"))
    )
    filled = fill_quarters(hours, policy=HOURLY, on_gap="null")
    return filled.groupBy("delivery_date", "series").agg(
        F.count("value").alias("filled"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        F.sum(F.floor(F.col("value") * 1000)).alias("total"),
    )


@query(
    "circular_mean",
    "A4 X11 X14",
    with_ctes(
        s.events_cte(s.WINTER),
        select="""SELECT user_id, round(((degrees(atan2(ms, mc)) % 360) + 360) % 360, 6) AS direction,
  round(sqrt(ms * ms + mc * mc), 6) AS strength, n FROM (
  SELECT user_id, avg(sin(radians(value))) AS ms, avg(cos(radians(value))) AS mc, count(*) AS n
  FROM ev GROUP BY 1)""",
    ),
)
def circular_mean(spark, folder):
    angle = F.radians("value")
    means = s.events(spark, folder, s.WINTER).groupBy("user_id").agg(
        F.avg(F.sin(angle)).alias("ms"), F.avg(F.cos(angle)).alias("mc"), F.count("*").alias("n")
    )
    return means.select(
        "user_id",
        F.round(circular_degrees(F.col("ms"), F.col("mc")), 6).alias("direction"),
        F.round(resultant(F.col("ms"), F.col("mc")), 6).alias("strength"),
        "n",
    )


_SEASON = """CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring'
  WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""


@query(
    "calendar_features",
    "K1 S4 X17 O1",
    with_ctes(
        s.LINEITEM_CTE,
        """bounds AS (
  SELECT l_suppkey, max(delivery_date) - 2 AS b, max(delivery_date) AS e FROM li GROUP BY 1),
spine AS (
  SELECT l_suppkey, delivery_date, unnest(range(96)) AS q FROM (
    SELECT l_suppkey, CAST(unnest(generate_series(CAST(b AS TIMESTAMP), CAST(e AS TIMESTAMP),
      INTERVAL 1 DAY)) AS DATE) AS delivery_date FROM bounds)),
parts AS (
  SELECT *, extract(isodow FROM delivery_date) - 1 AS dow, extract(month FROM delivery_date) AS month
  FROM spine)""",
        select=f"""SELECT l_suppkey, delivery_date, q AS quarter_of_day, q // 4 AS hour, q % 4 AS quarter,
  CAST(delivery_date AS TIMESTAMP) + q * INTERVAL 15 MINUTE AS delivery_start_local,
  dow AS day_of_week, month, dow >= 5 AS is_weekend, {_SEASON} AS season FROM parts
ORDER BY l_suppkey, delivery_date, quarter_of_day""",
    ),
)
def calendar_features(spark, folder):
    last = F.max("delivery_date")
    bounds = s.lineitem_quarters(spark, folder).groupBy("l_suppkey").agg(
        F.date_add(last, -2).alias("start"), last.alias("end")
    )
    return calendar_spine(bounds).orderBy("l_suppkey", "delivery_date", "quarter_of_day")


@query(
    "holiday_ranges",
    "K6 J5",
    with_ctes(s.HOLIDAY_CTE, select="SELECT * FROM holidays"),
)
def holiday_ranges(spark, folder):
    bounds = s.year_bounds(spark, folder, s.AUTUMN)
    return holiday_calendar(bounds, s.holiday_ranges(spark, folder))


@query(
    "cyclical_encodings",
    "X12 K9",
    with_ctes(
        s.LINEITEM_CTE,
        """keys AS (SELECT delivery_date, quarter_of_day AS q, avg(value) AS mean_value,
  extract(isodow FROM delivery_date) - 1 AS dow, extract(month FROM delivery_date) AS month
  FROM li GROUP BY ALL)""",
        select="""SELECT delivery_date, q AS quarter_of_day, mean_value,
  CASE WHEN dow >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
  round(sin(2 * pi() * q / 96), 6) + 0.0 AS quarter_sin,
  round(cos(2 * pi() * q / 96), 6) + 0.0 AS quarter_cos,
  round(sin(2 * pi() * dow / 7), 6) + 0.0 AS weekday_sin,
  round(cos(2 * pi() * dow / 7), 6) + 0.0 AS weekday_cos,
  round(sin(2 * pi() * (month - 1) / 12), 6) + 0.0 AS month_sin,
  round(cos(2 * pi() * (month - 1) / 12), 6) + 0.0 AS month_cos FROM keys""",
    ),
)
def cyclical_encodings(spark, folder):
    rows = (
        s.lineitem_quarters(spark, folder)
        .groupBy("delivery_date", "quarter_of_day")
        .agg(F.avg("value").alias("mean_value"))
        .withColumn("day_of_week", t.weekday(F.col("delivery_date")))
        .withColumn("month", F.month("delivery_date"))
        .withColumn("is_weekend", F.col("day_of_week") >= 5)
    )
    encoded = encoded_features(rows, numeric=["mean_value"], flags=["is_weekend"])
    waves = [f"{n}_{w}" for n in ("quarter", "weekday", "month") for w in ("sin", "cos")]
    return encoded.select(
        "delivery_date",
        "quarter_of_day",
        "mean_value",
        "is_weekend",
        *((F.round(c, 6) + 0.0).alias(c) for c in waves),
    )


@query(
    "unfilled_quarters",
    "Q5 F11 K5",
    with_ctes(
        s.event_series_cte(s.AUTUMN),
        s.normalised_cte(),
        select="""SELECT delivery_date, series, count(*) AS unfilled FROM filled
WHERE value IS NULL GROUP BY 1, 2""",
    ),
)
def unfilled_quarters(spark, folder):
    filled = normalise_quarters(s.event_series(spark, folder, s.AUTUMN), on_gap="null")
    return (
        filled.where(F.col("value").isNull())
        .groupBy("delivery_date", "series")
        .agg(F.count(F.lit(1)).alias("unfilled"))
    )
