"""Version, upsert, request-plan and pending-day queries."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import functions as F

from parity import features, payloads
from parity import supplied as s
from parity.registry import CATALOG as ALL
from parity.registry import query, with_ctes
from parity.supplied import EVENT_SERIES
from quartergrid.functions.timegrid import forecast_kind
from quartergrid.operators.calendar import holiday_calendar
from quartergrid.operators.versions import changed_only, latest_version, upsert
from quartergrid.plans.pending import (
    default_start,
    evaluation_days,
    operational_state,
    pending_forecasts,
    ready_days,
)
from quartergrid.plans import refresh
from quartergrid.plans.model_input import model_input
from quartergrid.plans.requests import OFFSETS, missing_requests, request_plan
from quartergrid.session import shared_folder
from quartergrid.functions.timegrid import day_start
from quartergrid.sources.measurements import MEASUREMENT_SCHEMA, RAW_SCHEMA, measurements
from quartergrid.sources.tables import (
    HOLIDAY_SCHEMA,
    DayTable,
    cover_holidays,
    export_csv,
    extract_snapshot,
    production_version,
    read_snapshot,
)

CUT = date(1999, 1, 1)


def _orders(spark, folder):
    return s.table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"
    )


@query(
    "latest_version",
    "W1 P20",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_version_query(spark, folder):
    return latest_version(_orders(spark, folder), ["o_custkey"], "o_orderdate", ["o_orderkey"])


_NEWEST = """(SELECT * FROM orders WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus
    ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def _newest(spark, folder, condition):
    return latest_version(
        _orders(spark, folder).where(condition),
        ["o_custkey", "o_orderstatus"],
        "o_orderdate",
        ["o_orderkey"],
    ).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))


@query(
    "keyed_upsert",
    "S9 J17 F7 T4",
    f"""WITH stored AS {_NEWEST.format(where="o_orderdate < DATE '1999-01-01'")},
updates AS {_NEWEST.format(where="o_orderdate >= DATE '1999-01-01'")}
SELECT o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderkey, o_orderdate, o_totalprice
FROM updates
UNION ALL
SELECT o_custkey, nullif(o_orderstatus, 'P'), o_orderkey, o_orderdate, o_totalprice FROM stored t
WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.o_custkey = t.o_custkey
  AND u.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus)""",
)
def keyed_upsert(spark, folder):
    """Status P becomes NULL, so the keys exercise null-safe matching."""
    stored = _newest(spark, folder, F.col("o_orderdate") < F.lit(CUT))
    updates = _newest(spark, folder, F.col("o_orderdate") >= F.lit(CUT))
    return upsert(stored, updates, ["o_custkey", "o_orderstatus"])


@query(
    "changed_only_append",
    "I3 F7",
    """WITH stored AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate < DATE '1999-01-01'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus DESC) = 1)
SELECT o.o_custkey, o.o_orderkey, o.o_orderdate, o.o_orderstatus, o.o_totalprice
FROM orders o LEFT JOIN stored t USING (o_custkey)
WHERE o.o_orderdate >= DATE '1999-01-01' AND t.o_orderstatus IS DISTINCT FROM o.o_orderstatus""",
)
def changed_only_append(spark, folder):
    orders = _orders(spark, folder)
    return changed_only(
        orders.where(F.col("o_orderdate") >= F.lit(CUT)),
        orders.where(F.col("o_orderdate") < F.lit(CUT)),
        ["o_custkey"],
        "o_orderstatus",
        "o_orderdate",
    )


def _bounds(spark, folder):
    return s.lineitem_quarters(spark, folder).groupBy("l_suppkey").agg(
        F.date_add(F.max("delivery_date"), -1).alias("start"),
        F.date_add(F.max("delivery_date"), 3).alias("end"),
    )


_OFFSET_ROWS = ", ".join(
    f"('{series}', {first}, {last})" for group, first, last in OFFSETS for series in group
)
PLAN_CTE = f"""{s.LINEITEM_CTE},
offsets AS (SELECT * FROM (VALUES {_OFFSET_ROWS}) v(series, first, last)),
bounds AS (SELECT l_suppkey, max(delivery_date) - 1 AS b,
  least(max(delivery_date) + 3, DATE '2001-11-01' + 1) AS e FROM li GROUP BY 1),
plan AS (
  SELECT l_suppkey, series, CAST(unnest(generate_series(CAST(b + first AS TIMESTAMP),
    CAST(e + last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS delivery_date
  FROM bounds CROSS JOIN offsets WHERE b <= e)"""
TODAY = date(2001, 11, 1)


@query("request_plan", "I1 T1", with_ctes(PLAN_CTE, select="SELECT * FROM plan"))
def request_plan_query(spark, folder):
    return request_plan(_bounds(spark, folder), F.lit(TODAY))


@query(
    "missing_requests",
    "I2 J8 T2 A7 O2",
    with_ctes(
        PLAN_CTE,
        """missing AS (SELECT * FROM plan p WHERE NOT EXISTS (
  SELECT 1 FROM li WHERE li.delivery_date = p.delivery_date AND li.l_suppkey = p.l_suppkey)),
batches AS (SELECT delivery_date, (row_number() OVER (ORDER BY delivery_date DESC) - 1) // 7 AS batch
  FROM (SELECT DISTINCT delivery_date FROM missing))""",
        select="SELECT * FROM missing JOIN batches USING (delivery_date)",
    ),
)
def missing_requests_query(spark, folder):
    plan = request_plan(_bounds(spark, folder), F.lit(TODAY))
    stored = s.lineitem_quarters(spark, folder)
    return missing_requests(plan, stored, ["delivery_date", "l_suppkey"])


@query(
    "ready_days",
    "A9 F6",
    with_ctes(
        s.measurements_cte(s.AUTUMN, ("de_lu.price.sdac",)),
        select="SELECT delivery_date FROM src GROUP BY 1 HAVING count(*) = 96",
    ),
)
def ready_days_query(spark, folder):
    rows = s.measurements(spark, folder, s.AUTUMN, ("de_lu.price.sdac",))
    passed = F.unix_timestamp("delivery_start_utc") - F.unix_timestamp(day_start(F.col("delivery_date")))
    return ready_days(rows.withColumn("quarter_of_day", F.floor(passed / 900).cast("int")))


# Ready days have 96 quarters; every third (zone, day) lacks its last one.
QUARTER_ROWS = f"""{s.LINEITEM_CTE},
inputs AS (
  SELECT l_suppkey % 10 AS zone, delivery_date, unnest(range(
    CASE WHEN count(*) % 3 = 0 THEN 95 ELSE 96 END)) AS quarter_of_day
  FROM li GROUP BY 1, 2),
runs AS (SELECT DISTINCT l_suppkey % 10 AS zone, delivery_date FROM li WHERE l_linenumber = 7)"""


def _inputs(spark, folder):
    rows = s.lineitem_quarters(spark, folder).withColumn("zone", F.col("l_suppkey") % 10)
    last = F.when(F.count(F.lit(1)) % 3 == 0, 94).otherwise(95)
    return rows.groupBy("zone", "delivery_date").agg(last.alias("last")).select(
        "zone", "delivery_date", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("quarter_of_day")
    )


def _runs(spark, folder):
    rows = s.lineitem_quarters(spark, folder).where(F.col("l_linenumber") == 7)
    return rows.select((F.col("l_suppkey") % 10).alias("zone"), "delivery_date").distinct()


@query(
    "pending_days",
    "I4 I7 J6 F5 A9",
    with_ctes(
        QUARTER_ROWS,
        select="""SELECT zone, delivery_date FROM inputs
WHERE delivery_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND (zone, delivery_date) NOT IN (SELECT zone, delivery_date FROM runs)
GROUP BY 1, 2 HAVING count(*) = 96""",
    ),
)
def pending_days(spark, folder):
    return pending_forecasts(
        _inputs(spark, folder),
        _runs(spark, folder),
        start=date(1996, 1, 1),
        end=date(2000, 12, 31),
        entity=["zone"],
    )


@query(
    "recompute_from_first_gap",
    "I6 J7 J14 A8 A10",
    with_ctes(
        QUARTER_ROWS,
        """forecasts AS (SELECT zone, delivery_date FROM inputs GROUP BY 1, 2
  HAVING count(DISTINCT quarter_of_day) = 96),
actuals AS (SELECT zone, delivery_date FROM inputs
  WHERE (zone + quarter_of_day + day(delivery_date)) % 96 <> 0 OR zone > 6 GROUP BY 1, 2
  HAVING count(DISTINCT quarter_of_day) = 96),
done AS (SELECT DISTINCT l_suppkey % 10 AS zone, delivery_date FROM li
  WHERE delivery_date < DATE '1997-05-05' + CAST(l_suppkey % 10 AS INTEGER) * 100),
eligible AS (SELECT * FROM forecasts SEMI JOIN actuals USING (zone, delivery_date)),
gaps AS (SELECT zone, min(delivery_date) AS gap FROM eligible
  WHERE (zone, delivery_date) NOT IN (SELECT zone, delivery_date FROM done) GROUP BY 1)""",
        select="""SELECT zone, delivery_date FROM eligible JOIN gaps USING (zone)
WHERE delivery_date >= gap""",
    ),
)
def recompute_from_first_gap(spark, folder):
    rows = _inputs(spark, folder)
    missing = (F.col("zone") + F.col("quarter_of_day") + F.dayofmonth("delivery_date")) % 96 == 0
    target = F.when(~missing | (F.col("zone") > 6), 1.0)
    zone = F.col("l_suppkey") % 10
    limit = F.date_add(F.lit("1997-05-05").cast("date"), (zone * 100).cast("int"))
    done = (
        s.lineitem_quarters(spark, folder)
        .where(F.col("delivery_date") < limit)
        .select(zone.alias("zone"), "delivery_date")
    )
    return evaluation_days(
        rows, rows.withColumn("target", target), done, target="target", entity=["zone"]
    )


@query(
    "default_start",
    "I5 X8 A10",
    with_ctes(
        QUARTER_ROWS,
        select="SELECT min(delivery_date) AS start FROM runs",
    ),
)
def default_start_query(spark, folder):
    return default_start(_runs(spark, folder), F.lit(1_700_000_000_000))


@query(
    "forecast_kind",
    "I8 F12",
    f"""SELECT o_orderkey, CASE WHEN o_orderdate + (o_orderkey % 48) * INTERVAL 30 MINUTE <=
  {s.utc("CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) - 1 AS TIMESTAMP) + INTERVAL 12 HOUR")}
  THEN 'operational' ELSE 'retrospective' END AS kind FROM orders""",
)
def forecast_kind_query(spark, folder):
    orders = s.table(spark, folder, "orders")
    minutes = (F.col("o_orderkey") % 48 * 30).cast("int")
    stamp = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), minutes
    )
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3).cast("int"))
    return orders.select("o_orderkey", forecast_kind(day, stamp).alias("kind"))


@query(
    "production_version",
    "S15 W1 L13",
    """WITH v AS (SELECT o_orderkey AS version, o_totalprice AS mae,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS n FROM orders)
SELECT version, mae FROM v WHERE n = 0 ORDER BY version DESC LIMIT 1""",
)
def production_version_query(spark, folder):
    rejected = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(
        F.array("o_orderstatus")
    )
    log = s.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("version"),
        F.col("o_totalprice").alias("mae"),
        rejected.alias("promotion_reasons"),
    )
    return production_version(log).select("version", "mae")


@query(
    "operational_state",
    "I9 F6 A16",
    """SELECT DATE '2000-06-15' AS delivery_date, count(*) AS operational_rows,
  CASE WHEN count(*) > 0 THEN 'ready' ELSE 'missing' END AS state FROM lineitem
WHERE CAST(l_shipdate AS DATE) = DATE '2000-06-15' AND l_linestatus = 'O'""",
)
def operational_state_query(spark, folder):
    rows = s.table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("delivery_date"),
        F.when(F.col("l_linestatus") == "O", "operational")
        .otherwise("retrospective")
        .alias("forecast_kind"),
    )
    return operational_state(rows, F.lit("2000-06-14 10:00:00").cast("timestamp"))


_DAILY = """SELECT CAST(o_orderdate AS DATE) AS delivery_date, o_orderstatus AS status,
  count(*) AS n, sum(round(o_totalprice * 100))::BIGINT AS cents FROM orders"""


@query(
    "stored_table_merge",
    "S2 S3 S6 S8 S9 S14 J17",
    f"""WITH stored AS ({_DAILY} WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2),
updates AS ({_DAILY} WHERE o_orderdate >= DATE '2000-01-01' GROUP BY 1, 2)
SELECT *, 3::BIGINT AS version FROM updates
UNION ALL SELECT *, 3 FROM stored t WHERE NOT EXISTS (SELECT 1 FROM updates u
  WHERE u.delivery_date = t.delivery_date AND u.status = t.status)""",
)
def stored_table_merge(spark, folder):
    """Create, rebuild and merge a stored table; an empty rebuild leaves it alone."""
    orders = s.table(spark, folder, "orders").withColumn("delivery_date", F.to_date("o_orderdate"))

    def daily(rows):
        return rows.groupBy("delivery_date", F.col("o_orderstatus").alias("status")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.round(F.col("o_totalprice") * 100)).cast("bigint").alias("cents"),
        )

    schema = "delivery_date date, status string, n bigint, cents bigint"
    stored = DayTable(spark, f"{shared_folder(spark)}/{uuid4().hex}", schema)
    stored.create()
    stored.overwrite(daily(orders.where(F.col("o_orderpriority") != "1-URGENT")))
    stored.overwrite(daily(orders.where(F.lit(False))))
    recent = daily(orders.where(F.col("o_orderdate") >= F.lit(date(2000, 1, 1))))
    for _ in range(2):
        stored.merge(recent, ("delivery_date", "status"))
    return stored.read().withColumn("version", F.lit(stored.version()))


@query(
    "schema_change_overwrite",
    "S5 S7 S14",
    f"""WITH daily AS ({_DAILY} GROUP BY 1, 2)
SELECT delivery_date, status, n, cents, n * 2 AS doubled, 3::BIGINT AS commits, true AS old_readable FROM daily""",
)
def schema_change_overwrite(spark, folder):
    """Append, then overwrite with one more column: the log and the old version stay."""
    orders = s.table(spark, folder, "orders").withColumn("delivery_date", F.to_date("o_orderdate"))
    daily = orders.groupBy("delivery_date", F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("o_totalprice") * 100)).cast("bigint").alias("cents"),
    )
    schema = "delivery_date date, status string, n bigint, cents bigint"
    stored = DayTable(spark, f"{shared_folder(spark)}/{uuid4().hex}", schema)
    stored.create()
    stored.append(daily)
    stored.overwrite(daily.withColumn("doubled", F.col("n") * 2))
    old = stored.read(1)
    readable = old.columns == daily.columns and old.count() == daily.count()
    return stored.read().select(
        "*", F.lit(stored.log().count()).alias("commits"), F.lit(readable).alias("old_readable")
    )


@query(
    "snapshot_round_trip",
    "S10 S11",
    with_ctes(
        s.LINEITEM_CTE,
        select="""SELECT delivery_date, quarter_of_day, count(*) AS n FROM li
WHERE delivery_date <= DATE '1998-01-31' GROUP BY 1, 2""",
    ),
)
def snapshot_round_trip(spark, folder):
    """Write a snapshot twice and read it up to an earlier date."""
    rows = s.lineitem_quarters(spark, folder).groupBy("delivery_date", "quarter_of_day").agg(
        F.count(F.lit(1)).alias("n")
    )
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    for _ in range(2):
        extract_snapshot(rows, path, date(1998, 6, 30))
    return read_snapshot(spark, path, date(1998, 1, 31))


@query(
    "csv_export",
    "S12 O1",
    with_ctes(
        s.LINEITEM_CTE,
        select="""SELECT delivery_date, quarter_of_day, count(*) AS n, sum(value) AS total FROM li
WHERE delivery_date <= DATE '2000-12-31' GROUP BY 1, 2""",
    ),
)
def csv_export(spark, folder):
    rows = s.lineitem_quarters(spark, folder).groupBy("delivery_date", "quarter_of_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    export_csv(rows, path, date(2000, 12, 31))
    schema = "delivery_date date, quarter_of_day int, n bigint, total double"
    return spark.read.schema(schema).option("header", True).csv(path)


def _thirds():
    return F.pmod(F.dayofyear("delivery_date"), F.lit(3)) == 0


def _refreshed_log(spark, folder):
    """A stored log of old versions and two thirds of the new ones, and a refresh with all new ones."""
    raw = payloads.curve_log(spark, folder)
    new = F.col("payload") != "<broken>"
    base = f"{shared_folder(spark)}/{uuid4().hex}"
    log = DayTable(spark, f"{base}/log", RAW_SCHEMA)
    state = DayTable(spark, f"{base}/state", refresh.STATE_SCHEMA)
    log.append(raw.where(~new | ~_thirds()))
    return base, log, log.version(), lambda: refresh.append_changed(log, state, raw.where(new))


@query(
    "refresh_appends",
    "I3 P19",
    with_ctes(
        payloads.CURVE_CTE,
        select="""SELECT delivery_date, series FROM states WHERE status = 'accepted'
  AND dayofyear(delivery_date) % 3 = 0""",
    ),
)
def refresh_appends(spark, folder):
    """What a refresh appends: accepted payloads that differ from the stored digest."""
    _, _, _, append = _refreshed_log(spark, folder)
    return append().select("delivery_date", "series")


@query("incremental_measurements", "P20 I3 S6 S9", ALL["xml_curve_expand"].sql)
def incremental_measurements(spark, folder):
    """Measurements of the stored log, then of what a refresh appended: the full build's rows."""
    base, log, before, append = _refreshed_log(spark, folder)
    table = DayTable(spark, f"{base}/measurements", MEASUREMENT_SCHEMA)
    table.append(measurements(log.read(version=before)))
    append()
    refresh.refresh_measurements(log, table, before)
    return table.read()


@query("incremental_model_input", "K8 I6 S8", ALL["flagship_model_input"].sql)
def incremental_model_input(spark, folder):
    """The wide table built from partly wrong measurements, then refreshed: the full build's rows."""
    right = s.measurements(spark, folder, s.AUTUMN)
    wrong = (F.pmod(F.dayofmonth("delivery_date"), F.lit(9)) == 0) & (
        F.col("series") == EVENT_SERIES["purchase"]
    )
    base = f"{shared_folder(spark)}/{uuid4().hex}"
    measured = DayTable(spark, f"{base}/measurements", right.schema)
    measured.append(right.withColumn("value", F.when(wrong, -1.0).otherwise(F.col("value"))))
    holidays = holiday_calendar(s.year_bounds(spark, folder, s.AUTUMN), s.holiday_ranges(spark, folder))
    rows = model_input(measured.read(), holidays, through=features.THROUGH)
    wide = DayTable(spark, f"{base}/wide", rows.schema)
    wide.append(rows)
    measured.overwrite(measured.read().where(~wrong).unionByName(right.where(wrong)))
    changed = right.where(wrong).select("delivery_date", "series").distinct()
    refresh.refresh_model_input(measured, wide, changed, holidays, through=features.THROUGH)
    return wide.read().withColumns({c: F.round(c, 6) for c in features.DIRECTIONS})


_LATER = "CAST(o_orderdate AS DATE) BETWEEN DATE '1993-03-01' AND DATE '1997-06-30'"
_FIRST = "DATE '1992-01-01' + CAST(s_suppkey * 37 % 2400 AS INTEGER)"


@query(
    "holiday_cache",
    "S18 K6",
    with_ctes(
        f"""stored AS (SELECT CAST(o_orderdate AS DATE) AS delivery_date,
    min(o_custkey) % 2 = 0 AS is_holiday_de_nationwide, max(o_custkey) % 3 = 0 AS is_holiday_lu
  FROM orders WHERE o_orderkey % 3 <> 0 OR year(CAST(o_orderdate AS DATE)) > 1994 GROUP BY 1)""",
        """asked AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS delivery_date
  FROM (SELECT CAST(min(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS lo,
    CAST(max(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS hi FROM orders WHERE """ + _LATER + "))",
        """gaps AS (SELECT DISTINCT year(delivery_date) AS y FROM asked
  WHERE delivery_date NOT IN (SELECT delivery_date FROM stored))""",
        f"""covered AS (SELECT DISTINCT s_suppkey % 2 = 0 AS de, CAST(unnest(generate_series(
    CAST({_FIRST} AS TIMESTAMP), CAST({_FIRST} + s_nationkey % 3 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
    AS delivery_date FROM supplier WHERE s_suppkey % 2 = 1 OR s_acctbal > 4000)""",
        select="""SELECT a.delivery_date, coalesce(bool_or(c.de), false) AS is_holiday_de_nationwide,
  coalesce(bool_or(NOT c.de), false) AS is_holiday_lu FROM asked a LEFT JOIN covered c USING (delivery_date)
WHERE year(a.delivery_date) IN (SELECT y FROM gaps) GROUP BY 1
UNION ALL SELECT s.* FROM stored s JOIN asked USING (delivery_date)
WHERE year(s.delivery_date) NOT IN (SELECT y FROM gaps)""",
    ),
)
def holiday_cache(spark, folder):
    """Order dates as a cache with holes: whole years with a hole are computed anew."""
    day = F.col("o_orderdate").cast("date")
    orders = s.table(spark, folder, "orders").withColumn("delivery_date", day)
    stored = (
        orders.where((F.col("o_orderkey") % 3 != 0) | (F.year("delivery_date") > 1994))
        .groupBy("delivery_date")
        .agg(
            (F.min("o_custkey") % 2 == 0).alias("is_holiday_de_nationwide"),
            (F.max("o_custkey") % 3 == 0).alias("is_holiday_lu"),
        )
    )
    bounds = orders.where(F.expr(_LATER)).agg(
        F.min("delivery_date").alias("start"), F.max("delivery_date").alias("end")
    )
    first = F.date_add(F.lit("1992-01-01").cast("date"), F.pmod(F.col("s_suppkey") * 37, F.lit(2400)).cast("int"))
    ranges = s.table(spark, folder, "supplier").select(
        F.when(F.col("s_suppkey") % 2 == 0, "DE").otherwise("LU").alias("country"),
        first.alias("start_date"),
        F.date_add(first, F.col("s_nationkey") % 3).alias("end_date"),
        (F.col("s_acctbal") > 4000).alias("nationwide"),
    )
    cache = DayTable(spark, f"{shared_folder(spark)}/{uuid4().hex}", HOLIDAY_SCHEMA)
    cache.append(stored)
    return cover_holidays(cache, bounds, ranges)
