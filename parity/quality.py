"""Data-quality queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from parity import supplied as s
from parity.registry import query, with_ctes
from quartergrid.operators import quality as q
from quartergrid.plans.evaluate import published_quality
from quartergrid.plans.views import feature_quality, served_quality


@query(
    "null_profile",
    "A1 Q1",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE nullif(l_linenumber, 3) IS NULL) AS line_nulls,
  count(*) FILTER (WHERE nullif(l_returnflag, 'A') IS NULL) AS flag_nulls,
  count(*) FILTER (WHERE l_quantity IS NULL) AS l_quantity_nulls FROM lineitem""",
)
def null_profile(spark, folder):
    rows = s.table(spark, folder, "lineitem").select(
        F.nullif("l_linenumber", F.lit(3)).alias("line"),
        F.nullif("l_returnflag", F.lit("A")).alias("flag"),
        "l_quantity",
    )
    return q.null_profile(rows, ["line", "flag", "l_quantity"])


@query(
    "duplicate_keys",
    "A2 Q2",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    return q.duplicate_keys(s.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# A day per (supplier group, ship date): mostly complete, with planted defects.
DAYS_CTE = f"""{s.LINEITEM_CTE},
seed AS (SELECT delivery_date, count(*) AS n, sum(l_partkey)::BIGINT AS k FROM li GROUP BY 1),
rows_ AS (
  SELECT delivery_date, n, k, unnest(range(CASE WHEN k % 7 = 0 THEN 95 ELSE 96 END)) AS q FROM seed),
frame AS (
  SELECT delivery_date, CASE WHEN k % 11 = 0 AND q = 5 THEN 4 ELSE q END AS quarter_of_day,
    CASE WHEN k % 13 = 0 AND q = 9 THEN 'NaN'::DOUBLE ELSE (k + q)::DOUBLE END AS feature,
    CASE WHEN k % 17 = 0 AND q = 1 THEN NULL ELSE k % 2 = 0 END AS flag,
    CASE WHEN k % 5 = 0 OR (k % 19 = 0 AND q > 50) THEN NULL ELSE q::DOUBLE END AS target
  FROM rows_)"""


def _frame(spark, folder):
    seed = s.lineitem_quarters(spark, folder).groupBy("delivery_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("k")
    )
    slot, key = F.col("q"), F.col("k")
    rows = seed.withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.when(key % 7 == 0, 94).otherwise(95)))
    )
    return rows.select(
        "delivery_date",
        F.when((key % 11 == 0) & (slot == 5), 4).otherwise(slot).alias("quarter_of_day"),
        F.when((key % 13 == 0) & (slot == 9), float("nan"))
        .otherwise((key + slot).cast("double"))
        .alias("feature"),
        F.when(~((key % 17 == 0) & (slot == 1)), key % 2 == 0).alias("flag"),
        F.when(~((key % 5 == 0) | ((key % 19 == 0) & (slot > 50))), slot.cast("double")).alias(
            "target"
        ),
    )


_PROFILE = """SELECT delivery_date, count(*) AS rows, count(DISTINCT quarter_of_day) AS quarters,
  min(quarter_of_day) AS first_quarter, max(quarter_of_day) AS last_quarter, count(target) AS targets,
  count(*) FILTER (WHERE isnan(feature)) AS bad_features,
  count(*) FILTER (WHERE flag IS NULL) AS missing_flags FROM frame GROUP BY 1"""


@query(
    "day_quality",
    "Q6 Q7 F10 F11",
    with_ctes(
        DAYS_CTE,
        f"profile AS ({_PROFILE})",
        select="""SELECT *, CASE WHEN NOT (rows = 96 AND quarters = 96 AND first_quarter = 0
  AND last_quarter = 95 AND bad_features = 0 AND missing_flags = 0) THEN 'invalid'
  WHEN targets = 0 THEN 'unlabelled' WHEN targets < 96 THEN 'partial' ELSE 'complete' END AS verdict
FROM profile""",
    ),
)
def day_quality(spark, folder):
    return q.day_quality(_frame(spark, folder), ["feature"], "target", flags=["flag"])


@query(
    "snapshot_problems",
    "Q8 A10",
    with_ctes(
        DAYS_CTE,
        f"profile AS ({_PROFILE.replace('GROUP BY', 'WHERE delivery_date <= DATE %s GROUP BY')})".replace(
            "%s", "'2000-12-31'"
        ),
        select="""SELECT max(delivery_date) AS last_day, max(delivery_date) = DATE '2000-12-31'
  AS ends_on_cutoff, (max(delivery_date) - min(delivery_date) + 1) - count(*) AS missing_days,
  count(*) FILTER (WHERE NOT (rows = 96 AND quarters = 96 AND bad_features = 0
    AND missing_flags = 0 AND targets = 96)) AS incomplete_days FROM profile""",
    ),
)
def snapshot_problems(spark, folder):
    through = date(2000, 12, 31)
    rows = _frame(spark, folder).where(F.col("delivery_date") <= F.lit(through))
    verdicts = q.day_quality(rows, ["feature"], "target", flags=["flag"])
    return q.snapshot_problems(verdicts, through)


@query(
    "invalid_intervals",
    "Q9 F10",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS point, l_tax * 100 AS lower_bound,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_discount * 100 END AS upper_bound FROM lineitem
WHERE l_partkey % 50 = 0 OR l_tax * 100 > l_discount * 100""",
)
def invalid_intervals(spark, folder):
    rows = s.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("point"),
        (F.col("l_tax") * 100).alias("lower_bound"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_discount") * 100).alias("upper_bound"),
    )
    return q.invalid_intervals(rows, "point", "lower_bound", "upper_bound")


PUBLISHED_CTE = f"""{DAYS_CTE},
joined AS (
  SELECT r.delivery_date, CASE WHEN k % 11 = 0 AND q = 5 THEN 4 ELSE q END AS quarter_of_day,
    CASE WHEN k % 13 = 0 AND q > 90 THEN 'v2' ELSE 'v1' END AS model_version,
    CAST(r.delivery_date AS TIMESTAMP) - INTERVAL 1 DAY + CAST(k % 24 AS INTEGER) * INTERVAL 1 HOUR
      + CASE WHEN k % 17 = 0 AND q = 3 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END AS predicted_at,
    CASE WHEN k % 24 <= 10 OR (k % 24 = 11 AND k % 5 = 0) THEN 'operational'
      ELSE 'retrospective' END AS forecast_kind,
    CASE WHEN k % 19 = 0 AND q = 2 THEN NULL ELSE q::DOUBLE END AS price, k
  FROM rows_ r)"""


def _published(spark, folder):
    seed = s.lineitem_quarters(spark, folder).groupBy("delivery_date").agg(
        F.sum("l_partkey").alias("k")
    )
    slot, key = F.col("q"), F.col("k")
    hour = key % 24
    rows = seed.withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.when(key % 7 == 0, 94).otherwise(95)))
    )
    seconds = (
        F.unix_timestamp(F.date_add("delivery_date", -1).cast("timestamp"))
        + hour * 3600
        + F.when((key % 17 == 0) & (slot == 3), 60).otherwise(0)
    )
    price = F.when(~((key % 19 == 0) & (slot == 2)), slot.cast("double"))
    return rows.select(
        "delivery_date",
        F.when((key % 11 == 0) & (slot == 5), 4).otherwise(slot).alias("quarter_of_day"),
        F.when((key % 13 == 0) & (slot > 90), "v2").otherwise("v1").alias("model_version"),
        F.timestamp_seconds(seconds).alias("predicted_at"),
        F.when((hour <= 10) | ((hour == 11) & (key % 5 == 0)), "operational")
        .otherwise("retrospective")
        .alias("forecast_kind"),
        *(
            price.alias(c)
            for c in (
                "predicted_price_eur_per_mwh",
                "lower_price_eur_per_mwh",
                "upper_price_eur_per_mwh",
                "price_de_lu_sdac_eur_per_mwh",
                "price_de_lu_exaa_eur_per_mwh",
                "price_de_lu_sdac_lag_7d_eur_per_mwh",
            )
        ),
    )


@query(
    "published_quality",
    "Q10 A16 F14",
    with_ctes(
        PUBLISHED_CTE,
        f"""days AS (
  SELECT delivery_date, count(*) AS rows, count(DISTINCT quarter_of_day) AS quarters,
    count(*) FILTER (WHERE price IS NULL) AS nulls, min(model_version) AS model_version,
    min(predicted_at) AS predicted_at, min(forecast_kind) AS forecast_kind,
    count(DISTINCT model_version) AS versions, count(DISTINCT predicted_at) AS times
  FROM joined GROUP BY 1),
judged AS (
  SELECT *, rows < 96 OR nulls > 0 AS waiting,
    concat_ws(', ', CASE WHEN rows <> 96 OR quarters <> 96 THEN 'invalid quarter grid' END,
      CASE WHEN versions > 1 THEN 'multiple model versions' END,
      CASE WHEN times > 1 THEN 'multiple prediction times' END,
      CASE WHEN forecast_kind <> CASE WHEN predicted_at <=
          {s.utc("CAST(delivery_date - 1 AS TIMESTAMP) + INTERVAL 12 HOUR")}
        THEN 'operational' ELSE 'retrospective' END THEN 'kind conflicts with creation time' END)
      AS found FROM days)""",
        select="""SELECT delivery_date, rows, quarters, nulls, model_version, predicted_at, forecast_kind,
  CASE WHEN waiting THEN '' ELSE found END AS problems,
  CASE WHEN waiting THEN 'waiting' WHEN found <> '' THEN 'invalid' ELSE 'ready' END AS state
FROM judged""",
    ),
)
def published_quality_query(spark, folder):
    days = published_quality(_published(spark, folder))
    return days.withColumn("problems", F.array_join("problems", ", "))


@query(
    "served_quality",
    "V7 Q12 A16",
    with_ctes(
        PUBLISHED_CTE,
        """days AS (
  SELECT delivery_date, count(*) AS rows, count(DISTINCT quarter_of_day) AS quarters,
    count(price) AS settled_quarters, count(DISTINCT model_version) AS versions,
    count(DISTINCT predicted_at) AS times FROM joined GROUP BY 1)""",
        select="""SELECT delivery_date, rows, quarters, settled_quarters, settled_quarters = 96 AS settled,
  CASE WHEN rows <> 96 THEN 'incomplete' WHEN quarters <> 96 THEN 'invalid grid'
    WHEN versions <> 1 OR times <> 1 THEN 'inconsistent metadata'
    WHEN settled_quarters NOT IN (0, 96) THEN 'partial settlement' ELSE 'ok' END AS status FROM days""",
    ),
)
def served_quality_query(spark, folder):
    rows = _published(spark, folder).withColumnRenamed(
        "price_de_lu_sdac_eur_per_mwh", "actual_price_eur_per_mwh"
    )
    return served_quality(rows, ["model_version", "predicted_at", "forecast_kind"])


@query(
    "feature_quality",
    "Q12 F7",
    with_ctes(
        DAYS_CTE,
        """days AS (SELECT delivery_date, count(*) AS rows, count(DISTINCT quarter_of_day) AS quarters,
  count(*) FILTER (WHERE target IS NULL OR flag IS NULL) AS null_rows FROM frame GROUP BY 1)""",
        select="""SELECT *, CASE WHEN rows = 96 AND quarters = 96 AND null_rows = 0 THEN 'ok'
  ELSE 'incomplete' END AS status FROM days""",
    ),
)
def feature_quality_query(spark, folder):
    return feature_quality(_frame(spark, folder), ["target", "flag"])
