"""Raw response log to typed measurements, with a quarantine for bad payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from quartergrid.market import WEATHER_MODEL
from quartergrid.operators.quality import null_profile, require_none
from quartergrid.operators.versions import latest_version
from quartergrid.session import use_utc
from quartergrid.sources.curve_documents import parse_curves
from quartergrid.sources.forecast_documents import parse_weather

RAW_SCHEMA = StructType(
    [
        StructField("delivery_date", DateType(), False),
        StructField("series", StringType(), False),
        StructField("payload", StringType(), False),
        StructField("ingested_at", TimestampType(), False),
    ]
)
MEASUREMENT_SCHEMA = StructType(
    [
        StructField("delivery_date", DateType(), False),
        StructField("delivery_start_utc", TimestampType(), False),
        StructField("series", StringType(), False),
        StructField("value", DoubleType(), False),
        StructField("unit", StringType(), False),
        StructField("source_ingested_at", TimestampType(), False),
    ]
)


def is_weather():
    return F.col("series").startswith(f"weather.{WEATHER_MODEL}.")


def require_raw(raw: DataFrame) -> None:
    """The log must have rows and no NULLs."""
    profile = null_profile(raw, RAW_SCHEMA.names).first()
    if profile["rows"] == 0:
        raise ValueError("raw log is empty")
    missing = [c for c in RAW_SCHEMA.names if profile[f"{c}_nulls"]]
    if missing:
        raise ValueError(f"raw log contains NULLs in {missing}")


def latest_payloads(raw: DataFrame) -> DataFrame:
    """Newest response per (day, series); equal times are settled by payload text."""
    return latest_version(raw, ("delivery_date", "series"), "ingested_at", ("payload",))


def parsed_payloads(raw: DataFrame) -> DataFrame:
    """Each payload with its status and its intervals in one common shape.

    Both document kinds are parsed in one pass over the log; a row only carries
    text into the parser of its own kind.
    """
    use_utc(raw.sparkSession)
    outcome = ("status", "reason", "intervals")
    weather, text = is_weather(), F.col("payload")
    curves = parse_curves(raw, F.when(~weather, text)).withColumn(
        "intervals",
        F.transform(
            "intervals",
            lambda item: F.struct(
                F.col("series").alias("series"),
                item["start"].alias("start"),
                item["value"].alias("value"),
                F.col("unit").alias("unit"),
            ),
        ),
    )
    curves = curves.withColumnsRenamed({c: f"_curve_{c}" for c in outcome}).drop("unit")
    parsed = parse_weather(curves, F.when(weather, text))
    chosen = (
        F.when(weather, F.col(c)).otherwise(F.col(f"_curve_{c}")).alias(c) for c in outcome
    )
    # A one-element generator: Spark does not push a later status filter below it,
    # where the filter would repeat the whole parse.
    return parsed.select(
        *raw.columns,
        F.date_add("delivery_date", F.when(weather, 1).otherwise(0)).alias("target_date"),
        F.inline_outer(F.array(F.struct(*chosen))),
    )


def payload_status(raw: DataFrame) -> DataFrame:
    """Status and reason of every payload, without its content."""
    return parsed_payloads(raw).select("delivery_date", "series", "ingested_at", "status", "reason")


def quarantine(raw: DataFrame) -> DataFrame:
    """Payloads that were not accepted, with the reason."""
    parsed = parsed_payloads(raw).where(F.col("status") != "accepted")
    return parsed.select(*raw.columns, "status", "reason")


def accepted_payloads(incoming: DataFrame) -> DataFrame:
    """The part of an incoming batch that may be stored."""
    return parsed_payloads(incoming).where(F.col("status") == "accepted").select(*incoming.columns)


def measurements(raw: DataFrame, *, strict: bool = False) -> DataFrame:
    """Typed measurements of the newest payloads; incomplete ones are left out.

    ``strict`` raises when any newest payload is malformed.
    """
    newest = latest_payloads(raw)
    if strict:
        bad = payload_status(newest).where(F.col("status") == "malformed")
        require_none(bad, "payloads")
    # Rejected payloads carry no intervals. The outer form keeps Spark from adding a
    # size filter below the projection, which would decode every document twice.
    exploded = parsed_payloads(newest).select(
        F.col("target_date").alias("delivery_date"),
        F.col("ingested_at").alias("source_ingested_at"),
        F.inline_outer("intervals"),
    )
    return exploded.where(F.col("start").isNotNull()).select(
        "delivery_date",
        F.col("start").alias("delivery_start_utc"),
        "series",
        "value",
        "unit",
        "source_ingested_at",
    )
