"""Stored tables brought up to date from what was appended.

Changes travel as narrow keys: appended payloads to the measurements they hold, and these
through the layout's shifts to the days that use them. Only the months of those days are
read and written, however long the stored history is.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.market import MODEL_INPUT, MODEL_INPUT_COLUMNS, WEATHER_FIELDS, WEATHER_LOCATIONS, WideLayout
from quartergrid.operators.normalise import MARKET_POLICY, FillPolicy
from quartergrid.operators.versions import latest_version
from quartergrid.operators.wide import placement_table
from quartergrid.plans.model_input import model_input
from quartergrid.session import durable
from quartergrid.sources.measurements import accepted_payloads, is_weather, latest_payloads, measurements
from quartergrid.sources.tables import DayTable

KEYS = ("delivery_date", "series")
# Newest stored response of each key, by the digest of its payload, and the log version that held it.
STATE_SCHEMA = (
    "delivery_date date, series string, ingested_at timestamp, payload_sha256 string, log_version bigint"
)


def months_of(days: DataFrame, day: str = "delivery_date") -> list[str]:
    """Months (yyyy-MM) of the rows: at most twelve for each year."""
    found = days.select(F.date_format(day, "yyyy-MM").alias("month")).distinct().collect()
    return sorted(row["month"] for row in found)


def catch_up(log: DayTable, state: DayTable) -> None:
    """Fold the responses appended since the state's last log version into it.

    The state follows from the log alone, so a job that ended between the two writes is
    made good by the next call.
    """
    state.create()
    seen = state.read().agg(F.max("log_version")).first()[0]
    last = log.version()
    if seen is not None and seen >= last:
        return
    rows = log.read() if seen is None else log.added(seen)
    digests = rows.select(*KEYS, "ingested_at", F.sha2("payload", 256).alias("payload_sha256"))
    fresh = durable(digests)
    months = months_of(fresh)
    if not months:
        return
    held = state.read(months=months).drop("log_version").unionByName(fresh)
    newest = latest_version(held, KEYS, "ingested_at", ("payload_sha256",))
    state.replace_months(newest.withColumn("log_version", F.lit(last).cast("bigint")), months)


def append_changed(log: DayTable, state: DayTable, incoming: DataFrame) -> DataFrame:
    """Append accepted responses whose payload differs from the newest stored one; returns them.

    Reads the state of the batch's months and neither a stored payload nor other months.
    """
    catch_up(log, state)
    accepted = durable(accepted_payloads(incoming).withColumn("_digest", F.sha2("payload", 256)))
    stored = state.read(months=months_of(accepted)).select(*KEYS, "payload_sha256")
    changed = durable(
        accepted.join(stored, list(KEYS), "left")
        .where(~F.col("_digest").eqNullSafe(F.col("payload_sha256")))
        .select(*incoming.columns)
    )
    if not changed.isEmpty():
        log.append(changed)
        catch_up(log, state)
    return changed


def measured_keys(keys: DataFrame) -> DataFrame:
    """(delivery_date, series) of the measurements that the payloads of ``keys`` hold."""
    held = {
        cell: F.array(
            *(
                F.lit(f"weather.{place}.{field}")
                for place, _, _, at in WEATHER_LOCATIONS
                if at == cell
                for field, _, _ in WEATHER_FIELDS
            )
        )
        for cell in ("land", "sea")
    }
    cells = F.create_map(*(x for cell, names in held.items() for x in (F.lit(cell), names)))
    cell = F.element_at(F.split("series", r"\."), -1)
    names = F.when(is_weather(), F.try_element_at(cells, cell)).otherwise(F.array("series"))
    day = F.date_add("delivery_date", F.when(is_weather(), 1).otherwise(0))
    return keys.select(day.alias("delivery_date"), F.explode(names).alias("series")).distinct()


def refresh_measurements(log: DayTable, table: DayTable, since: int) -> DataFrame:
    """Measurements of every key with a response appended after log version ``since``.

    The newest response of such a key decides, as in a full build: where it is rejected,
    the key's measurements go. Returns the changed (delivery_date, series).
    """
    keys = durable(log.added(since).select(*KEYS).distinct())
    changed = durable(measured_keys(keys))
    months = months_of(changed)
    # The newest row per key and the keys share one partitioning.
    newest = latest_payloads(log.read(months=months_of(keys))).join(keys, list(KEYS), "left_semi")
    if months:
        held = table.read(months=months)
        stays = held.join(changed, list(KEYS), "left_anti").select(*held.columns)
        table.replace_months(stays.unionByName(measurements(newest)), months)
    return changed


def served_days(changed: DataFrame, layout: WideLayout = MODEL_INPUT, *, entity: Sequence[str] = ()) -> DataFrame:
    """Days whose wide rows use a changed (delivery_date, series), through every shift of the layout."""
    shifts = F.broadcast(placement_table(changed.sparkSession, layout).select("series", "_shift").distinct())
    day = F.date_add("delivery_date", F.col("_shift")).alias("delivery_date")
    return changed.join(shifts, "series").select(*entity, day).distinct()


def refresh_model_input(
    measured: DayTable,
    wide: DayTable,
    changed: DataFrame,
    holidays: DataFrame,
    *,
    through: date | Column | None = None,
    layout: WideLayout = MODEL_INPUT,
    policy: FillPolicy = MARKET_POLICY,
    entity: Sequence[str] = (),
    columns: Sequence[str] | None = MODEL_INPUT_COLUMNS,
) -> DataFrame:
    """Rebuild the wide days that use a changed measurement; returns these days.

    Days that are no longer complete go. All others stay as they are stored.
    """
    on = [*entity, "delivery_date"]
    days = durable(served_days(changed, layout, entity=entity))
    months = months_of(days)
    if not months:
        return days
    shifts = sorted({p.shift for p in layout.placements})
    back = F.explode(F.array(*(F.date_sub("delivery_date", shift) for shift in shifts)))
    needed = durable(days.select(*entity, back.alias("delivery_date")).distinct())
    sources = measured.read(months=months_of(needed)).join(needed, on, "left_semi")
    rebuilt = model_input(
        sources, holidays, through=through, layout=layout, policy=policy, entity=entity, columns=columns
    ).join(days, on, "left_semi")
    held = wide.read(months=months)
    stays = held.join(days, on, "left_anti").select(*held.columns)
    wide.replace_months(stays.unionByName(rebuilt), months)
    return days
