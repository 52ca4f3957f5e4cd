"""Latest versions, changed-only appends and keyed upserts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartergrid.operators.quality import duplicate_keys, require_none

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def latest_version(
    frame: DataFrame,
    keys: Sequence[str],
    version: str,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Newest row per key.

    Spark keeps one candidate row per key and task before the shuffle (window group
    limit), so a key with very many versions does not end up in one task.
    """
    order = [F.col(version).desc(), *(F.col(c).desc() for c in tie_break)]
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", ranked).where(F.col("_rank") == 1).drop("_rank")


def changed_only(
    incoming: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    payload: str,
    version: str,
) -> DataFrame:
    """Incoming rows whose payload differs from the newest stored one, or is new."""
    newest = latest_version(stored, keys, version, (payload,)).select(
        *keys, F.col(payload).alias("_stored")
    )
    return (
        incoming.join(newest, list(keys), "left")
        .where(~F.col(payload).eqNullSafe(F.col("_stored")))
        .select(*incoming.columns)
    )


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update matching keys and insert the rest; NULL keys match NULL keys."""
    check_merge_keys(keys)
    kept = target.alias("t").join(
        updates.select(*keys).alias("u"),
        reduce(and_, (F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys)),
        "left_anti",
    )
    return kept.unionByName(updates)


def check_merge_keys(keys: Sequence[str]) -> None:
    if not keys or not all(_IDENTIFIER.fullmatch(key) for key in keys):
        raise ValueError("merge keys must be simple identifiers")


def check_updates(updates: DataFrame, keys: Sequence[str]) -> None:
    """Refuse an empty update and one that would touch a row twice."""
    check_merge_keys(keys)
    if updates.isEmpty():
        raise ValueError("cannot merge an empty update")
    require_none(duplicate_keys(updates, keys), "update keys")
