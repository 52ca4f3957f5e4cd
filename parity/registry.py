"""Query registration: name, survey items covered, DataFrame builder and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quartergrid.session import use_utc

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Builder
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            return _plain(build(spark, folder))

        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, tuple(covers.split()), run, sql)
        return build

    return register


def _plain(frame: DataFrame) -> DataFrame:
    """Widen small integers and drop zones, so both engines return the same types."""
    casts = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double",
             "timestamp": "timestamp_ntz"}
    return frame.selectExpr(
        *(f"CAST(`{c}` AS {casts[t]}) AS `{c}`" if t in casts else f"`{c}`"
          for c, t in frame.dtypes)
    )


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
