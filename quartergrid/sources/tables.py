"""Stored tables: explicit schemas, month partitions, keyed merges and exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence, Set
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quartergrid.operators.calendar import days_between, holiday_calendar, uncovered_years
from quartergrid.operators.versions import check_updates, upsert
from quartergrid.session import durable

MONTH = "delivery_month"
WRITE = "write"


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    files, location = _file_system(spark, path)
    return files.exists(location)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders that a finished write has left."""
    files, location = _file_system(spark, path)
    names = (item.getPath().getName() for item in files.listStatus(location))
    return sorted(name for name in names if "=" in name)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Move a finished folder into place; the old one is set aside until that has worked."""
    files, new = _file_system(spark, source)
    aside = f"{target}.before"
    _, old = _file_system(spark, target)
    _, spare = _file_system(spark, aside)
    if files.exists(old):
        files.delete(spare, True)
        if not files.rename(old, spare):
            raise OSError(f"could not set {target} aside")
    if not files.rename(new, old):
        files.rename(spare, old)
        raise OSError(f"could not move {source} to {target}")
    files.delete(spare, True)


@dataclass(frozen=True)
class DayTable:
    """Parquet table of daily rows, partitioned by delivery month, with versions.

    Every commit writes the months it touches once, to a folder of its own, and then one
    manifest row: the version, its schema, and the folders that hold each month. A reader
    follows the last manifest row, so an interrupted write leaves the version before.
    Date filters prune whole months. Writers are expected to run one at a time, as the job
    graph does.
    """

    spark: SparkSession
    path: str
    schema: StructType | str
    day: str = "delivery_date"

    @property
    def _commits(self) -> str:
        return f"{self.path}/_commits"

    @property
    def _data(self) -> str:
        return f"{self.path}/data"

    def exists(self) -> bool:
        return path_exists(self.spark, self._commits)

    def create(self) -> None:
        """Create the table without rows unless it exists."""
        if not self.exists():
            self._record("create", self._declared(), [])

    def log(self) -> DataFrame:
        """All commits: version, operation, time, schema and parts."""
        return self.spark.read.parquet(self._commits)

    def read(self, version: int | None = None, months: Sequence[str] | None = None) -> DataFrame:
        """Rows of the last version, or of an earlier one; with ``months`` (yyyy-MM) only theirs are read."""
        stored = self._stored(version)
        return (stored if months is None else stored.where(F.col(MONTH).isin(list(months)))).drop(MONTH)

    def added(self, since: int) -> DataFrame:
        """Rows of the folders that version ``since`` did not name.

        In a table that is only appended to, these are the rows appended after that version.
        """
        return self._stored(without=set(self._manifest(since)["parts"])).drop(MONTH)

    def version(self) -> int:
        """Number of the last commit, to be stored with whatever is derived from it."""
        return self.log().agg(F.max("version")).first()[0]

    def append(self, rows: DataFrame) -> None:
        self._commit("append", rows, lambda part: True)

    def overwrite(self, rows: DataFrame) -> bool:
        """Replace everything; keep the last good rows when there are none to write.

        A new column layout replaces the old one.
        """
        if rows.isEmpty():
            return False
        self._commit("overwrite", rows, lambda part: False)
        return True

    def replace_months(self, rows: DataFrame, months: Sequence[str] | None = None) -> bool:
        """Replace only the months that occur in ``rows``, or the given ones, also where no row is left."""
        if months is None:
            if rows.isEmpty():
                return False
            self._commit("overwrite", rows)
            return True
        gone = {f"{MONTH}={month}" for month in months}
        self._commit("overwrite", rows, lambda part: part.rpartition("/")[2] not in gone)
        return True

    def merge(self, updates: DataFrame, keys: Sequence[str]) -> None:
        """Idempotent keyed upsert. Creates the table when it does not exist.

        A key must contain the day, so that a row cannot move between months.
        """
        if self.day not in keys:
            raise ValueError(f"merge keys must contain {self.day}")
        updates = durable(updates)
        check_updates(updates, keys)
        if not self.exists():
            self._commit("append", updates)
            return
        touched = updates.select(self._month().alias(MONTH)).distinct()
        months = [row[0] for row in touched.collect()]
        kept = self._stored().where(F.col(MONTH).isin(months)).drop(MONTH)
        self._commit("overwrite", upsert(kept, updates.select(*kept.columns), keys))

    def _month(self):
        return F.date_format(self.day, "yyyy-MM")

    def _declared(self) -> StructType:
        return StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema

    def _manifest(self, version: int | None = None):
        """Manifest row of a version; one row per commit is looked through."""
        rows = self.log() if version is None else self.log().where(F.col("version") == version)
        newest = F.max_by(F.struct("version", "schema", "parts"), "version").alias("row")
        found = rows.agg(newest).first()["row"]
        if found is None:
            raise ValueError(f"there is no version {version}")
        return found

    def _stored(self, version: int | None = None, without: Set[str] = frozenset()) -> DataFrame:
        found = self._manifest(version) if self.exists() else None
        schema = StructType.fromJson(json.loads(found["schema"])) if found else self._declared()
        fields = StructType(list(schema.fields)).add(MONTH, "string")
        paths = [f"{self._data}/{part}" for part in found["parts"] if part not in without] if found else []
        if not paths:
            return self.spark.createDataFrame([], fields)
        stored = self.spark.read.schema(StructType(list(fields.fields)).add(WRITE, "string"))
        return stored.option("basePath", self._data).parquet(*paths).drop(WRITE)

    def _commit(self, operation: str, rows: DataFrame, keeps=None) -> None:
        """Write the rows' months to a new folder, then name it in the manifest.

        ``keeps`` tells which parts of the version before stay; by default those of other months.
        """
        earlier = list(self._manifest()["parts"]) if self.exists() else []
        write = f"{WRITE}={uuid.uuid4().hex}"
        # Rebalancing splits a month, or a single day, that is larger than its share.
        (
            rows.withColumn(MONTH, self._month())
            .hint("rebalance", MONTH)
            .sortWithinPartitions(MONTH, self.day)
            .write.partitionBy(MONTH)
            .parquet(f"{self._data}/{write}")
        )
        months = _folders(self.spark, f"{self._data}/{write}")
        keeps = keeps or (lambda part: part.rpartition("/")[2] not in months)
        parts = [part for part in earlier if keeps(part)] + [f"{write}/{month}" for month in months]
        self._record(operation, rows.schema, parts)

    def _record(self, operation: str, schema: StructType, parts: list[str]) -> None:
        number = self.version() + 1 if self.exists() else 0
        row = self.spark.createDataFrame(
            [(number, operation, schema.json(), parts)],
            "version bigint, operation string, schema string, parts array<string>",
        ).withColumn("committed_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self._commits)


MODEL_VERSION_SCHEMA = (
    "version bigint, path string, model_data_version int, feature_count int, "
    "target_coverage double, training_through date, point_shrinkage double, "
    "baseline_exaa_mae double, test_metrics map<string,double>, "
    "promotion_reasons array<string>, published_at timestamp"
)


def log_model_version(spark: SparkSession, path: str, row: dict) -> None:
    frame = spark.createDataFrame([row], MODEL_VERSION_SCHEMA)
    frame.write.mode("append").parquet(path)


def production_version(log: DataFrame) -> DataFrame:
    """Newest version that passed every promotion rule."""
    promoted = log.where(F.size("promotion_reasons") == 0)
    newest = promoted.agg(F.max_by(F.struct(*log.columns), "version").alias("row"))
    return newest.where(F.col("row").isNotNull()).select("row.*")


def named_query(
    spark: SparkSession, statement: str, parameters: dict, **tables: DataFrame
) -> DataFrame:
    """SQL with named parameters over the given frames as ``{name}``."""
    return spark.sql(statement, args=parameters, **tables)


def extract_snapshot(frame: DataFrame, path: str, through: date) -> None:
    """Write the rows up to a date in key order; the old snapshot stays until then."""
    staged = f"{path}.tmp"
    cut = frame.where(F.col("delivery_date") <= F.lit(through))
    cut.orderBy("delivery_date", "quarter_of_day").write.mode("overwrite").parquet(staged)
    replace_folder(frame.sparkSession, staged, path)


def read_snapshot(spark: SparkSession, path: str, through: date) -> DataFrame:
    return spark.read.parquet(path).where(F.col("delivery_date") <= F.lit(through))


def export_csv(frame: DataFrame, path: str, through: date | None = None) -> None:
    """Whole wide table as CSV parts with headers, ordered across the parts."""
    if through is not None:
        frame = frame.where(F.col("delivery_date") <= F.lit(through))
    ordered = frame.orderBy("delivery_date", "quarter_of_day")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def export_results(results: DataFrame, path: str) -> None:
    """Small result table as one CSV file."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def holidays_covered(stored: DataFrame, start: date, end: date) -> bool:
    """Whether stored holiday rows cover every date of the range."""
    inside = stored.where(F.col("delivery_date").between(F.lit(start), F.lit(end)))
    return inside.count() == (end - start).days + 1


HOLIDAY_SCHEMA = "delivery_date date, is_holiday_de_nationwide boolean, is_holiday_lu boolean"


def cover_holidays(cache: DayTable, bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holiday flags of every date in ``bounds``, from the stored rows where these cover a year's dates.

    A year with a requested date that is not stored is computed from the holiday ranges as a
    whole and replaces what the table held of it; other years stay as they are.
    """
    cache.create()
    gaps = durable(uncovered_years(bounds, cache.read()))
    if not gaps.isEmpty():
        cache.replace_months(holiday_calendar(gaps, holidays))
    asked = days_between(bounds.select("start", "end"), "start", "end").select("delivery_date")
    return cache.read().join(asked, "delivery_date", "left_semi")
