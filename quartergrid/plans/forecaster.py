"""Reference-anchored boosted forecasts with conformal intervals, on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartergrid.market import (
    CALIBRATION_DAYS,
    HUBER_DELTA,
    LOWER,
    MATERIAL_SHIFT,
    MODEL_DATA_VERSION,
    POINT,
    REFERENCE,
    TARGET,
    TARGET_COVERAGE,
    UPPER,
)
from quartergrid.operators.monitoring import feature_statistics, input_drift
from quartergrid.operators.splits import day_index, sample_weights, spread
from quartergrid.operators.statistics import conformal_rank, order_statistic
from quartergrid.plans.boosting import BoostedTrees, Objective, boost
from quartergrid.session import together

SPREAD = "_spread"
VECTOR = "_features"
BOUNDS = ("_lower_spread", "_upper_spread")


@dataclass(frozen=True)
class BoostingConfig:
    """Knobs of the boosted point model and of the two boosted bounds.

    Boosting ends when ``patience`` rounds bring no gain on the held-out rows, and keeps the
    best round.
    """

    step: float = 0.05
    rounds: int = 250
    patience: int = 10
    depth: int = 4
    interval_depth: int = 3
    min_rows: int = 40
    validation_share: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Loss:
    """How the point model is fitted; ``heavy_from`` doubles as the bound of large shifts."""

    label: str
    kind: str
    heavy_from: float | None = None


# Same features, folds and settings; only the loss differs.
LOSSES = tuple(
    Loss(label, kind, heavy_from)
    for label, kind, heavy_from in (
        ("boosted, absolute", "absolute", None),
        ("boosted, squared", "squared", None),
        (f"boosted, Huber from {HUBER_DELTA:g} EUR/MWh", "huber", None),
        (f"boosted, absolute, shifts from {MATERIAL_SHIFT:g} weighted", "absolute", MATERIAL_SHIFT),
    )
)


def assemble_interval(
    point: Column, lower: Column, upper: Column, adjustment: Column, reference: Column
) -> tuple[Column, Column, Column]:
    """Point, lower and upper price from spreads; the point is always inside."""
    low = F.least(F.least(lower, upper) - adjustment, point)
    high = F.greatest(F.greatest(lower, upper) + adjustment, point)
    return reference + point, reference + low, reference + high


def conformal_score(actual: Column, lower: Column, upper: Column) -> Column:
    return F.greatest(lower - actual, actual - upper)


def conformal_adjustment(
    frame: DataFrame,
    actual: str,
    lower: str,
    upper: str,
    *,
    coverage: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Finite-sample widening of the bounds; negative when they are too wide."""
    score = conformal_score(F.col(actual), F.col(lower), F.col(upper))
    return order_statistic(
        frame.select(*by, score.alias("_score")),
        "_score",
        conformal_rank(coverage),
        by=by,
        name="adjustment",
    )


def with_vector(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(
        inputCols=list(features), outputCol=VECTOR, handleInvalid="error"
    )
    return assembler.transform(frame)


def fit_point(frame: DataFrame, config: BoostingConfig, loss: Loss = LOSSES[0]) -> BoostedTrees:
    """Fit the spread model. Early stopping watches a hashed tenth of the rows."""
    objective = Objective(loss.kind, HUBER_DELTA if loss.kind == "huber" else None)
    weight = None if loss.heavy_from is None else sample_weights(F.col(SPREAD), threshold=loss.heavy_from)
    return _boosted(frame, objective, config, "_point", config.depth, weight)


def fit_bounds(frame: DataFrame, coverage: float, config: BoostingConfig) -> tuple[BoostedTrees, BoostedTrees]:
    """Boosted models of the spread's lower and upper quantile under the pinball loss."""
    alpha = 1 - coverage

    def fit(share: float, name: str) -> BoostedTrees:
        return _boosted(frame, Objective("quantile", share), config, name, config.interval_depth, None)

    shares = zip((alpha / 2, 1 - alpha / 2), BOUNDS, strict=True)
    lower, upper = together(frame.sparkSession, [partial(fit, *one) for one in shares])
    return lower, upper


def _boosted(
    frame: DataFrame, objective: Objective, config: BoostingConfig, output: str, depth: int, weight: Column | None
) -> BoostedTrees:
    bucket = F.pmod(F.xxhash64("delivery_date", "quarter_of_day"), F.lit(1000))
    return boost(
        frame, objective, vector=VECTOR, label=SPREAD, output=output,
        held_out=bucket < int(config.validation_share * 1000), step=config.step, rounds=config.rounds,
        patience=config.patience, depth=depth, min_rows=config.min_rows, seed=config.seed, weight=weight,
    )


@dataclass(frozen=True)
class ConformalForecaster:
    """Fitted point model, models of the lower and upper quantile, and calibration."""

    features: tuple[str, ...]
    target: str
    reference: str
    point_model: BoostedTrees
    lower_model: BoostedTrees
    upper_model: BoostedTrees
    adjustment: float
    statistics: dict[str, tuple[float, float]]
    coverage: float = TARGET_COVERAGE
    calibration_days: int = CALIBRATION_DAYS
    point_shrinkage: float = 1.0
    model_data_version: int = MODEL_DATA_VERSION

    def with_shrinkage(self, shrinkage: float) -> ConformalForecaster:
        if not 0 <= shrinkage <= 1:
            raise ValueError("shrinkage lies in [0, 1]")
        return replace(self, point_shrinkage=shrinkage)

    def corrections(self, frame: DataFrame, name: str = "correction") -> DataFrame:
        """Unshrunk point corrections of the reference."""
        scored = self.point_model.transform(with_vector(frame, self.features))
        return scored.withColumnRenamed("_point", name).drop(VECTOR)

    def predict(self, frame: DataFrame) -> DataFrame:
        """Add point, lower and upper prices to every row."""
        scored = self.point_model.transform(with_vector(frame, self.features))
        scored = self.upper_model.transform(self.lower_model.transform(scored))
        lower, upper = (F.col(c) for c in BOUNDS)
        columns = assemble_interval(
            F.col("_point") * self.point_shrinkage,
            lower,
            upper,
            F.lit(self.adjustment),
            F.col(self.reference),
        )
        named = dict(zip((POINT, LOWER, UPPER), columns, strict=True))
        return scored.withColumns(named).drop(VECTOR, *BOUNDS, "_point")

    def drift(self, predicted: DataFrame, by: Sequence[str]) -> DataFrame:
        """Input and output drift of predicted rows against the training statistics."""
        fixed = {
            name: (F.lit(mean), F.lit(scale)) for name, (mean, scale) in self.statistics.items()
        }
        return input_drift(
            predicted,
            {name: F.col(name).cast("double") for name in self.features},
            fixed,
            by,
            point=F.col(POINT),
            target_statistics=fixed[self.target],
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Write models and metadata; an existing version is never overwritten."""
        for name, model in (("point", self.point_model), ("lower", self.lower_model), ("upper", self.upper_model)):
            model.save(spark, f"{path}/{name}")
        metadata = {
            "features": self.features,
            "target": self.target,
            "reference": self.reference,
            "adjustment": self.adjustment,
            "statistics": self.statistics,
            "coverage": self.coverage,
            "calibration_days": self.calibration_days,
            "point_shrinkage": self.point_shrinkage,
            "model_data_version": self.model_data_version,
        }
        row = spark.createDataFrame([(json.dumps(metadata),)], "value string")
        row.coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ConformalForecaster:
        stored = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        if stored["model_data_version"] != MODEL_DATA_VERSION:
            raise ValueError(f"model must be retrained on data version {MODEL_DATA_VERSION}")
        stored["features"] = tuple(stored["features"])
        stored["statistics"] = {k: tuple(v) for k, v in stored["statistics"].items()}
        return cls(
            **{f"{name}_model": BoostedTrees.load(spark, f"{path}/{name}") for name in ("point", "lower", "upper")},
            **stored,
        )


def fit_forecaster(
    frame: DataFrame,
    features: Sequence[str],
    *,
    target: str = TARGET,
    reference: str = REFERENCE,
    coverage: float = TARGET_COVERAGE,
    calibration_days: int = CALIBRATION_DAYS,
    point_shrinkage: float = 1.0,
    config: BoostingConfig = BoostingConfig(),
) -> ConformalForecaster:
    """Fit on the rows of fully labelled days.

    The point model sees all days. The quantile models leave out the last
    ``calibration_days``, which then calibrate the bounds.
    """
    if not 0 < coverage < 1 or not 0 <= point_shrinkage <= 1:
        raise ValueError("coverage lies in (0, 1), shrinkage in [0, 1]")
    days = day_index(frame)
    first_calibration = days.where(F.col("day_index") == F.col("days") - calibration_days).first()
    if first_calibration is None or first_calibration["day_index"] == 0:
        raise ValueError("too few days: none is left before the calibration days")
    cut = F.lit(first_calibration["delivery_date"])
    prepared = with_vector(
        frame.withColumn(SPREAD, spread(target, reference)), features
    ).persist()
    try:
        early = prepared.where(F.col("delivery_date") < cut)
        fits = (lambda: fit_point(prepared, config), lambda: fit_bounds(early, coverage, config))
        point_model, (lower_model, upper_model) = together(frame.sparkSession, fits)
        lower, upper = (F.col(c) for c in BOUNDS)
        late = prepared.where(F.col("delivery_date") >= cut)
        calibration = upper_model.transform(lower_model.transform(late)).select(
            SPREAD, F.least(lower, upper).alias("_low"), F.greatest(lower, upper).alias("_high")
        )
        adjustment = conformal_adjustment(
            calibration, SPREAD, "_low", "_high", coverage=coverage
        ).first()["adjustment"]
        statistics = _statistics(prepared, (*features, target))
    finally:
        prepared.unpersist()
    return ConformalForecaster(
        features=tuple(features), target=target, reference=reference, point_model=point_model,
        lower_model=lower_model, upper_model=upper_model, adjustment=float(adjustment),
        statistics=statistics, coverage=coverage, calibration_days=calibration_days,
        point_shrinkage=point_shrinkage,
    )


def _statistics(frame: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = frame.agg(
        *feature_statistics({c: F.col(c).cast("double") for c in columns})
    ).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__scale"]) for c in columns}


def days_before(frame: DataFrame, day: date) -> DataFrame:
    return frame.where(F.col("delivery_date") < F.lit(day))


def days_from(frame: DataFrame, start: date, end: date | None = None) -> DataFrame:
    kept = frame.where(F.col("delivery_date") >= F.lit(start))
    return kept if end is None else kept.where(F.col("delivery_date") < F.lit(end))
