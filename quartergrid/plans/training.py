"""Walk-forward evaluation, promotion and loss comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartergrid.functions.numbers import reasons
from quartergrid.market import (
    CALIBRATION_DAYS,
    LOWER,
    POINT,
    PROMOTION_REASONS,
    REFERENCE,
    TARGET,
    TARGET_COVERAGE,
    UPPER,
)
from quartergrid.operators.metrics import forecast_metrics, mean_absolute
from quartergrid.operators.shifts import (
    best_shrinkage,
    daily_gains,
    gain_interval,
    shift_metrics,
    shrinkage_errors,
)
from quartergrid.operators.splits import day_index, spread, walk_forward_roles
from quartergrid.plans.forecaster import (
    LOSSES,
    SPREAD,
    BoostingConfig,
    ConformalForecaster,
    Loss,
    days_before,
    days_from,
    fit_forecaster,
    fit_point,
    with_vector,
)
from quartergrid.session import durable, together

UNCHANGED = "reference as it is"


@dataclass(frozen=True)
class Fold:
    """Days before ``start`` train; days from ``start`` up to ``end`` are predicted."""

    start: date
    end: date | None


@dataclass(frozen=True)
class Candidate:
    model: ConformalForecaster
    point_shrinkage: float
    fold_metrics: tuple[dict, ...]
    test_metrics: dict
    baseline_mae: float
    promotion_reasons: tuple[str, ...]


def walk_forward_folds(frame: DataFrame, **sizes: int) -> tuple[Fold, ...]:
    """Fold boundaries, the final test last. Only one row per fold is fetched."""
    roles = walk_forward_roles(day_index(frame), **sizes)
    starts = (
        roles.where(F.col("role") != "train")
        .groupBy("fold")
        .agg(F.min("delivery_date").alias("start"))
        .orderBy("fold")
        .collect()
    )
    days = [row["start"] for row in starts]
    return tuple(Fold(a, b) for a, b in zip(days, [*days[1:], None], strict=True))


def promotion_reasons(
    candidate: dict[str, Column],
    baseline_mae: Column,
    production: dict[str, Column],
    coverage: float = TARGET_COVERAGE,
) -> Column:
    """Why a candidate is not promoted; NULL production metrics skip their rules."""
    return reasons(
        {
            PROMOTION_REASONS["reference"]: candidate["mae"] >= baseline_mae,
            PROMOTION_REASONS["coverage"]: candidate["picp"] < coverage - 0.02,
            PROMOTION_REASONS["mae"]: candidate["mae"] >= production["mae"],
            PROMOTION_REASONS["interval"]: candidate["interval_score"]
            >= production["interval_score"],
        }
    )


def compatible(production: ConformalForecaster | None, candidate: ConformalForecaster) -> bool:
    """Only models on the same features and data version are compared."""
    return (
        production is not None
        and len(production.features) == len(candidate.features)
        and production.model_data_version == candidate.model_data_version
    )


def model_metrics(
    model: ConformalForecaster, frame: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    predicted = model.predict(frame)
    metrics = forecast_metrics(model.target, POINT, LOWER, UPPER, coverage=model.coverage)
    return predicted.groupBy(*by).agg(*metrics)


def evaluate_candidate(
    frame: DataFrame,
    features: Sequence[str],
    *,
    target: str = TARGET,
    reference: str = REFERENCE,
    coverage: float = TARGET_COVERAGE,
    calibration_days: int = CALIBRATION_DAYS,
    production: ConformalForecaster | None = None,
    config: BoostingConfig = BoostingConfig(),
    **sizes: int,
) -> Candidate:
    """Choose the shrinkage on rolling folds, test once, and refit when promoted."""
    settings = {
        "target": target, "reference": reference, "coverage": coverage,
        "calibration_days": calibration_days, "config": config,
    }
    *folds, last = walk_forward_folds(frame, **sizes)
    fits = [partial(fit_forecaster, days_before(frame, f.start), features, **settings) for f in folds]
    models = together(frame.sparkSession, fits)
    residual = spread(target, reference).alias("residual")
    pooled = reduce(
        DataFrame.unionByName,
        (
            model.corrections(days_from(frame, f.start, f.end)).select("correction", residual)
            for model, f in zip(models, folds, strict=True)
        ),
    )
    errors = shrinkage_errors(pooled, "correction", "residual")
    shrinkage = best_shrinkage(errors).first()["shrinkage"]
    fold_metrics = tuple(
        model_metrics(model.with_shrinkage(shrinkage), days_from(frame, f.start, f.end))
        .first()
        .asDict()
        for model, f in zip(models, folds, strict=True)
    )
    tested = fit_forecaster(
        days_before(frame, last.start), features, point_shrinkage=shrinkage, **settings
    )
    test = days_from(frame, last.start)
    test_metrics = model_metrics(tested, test).first().asDict()
    baseline = test.agg(mean_absolute(spread(target, reference))).first()[0]
    rival = None
    if compatible(production, tested):
        rival = model_metrics(production, test).first().asDict()
    found = _reason_list(frame, test_metrics, baseline, rival, coverage)
    final = tested
    if not found:
        final = fit_forecaster(frame, features, point_shrinkage=shrinkage, **settings)
    return Candidate(final, shrinkage, fold_metrics, test_metrics, baseline, found)


def _reason_list(frame, metrics, baseline, rival, coverage) -> tuple[str, ...]:
    rival = rival or {"mae": None, "interval_score": None}
    as_columns = {k: F.lit(v).cast("double") for k, v in metrics.items()}
    rival_columns = {k: F.lit(v).cast("double") for k, v in rival.items()}
    found = promotion_reasons(as_columns, F.lit(baseline), rival_columns, coverage)
    return tuple(frame.sparkSession.range(1).select(found).first()[0])


def loss_predictions(
    frame: DataFrame,
    features: Sequence[str],
    losses: Sequence[Loss] = LOSSES,
    *,
    target: str = TARGET,
    reference: str = REFERENCE,
    config: BoostingConfig = BoostingConfig(),
    **sizes: int,
) -> DataFrame:
    """Out-of-sample shifts of every loss on the same folds and the same test."""
    *folds, last = walk_forward_folds(frame, **sizes)
    prepared = with_vector(frame.withColumn(SPREAD, spread(target, reference)), features).persist()
    columns = ("point_loss", "split", "delivery_date", "quarter_of_day", "actual", "predicted")
    parts = []
    for fold, split in [*((f, "validation") for f in folds), (last, "holdout")]:
        evaluation = days_from(prepared, fold.start, fold.end)
        train = days_before(prepared, fold.start)
        scored = [(UNCHANGED, evaluation.withColumn("_point", F.lit(0.0)))]
        fits = together(frame.sparkSession, [partial(fit_point, train, config, s) for s in losses])
        scored += [(s.label, fit.transform(evaluation)) for s, fit in zip(losses, fits, strict=True)]
        parts += [
            rows.select(
                F.lit(label).alias("point_loss"),
                F.lit(split).alias("split"),
                "delivery_date",
                "quarter_of_day",
                F.col(SPREAD).alias("actual"),
                F.col("_point").alias("predicted"),
            ).select(*columns)
            for label, rows in scored
        ]
    # Kept once: the comparison reads the predictions several times.
    predictions = durable(reduce(DataFrame.unionByName, parts))
    prepared.unpersist()
    return predictions


def loss_comparison(predictions: DataFrame, *, samples: int = 10_000) -> DataFrame:
    """Validation MAE, holdout metrics and holdout gain with interval, per loss."""
    validation = F.col("split") == "validation"
    cv = predictions.where(validation).groupBy("point_loss").agg(
        mean_absolute(F.col("predicted") - F.col("actual")).alias("cv_mae")
    )
    holdout = predictions.where(~validation)
    metrics = holdout.groupBy("point_loss").agg(*shift_metrics("actual", "predicted"))
    metrics = metrics.withColumnsRenamed({"mae": "holdout_sdac_mae", "rmse": "holdout_rmse"})
    gains = gain_interval(
        daily_gains(holdout, "actual", "predicted", by=["point_loss"]),
        by=["point_loss"],
        samples=samples,
    ).withColumnsRenamed(
        {
            "mae_gain": "mae_gain_vs_exaa",
        }
    )
    return cv.join(metrics, "point_loss").join(gains, "point_loss")
