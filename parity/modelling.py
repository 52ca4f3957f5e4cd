"""Model fits on line-item quarters with far fewer rounds and features than the defaults.

The early stop needs ten rounds without a gain and so cannot occur in six; tests/test_boosting.py
shows it.

Trees have no SQL form; the queries return what SQL can state of a fit's results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parity import supplied as s
from parity.registry import query, with_ctes
from quartergrid.functions.numbers import any_of, non_finite
from quartergrid.market import (
    LOWER,
    POINT,
    PROMOTION_REASONS,
    REFERENCE,
    TARGET,
    TARGET_COVERAGE,
    UPPER,
)
from quartergrid.plans.forecaster import (
    LOSSES,
    BoostingConfig,
    days_before,
    days_from,
    fit_forecaster,
)
from quartergrid.plans.training import (
    UNCHANGED,
    evaluate_candidate,
    loss_comparison,
    loss_predictions,
    walk_forward_folds,
)

FEATURES = (REFERENCE, "line", "part", "supplier", "quarter")
# Fewer and larger steps than the library's default, so that the fits of all folds end in minutes.
STEPS = BoostingConfig(step=0.5, rounds=6, depth=3)
# The spread is a sum over features, which one tree of bounded depth does not reach.
SHIFTED = "value + l_linenumber - 4 + 3 * (l_partkey % 7) + 2 * (l_suppkey % 5)"
SIZES = {"folds": 3, "validation_days": 28, "test_days": 28, "minimum_train_days": 120}


def _rows(spark, folder):
    return (
        s.lineitem_quarters(spark, folder)
        .groupBy("delivery_date", "quarter_of_day")
        .agg(
            F.avg("value").alias(TARGET),
            F.avg(F.expr(SHIFTED)).alias(REFERENCE),
            F.avg("l_linenumber").alias("line"),
            F.avg(F.col("l_partkey") % 7).alias("part"),
            F.avg(F.col("l_suppkey") % 5).alias("supplier"),
        )
        .withColumn("quarter", F.col("quarter_of_day").cast("double"))
    )


ROWS_CTE = f"""{s.LINEITEM_CTE},
rows_ AS (SELECT delivery_date, quarter_of_day, avg(value) AS target,
    avg({SHIFTED}) AS reference FROM li GROUP BY 1, 2),
days AS (SELECT delivery_date, row_number() OVER (ORDER BY delivery_date DESC) AS back
  FROM (SELECT DISTINCT delivery_date FROM rows_)),
test AS (SELECT r.* FROM rows_ r JOIN days USING (delivery_date) WHERE back <= {SIZES["test_days"]})"""


@query(
    "gbt_forecast",
    "L1 L2 L3 L4 L7 L11 T5",
    with_ctes(
        ROWS_CTE,
        select="""SELECT delivery_date, count(*) AS n, 0 AS misordered, true AS boosted, true AS closer,
  round(avg(abs(target - reference)), 6) AS reference_mae FROM test GROUP BY 1""",
    ),
)
def gbt_forecast(spark, folder):
    """Predicted test rows per day, whether bounds enclose the point, and whether the fit is of use.

    It is if more than one tree votes and the point is closer to the target than the
    reference over all test days.
    """
    rows = _rows(spark, folder)
    last = walk_forward_folds(rows, **SIZES)[-1]
    model = fit_forecaster(days_before(rows, last.start), FEATURES, config=STEPS)
    low, point, high = (F.col(c) for c in (LOWER, POINT, UPPER))
    ordered = (low <= point) & (point <= high)
    predicted = model.predict(days_from(rows, last.start))
    errors = predicted.agg(
        F.avg(F.abs(point - F.col(TARGET))).alias("own"), F.avg(F.abs(F.col(REFERENCE) - F.col(TARGET))).alias("unchanged")
    ).first()
    return (
        predicted.groupBy("delivery_date")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.coalesce(ordered, F.lit(False))).alias("misordered"),
            F.lit(model.point_model.getNumTrees > 1).alias("boosted"),
            F.lit(errors["own"] < errors["unchanged"]).alias("closer"),
            F.round(F.avg(F.abs(F.col(TARGET) - F.col(REFERENCE))), 6).alias("reference_mae"),
        )
    )


@query(
    "candidate_evaluation",
    "L5 L6 L7 L8 L9 K13",
    with_ctes(
        ROWS_CTE,
        select="""SELECT 3 AS folds, round(avg(abs(target - reference)), 6) AS reference_mae,
  true AS strength_allowed, true AS gate_agrees FROM test""",
    ),
)
def candidate_evaluation(spark, folder):
    """Folds, the reference's test error, and whether the gate follows the test metrics."""
    found = evaluate_candidate(_rows(spark, folder), FEATURES, config=STEPS, **SIZES)
    mae, inside = found.test_metrics["mae"], found.test_metrics["picp"]
    wanted = [
        PROMOTION_REASONS[name]
        for name, fails in (
            ("reference", mae >= found.baseline_mae),
            ("coverage", inside < TARGET_COVERAGE - 0.02),
        )
        if fails
    ]
    row = (
        len(found.fold_metrics),
        round(found.baseline_mae, 6),
        0 <= found.point_shrinkage <= 1,
        list(found.promotion_reasons) == wanted,
    )
    schema = "folds bigint, reference_mae double, strength_allowed boolean, gate_agrees boolean"
    return spark.createDataFrame([row], schema)


@query(
    "loss_comparison",
    "L12 M15 K14 M13",
    with_ctes(
        ROWS_CTE,
        select=f"""SELECT '{UNCHANGED}' AS point_loss, round(avg(abs(target - reference)), 6) AS reference_mae,
  true AS finite FROM test UNION ALL SELECT label, NULL, true FROM (VALUES
  {", ".join(f"('{loss.label}')" for loss in LOSSES)}) AS losses(label)""",
    ),
)
def loss_comparison_query(spark, folder):
    """One row per loss with finite errors; the unchanged reference's error is stated by SQL."""
    table = loss_comparison(loss_predictions(_rows(spark, folder), FEATURES, LOSSES, config=STEPS, **SIZES))
    measured = [F.col(c) for c in ("cv_mae", "holdout_sdac_mae", "holdout_rmse")]
    unchanged = F.col("point_loss") == UNCHANGED
    return table.select(
        "point_loss",
        F.when(unchanged, F.round("holdout_sdac_mae", 6)).alias("reference_mae"),
        (~any_of([non_finite(c) for c in measured])).alias("finite"),
    )
