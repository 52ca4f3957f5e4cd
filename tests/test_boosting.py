import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quartergrid.operators.statistics import order_statistic
from quartergrid.plans import boosting
from quartergrid.plans.boosting import BoostedTrees, Objective, boost, quantile_rank

SETTINGS = {"vector": "v", "label": "y", "output": "p", "step": 0.3, "depth": 3, "min_rows": 10}


@pytest.fixture(scope="module")
def rows(spark):
    """A step in ``x`` and skewed noise, with every eleventh label far off."""
    i = F.col("id")
    noise = F.pow(F.abs(F.sin(i * 12.9898)), F.lit(3.0)) * 6
    frame = spark.range(1500).select(
        "id", (i % 17).cast("double").alias("x"), (i % 5).cast("double").alias("z"),
        (F.when(i % 17 > 8, 10.0).otherwise(0.0) + noise + F.when(i % 11 == 3, 80.0).otherwise(0.0)).alias("y"),
    )
    return VectorAssembler(inputCols=["x", "z"], outputCol="v").transform(frame).cache()


def test_leaf_values_are_the_best_constants(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(float(leaf), float(round(x, 3)), float(w)) for leaf in (1, 4) for x, w in zip(rng.normal(leaf, 3, 41), rng.integers(1, 4, 41))]
    frame = spark.createDataFrame(data, f"{boosting.LEAF} double, {boosting.RESIDUAL} double, {boosting.WEIGHT} double")
    plain = frame.drop(boosting.WEIGHT)
    for objective in (Objective("squared"), Objective("absolute"), Objective("huber", 1.5), Objective("quantile", 0.05), Objective("quantile", 0.9)):
        for weighted, table in ((False, plain), (True, frame)):
            values = objective.leaf_values(table, True)
            assert values == objective.leaf_values(table, False)
            for leaf in (1.0, 4.0):
                own = [(x, w if weighted else 1.0) for at, x, w in data if at == leaf]

                def loss(c, own=own, objective=objective):
                    total = 0.0
                    for x, w in own:
                        r = x - c
                        if objective.kind == "squared":
                            total += w * r * r
                        elif objective.kind == "absolute":
                            total += w * abs(r)
                        elif objective.kind == "quantile":
                            total += w * max(objective.at * r, (objective.at - 1) * r)
                        else:
                            total += w * (r * r / 2 if abs(r) <= 1.5 else 1.5 * (abs(r) - 0.75))
                    return total

                best = min(loss(c) for c in np.linspace(-9, 14, 2301))
                # The Huber step is one step towards the minimum.
                allowed = 1.02 if objective.kind == "huber" else 1 + 1e-6
                assert loss(values[leaf]) <= best * allowed + 1e-9


def test_weighted_order_statistic_counts_repeats(spark):
    data = [(1, 3.0, 2.0), (1, 1.0, 1.0), (1, 9.0, 4.0), (2, 5.0, 1.0)]
    frame = spark.createDataFrame(data, "g int, x double, w double")
    repeated = frame.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    for share in (0.1, 0.4, 0.5, 0.9):
        one = order_statistic(frame, "x", quantile_rank(share), by=["g"], weight="w")
        two = order_statistic(repeated, "x", quantile_rank(share), by=["g"])
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_losses_pull_apart_and_the_early_stop_is_seen(rows):
    held = F.col("id") % 10 == 0
    fits = {
        kind: boost(rows, Objective(kind, at), held_out=held, rounds=25, patience=3, **SETTINGS)
        for kind, at in (("absolute", None), ("squared", None), ("huber", 2.0))
    }
    stopped = fits["absolute"]
    assert stopped.stopped and len(stopped.errors) < 25 and stopped.getNumTrees == boosting.best_round(list(stopped.errors))
    assert all(e >= stopped.errors[stopped.getNumTrees - 1] for e in stopped.errors)
    usual = F.col("id") % 11 != 3
    error = {k: m.transform(rows).where(usual).agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0] for k, m in fits.items()}
    # Labels that are far off move the mean, and hardly the median or the Huber fit.
    assert max(error["absolute"], error["huber"]) < 3 and error["squared"] > 2 * error["absolute"]
    assert abs(error["huber"] - error["absolute"]) > 1e-6


def test_quantile_models_cover_their_share_before_any_calibration(rows):
    held = F.col("id") % 10 == 0
    for share in (0.1, 0.8):
        model = boost(rows, Objective("quantile", share), held_out=held, rounds=8, patience=8, **SETTINGS)
        below = model.transform(rows).agg(F.avg((F.col("y") <= F.col("p")).cast("double"))).first()[0]
        assert abs(below - share) < 0.06


def test_models_survive_a_round_trip_and_need_rows(spark, rows, tmp_path):
    model = boost(rows, Objective("absolute"), held_out=F.lit(False), rounds=3, patience=2, **SETTINGS)
    assert model.getNumTrees == 3 and not model.stopped
    model.save(spark, str(tmp_path / "m"))
    loaded = BoostedTrees.load(spark, str(tmp_path / "m"))
    assert loaded.transform(rows).select("id", "p").exceptAll(model.transform(rows).select("id", "p")).isEmpty()
    with pytest.raises(ValueError, match="no rows"):
        boost(rows.limit(0), Objective("absolute"), held_out=F.lit(False), rounds=3, patience=2, **SETTINGS)
    for kind, at in (("huber", None), ("quantile", 1.0), ("other", None)):
        with pytest.raises(ValueError):
            Objective(kind, at)
