"""Gradient boosting for any loss with exact leaf values, on Spark ML trees.

A tree of the loss's negative gradients gives the structure of each round. Its leaves then
take the value that minimises the loss of their own rows: exact medians and quantiles, a
Huber step around the median, or the mean. Lineage is cut every few rounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartergrid.operators.statistics import order_statistic
from quartergrid.session import durable

MARGIN = "_margin"
RESIDUAL = "_residual"
GRADIENT = "_gradient"
WEIGHT = "_weight_of"
LEAF = "_leaf"
# Rounds between two cuts of the lineage.
CUT_EVERY = 4
TASK_ROWS = 50_000
# Up to so many rows, groups of residuals are sorted in memory; beyond, by ranges. Both are exact.
SORTED_ROWS = 1_000_000


def quantile_rank(share: float) -> Callable[[Column], Column]:
    """Rank of the smallest value that at least ``share`` of the weight does not pass."""
    return lambda weight: F.greatest(F.ceil(weight * F.lit(share)) - 1, F.lit(0))


@dataclass(frozen=True)
class Objective:
    """A loss of ``actual - predicted``: what trees follow, what leaves take, and what is watched.

    ``kind`` is ``squared``, ``absolute``, ``huber`` (``at`` is where the loss turns linear)
    or ``quantile`` (``at`` is the share below).
    """

    kind: str
    at: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("squared", "absolute", "huber", "quantile"):
            raise ValueError(f"unknown loss {self.kind}")
        if self.kind == "huber" and not (self.at and self.at > 0):
            raise ValueError("the Huber loss turns linear at a positive residual")
        if self.kind == "quantile" and not 0 < (self.at or 0) < 1:
            raise ValueError("a quantile lies in (0, 1)")

    def gradient(self, residual: Column) -> Column:
        if self.kind == "squared":
            return residual
        if self.kind == "absolute":
            return F.signum(residual)
        if self.kind == "huber":
            return clipped(residual, self.at)
        return F.when(residual > 0, self.at).otherwise(self.at - 1)

    def loss(self, residual: Column) -> Column:
        size = F.abs(residual)
        if self.kind == "squared":
            return residual * residual
        if self.kind == "absolute":
            return size
        if self.kind == "huber":
            return F.when(size <= self.at, residual * residual / 2).otherwise(self.at * (size - self.at / 2))
        return F.greatest(residual * self.at, residual * (self.at - 1))

    def leaf_values(self, rows: DataFrame, small: bool) -> dict[float, float]:
        """The best constant of each leaf: at most one row per leaf of a tree of bounded depth."""
        weighted = WEIGHT in rows.columns
        weight = F.col(WEIGHT) if weighted else F.lit(1.0)
        mean = (F.sum(weight * F.col(RESIDUAL)) / F.sum(weight)).alias("value")
        if self.kind == "squared":
            return _by_leaf(rows.groupBy(LEAF).agg(mean))
        share = self.at if self.kind == "quantile" else 0.5
        if small and not weighted:
            middle = rows.groupBy(LEAF).agg(
                F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {RESIDUAL})").alias("value")
            )
        else:
            kept = rows.select(LEAF, RESIDUAL, *([WEIGHT] if weighted else []))
            middle = order_statistic(
                kept, RESIDUAL, quantile_rank(share), by=[LEAF], name="value", weight=WEIGHT if weighted else None
            )
        found = _by_leaf(middle)
        if self.kind != "huber":
            return found
        away = clipped(F.col(RESIDUAL) - leaf_column(found), self.at)
        steps = _by_leaf(rows.groupBy(LEAF).agg((F.sum(weight * away) / F.sum(weight)).alias("value")))
        return {leaf: value + steps[leaf] for leaf, value in found.items()}


def clipped(value: Column, bound: float) -> Column:
    return F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))


def _by_leaf(found: DataFrame) -> dict[float, float]:
    return {row[LEAF]: float(row["value"]) for row in found.collect()}


def leaf_column(values: dict[float, float]) -> Column:
    """The value of the row's leaf."""
    pairs = [F.lit(x) for leaf, value in sorted(values.items()) for x in (float(leaf), float(value))]
    return F.create_map(*pairs)[F.col(LEAF)]


@dataclass(frozen=True)
class BoostedTrees:
    """A constant and trees whose leaves hold steps; ``errors`` are the watched losses by round."""

    vector: str
    output: str
    start: float
    step: float
    trees: tuple[DecisionTreeRegressionModel, ...]
    leaves: tuple[dict[float, float], ...]
    errors: tuple[float, ...] = ()
    stopped: bool = False

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as in Spark's ensembles
        return len(self.trees)

    def transform(self, frame: DataFrame) -> DataFrame:
        """Add the prediction as ``output``."""
        rows = frame.withColumn(self.output, F.lit(self.start))
        for tree, leaves in zip(self.trees, self.leaves, strict=True):
            rows = stepped(rows, tree, leaves, self.step, self.output)
        return rows

    def save(self, spark: SparkSession, path: str) -> None:
        for number, tree in enumerate(self.trees):
            tree.write().save(f"{path}/tree-{number}")
        told = {
            "vector": self.vector, "output": self.output, "start": self.start, "step": self.step,
            "leaves": [sorted(leaves.items()) for leaves in self.leaves], "errors": self.errors, "stopped": self.stopped,
        }
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        told = json.loads(spark.read.text(f"{path}/values").first()["value"])
        told["leaves"] = tuple(dict(map(tuple, leaves)) for leaves in told["leaves"])
        told["errors"] = tuple(told["errors"])
        numbers = range(len(told["leaves"]))
        trees = tuple(DecisionTreeRegressionModel.load(f"{path}/tree-{n}") for n in numbers)
        return cls(trees=trees, **told)


def stepped(
    rows: DataFrame, tree: DecisionTreeRegressionModel, leaves: dict[float, float], step: float, column: str
) -> DataFrame:
    located = tree.transform(rows)
    moved = F.col(column) + F.lit(step) * leaf_column(leaves)
    return located.withColumn(column, moved).drop(LEAF, tree.getPredictionCol())


def boost(
    frame: DataFrame,
    objective: Objective,
    *,
    vector: str,
    label: str,
    output: str,
    held_out: Column,
    step: float,
    rounds: int,
    patience: int,
    depth: int,
    min_rows: int,
    seed: int = 42,
    weight: Column | None = None,
) -> BoostedTrees:
    """Boost until ``patience`` rounds bring no gain on the held-out rows, and keep the best round.

    Without held-out rows all rounds are kept. Rows need finite labels.
    """
    columns = [F.col(vector), F.col(label).cast("double").alias(label), F.coalesce(held_out, F.lit(False)).alias("_held")]
    if weight is not None:
        columns.append(weight.cast("double").alias(WEIGHT))
    chosen = frame.select(*columns)
    counts = {row["_held"]: row["count"] for row in chosen.groupBy("_held").count().collect()}
    # Few rows in many partitions would spend every round on starting tasks.
    rows = durable(chosen.coalesce(sum(counts.values()) // TASK_ROWS + 1))
    if not counts.get(False):
        raise ValueError("no rows are left to fit")
    small, watched = counts[False] <= SORTED_ROWS, counts.get(True, 0) > 0
    alone = rows.where("NOT _held").withColumns({LEAF: F.lit(0.0), RESIDUAL: F.col(label)})
    start = objective.leaf_values(alone, small)[0.0]
    rows = rows.withColumn(MARGIN, F.lit(start))
    grower = DecisionTreeRegressor(
        featuresCol=vector, labelCol=GRADIENT, predictionCol="_tree", leafCol=LEAF, maxDepth=depth,
        minInstancesPerNode=min_rows, seed=seed, cacheNodeIds=False,
    )
    if weight is not None:
        grower = grower.setWeightCol(WEIGHT)
    trees, leaves, errors = [], [], []
    residual = F.col(label) - F.col(MARGIN)
    for number in range(rounds):
        led = rows.where("NOT _held").withColumn(RESIDUAL, residual).withColumn(GRADIENT, objective.gradient(F.col(RESIDUAL)))
        tree = grower.fit(led)
        found = objective.leaf_values(tree.transform(led), small)
        # A leaf always has training rows of its own, so every row finds a value.
        rows = stepped(rows, tree, found, step, MARGIN)
        trees.append(tree)
        leaves.append(found)
        if (number + 1) % CUT_EVERY == 0:
            rows = durable(rows)
        if watched:
            errors.append(rows.where("_held").agg(F.avg(objective.loss(residual))).first()[0])
            if number + 1 - best_round(errors) >= patience:
                break
    kept = best_round(errors) if watched else len(trees)
    stopped = len(trees) < rounds
    return BoostedTrees(vector, output, start, step, tuple(trees[:kept]), tuple(leaves[:kept]), tuple(errors), stopped)


def best_round(errors: list[float]) -> int:
    """The first round with the smallest error, counted from 1."""
    return min(range(len(errors)), key=errors.__getitem__) + 1

