"""Numeric predicates, row-wise means and angles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_finite(value: Column) -> Column:
    """NULL, NaN or infinite."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean across columns of one row; NULL when any of them is NULL."""
    return reduce(add, columns) / float(len(columns))


def resultant(mean_sin: Column, mean_cos: Column) -> Column:
    return F.hypot(mean_sin, mean_cos)


def circular_degrees(mean_sin: Column, mean_cos: Column) -> Column:
    """Angle of a mean direction in [0, 360)."""
    angle = F.pmod(F.degrees(F.atan2(mean_sin, mean_cos)), F.lit(360.0))
    return F.when(angle > 360 - 1e-9, 0.0).otherwise(angle)


def reasons(rules: dict[str, Column]) -> Column:
    """Texts whose condition holds, in order, as an array."""
    texts = F.array(*(F.when(condition, text) for text, condition in rules.items()))
    return F.filter(texts, lambda text: text.isNotNull())


def join_reasons(texts: Column) -> Column:
    return F.array_join(texts, "; ")


def split_reasons(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "; "), lambda part: part != "")
