"""Aggregates of reports: sums that are whole or null, agreement of a group, ratios of paired sums, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(value) -> Column:
    """Sum if no value of the group is null, else null; null for an empty group."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def zero_sum(value) -> Column:
    """Sum with nulls as 0."""
    return F.coalesce(F.sum(value), F.lit(0))


def consensus(value, otherwise: str = "mixed") -> Column:
    """The one distinct value of the group, else ``otherwise``; so has a group of nulls."""
    return F.when(F.min(value) == F.max(value), F.max(value)).otherwise(F.lit(otherwise))


def paired(value, weight) -> tuple[Column, Column]:
    """Sums of ``value`` and of ``weight`` over the rows where both can be used: value known and weight positive."""
    usable = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.sum(F.when(usable, F.col(value))), F.sum(F.when(usable, F.col(weight)))


def ratio(numerator, denominator, scale: float = 1.0) -> Column:
    """scale * numerator / denominator as double; null unless the denominator is positive."""
    n = F.col(numerator) if isinstance(numerator, str) else numerator
    d = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.when(d > 0, n.cast("double") * F.lit(float(scale)) / d.cast("double"))


def ordered_list(value, separator: str = ", ") -> Column:
    """The distinct values of the group in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)
