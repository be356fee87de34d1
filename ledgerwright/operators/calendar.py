"""Calendars of activity: one row a day, a status, a metric and its intensity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISJOINT = {"input": ["input_tokens"], "output": ["output_tokens"], "cache_read": ["cache_read"], "cache_write": ["cache_write"], "reasoning": ["reasoning"], "total": ["input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning"]}
ALONE = ("cost", "cost_per_million", "session_time")
MAX_CHART_DAYS = 31


def metric(names: list[str]) -> Column:
    """The sum of disjoint token fields, or one metric that stands alone; overlaps and unknown names are errors."""
    if len(names) == 1 and names[0] in ALONE:
        return {"cost": F.col("cost_usd"), "cost_per_million": F.when(F.col("total_tokens") > 0, F.col("cost_usd") * F.lit(1e6) / F.col("total_tokens")), "session_time": F.col("duration_ms").cast("double")}[names[0]]
    unknown = [n for n in names if n not in DISJOINT]
    if unknown or not names:
        raise ValueError(f"not a metric, or one that stands alone: {unknown}")
    used = [c for n in names for c in DISJOINT[n]]
    if len(used) != len(set(used)):
        raise ValueError("metrics overlap")
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in used), F.lit(0)).cast("double")


def days_between(spark, since: dt.date, until: dt.date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(since), F.lit(until))).alias("day"))


def densify(daily: DataFrame, since: dt.date, until: dt.date, today: dt.date, names: list[str]) -> DataFrame:
    """One row for each day from since to until, with the chosen metric as value, and a status.

    A day with facts is complete, one without is no-recorded-usage and has value 0 (but no cost per million). Session time
    is partial where only some facts are measured; a day whose value can't be known is unknown; a later day than today
    is future and has no value, whatever is recorded for it.
    """
    got = days_between(daily.sparkSession, since, until).join(daily, "day", "left")
    used = F.col("facts").isNotNull()
    value = metric(names)
    if names != ["cost_per_million"]:
        value = F.when(used, value).otherwise(F.lit(0.0))
    status = F.when(used, "complete").otherwise("no-recorded-usage")
    if names == ["session_time"]:
        status = F.when((F.col("measured_facts") > 0) & (F.col("measured_facts") < F.col("facts")), "partial").otherwise(status)
    late = F.col("day") > F.lit(today)
    got = got.withColumn("value", F.when(~late, value)).withColumn("status", F.when(late, "future").when(F.col("value").isNull(), "unknown").otherwise(status))
    return got


def intensity(rows: DataFrame, value: str, bins: int = 7, scale: str = "linear") -> DataFrame:
    """Add intensity: null stays null, what isn't positive is 0, the rest 1 to bins - 1 by its share of the largest value."""
    if not 3 <= bins <= 10 or scale not in ("linear", "log"):
        raise ValueError("bins must be from 3 to 10 and the scale linear or log")
    top = rows.agg(F.max(value).alias("top"))
    share = F.col(value) / F.col("top") if scale == "linear" else F.log1p(value) / F.log1p("top")
    band = F.least(F.lit(bins - 1), F.greatest(F.lit(1), F.ceil(F.lit(bins - 1) * share)))
    got = rows.crossJoin(F.broadcast(top))  # one row
    return got.withColumn("intensity", F.when(F.col(value).isNull(), None).when(F.col(value) <= 0, F.lit(0)).otherwise(band).cast("int")).drop("top")


def chart_series(daily: DataFrame, value: Column, until: dt.date, days: int = 10) -> DataFrame:
    """(day, value, missing_cost): the last days up to until, missing ones and missing values as 0."""
    if not 1 <= days <= MAX_CHART_DAYS:
        raise ValueError(f"a chart has 1 to {MAX_CHART_DAYS} days")
    span = days_between(daily.sparkSession, until - dt.timedelta(days=days - 1), until)
    got = span.join(daily, "day", "left")
    return got.select("day", F.coalesce(value, F.lit(0.0)).alias("value"), (F.col("facts").isNotNull() & F.col("cost_usd").isNull()).alias("missing_cost"))
