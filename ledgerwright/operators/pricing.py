"""Rate resolution and cost: the best eligible rate by day, two ways, and what each fact costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwright.sources.scratch import written

RATES = ["price_input_per_token", "price_output_per_token", "price_cache_read_per_token", "price_cache_write_per_token"]
FACT = ["source_id", "day", "client", "session_id", "model"]


def _needs(*tokens: str) -> Column:
    """A component needs its rate unless its tokens are known to be 0."""
    known_zero = [F.coalesce(F.col(t) == 0, F.lit(False)) for t in tokens]
    all_zero = known_zero[0]
    for z in known_zero[1:]:
        all_zero = all_zero & z
    return ~all_zero


def required_mask() -> Column:
    """One bit for each rate that a fact needs; the output rate covers output and reasoning tokens."""
    parts = [_needs("input_tokens"), _needs("output_tokens", "reasoning"), _needs("cache_read"), _needs("cache_write")]
    return sum((F.when(p, F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(parts)), F.lit(0))


def available_mask() -> Column:
    return sum((F.when(F.col(r).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RATES)), F.lit(0))


def resolve_rates(facts: DataFrame, rates: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Add rate_day and the rates: the newest eligible one at or before a fact's day, else the earliest later one.

    Facts that need the same rates on the same day of one source and model resolve alike, so only their distinct (source,
    model, mask, day) meet the rates; the chosen day joins back by equality. No fact is multiplied by rates. ``among``: rows
    that name every (source, model, day) of the facts and are cheaper to read twice, such as the observations that they were made of.
    """
    masked = facts.withColumn("mask", required_mask())
    if among is None:
        keys = masked.select("source_id", "model", "mask", F.col("day").alias("usage_day")).distinct()
    else:
        every = F.explode(F.array(*[F.lit(k) for k in range(1 << len(RATES))])).alias("mask")
        keys = among.select("source_id", "model", "day").distinct().select("source_id", "model", every, F.col("day").alias("usage_day"))
    offered = rates.select("source_id", "model", "day", *RATES).withColumn("offers", available_mask())
    met = keys.join(offered, ["source_id", "model"]).where(F.col("offers").bitwiseAND(F.col("mask")) == F.col("mask"))
    chosen = met.groupBy("source_id", "model", "mask", "usage_day").agg(
        F.coalesce(F.max(F.when(F.col("day") <= F.col("usage_day"), F.col("day"))), F.min(F.when(F.col("day") > F.col("usage_day"), F.col("day")))).alias("rate_day")
    )
    priced = chosen.join(rates.select("source_id", "model", F.col("day").alias("rate_day"), *RATES), ["source_id", "model", "rate_day"])
    priced = priced.withColumnRenamed("usage_day", "day")
    if among is not None:
        priced = written(priced)  # of a size that Spark knows: it is broadcast if small, and the facts stay where they are
    return masked.join(priced, ["source_id", "model", "mask", "day"], "left").drop("mask")


def resolve_rates_ranked(facts: DataFrame, rates: DataFrame) -> DataFrame:
    """The same by ranking every eligible rate of every fact; kept to measure :func:`resolve_rates` against."""
    offered = rates.select(F.col("source_id").alias("r_source"), F.col("model").alias("r_model"), F.col("day").alias("rate_day"), *RATES).withColumn("offers", available_mask())
    masked = facts.withColumn("mask", required_mask())
    met = masked.join(offered, (F.col("source_id") == F.col("r_source")) & (F.col("model") == F.col("r_model")) & (F.col("offers").bitwiseAND(F.col("mask")) == F.col("mask")), "left")
    past = F.col("rate_day") <= F.col("day")
    order = W.partitionBy(*FACT).orderBy(past.desc_nulls_last(), F.when(past, F.col("rate_day")).desc_nulls_last(), F.col("rate_day").asc_nulls_last())
    return met.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "mask", "offers", "r_source", "r_model")


def cost_of(resolved: DataFrame) -> DataFrame:
    """Add cost_usd, cost_basis and ms_per_1k_tokens to facts with resolved rates."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = F.col("rate_day").isNotNull()
    by_rate = zero("input_tokens") * zero(RATES[0]) + (zero("output_tokens") + zero("reasoning")) * zero(RATES[1]) + zero("cache_read") * zero(RATES[2]) + zero("cache_write") * zero(RATES[3])
    basis = (
        F.when(F.col("rate_day") == F.col("day"), "observed")
        .when(F.col("rate_day") < F.col("day"), "carried_forward")
        .when(found, "historical_estimate")
        .when(F.col("total_tokens") == 0, "zero_usage")
        .when(F.col("reported_cost_usd").isNotNull(), "reported")
        .otherwise("unknown")
    )
    timed = F.when((F.col("perf_timed_tokens") > 0) & F.col("perf_duration_ms").isNotNull(), F.lit(1000.0) * F.col("perf_duration_ms") / F.col("perf_timed_tokens"))
    return resolved.select("*", F.when(found | (F.col("total_tokens") == 0), by_rate.cast("double")).otherwise(F.col("reported_cost_usd")).alias("cost_usd"), basis.alias("cost_basis"), timed.alias("ms_per_1k_tokens"))


def daily_cost(facts: DataFrame, rates: DataFrame, among: DataFrame | None = None) -> DataFrame:
    return cost_of(resolve_rates(facts, rates, among))
