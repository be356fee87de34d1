"""Rate resolution: every basis, eligibility by needed components, both ways alike."""

import datetime as dt

from ledgerwright.functions.aggregates import strict_sum
from ledgerwright.operators import pricing

FACT = "source_id string, day date, client string, session_id string, model string, input_tokens long, output_tokens long, cache_read long, cache_write long, reasoning long, total_tokens long, reported_cost_usd double, perf_duration_ms long, perf_timed_tokens long"
RATE = "source_id string, day date, model string, price_input_per_token double, price_output_per_token double, price_cache_read_per_token double, price_cache_write_per_token double"


def day(n):
    return dt.date(2026, 9, n)


def fact(model, n, tokens, cost=None, session="x"):
    return ("s", day(n), "c", session, model, *tokens, sum(t or 0 for t in tokens), cost, 10, 5)


def test_every_basis(spark):
    facts = [
        fact("later", 5, (10, 0, 0, 0, 0)), fact("earlier", 5, (10, 0, 0, 0, 0)), fact("same", 5, (10, 5, 0, 0, 5)), fact("none", 5, (1, 0, 0, 0, 0), 7.0), fact("none", 6, (0, 0, 0, 0, 0), 9.0),
        fact("none", 7, (1, 0, 0, 0, 0)), fact("partial", 5, (10, 0, 3, 0, 0), 7.0), fact("partial", 6, (11, 0, 0, 0, 0)), fact("null", 5, (10, 0, None, 0, 0), 3.0),
    ]
    rates = [("s", day(9), "later", 1.0, 1.0, None, None), ("s", day(12), "later", 3.0, 1.0, None, None), ("s", day(1), "earlier", 9.0, 1.0, None, None), ("s", day(3), "earlier", 1.0, 1.0, None, None), ("s", day(8), "earlier", 5.0, 1.0, None, None), ("s", day(5), "same", 1.0, 1.0, None, None), ("s", day(4), "partial", 1.0, None, None, None), ("s", day(4), "null", 1.0, 1.0, None, 1.0)]
    f, r = spark.createDataFrame(facts, FACT), spark.createDataFrame(rates, RATE)
    got = {(x["model"], x["day"].day): (x["cost_basis"], x["cost_usd"]) for x in pricing.daily_cost(f, r).collect()}
    assert got == {
        ("later", 5): ("historical_estimate", 10.0), ("earlier", 5): ("carried_forward", 10.0), ("same", 5): ("observed", 20.0), ("none", 5): ("reported", 7.0), ("none", 6): ("zero_usage", 0.0), ("none", 7): ("unknown", None),
        ("partial", 5): ("reported", 7.0), ("partial", 6): ("carried_forward", 11.0), ("null", 5): ("reported", 3.0),
    }
    total = pricing.daily_cost(f, r).agg(strict_sum("cost_usd").alias("c")).first()["c"]
    assert total is None  # one unpriced fact makes the group null


def test_masks_and_ranking_agree(spark, sf_dir):
    from ledgerwright.plans.ledger import Ledger

    x = Ledger(spark, sf_dir)
    columns = [*pricing.FACT, "rate_day", *pricing.RATES]
    one = pricing.resolve_rates(x.daily, x.prices).select(*columns)
    two = pricing.resolve_rates_ranked(x.daily, x.prices).select(*columns)
    assert one.count() == two.count()
    assert one.exceptAll(two).isEmpty()
