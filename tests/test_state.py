"""Scenarios of current state: ties, monotone counters, visibility, permutations, partition counts."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from ledgerwright.operators import collapse

T0 = dt.datetime(2026, 9, 20, 12)
DAILY = "source_id string, day date, client string, session_id string, model string, event_id string, collected_at timestamp_ntz, input_tokens long, output_tokens long, cache_read long, cache_write long, reasoning long, total_tokens long, provider string"


def fact(event, hour, tokens, provider="p", total=None):
    return ("s", dt.date(2026, 9, 20), "c", "x", "m", event, T0 + dt.timedelta(hours=hour), *tokens, sum(tokens) if total is None else total, provider)


SEQUENCE = [fact("e1", 0, (100, 20, 0, 0, 0), "p1"), fact("e2", 2, (80, 40, 0, 0, 0), "p2"), fact("e3", -1, (150, 0, 9, 8, 7), "p3"), fact("e4", 3, (0, 0, 0, 0, 0), "p4")]


def python_fold(rows):
    at = None
    for r in rows:
        if at is None:
            at = list(r)
        elif (r[6], r[12], r[5]) > (at[6], at[12], at[5]):
            lifted = [max(a, b) for a, b in zip(r[7:12], at[7:12], strict=True)]
            at = [*r[:7], *lifted, max(r[12], at[12], sum(lifted)), r[13]]
    return tuple(at)


def test_counters_never_fall_and_order_of_arrival_matters(spark):
    results = set()
    for order in ((0, 1, 2, 3), (2, 0, 1, 3), (1, 0, 2, 3), (3, 2, 1, 0), (2, 1, 0, 3)):
        rows = [(*SEQUENCE[k], n) for n, k in enumerate(order)]
        rows += [(*SEQUENCE[k], 10 + n) for n, k in enumerate(order)]  # every batch again
        got = collapse.fold_history(spark.createDataFrame(rows, f"{DAILY}, arrival long").repartition(3), ["arrival"]).collect()
        want = python_fold([SEQUENCE[k] for k in order] * 2)
        assert [tuple(got[0])] == [want]
        results.add(want[7])
    assert results == {0, 80, 100, 150}  # an older row lifts the maximum only where it comes before a newer one


def test_pairwise_merge_equals_fold(spark):
    stored = spark.createDataFrame(SEQUENCE[:1], DAILY)
    for row in SEQUENCE[1:]:
        stored_rows = [tuple(r) for r in stored.collect()]
        merged = collapse.monotone_merge(spark.createDataFrame([row], DAILY), stored).collect()
        assert [tuple(r) for r in merged or stored_rows] == [python_fold([*stored_rows, row])]


def test_ties_go_by_preference_then_event(spark):
    rows = [fact("a", 0, (5, 0, 0, 0, 0)), fact("z", 0, (4, 0, 0, 0, 0)), fact("b", 0, (5, 0, 0, 0, 0))]
    for order in itertools.permutations(rows):
        got = collapse.current(spark.createDataFrame(list(order), DAILY), "daily_stats").collect()
        assert [r["event_id"] for r in got] == ["b"]


def test_both_collapses_agree_for_any_number_of_partitions(spark, sf_dir):
    from ledgerwright.plans import fixtures

    obs = fixtures.daily_obs(spark, sf_dir)
    t = collapse.TABLES["daily_stats"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, collapse.collapse(obs, t.keys, t.order).select("event_id").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    seen.append(sorted(map(tuple, collapse.collapse_by_struct(obs, t.keys, t.order).select("event_id").collect())))
    assert seen[0] == seen[1] == seen[2]


def test_deletes_hide_what_they_follow(spark):
    cols = "scope string, client string, workspace string, session_id string, tag string, op string, event_id string, collected_at timestamp_ntz"
    rows = [("client", "c", "", "", "t", "upsert", "a", T0), ("client", "c", "", "", "t", "delete", "b", T0 + dt.timedelta(1)), ("client", "c", "", "", "u", "delete", "z", T0), ("client", "c", "", "", "u", "upsert", "a", T0)]
    got = collapse.current(spark.createDataFrame(rows, cols), "tags").collect()
    assert [r["tag"] for r in got] == ["u"]  # at one time the upsert ranks after the delete


def test_session_visibility_grows_though_the_row_loses(spark):
    cols = "event_id string, source_id string, client string, session_id string, workspace string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, collected_at timestamp_ntz"
    day = dt.timedelta(1)
    current = spark.createDataFrame([("b", "s", "c", "x", "new", T0, T0 + day, T0)], cols)
    batch = spark.createDataFrame([("a", "s", "c", "x", "old", T0 - day, T0 + 3 * day, T0 - day)], cols)
    after, counts = collapse.upsert(current, batch, "sessions")
    row = after.first()
    assert (row["workspace"], row["first_seen_at"], row["last_seen_at"]) == ("new", T0 - day, T0 + 3 * day)
    assert tuple(counts.first()) == (0, 0)


def test_upsert_of_daily_facts_lifts_components(spark):
    stored = spark.createDataFrame([fact("a", 0, (100, 20, 0, 0, 0), "p1")], DAILY)
    batch = spark.createDataFrame([fact("b", 1, (80, 10, 7, 0, 0), "p2"), fact("c", 2, (60, 30, 0, 0, 0), "p3")], DAILY)
    after, counts = collapse.upsert(stored, batch, "daily_stats")
    row = after.first()
    assert (row["event_id"], row["provider"], row["input_tokens"], row["output_tokens"], row["cache_read"], row["total_tokens"]) == ("c", "p3", 100, 30, 7, 137)
    assert tuple(counts.first()) == (0, 1)
    older = spark.createDataFrame([fact("z", -1, (999, 0, 0, 0, 0))], DAILY)
    assert tuple(collapse.upsert(stored, older, "daily_stats")[0].first()) == tuple(stored.first())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DAILY)
    assert collapse.current(empty, "daily_stats").isEmpty()
    assert collapse.monotone_merge(empty, empty).isEmpty()
    assert collapse.raw_and_gold(empty, empty).isEmpty()
    assert collapse.fold_history(empty.withColumn("arrival", F.lit(0)), ["arrival"]).isEmpty()
