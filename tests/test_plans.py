"""How often queries read, shuffle and sort their rows: what they cost at size, seen in their plans."""

import datetime as dt
import re

from pyspark.sql import functions as F

from ledgerwright.operators import collapse, compaction, pricing
from ledgerwright.plans.ledger import QUERIES, Ledger
from ledgerwright.sources import payloads, warehouse
from ledgerwright.streaming import ingest


def physical(df):
    """The plan as it is before any stage has run."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_reports_shuffle_facts_once_and_sort_them_after_it(spark, sf_dir):
    for name in ("E5_report_session_models", "E4_report_sessions", "H1_session_sorts"):
        plan = physical(QUERIES[name](Ledger(spark, sf_dir)))
        assert plan.count("lineitem.parquet") == 1, name
        dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(source_id" in x]
        assert len(dealt) == 2 and all("hashpartitioning(source_id, client, session_id, " in x for x in dealt), name  # facts, sessions
        below = plan[plan.rindex("Exchange hashpartitioning(source_id") :].splitlines()[1:]
        assert not any("Sort" in x for x in below), name


def test_preflight_ranks_the_facts_once(spark, sf_dir):
    plan = physical(QUERIES["G2_preflight"](Ledger(spark, sf_dir)))
    assert len(re.findall(r"WindowGroupLimit .*total_tokens.*Final", plan)) == 1
    assert not re.search(r"WindowGroupLimit .*total_tokens.*Partial\W*\n\W*Sort [^\n]*\n\W*Project", plan)  # no sort of a split before the shuffle


def test_compaction_joins_no_floor(spark, sf_dir):
    plan = physical(QUERIES["M2_compact_daily"](Ledger(spark, sf_dir)))
    assert not re.search(r"Join \[[^\]]*session_id", plan)


def test_compaction_shuffles_gold_once_and_only_what_is_asked_for(spark, sf_dir):
    plan = physical(QUERIES["M2_compact_daily"](Ledger(spark, sf_dir)))
    assert "Exchange" not in plan[: plan.index("Union")] and len(re.findall(r"Exchange hashpartitioning\(source_id, client, session_id, ", plan)) == 2
    assert "provider" not in plan and "perf_duration_ms" not in plan
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as where the facts are large: days are estimated by them
        assert physical(QUERIES["M2_compact_daily"](Ledger(spark, sf_dir))).count("BroadcastHashJoin [day], [day], LeftSemi") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_gold_that_is_dealt_out_gives_the_same_rows(spark):
    cols = "source_id string, day date, client string, session_id string, model string, event_id string, collected_at timestamp_ntz, input_tokens long, output_tokens long, cache_read long, cache_write long, reasoning long, total_tokens long"
    t = dt.datetime(2026, 9, 20)
    rows = [(None if k % 7 == 0 else "s", t.date(), "c", f"x{k % 40}", None if k % 5 == 0 else "m", f"e{k}", t + dt.timedelta(hours=k % 9), k % 11, k % 13, None, k % 3, 0, k % 11 + k % 13 + k % 3) for k in range(400)]
    raw = spark.createDataFrame(rows, cols)
    gold = collapse.current(raw.where("collected_at < timestamp_ntz'2026-09-20 05:00:00'"), "daily_stats")
    one, two, three = (sorted(map(tuple, collapse.raw_and_gold(raw, gold, *how).collect()), key=repr) for how in ((None, True), (None, False), ("day",)))
    assert one == two == three and len(one) == raw.select(*collapse.TABLES["daily_stats"].keys).distinct().count()


def test_daily_payloads_are_parsed_once(spark, sf_dir):
    plan = QUERIES["A1_daily_payload_scan"](Ledger(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_a_payload_that_fails_is_still_rejected(spark):
    rows = [("a", None, '{"entries": [{"model": "m", "input": 3}]}'), ("b", None, '{"entries": [null]}'), ("c", None, "{"), ("d", None, None), ("e", None, "{}")]
    entries, totals, bad = payloads.parse_daily(spark.createDataFrame(rows, "file string, day date, json string"))
    assert [(r["file"], r["input_tokens"]) for r in entries.collect()] == [("a", 3)]
    assert sorted(r["file"] for r in totals.collect()) == ["a", "e"] and sorted(r["file"] for r in bad.collect()) == ["b", "c", "d"]


def test_rates_among_more_keys_than_the_facts_have(spark, sf_dir):
    x = Ledger(spark, sf_dir)
    columns = [*pricing.FACT, "rate_day", *pricing.RATES]
    one = pricing.resolve_rates(x.daily, x.prices, x.obs("daily_obs")).select(*columns)
    two = pricing.resolve_rates_ranked(x.daily, x.prices).select(*columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_gold_lifts_the_best_row_whichever_way_they_meet(spark):
    t, cols = dt.datetime(2026, 9, 20), "source_id string, day date, client string, session_id string, model string, event_id string, collected_at timestamp_ntz, input_tokens long, output_tokens long, cache_read long, cache_write long, reasoning long, total_tokens long"
    row = lambda event, hour, session, *n: ("s", t.date(), "c", session, "m", event, t + dt.timedelta(hours=hour), *n, sum(v or 0 for v in n))
    raw = spark.createDataFrame([row("b", 2, "x", 1, 9, None, 0, 0), row("a", 0, "y", 5, 0, 0, 0, 0)], cols)
    gold = spark.createDataFrame([row("a", 1, "x", 7, 2, 3, 0, None), row("b", 1, "y", 1, 1, 1, 1, 1), row("c", 1, "z", 1, 0, 0, 0, None)], cols)
    for by in (None, "day"):
        got = {r["session_id"]: (r["event_id"], r["input_tokens"], r["output_tokens"], r["cache_read"], r["reasoning"], r["total_tokens"]) for r in collapse.raw_and_gold(raw, gold, by).collect()}
        assert got == {"x": ("b", 7, 9, 3, 0, 19), "y": ("b", 1, 1, 1, 1, 5), "z": ("c", 1, 0, 0, None, 1)}


def test_a_batch_is_shuffled_once_with_the_ids_of_bronze(spark, tmp_path):
    w = warehouse.Warehouse(spark, str(tmp_path))
    rows = spark.range(40).select(F.lit("s").alias("source_id"), F.col("id").cast("string").alias("event_id"), F.lit("old").alias("x"))
    w.commit("all", [warehouse.Change("bronze", rows, ingest.bucket_of())])
    some = [("s", "3", "new"), ("s", "77", "new"), ("s", "77", "new"), (None, "3", "new"), ("s", None, "new")]
    fresh = ingest.unseen(w, spark.createDataFrame(some, "source_id string, event_id string, x string"), "bronze")
    assert physical(fresh).count("Exchange ") == 1
    assert sorted(map(tuple, fresh.collect()), key=repr) == sorted([("s", "77", "new"), (None, "3", "new"), ("s", None, "new")], key=repr)


def test_only_grown_arrivals_meet_gold_again(spark, tmp_path, monkeypatch):
    t, cols = dt.datetime(2026, 9, 20), "source_id string, day date, client string, session_id string, model string, event_id string, collected_at timestamp_ntz, input_tokens long, output_tokens long, cache_read long, cache_write long, reasoning long, total_tokens long"
    row = lambda event, days, n, source="s": (source, t.date(), "c", "x", "m", event, t + dt.timedelta(days), n, 0, 0, 0, None, n)
    met, merge = [], compaction.raw_and_gold
    monkeypatch.setattr(compaction, "raw_and_gold", lambda raw, gold, *by: (met.append((sorted(r["event_id"] for r in raw.collect()), gold.count())), merge(raw, gold, *by))[1])
    w = warehouse.Warehouse(spark, str(tmp_path))
    for k, rows in enumerate(([row("a", 0, 9), row("b", 1, 4), row("n", 0, 1, None)], [row("c", 1, 2), row("d", 2, 3)])):
        w.commit(f"in-{k}", [warehouse.Change("raw_daily_stats", spark.createDataFrame(rows, cols), F.to_date("collected_at"))])
        assert warehouse.publish_compaction(w, f"c-{k}")
    assert met == [(["a", "b", "n"], 0), (["b", "c", "d", "n"], 2)]
    got = {(r["source_id"], r["event_id"], r["input_tokens"], r["total_tokens"]) for r in w.read("daily_stats").collect()}
    assert got == {("s", "d", 4, 4), (None, "n", 1, 1)}


def test_input_rows_are_written_without_a_sort(spark, tmp_path):
    counts = payloads.write_inputs({"entries": spark.range(7), "none": spark.range(0)}, str(tmp_path / "in"))
    assert counts == {"entries": 7, "none": 0}
    got = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, got.select("kind", "json").collect()))[0] == ("entries", '{"id":0}') and got.count() == 7
    assert all(".zstd." in f for f in got.inputFiles())
