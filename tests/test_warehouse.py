"""Committed runs, published compactions, pinned reads, snapshots and streamed state: crashes, repetitions and orders of batches."""

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from ledgerwright.operators import collapse
from ledgerwright.sources import tables, warehouse
from ledgerwright.sources.warehouse import Change, Conflict, Warehouse
from ledgerwright.streaming import ingest

T0 = dt.datetime(2026, 9, 20, 12)
DAILY = "source_id string, day date, client string, session_id string, model string, event_id string, collected_at timestamp_ntz, input_tokens long, output_tokens long, cache_read long, cache_write long, reasoning long, total_tokens long, provider string"
LEDGER = "event_id string, source_id string, run_id string, day date, domain string, status string, collected_at timestamp_ntz"


def fact(event, hour, tokens, day=20, session="x"):
    return ("s", dt.date(2026, 9, day), "c", session, "m", event, T0 + dt.timedelta(hours=hour), *tokens, sum(x or 0 for x in tokens), event)


def run_rows(spark, run):
    return spark.createDataFrame([(f"l-{run}", "s", run, dt.date(2026, 9, 20), "collection", "ok", T0)], LEDGER)


def persist(w, run, facts):
    return warehouse.persist_run(w, run, {"daily_stats": w.spark.createDataFrame(facts, DAILY)}, {}, run_rows(w.spark, run))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


FACTS = [fact("a", 0, (100, 20, 0, 0, None)), fact("b", 2, (80, 40, 0, 0, 0)), fact("c", -1, (150, 0, 9, 8, 7)), fact("d", 3, (1, 1, 1, 1, 1), day=21), fact("e", 3, (2, 2, 2, 2, 2), session="y")]


def test_a_repeated_run_changes_nothing(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    assert w.head().number == 0
    first = persist(w, "run-1", FACTS[:1] + FACTS[3:])
    assert first.counts == {"daily_stats": (3, 0)} and not first.already_committed
    second = persist(w, "run-2", FACTS[1:3])
    assert second.counts == {"daily_stats": (0, 1)}  # both rows are of one key
    before = rows_of(w.read("daily_stats")), w.head().number
    for run in ("run-1", "run-2"):
        again = persist(w, run, FACTS)
        assert again.already_committed and again.counts == {"daily_stats": (0, 0)}
    assert (rows_of(w.read("daily_stats")), w.head().number) == before
    assert sorted(r["run_id"] for r in w.read("collection_ledger").collect()) == ["run-1", "run-2"]
    with pytest.raises(ValueError, match="another run"):
        warehouse.persist_run(w, "run-3", {}, {}, run_rows(spark, "run-2"))


def test_runs_in_any_order_equal_upserts(spark, tmp_path):
    for k, order in enumerate(itertools.permutations(FACTS[:3])):
        w = Warehouse(spark, str(tmp_path / str(k)))
        now = spark.createDataFrame([], DAILY)
        for n, row in enumerate(order):
            persist(w, f"run-{n}", [row])
            now = spark.createDataFrame(collapse.upsert(now, spark.createDataFrame([row], DAILY), "daily_stats")[0].collect(), DAILY)
        assert rows_of(w.read("daily_stats")) == rows_of(now)


def test_a_crash_between_tables_leaves_no_half_run(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path))
    persist(w, "run-1", FACTS[:1])
    before = rows_of(w.read("daily_stats")), rows_of(w.read("collection_ledger"))
    broken = run_rows(spark, "run-2").withColumn("status", F.expr("if(status = 'ok', raise_error('lost'), status)"))
    with pytest.raises(Exception, match="lost"):
        warehouse.persist_run(w, "run-2", {"daily_stats": spark.createDataFrame(FACTS[1:], DAILY)}, {}, broken)
    monkeypatch.setattr(Warehouse, "_put", lambda *_: (_ for _ in ()).throw(OSError("died before the commit")))
    with pytest.raises(OSError):
        persist(w, "run-2", FACTS[1:])
    monkeypatch.undo()
    assert (rows_of(w.read("daily_stats")), rows_of(w.read("collection_ledger"))) == before and not w.committed("run-2")
    assert persist(w, "run-2", FACTS[1:]).counts == {"daily_stats": (2, 1)}
    named = {f for held in w.head().tables.values() for own in held["parts"].values() for f in own}
    gone = w.vacuum()
    assert gone and not named & set(gone)
    assert len(rows_of(w.read("daily_stats"))) == 3 and not w.vacuum()


def test_the_second_of_two_writers_meets_a_conflict(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    base = w.head()
    w.commit("a", [Change("t", spark.range(2), "id")], base)
    with pytest.raises(Conflict):
        w.commit("b", [Change("t", spark.range(5), "id")], base)
    assert w.read("t").count() == 2
    with pytest.raises(ValueError, match="other columns"):
        w.commit("c", [Change("t", spark.range(1).withColumnRenamed("id", "x"), "x")])


def folders(w, table):
    return {value: tuple(f) for value, f in w.head().tables[table]["parts"].items()}


def test_published_days_replace_only_themselves(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path))
    arrive = lambda key, rows: w.commit(key, [Change("raw_daily_stats", spark.createDataFrame(rows, DAILY), F.to_date("collected_at"))])
    arrive("in-1", [FACTS[0], FACTS[3], FACTS[4]])
    assert warehouse.publish_compaction(w, "c-1") and not warehouse.publish_compaction(w, "c-1")
    assert not warehouse.publish_compaction(w, "c-2")  # nothing has arrived
    old = folders(w, "daily_stats")
    arrive("in-2", [FACTS[1]])
    monkeypatch.setattr(Warehouse, "_put", lambda *_: (_ for _ in ()).throw(OSError("died before progress was written")))
    with pytest.raises(OSError):
        warehouse.publish_compaction(w, "c-3")
    monkeypatch.undo()
    assert folders(w, "daily_stats") == old
    assert warehouse.publish_compaction(w, "c-3")
    new = folders(w, "daily_stats")
    assert new["2026-09-21"] == old["2026-09-21"] and new["2026-09-20"] != old["2026-09-20"]
    got = {(r["session_id"], r["day"].day): (r["event_id"], r["input_tokens"], r["output_tokens"], r["total_tokens"]) for r in w.read("daily_stats").collect()}
    assert got == {("x", 20): ("b", 100, 40, 140), ("y", 20): ("e", 2, 2, 10), ("x", 21): ("d", 1, 1, 5)}
    progress = {(r["day"].day, r["arrival_day"].day): r["rows_done"] for r in w.read("compaction_ledger").orderBy("rows_done").collect()}
    assert progress == {(20, 20): 3, (21, 20): 1}


def test_gold_outlives_expired_arrivals_and_pending_ones_stay(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    arrive = lambda key, rows: w.commit(key, [Change("raw_daily_stats", spark.createDataFrame(rows, DAILY), F.to_date("collected_at"))])
    arrive("in-1", [fact("old", -24 * 200, (500, 0, 0, 0, 0))])
    warehouse.publish_compaction(w, "c-1")
    arrive("in-2", [fact("late", -24 * 150, (7, 0, 0, 0, 0), session="z"), fact("new", 0, (1, 9, 0, 0, 0))])
    assert warehouse.expire(w, "e-1", "2026-09-25") == [str((T0 - dt.timedelta(days=200)).date())]
    assert sorted(r["event_id"] for r in w.read("raw_daily_stats").collect()) == ["late", "new"]
    warehouse.publish_compaction(w, "c-2")
    assert {r["event_id"]: r["input_tokens"] for r in w.read("daily_stats").collect()} == {"new": 500, "late": 7}
    assert warehouse.expire(w, "e-2", "2026-09-25") == [str((T0 - dt.timedelta(days=150)).date())]
    assert warehouse.expire(w, "e-3", "2026-09-25") == []


def test_a_pinned_read_has_no_late_arrival(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.commit("in-1", [Change("t", spark.createDataFrame(FACTS[:1], DAILY), "day")])
    pin = w.head()
    w.commit("in-2", [Change("t", spark.createDataFrame([fact("late", -99, (1, 1, 1, 1, 1), session="q")], DAILY), "day")])
    assert [r["event_id"] for r in w.read("t", at=w.as_of(pin.at)).collect()] == ["a"]
    assert w.read("t").count() == 2 and w.as_of(pin.at - 1).number == 0
    assert w.read("t", {"2026-09-21"}).isEmpty()


def test_snapshot_of_a_commit_is_restored_once(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    persist(w, "run-1", FACTS)
    issue = ("i", "s", "check", "key", True, T0, T0, 1, "m")
    cols = "event_id string, source_id string, check_name string, issue_key string, resolved boolean, created_at timestamp_ntz, collected_at timestamp_ntz, observation_count long, message string"
    pin = w.commit("issues", [Change("reconciliation_issues", spark.createDataFrame([issue, issue, ("j", *issue[1:])], cols), "source_id")])
    persist(w, "run-2", [fact("f", 9, (5, 5, 5, 5, 5), session="new")])
    folder = str(tmp_path / "snap")
    manifest = {r["table"]: r["rows"] for r in tables.capture(w, folder, pin).collect()}
    assert manifest == {"collection_ledger": 1, "daily_stats": 3, "reconciliation_issues": 2}
    other = Warehouse(spark, str(tmp_path / "other"))
    assert tables.restore_snapshot(other, folder, "snap-1", warehouse.PARTS) is True
    assert tables.restore_snapshot(other, folder, "snap-1", warehouse.PARTS) is False
    assert rows_of(other.read("daily_stats")) == rows_of(w.read("daily_stats", at=pin))
    with pytest.raises(ValueError, match="isn't empty"):
        tables.restore_snapshot(other, folder, "snap-2", warehouse.PARTS)
    spark.read.parquet(f"{folder}/daily_stats").limit(2).write.parquet(f"{tmp_path}/less")
    spark.read.parquet(f"{tmp_path}/less").write.mode("overwrite").parquet(f"{folder}/daily_stats")
    with pytest.raises(ValueError, match="daily_stats: rows, daily_stats: digest"):
        tables.restore_snapshot(Warehouse(spark, str(tmp_path / "third")), folder, "snap-1", warehouse.PARTS)


def test_replays_are_looked_for_in_the_buckets_of_the_batch_only(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    rows = spark.range(200).select(F.lit("s").alias("source_id"), F.col("id").cast("string").alias("event_id"))
    w.commit("all", [Change("bronze", rows, ingest.bucket_of())])
    batch = rows.where("event_id in ('3', '4')").union(spark.createDataFrame([("s", "new")], "source_id string, event_id string"))
    fresh = ingest.unseen(w, batch, "bronze")
    assert [r["event_id"] for r in fresh.collect()] == ["new"]
    buckets = {str(r[0]) for r in batch.select(ingest.bucket_of()).collect()}
    read = {f.split("part__=")[1].split("/")[0] for f in fresh.inputFiles() if "part__=" in f}
    assert read <= buckets and len(buckets) <= 3 < len(folders(w, "bronze"))


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    names = [c.split()[0] for c in DAILY.split(", ")]
    (folder / name).write_text("".join(json.dumps(dict(zip(names, r, strict=True)), default=str) + "\n" for r in rows))


def test_streamed_state_equals_upserts_in_any_order_and_after_restarts(spark, tmp_path):
    fields = spark.createDataFrame([], DAILY).schema
    for k, order in enumerate(([0, 1, 2], [2, 0, 1], [1, 2, 0])):
        landing, out = tmp_path / f"in{k}", str(tmp_path / f"out{k}")
        now = spark.createDataFrame([], DAILY)
        for n, i in enumerate(order):
            rows = [FACTS[i], FACTS[3 + n]] if n < 2 else [FACTS[i], FACTS[i]]
            land(landing, f"{n}.json", rows)
            ingest.fold_stream(spark, str(landing), out, str(tmp_path / f"check{k}"), fields)  # each call starts from the checkpoint
            now = spark.createDataFrame(collapse.upsert(now, spark.createDataFrame(rows, DAILY), "daily_stats")[0].collect(), DAILY)
        assert rows_of(ingest.folded(spark, out, fields)) == rows_of(now)
        written = spark.read.parquet(f"{out}/batch_id=2")
        assert written.count() <= 1  # the keys of the first two batches aren't written again
        ingest.fold_stream(spark, str(landing), out, str(tmp_path / f"check{k}"), fields)  # nothing is new
        assert rows_of(ingest.folded(spark, out, fields)) == rows_of(now)


def test_streamed_rows_of_one_time_rank_as_they_were_observed(spark, tmp_path):
    fields = spark.createDataFrame([], DAILY).schema
    big, low, last = fact("a", 0, (100, 0, 100, 9, 0)), fact("b", 5, (1, 300, 0, 0, 0)), fact("c", 5, (2, 400, 0, 0, 20))  # a and b lifted have a larger total than c
    for k, batches in enumerate(([[big, low, last]], [[last, big, low, last]], [[big], [last, low]], [[big, low], [last]], [[low, last], [big], [low]])):
        now = spark.createDataFrame([], DAILY)
        for n, rows in enumerate(batches):
            land(tmp_path / f"in{k}", f"{n}.json", rows)
            ingest.fold_stream(spark, str(tmp_path / f"in{k}"), str(tmp_path / f"out{k}"), str(tmp_path / f"check{k}"), fields)
            now = spark.createDataFrame(collapse.upsert(now, spark.createDataFrame(rows, DAILY), "daily_stats")[0].collect(), DAILY)
        assert rows_of(ingest.folded(spark, str(tmp_path / f"out{k}"), fields)) == rows_of(now)
        if len(batches) == 1:
            assert now.first()["event_id"] == "c"


def test_streaming_ingest_adds_nothing_twice(spark, tmp_path):
    landing, root, check = tmp_path / "in", str(tmp_path / "bronze"), str(tmp_path / "check")
    fields = spark.createDataFrame([], DAILY).schema
    for name, rows in (("a.json", FACTS[:2]), ("b.json", FACTS[1:4])):
        land(landing, name, rows)
        ingest.ingest(spark, str(landing), root, check, "daily", fields)
    ingest.ingest(spark, str(landing), root, check, "daily", fields)
    w = Warehouse(spark, root)
    assert sorted(r["event_id"] for r in w.read("daily").collect()) == ["a", "b", "c", "d"]
    land(landing, "c.json", FACTS[2:])
    ingest.ingest(spark, str(landing), root, str(tmp_path / "lost"), "daily", fields)  # the checkpoint is lost: batches begin at 0 again
    assert sorted(r["event_id"] for r in w.read("daily").collect()) == ["a", "b", "c", "d", "e"]


SEEN = "event_id string, source_id string, domain string, payload_ver string, drift_key string, created_at timestamp_ntz, collected_at timestamp_ntz, resolved boolean, observation_count long"


def test_resolved_sightings_rank_first_at_one_time(spark):
    rows = [("a", "s", "models", "1", "k", T0, T0, True, 0), ("b", "s", "models", "1", "k", T0, T0, False, 1)]
    for order in itertools.permutations(rows):
        assert collapse.current(spark.createDataFrame(list(order), SEEN), "payload_drift_events").first()["event_id"] == "a"
    twice = [("a", "s", "models", "1", "k", T0, T0, r, n) for r, n in ((False, 5), (True, 3), (True, 4))]
    for order in itertools.permutations(twice):
        row = collapse.replayed_once(spark.createDataFrame(list(order), SEEN)).first()
        assert (row["resolved"], row["observation_count"]) == (True, 4)
    cols = SEEN.replace("domain string, payload_ver string, drift_key string", "check_name string, issue_key string") + ", message string"
    said = [("a", "s", "c", "k", T0, T0, True, 0, "resolved"), ("b", "s", "c", "k", T0, T0, False, 1, "open"), ("c", "s", "c", "k", T0, T0, True, 1, None)]
    assert collapse.current(spark.createDataFrame(said, cols), "reconciliation_issues").first()["message"] == "resolved"


def test_streamed_state_is_kept_by_aggregates_and_no_python_call_a_key(spark, tmp_path):
    fields = spark.createDataFrame([], DAILY).schema
    land(tmp_path / "in", "a.json", FACTS[:2])
    query = ingest.fold_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), fields)
    assert [s["operatorName"] for s in query.lastProgress["stateOperators"]] == ["stateStoreSave"]


def test_an_upsert_is_shuffled_once_and_written_as_it_stands(spark):
    stored, batch = spark.createDataFrame(FACTS[:2], DAILY), spark.createDataFrame(FACTS[2:], DAILY)
    after = collapse.upsert_flagged(stored, batch, "daily_stats", "day")[0]
    plan = after._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(day" in plan and "Join" not in plan
    assert sorted(map(str, after.collect())) == sorted(map(str, collapse.upsert_flagged(stored, batch, "daily_stats")[0].collect()))
