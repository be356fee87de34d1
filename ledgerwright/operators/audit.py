"""Audit and health: runs, sources, unresolved targets and diagnostics, and what to collect next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwright.operators.collapse import collapse, collection_runs, collection_status

HOST_NEEDED = ("host", "os_name", "architecture", "cpu_count", "memory_bytes")
HOST_IF_KNOWN = ("cpu_model", "os_version")


def recent_runs(ledger: DataFrame, limit: int = 20) -> DataFrame:
    got = collection_runs(ledger).select("source_id", "run_id", "day", "status", "started_at", "finished_at", "host")
    return got.orderBy(F.desc("started_at"), F.desc("run_id"), "source_id", "day").limit(limit)


def all_sources(*relations: DataFrame) -> DataFrame:
    """Every source id that occurs anywhere."""
    return reduce(DataFrame.union, [r.select("source_id") for r in relations]).distinct()


def audit_sources(sources: DataFrame, facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each source with its first and last day of use, its number of runs, and outcome and host of its newest run row."""
    used = facts.groupBy("source_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    runs = collection_runs(ledger).select("source_id", "run_id").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"))
    newest = collapse(collection_runs(ledger), ["source_id"], ["collected_at", "finished_at", "event_id"]).select("source_id", "run_id", "status", "collected_at", *HOST_NEEDED, *HOST_IF_KNOWN)
    got = sources.join(used, "source_id", "left").join(runs, "source_id", "left").join(newest, "source_id", "left")
    return got.withColumn("runs", F.coalesce("runs", F.lit(0)).cast("long"))


def same_host_sources(audited: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Pairs of sources seen within ``days`` whose host evidence agrees: all needed fields equal, CPU model and version of the system where both know them."""
    recent = audited.where(F.col("collected_at") >= now - F.expr(f"INTERVAL {days} DAYS")).select("source_id", *HOST_NEEDED, *HOST_IF_KNOWN)
    other = recent.select(F.col("source_id").alias("other_id"), *HOST_NEEDED, *[F.col(c).alias(f"other_{c}") for c in HOST_IF_KNOWN])
    same = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == F.col(f"other_{c}"), F.lit(True)) for c in HOST_IF_KNOWN])
    return recent.join(other, list(HOST_NEEDED)).where((F.col("source_id") < F.col("other_id")) & same).select("source_id", "other_id", "host")


def unresolved_targets(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    got = collection_status(ledger).where(~F.col("status").isin("complete", "provisional")).select("source_id", "run_id", "day", "domain", "status", "expected_count", "succeeded_count", "collected_at")
    return got if limit is None else got.orderBy(F.col("collected_at").desc_nulls_last(), F.desc("day"), "source_id", "domain").limit(limit)


def unresolved_runs(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs that failed, were partial or drifted, and after whose end their source had no ok run, newest first."""
    ended = F.coalesce("finished_at", "started_at")
    runs = collection_runs(ledger).withColumn("ended", ended)
    ok = runs.where("status = 'ok'").groupBy("source_id").agg(F.max("ended").alias("ok_at"))
    bad = runs.where(F.col("status").isin("failed", "partial", "payload_drift")).join(ok, "source_id", "left")
    got = bad.where(~F.coalesce(F.col("ok_at") > F.col("ended"), F.lit(False))).orderBy(F.col("ended").desc_nulls_last(), F.desc("run_id"))
    got = got.select("source_id", "run_id", "day", "status", "finished_at", "collected_at")
    return got if limit is None else got.limit(limit)


def ingest_issues(ledger: DataFrame) -> DataFrame:
    """Unresolved targets, and the unresolved runs that none of them names."""
    targets = unresolved_targets(ledger).select("source_id", "run_id", "day", "domain", "status", "collected_at")
    runs = unresolved_runs(ledger).drop("finished_at").join(targets.select("run_id").distinct(), "run_id", "left_anti").withColumn("domain", F.lit("collection"))
    return targets.unionByName(runs)


#: Columns of the preflight relation, and those of each kind of record.
PREFLIGHT = (
    "kind", "source_id", "day", "domain", "status", "expected_count", "succeeded_count", "run_id", "failure_code", "model", "check_name", "issue_key", "payload_ver", "drift_key", "drift_kind", "path", "detail",
    "contract_ver", "created_at", "observation_count", "client", "session_id", "input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning", "total_tokens", "event_id", "collected_at",
)
PREFLIGHT_PARTS = {
    "status": ("source_id", "day", "domain", "status", "expected_count", "succeeded_count", "run_id", "failure_code"),
    "models": ("source_id", "day", "model", "client", "session_id", "input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning", "total_tokens", "event_id", "collected_at"),
    "prices": ("source_id", "day", "model"),
    "issues": ("source_id", "check_name", "issue_key"),
    "drift": ("source_id", "domain", "payload_ver", "drift_key", "drift_kind", "path", "detail", "contract_ver", "created_at", "observation_count"),
    "sessions": ("source_id", "client", "session_id", "created_at"),
    "missing_sessions": ("source_id", "client", "session_id"),
}


def preflight(status: DataFrame, facts: DataFrame, prices: DataFrame, issues: DataFrame, drift: DataFrame, sessions: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Seven kinds of records in one relation of thirty columns; what a kind doesn't have is null.

    ``used``: rows that name just the sessions of the facts and are cheaper to read twice, such as the observations that they were made of.
    """
    keys = ["source_id", "client", "session_id"]
    used = (facts if used is None else used).select(*keys).distinct()
    parts = {"status": status, "models": facts, "prices": prices, "issues": issues.where("not resolved"), "drift": drift.where("not resolved"), "sessions": sessions, "missing_sessions": used.join(sessions, keys, "left_anti")}
    rows = [p.select(F.lit(k).alias("kind"), *[c for c in PREFLIGHT_PARTS[k] if c in p.columns]).distinct() for k, p in parts.items()]
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return wide.select(*[F.col(c) if c in wide.columns else F.lit(None).cast("string").alias(c) for c in PREFLIGHT])


def custom_price_models(prices: DataFrame) -> DataFrame:
    return prices.where("source = 'Custom'").select("model").distinct()


def day_plan(contributions: DataFrame, status: DataFrame, today: Column, overlap: int = 3, refresh: tuple | None = None) -> DataFrame:
    """(source_id, day, reason): days to fetch again. contributions: (source_id, day) with usage.

    Candidates are the contribution days and those whose models target isn't complete. Of them, today and later are
    fetched, the newest ``overlap`` past contribution days, and what isn't complete. refresh: (since, until) takes every
    day of that range instead; where since is None it begins with the earliest day known up to until.
    """
    models = status.where("domain = 'models'").select("source_id", "day", (F.col("status") == "complete").alias("done"))
    known = contributions.select("source_id", "day").distinct()
    if refresh is not None:
        since, until = (None if x is None else F.lit(x) for x in refresh)
        every = known.union(models.select("source_id", "day"))
        begin = F.coalesce(F.min(F.when(F.col("day") <= until, F.col("day"))), until) if since is None else F.max(since)
        spans = every.groupBy("source_id").agg(begin.alias("since"))
        return spans.where(F.col("since") <= until).select("source_id", F.explode(F.sequence("since", until)).alias("day"), F.lit("refresh").alias("reason"))
    newest = known.where(F.col("day") < today).withColumn("nth", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("day")))).where(F.col("nth") <= overlap)
    got = known.union(models.where("not done").select("source_id", "day")).distinct().join(models, ["source_id", "day"], "left").join(newest, ["source_id", "day"], "left")
    reason = F.when(F.col("day") >= today, "open").when(F.col("nth").isNotNull(), "overlap").when(~F.coalesce("done", F.lit(False)), "incomplete")
    return got.withColumn("reason", reason).where("reason is not null").select("source_id", "day", "reason")


def price_gaps(facts: DataFrame, prices: DataFrame, today: Column) -> DataFrame:
    """Models used today or never priced, without those priced today."""
    used_today = facts.where(F.col("day") == today).select("source_id", "model")
    never = facts.select("source_id", "model").distinct().join(prices, ["source_id", "model"], "left_anti")
    priced = prices.where(F.col("day") == today)
    return used_today.union(never).distinct().join(priced, ["source_id", "model"], "left_anti")


def session_gaps(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """(source_id, client, session_id, gap): sessions with usage that have no metadata (missing) or no time of creation (undated)."""
    keys = ["source_id", "client", "session_id"]
    known = sessions.select(*keys, F.col("created_at").isNull().alias("undated")).withColumn("known", F.lit(True))
    got = facts.select(*keys).distinct().join(known, keys, "left")
    return got.where(F.col("known").isNull() | F.col("undated")).select(*keys, F.when(F.col("known").isNull(), "missing").otherwise("undated").alias("gap"))


def report_days(facts: DataFrame, sessions: DataFrame, status: DataFrame) -> DataFrame:
    """(source_id, day): days to ask reports for: those on which sessions in use were created, and those whose report target isn't complete."""
    keys = ["source_id", "client", "session_id"]
    created = sessions.where("created_at is not null").join(facts.select(*keys).distinct(), keys, "left_semi").select("source_id", F.to_date("created_at").alias("day"))
    open_ = status.where((F.col("domain") == "report") & (F.col("status") != "complete")).select("source_id", "day")
    return created.union(open_).distinct()


def full_report(gaps: DataFrame, status: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose whole report has to be read: no inventory of theirs was ever complete, or sessions in use have gaps."""
    done = status.where("domain = 'report_inventory' and status = 'complete'").select("source_id").distinct()
    return sources.join(done, "source_id", "left_anti").union(sources.join(gaps, "source_id", "left_semi")).distinct()


def identity_sets(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(identity columns, in_set): expected and found, only expected, only found."""
    both = expected.intersect(found).withColumn("in_set", F.lit("both"))
    return both.unionByName(expected.exceptAll(found).distinct().withColumn("in_set", F.lit("missing"))).unionByName(found.exceptAll(expected).distinct().withColumn("in_set", F.lit("surplus")))
