"""Incremental compaction of observations into gold, by arrival buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwright.operators.collapse import TABLES, collapse, raw_and_gold


def arrival_counts(raw: DataFrame, *bucket: str) -> DataFrame:
    return raw.groupBy(*bucket, "arrival_day").agg(F.count(F.lit(1)).alias("rows_seen"))


def candidates(raw: DataFrame, progress: DataFrame, *bucket: str) -> DataFrame:
    """Arrival buckets that hold more rows than were processed; counts, not clocks, find late commits."""
    done = progress.groupBy(*bucket, "arrival_day").agg(F.max("rows_done").alias("rows_done"))
    both = arrival_counts(raw, *bucket).join(done, [*bucket, "arrival_day"], "left").withColumn("rows_done", F.coalesce("rows_done", F.lit(0)))
    return both.where(F.col("rows_seen") > F.col("rows_done"))


def compact_daily(raw: DataFrame, gold: DataFrame, progress: DataFrame, gold_dealt: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new rows of the touched day partitions, touched days, progress rows to append after they are written).

    Raw and gold rows of the touched days compete, so gold rows whose raw ones have expired take part. The caller writes the
    rows elsewhere first, overwrites these partitions from there, and appends the progress last, as the commit record.
    ``gold_dealt``: as in :func:`raw_and_gold`.
    """
    grown = candidates(raw, progress, "source_id", "day")
    days = grown.select("day").distinct()
    touched = F.broadcast(days)  # a date a row, however large the facts are; without the hint they were shuffled by day
    fresh = raw.drop("arrival_day").join(touched, "day", "left_semi")
    rows = raw_and_gold(fresh, gold.join(touched, "day", "left_semi"), gold_dealt=gold_dealt)
    return rows, days, grown.select("source_id", "day", "arrival_day", F.col("rows_seen").alias("rows_done"))


def compact_grown(raw: DataFrame, gold: DataFrame, grown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows of the touched days, progress rows), given the grown arrival buckets, for gold that holds what progress says was done.

    Only arrivals of grown buckets compete with gold. The rest can't change it: the gold row of their key has at least the rank and each component of the best of them.
    Rows come dealt out by day, to be written as they stand. Raw rows and gold are of the touched days' partitions or more.
    """
    near = grown.select(F.col("source_id").alias("s__"), F.col("day").alias("d__"), F.col("arrival_day").alias("a__"))
    same = F.col("source_id").eqNullSafe(F.col("s__")) & (F.col("day") == F.col("d__")) & F.col("arrival_day").eqNullSafe(F.col("a__"))
    fresh = raw.join(near, same, "left_semi").drop("arrival_day")
    return raw_and_gold(fresh, gold.join(F.broadcast(grown.select("day").distinct()), "day", "left_semi").select(*fresh.columns), "day"), grown.select("source_id", "day", "arrival_day", F.col("rows_seen").alias("rows_done"))


def compact_curation(raw: DataFrame, gold: DataFrame, table: str, affected: DataFrame) -> DataFrame:
    """Winners of the affected keys over raw and gold, across all sources; deletes stay, so that they outlive raw rows."""
    t = TABLES[table]
    keys = list(t.keys)
    rows = raw.unionByName(gold).join(affected.select(*keys).distinct(), keys, "left_semi").withColumn("is_upsert", F.col("op") == "upsert")
    return collapse(rows, keys, t.order).drop("is_upsert")


def expired(raw: DataFrame, progress: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """(arrival_day, pending): arrival days past retention; pending ones hold rows that weren't compacted yet and must stay."""
    old = F.col("arrival_day") < F.date_sub(today, days)
    waiting = candidates(raw.where(old), progress.where(old), "source_id", "day").select("arrival_day").distinct().withColumn("waits", F.lit(True))
    return raw.where(old).select("arrival_day").distinct().join(waiting, "arrival_day", "left").select("arrival_day", F.coalesce("waits", F.lit(False)).alias("pending"))


def backlog(raw: DataFrame, progress: DataFrame, today: Column, warn: int = 2, error: int = 80) -> DataFrame:
    """Unprocessed rows by arrival bucket, from ``warn`` days of age."""
    got = candidates(raw, progress, "source_id", "day").withColumn("age_days", F.date_diff(today, F.col("arrival_day")))
    got = got.withColumn("pending", F.col("rows_seen") - F.col("rows_done")).where(F.col("age_days") >= warn)
    return got.select("source_id", "day", "arrival_day", "pending", "age_days", F.when(F.col("age_days") >= error, "error").otherwise("warn").alias("severity"))


def pinned(df: DataFrame, cutoff: Column, column: str = "collected_at") -> DataFrame:
    """Rows as of one cutoff, the same for all inputs of a run."""
    return df.where(F.col(column) <= cutoff)


def retention_plan(versions: DataFrame, newest: int = 5, weeks: int = 4) -> DataFrame:
    """Versions (version_id, role, weekly_slot, pinned, state, created_at) with keep and the reason.

    Kept: those of an uncertain state, pinned ones, the ``newest`` others of scheduled or manual role, counted together, and the
    newest of each of the ``weeks`` newest weekly slots of those whose role is weekly. Slots are stated, never made up.
    """
    sure = F.col("state").isin("complete", "failed") & F.col("pinned").isNotNull()
    rated = versions.where(sure & ~F.col("pinned"))
    last = [F.desc("created_at"), F.asc("version_id")]
    by_count = rated.where(F.col("role").isin("scheduled", "manual")).orderBy(*last).limit(newest).select("version_id", F.lit("newest").alias("why"))
    slots = rated.where((F.col("role") == "weekly") & F.col("weekly_slot").isNotNull())
    first = slots.withColumn("nth", F.row_number().over(W.partitionBy("weekly_slot").orderBy(*last))).where("nth = 1")
    by_week = first.orderBy(*last).limit(weeks).select("version_id", F.lit("weekly").alias("why"))
    got = versions.join(F.broadcast(by_count.union(by_week)), "version_id", "left")  # newest + weeks rows
    reason = F.when(~F.coalesce(sure, F.lit(False)), "unknown state").when(F.col("pinned"), "pinned").otherwise(F.col("why"))
    return got.select("version_id", "role", "created_at", reason.isNotNull().alias("keep"), reason.alias("reason"))
