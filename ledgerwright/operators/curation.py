"""Batches of tag and note mutations, as observations to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.functions.ids import event_id, note_id

TAG = ["scope", "client", "workspace", "session_id", "tag"]
NOTE = ["source_id", "client", "session_id"]


def scope_valid() -> Column:
    """Exactly the fields of the scope are set: a client; a workspace alone; a client with a session."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    client = (F.col("scope") == "client") & has("client") & ~has("workspace") & ~has("session_id")
    workspace = (F.col("scope") == "workspace") & ~has("client") & has("workspace") & ~has("session_id")
    session = (F.col("scope") == "session") & has("client") & ~has("workspace") & has("session_id")
    return F.coalesce((client | workspace | session) & has("tag"), F.lit(False))


def split_by_scope(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(scope_valid()), rows.where(~scope_valid())


def _observe(rows: DataFrame, keys: list[str], op: str, now: Column, run: str) -> DataFrame:
    return rows.withColumn("op", F.lit(op)).withColumn("updated_at", now).withColumn("collected_at", now).withColumn("op_id", F.coalesce(F.col("op_id"), F.lit(None).cast("string")) if "op_id" in rows.columns else F.lit(None).cast("string")).withColumn("event_id", event_id(F.lit(run), F.lit(op), *keys))


def add_tags(requests: DataFrame, current: DataFrame, now: Column, run: str) -> DataFrame:
    """Observations for the tags that aren't assigned yet; requests: source_id and the key."""
    new = split_by_scope(requests)[0].dropDuplicates(TAG).join(current, TAG, "left_anti").withColumn("created_at", now)
    return _observe(new.select("source_id", *TAG, "created_at"), TAG, "upsert", now, run)


def rename_tags(requests: DataFrame, current: DataFrame, now: Column, run: str) -> DataFrame:
    """A delete and a new row with one op_id for each rename; none where the old one is missing or the new one exists.

    requests: the key and new_tag. The created time is kept.
    """
    have = requests.select(*TAG, "new_tag").dropDuplicates(TAG).where("tag <> new_tag").join(current.select(*TAG, "source_id", "created_at"), TAG)
    taken = current.select(*TAG[:-1], F.col("tag").alias("new_tag"))
    have = have.join(taken, [*TAG[:-1], "new_tag"], "left_anti").dropDuplicates([*TAG[:-1], "new_tag"]).withColumn("op_id", event_id(F.lit(run), *TAG, "new_tag"))
    old = _observe(have.select("source_id", *TAG, "created_at", "op_id"), TAG, "delete", now, run)
    new = _observe(have.select("source_id", *TAG[:-1], F.col("new_tag").alias("tag"), "created_at", "op_id"), TAG, "upsert", now, run)
    return old.unionByName(new)


def set_notes(requests: DataFrame, current: DataFrame, now: Column, run: str, must_exist: bool = False) -> DataFrame:
    """Observations for notes whose text changes; the created time of a note that exists is kept. requests: the key and note."""
    had = current.select(*NOTE, F.col("note").alias("old_note"), F.col("created_at").alias("old_created"))
    both = requests.select(*NOTE, "note").dropDuplicates(NOTE).join(had, NOTE, "inner" if must_exist else "left")
    changed = both.where(~F.col("note").eqNullSafe(F.col("old_note"))).withColumn("created_at", F.coalesce("old_created", now)).withColumn("note_id", note_id(*NOTE))
    return _observe(changed.select("note_id", *NOTE, "note", "created_at"), NOTE, "upsert", now, run)


def remove(requests: DataFrame, current: DataFrame, keys: list[str], now: Column, run: str) -> DataFrame:
    """Delete observations for the assignments or notes that exist."""
    gone = current.join(requests.select(*keys).distinct(), keys, "left_semi")
    return _observe(gone.drop("op", "updated_at", "collected_at", "op_id", "event_id"), keys, "delete", now, run)
