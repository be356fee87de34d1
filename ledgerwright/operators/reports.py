"""Reports over priced facts: filters, per-day, per-model, per-session totals, tags, summaries, sorts and pages."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwright.functions.aggregates import consensus, ordered_list, paired, ratio, strict_sum, zero_sum

TOKENS = ["input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning", "total_tokens"]
SESSION = ["source_id", "client", "session_id"]
SORTS = ("activity_day", "created_at", "last_active", "total_tokens", "input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning", "cost_usd", "message_count", "ms_per_1k_tokens")
MAX_ROWS = 10_000


@dataclass(frozen=True)
class Filters:
    """What a report covers; empty fields don't filter. Values become literals of expressions, never text of a query."""

    source: str | None = None
    client: str | None = None
    model: str | None = None
    workspace: str | None = None
    tag: str | None = None
    exclude_models: tuple[str, ...] = field(default=())
    since: str | None = None
    until: str | None = None

    def days(self) -> tuple[dt.date | None, dt.date | None]:
        """The inclusive bounds; only YYYY-MM-DD is read, and a reversed range is an error."""
        out = []
        for x in (self.since, self.until):
            if x is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", x):
                raise ValueError(f"not a day of the form YYYY-MM-DD: {x!r}")
            out.append(None if x is None else dt.date.fromisoformat(x))
        if None not in out and out[0] > out[1]:
            raise ValueError("the range of days is reversed")
        return out[0], out[1]


def resolve_source(filters: Filters, local_id: str | None) -> Filters:
    """"local" stands for this machine's source id."""
    if filters.source != "local":
        return filters
    if local_id is None:
        raise ValueError("there is no local source id")
    return Filters(**{**filters.__dict__, "source": local_id})


def report_where(facts: DataFrame, filters: Filters, tagged: DataFrame | None = None, date_column: str = "day") -> DataFrame:
    """Facts that pass, before any aggregation; tags are a semi join, so several matching ones never multiply a fact."""
    tests = [F.col(c) == v for c, v in (("source_id", filters.source), ("client", filters.client), ("model", filters.model), ("workspace", filters.workspace)) if v is not None]
    if filters.exclude_models:
        tests.append(~F.col("model").isin(*filters.exclude_models))
    since, until = filters.days()
    tests += [F.col(date_column) >= F.lit(since)] * (since is not None) + [F.col(date_column) <= F.lit(until)] * (until is not None)
    got = facts.where(reduce(lambda a, b: a & b, tests)) if tests else facts
    return got if filters.tag is None else got.join(tagged.where(F.col("tag") == filters.tag), SESSION, "left_semi")


def daily_usage(cost: DataFrame, sessions: DataFrame) -> DataFrame:
    """Priced facts with their session's workspace; facts without a session stay."""
    return cost.join(sessions.select(*SESSION, "workspace", "workspace_label"), SESSION, "left")


def report_daily(usage: DataFrame, limit: int | None = None) -> DataFrame:
    got = usage.groupBy("day").agg(
        *[zero_sum(c).alias(c) for c in TOKENS],
        zero_sum(F.coalesce(F.col("output_tokens"), F.lit(0)) + F.coalesce(F.col("reasoning"), F.lit(0))).alias("output_with_reasoning"),
        F.sum("perf_duration_ms").alias("duration_ms"),
        F.count("ms_per_1k_tokens").alias("measured_facts"),
        F.count(F.lit(1)).alias("facts"),
        consensus("cost_basis").alias("cost_basis"),
        strict_sum("cost_usd").alias("cost_usd"),
    )
    return got.orderBy(F.desc("day")).limit(limit) if limit else got


def report_models(usage: DataFrame) -> DataFrame:
    ms, timed = paired("perf_duration_ms", "perf_timed_tokens")
    got = usage.groupBy("model", "client").agg(*[zero_sum(c).alias(c) for c in TOKENS], zero_sum("message_count").alias("message_count"), strict_sum("cost_usd").alias("cost_usd"), ms.alias("paired_ms"), timed.alias("paired_tokens"))
    return got.select("model", "client", *TOKENS, "message_count", "cost_usd", ratio("paired_ms", "paired_tokens", 1000).alias("ms_per_1k_tokens"), ratio("cost_usd", "total_tokens", 1e6).alias("cost_per_million"), ratio("cache_read", F.col("input_tokens")).alias("cache_multiplier")).orderBy(F.desc("total_tokens"), "model", "client")


def session_model_stats(cost: DataFrame, *more: Column) -> DataFrame:
    """All-time totals of each session and model, and ``more`` aggregates; plain sums keep null."""
    ms, timed = paired("perf_duration_ms", "perf_timed_tokens")
    got = cost.groupBy(*SESSION, "model").agg(
        F.max("provider").alias("provider"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("message_count").alias("message_count"), strict_sum("cost_usd").alias("cost_usd"),
        ms.alias("paired_ms"), timed.alias("paired_tokens"), F.sum("perf_duration_ms").alias("perf_duration_ms"), F.count(F.lit(1)).alias("facts"), F.max("collected_at").alias("collected_at"), *more,
    )
    return got.withColumn("ms_per_1k_tokens", ratio("paired_ms", "paired_tokens", 1000))


def report_session_models(cost: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session and model totals with the session's metadata and the day of its last activity; the facts are read once."""
    about = sessions.select(*SESSION, "workspace", "workspace_label", "created_at", "last_active")
    per = session_model_stats(cost, F.max("day").alias("last_day"))
    got = per.withColumn("last_usage_day", F.max("last_day").over(W.partitionBy(*SESSION))).drop("last_day").join(about, SESSION, "left")
    active = F.to_date("last_active")
    return got.withColumn("activity_day", F.greatest("last_usage_day", active)).withColumn("last_active_stale", active.isNull() | (F.col("last_usage_day") > active))


def report_sessions(session_models: DataFrame) -> DataFrame:
    got = session_models.groupBy(*SESSION).agg(
        F.max("workspace").alias("workspace"), ordered_list("model").alias("models"), *[zero_sum(c).alias(c) for c in TOKENS], zero_sum("message_count").alias("message_count"), strict_sum("cost_usd").alias("cost_usd"),
        F.sum("paired_ms").alias("paired_ms"), F.sum("paired_tokens").alias("paired_tokens"), F.max("last_active").alias("last_active"), F.max("activity_day").alias("activity_day"),
        F.max("last_usage_day").alias("last_usage_day"), F.max("last_active_stale").alias("last_active_stale"), F.max("created_at").alias("created_at"),
    )
    return got.withColumn("ms_per_1k_tokens", ratio("paired_ms", "paired_tokens", 1000)).withColumn("cost_per_million", ratio("cost_usd", "total_tokens", 1e6)).drop("paired_ms", "paired_tokens")


def sort_sessions(rows: DataFrame, by: str = "activity_day", limit: int | None = 16) -> DataFrame:
    """The top sessions by one of SORTS, largest first, nulls last; ties by last activity, then by key."""
    if by not in SORTS:
        raise ValueError(f"not a sort: {by!r}")
    order = [F.col(by).desc_nulls_last(), F.col("last_active").desc_nulls_last(), *SESSION, *(["model"] if "model" in rows.columns else [])]
    got = rows.orderBy(*order)
    return got if limit is None else got.limit(limit)


def top_by_each_sort(rows: DataFrame, k: int = 16) -> DataFrame:
    """The top k of every sort, with its name and rank: one pass, each row standing once for every sort, of which no task sees more than k past the first rank."""
    value = F.explode(F.array(*[F.struct(F.lit(by).alias("sort"), _number(rows, by).alias("v")) for by in SORTS])).alias("s")
    each = rows.select(*SESSION, F.unix_micros(F.col("last_active").cast("timestamp")).alias("seen"), value).select("s.sort", "s.v", "seen", *SESSION)
    w = W.partitionBy("sort").orderBy(F.col("v").desc_nulls_last(), F.col("seen").desc_nulls_last(), *SESSION)
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("sort", "rank", *SESSION)


def _number(rows: DataFrame, column: str) -> Column:
    kind = rows.schema[column].dataType.simpleString()
    if kind == "date":
        return F.unix_date(column).cast("double")
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.col(column).cast("double")


def summary(cost: DataFrame) -> DataFrame:
    """Sessions and all-or-null cost; (0, 0) for no fact."""
    per = cost.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("facts"), F.count("cost_usd").alias("priced"), F.sum("cost_usd").alias("cost"))
    whole = F.when(F.sum("facts") == F.sum("priced"), F.sum("cost"))
    return per.agg(F.count(F.lit(1)).alias("sessions"), F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(whole).alias("cost_usd"))


def summary_models(cost: DataFrame) -> DataFrame:
    return cost.groupBy("model").agg(zero_sum("total_tokens").alias("total_tokens"), strict_sum("cost_usd").alias("cost_usd"))


def filtered_summary(session_models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session count with all-or-null cost, and totals per model by cost, ties by model downwards."""
    sessions = report_sessions(session_models).agg(F.count(F.lit(1)).alias("sessions"), strict_sum("cost_usd").alias("cost_usd"))
    models = session_models.groupBy("model").agg(zero_sum("total_tokens").alias("total_tokens"), strict_sum("cost_usd").alias("cost_usd"))
    return sessions, models.orderBy(F.col("cost_usd").desc_nulls_last(), F.desc("model"))


def session_tags(sessions: DataFrame, tags: DataFrame) -> DataFrame:
    """(source, client, session, workspace, tag, tag_scope): a tag's scope is a client, a workspace or one session; each scope is an equi join."""
    s, t = sessions.select(*SESSION, "workspace"), tags.select("scope", F.col("client").alias("t_client"), F.col("workspace").alias("t_workspace"), F.col("session_id").alias("t_session"), "tag")
    parts = [
        s.join(t.where("scope = 'client'"), F.col("client") == F.col("t_client")),
        s.join(t.where("scope = 'workspace'"), F.col("workspace") == F.col("t_workspace")),
        s.join(t.where("scope = 'session'"), (F.col("client") == F.col("t_client")) & (F.col("session_id") == F.col("t_session"))),
    ]
    return reduce(DataFrame.union, [p.select(*SESSION, "workspace", "tag", F.col("scope").alias("tag_scope")) for p in parts]).distinct()


def tagged_sessions(sessions: DataFrame, tags: DataFrame) -> DataFrame:
    """Every session once for each of its tags and the scope that the tag reaches it by."""
    return sessions.join(session_tags(sessions, tags).drop("workspace"), SESSION)


def noted_sessions(sessions: DataFrame, notes: DataFrame) -> DataFrame:
    about = notes.select(*SESSION, "note_id", "note", F.col("created_at").alias("note_created_at"), F.col("updated_at").alias("note_updated_at"), F.col("collected_at").alias("note_collected_at"))
    return sessions.join(about, SESSION)


def missing_sessions(cost: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with usage but no metadata."""
    return cost.select(*SESSION).distinct().join(sessions, SESSION, "left_anti")


def note_page(notes: DataFrame, page: int | None = None, after: tuple | None = None, source_id: str | None = None, size: int = 16) -> DataFrame:
    """A page of notes with one row more, newest first, ids ascending; by page number, or after (updated_at, note_id)."""
    rows = notes if source_id is None else notes.where(F.col("source_id") == source_id)
    if after is not None:
        rows = rows.where((F.col("updated_at") < F.lit(after[0])) | ((F.col("updated_at") == F.lit(after[0])) & (F.col("note_id") > after[1])))
    rows = rows.orderBy(F.desc("updated_at"), "note_id")
    return (rows.offset((page - 1) * size) if page and page > 1 else rows).limit(size + 1)


def relation_query(relations: dict[str, DataFrame], name: str, filters: dict | None = None, limit: int = 1000) -> DataFrame:
    """Rows of an allowed relation whose columns equal the given values, at most ``limit`` of them."""
    if name not in relations:
        raise ValueError(f"not a public relation: {name!r}")
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"the limit must be from 1 to {MAX_ROWS}")
    rows = relations[name]
    for c, v in (filters or {}).items():
        if c not in rows.columns:
            raise ValueError(f"{name} has no column {c!r}")
        rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
    return rows.limit(limit)
