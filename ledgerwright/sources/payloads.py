"""Scans of usage payloads: JSON files, one a day and kind, parsed with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The shapes of the payloads.
ENTRY = (
    "client string, mergedClients array<string>, sessionId string, model string, provider string, input bigint, output bigint, cacheRead bigint, cacheWrite bigint, reasoning bigint, messageCount bigint, cost double, "
    "performance struct<msPer1KTokens: double, totalDurationMs: bigint, timedTokens: bigint, sampleCount: bigint, tokenCoverage: double>"
)
DAILY = f"groupBy string, entries array<struct<{ENTRY}>>, totalInput bigint, totalOutput bigint, totalCacheRead bigint, totalCacheWrite bigint, totalMessages bigint, totalCost double, processingTimeMs bigint, _corrupt_record string"
REPORT = (
    "session_id: string, client: string, workspace: string, workspace_label: string, created_at: string, last_active: string, title: string, total_input_tokens: bigint, total_output_tokens: bigint, total_cache_read: bigint, "
    "total_cost: double, models_used: array<string>, message_count: bigint, duration_minutes: bigint"
)
TOKENS5 = "struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint, reasoning: bigint>"
GRAPH = f"meta struct<version: string>, contributions array<struct<date: string, totals: struct<tokens: bigint, cost: double, messages: bigint>, clients: array<struct<client: string, modelId: string, providerId: string, tokens: {TOKENS5}, cost: double, messages: bigint>>>>"
PRICING = (
    "modelId string, matchedKey string, source string, resolution struct<kind: string>, "
    "pricing struct<inputCostPerToken: double, outputCostPerToken: double, cacheReadInputTokenCost: double, cacheCreationInputTokenCost: double>"
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(file, day, json): whole files; the day is the first YYYY-MM-DD of the file's name."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"))
    return rows.select("file", F.to_date(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1)).alias("day"), "json")


def parse_daily(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries with the day attached, declared totals, and rejected payloads of (file, day, json).

    A payload without entries has none; one that doesn't parse, or holds an entry that is no object, is rejected.
    """
    text = F.from_json("json", DAILY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = payloads.select("file", "day", "json", F.explode(F.array(text)).alias("p"))  # a generator's row is made once, where an expression is repeated in each place that reads it
    bad = F.col("p").isNull() | F.col("p._corrupt_record").isNotNull() | F.exists(F.coalesce("p.entries", F.array()), lambda e: e.isNull())
    good = parsed.where(~bad)
    e = F.col("e")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    entries = good.select("file", "day", F.posexplode("p.entries").alias("pos", "e")).select(
        "file", "day", "pos", e["client"].alias("client"), e["sessionId"].alias("session_id"), e["model"].alias("model"), e["provider"].alias("provider"),
        zero(e["input"]).alias("input_tokens"), zero(e["output"]).alias("output_tokens"), zero(e["cacheRead"]).alias("cache_read"), zero(e["cacheWrite"]).alias("cache_write"), zero(e["reasoning"]).alias("reasoning"),
        (zero(e["input"]) + zero(e["output"]) + zero(e["cacheRead"]) + zero(e["cacheWrite"]) + zero(e["reasoning"])).alias("total_tokens"),
        zero(e["messageCount"]).alias("message_count"), e["cost"].alias("reported_cost_usd"), *performance(e["performance"]),
    )
    totals = good.select("file", "day", *[F.col(f"p.{a}").alias(b) for a, b in (("totalInput", "total_input"), ("totalOutput", "total_output"), ("totalCacheRead", "total_cache_read"), ("totalCacheWrite", "total_cache_write"), ("totalMessages", "total_messages"), ("totalCost", "total_cost"))])
    return entries, totals, parsed.where(bad).select("file", "day", "json")


def performance(p: Column) -> list[Column]:
    """The nested timing object as flat columns; null where it is missing."""
    return [p["msPer1KTokens"].alias("reported_ms_per_1k"), p["totalDurationMs"].alias("perf_duration_ms"), p["timedTokens"].alias("perf_timed_tokens"), p["sampleCount"].alias("perf_sample_count"), p["tokenCoverage"].alias("perf_token_coverage")]


def parse_report(payloads: DataFrame) -> DataFrame:
    """Session rows of an array payload, with their place in it; duplicates still apart."""
    rows = payloads.select("file", "day", F.posexplode(F.from_json("json", f"array<struct<{REPORT}>>")).alias("pos", "r"))
    return rows.select("file", "day", "pos", "r.*")


def parse_graph(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, date, version) of the contributed days, and the dates that one payload holds twice."""
    parsed = payloads.select("file", F.from_json("json", GRAPH).alias("p"))
    days = parsed.select("file", F.col("p.meta.version").alias("version"), F.explode("p.contributions").alias("c")).select("file", "version", F.to_date("c.date").alias("date"))
    twice = days.groupBy("file", "date").count().where("count > 1").select("file", "date")
    return days.distinct(), twice


def parse_pricing(payloads: DataFrame) -> DataFrame:
    p = payloads.select("file", "day", F.from_json("json", PRICING).alias("p"))
    rates = (("inputCostPerToken", "input"), ("outputCostPerToken", "output"), ("cacheReadInputTokenCost", "cache_read"), ("cacheCreationInputTokenCost", "cache_write"))
    return p.select("file", "day", F.col("p.modelId").alias("model"), F.col("p.source").alias("source"), F.col("p.matchedKey").alias("matched_key"), F.col("p.resolution.kind").alias("match_kind"), *[F.col(f"p.pricing.{a}").alias(f"price_{b}_per_token") for a, b in rates])


def to_time(value: Column) -> Column:
    """A UTC timestamp from epoch milliseconds or ISO text (naive text is UTC), both as strings; null for anything else."""
    millis = F.when(value.rlike(r"^-?\d{1,15}$"), F.timestamp_millis(F.try_cast(value, "bigint") if hasattr(F, "try_cast") else value.try_cast("bigint")))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))
    return F.coalesce(millis, iso)


def session_label(workspace_label: Column, created: Column, session_id: Column) -> Column:
    """{label or session} · {date or unknown-date} · {last 8 characters of the id}."""
    return F.concat(F.coalesce(workspace_label, F.lit("session")), F.lit(" · "), F.coalesce(F.date_format(created, "yyyy-MM-dd"), F.lit("unknown-date")), F.lit(" · "), F.right(session_id, F.lit(8)))


def models_used(models: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(models, F.array().cast("array<string>"))))


def merge_sessions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each (client, session), and the keys in conflict.

    created_at is the earliest, last_active the latest, models the union; everything else comes from the row with the newest
    last_active, the later one of ties. Rows that name different workspaces or labels conflict and are left out.
    """
    keys = ["client", "session_id"]
    newest = F.struct(F.col("last_active").isNotNull(), "last_active", "pos")
    rest = [c for c in rows.columns if c not in (*keys, "created_at", "last_active", "models_used", "pos", "workspace", "workspace_label")]
    clash = lambda c: F.size(F.collect_set(c)) > 1
    got = rows.groupBy(*keys).agg(
        F.min("created_at").alias("created_at"), F.max("last_active").alias("last_active"), F.flatten(F.collect_list("models_used")).alias("models_used"),
        *[F.max(c).alias(c) for c in ("workspace", "workspace_label")], *[F.max_by(c, newest).alias(c) for c in rest], (clash("workspace") | clash("workspace_label")).alias("clash"),
    )
    return got.where("not clash").drop("clash").withColumn("models_used", models_used(F.col("models_used"))), got.where("clash").select(*keys)


def apply_rules(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Override fields by rules {when: {...}, skip_if: {...}, replace: {...}}: all of when match, not all of skip_if."""
    def all_of(tests: dict) -> Column:
        out = F.lit(True)
        for c, v in tests.items():
            out = out & F.col(c).eqNullSafe(F.lit(v))
        return out

    for c in {c for r in rules for c in r["replace"]}:
        value = F.col(c)
        for r in rules:
            if c in r["replace"]:
                hit = all_of(r["when"]) & (~all_of(r["skip_if"]) if r.get("skip_if") else F.lit(True))
                value = F.when(hit, F.lit(r["replace"][c])).otherwise(value)
        rows = rows.withColumn(f"new_{c}", value)
    changed = [c for r in rules for c in r["replace"]]
    return rows.select(*[F.col(f"new_{c}").cast(rows.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in rows.columns if not c.startswith("new_")])


def check_domains(rows: DataFrame, identifiers=(), metadata=(), non_negative=(), unit=()) -> DataFrame:
    """Add reject_reason: the constraints that a row breaks, empty if none."""
    tests = [(f"{c}: length", ~F.char_length(c).between(1, 1024)) for c in identifiers]
    tests += [(f"{c}: length", F.char_length(c) > 4096) for c in metadata]
    tests += [(f"{c}: negative or not finite", (F.col(c) < 0) | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in non_negative]
    tests += [(f"{c}: not in 0..1", ~F.col(c).between(0, 1)) for c in unit]
    return rows.withColumn("reject_reason", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests])))


def write_inputs(inputs: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write the input rows of a run (entries, session rows, contributions) as JSON text, one partition a kind, and count them in that write.

    Every input is read once, and the counts are observed as its rows go by. Each kind is written to its own folder: a writer that deals
    rows out to folders sorts them first.
    """
    counts = {}
    for kind, rows in inputs.items():
        seen = Observation()
        rows.select(F.to_json(F.struct("*")).alias("json")).observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(f"{folder}/kind={kind}")
        counts[kind] = seen.get["n"]
    return counts


def check_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of violation counts of a batch: nulls, sources and runs beyond one, malformed ids, keys not unique."""
    uuid = r"^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
    needed = [c for c in ("source_id", "event_id", "collected_at") if c in rows.columns]
    any_null = F.lit(False)
    for c in [*needed, *keys]:
        any_null = any_null | F.col(c).isNull()
    whole = rows.agg(F.count(F.when(any_null, 1)).alias("nulls"), F.countDistinct("source_id").alias("sources"), F.count(F.when(~F.col("event_id").rlike(uuid), 1)).alias("bad_ids"))
    twice = rows.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))
    return whole.crossJoin(twice)  # one row each
