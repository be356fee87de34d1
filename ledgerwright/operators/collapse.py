"""Current state of observation tables: the best row per key, in one aggregate with map-side combining."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKENS = ["input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning"]


@dataclass(frozen=True)
class Table:
    """Natural key of an observation table, and the columns that rank its rows, best last; the last one is unique.

    ``deal``: the part of the key by which rows are dealt out before they are ranked, for tables of short histories.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...] = ("collected_at", "event_id")
    deal: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


#: Keys and ranking of the canonical tables.
TABLES = {
    "sessions": Table(("source_id", "client", "session_id"), deal=("source_id", "client", "session_id")),
    "daily_stats": Table(("source_id", "client", "session_id", "model", "day"), ("collected_at", "total_tokens", "event_id"), deal=("source_id", "client", "session_id")),
    "price_versions": Table(("source_id", "day", "model"), ("collected_at", "price_output_per_token", "event_id")),
    "collection_ledger": Table(("source_id", "run_id", "day", "domain"), ("collected_at", "finished_at", "event_id")),
    "reconciliation_issues": Table(("source_id", "check_name", "issue_key"), ("collected_at", "resolved", "event_id")),
    "payload_drift_events": Table(("source_id", "domain", "payload_ver", "drift_key"), ("collected_at", "resolved", "event_id")),
    "tags": Table(("scope", "client", "workspace", "session_id", "tag"), ("collected_at", "is_upsert", "event_id")),
    "notes": Table(("source_id", "client", "session_id"), ("collected_at", "is_upsert", "event_id")),
}


def collapse(df: DataFrame, keys, order, **over_all: Column) -> DataFrame:
    """The row of each key that is last by ``order`` (nulls first), with ``over_all`` aggregates of the whole key replacing its columns.

    Without ``over_all`` it is a rank of one, which Spark also applies before the shuffle; with it, one struct maximum per key
    beside the aggregates. Either way rows combine on the map side, so a key with very many observations is no hot task.
    The order ends in a unique column; equal rows collapse into one.
    """
    if not over_all:
        return collapse_by_window(df, keys, order)
    return collapse_by_struct(df, keys, order, **over_all)


def collapse_by_struct(df: DataFrame, keys, order, **over_all: Column) -> DataFrame:
    keys, rest = list(keys), [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("best")
    got = df.groupBy(*keys).agg(best, *[a.alias(f"all_{n}") for n, a in over_all.items()])
    return got.select(*[F.col(c) if c in keys else F.col(f"all_{c}").alias(c) if c in over_all else F.col(f"best.row.{c}").alias(c) for c in df.columns], *[F.col(f"all_{n}").alias(n) for n in over_all if n not in df.columns])


def collapse_by_window(df: DataFrame, keys, order) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("rank__", F.row_number().over(w)).where("rank__ = 1").drop("rank__")


def dealt(df: DataFrame, table: str) -> DataFrame:
    """``df`` shuffled by the ``deal`` of its table, if it has one.

    Most facts and sessions have one or two observations, so combining them before the shuffle hardly drops a row and costs a sort of all
    rows of a file's split, on disk where they are many. Dealt out first, rows are sorted once, in tasks of the shuffle's size, and what else goes by session
    (totals, metadata, tags) needs no other shuffle and, as the keys begin with it, no other sort. A session's facts meet in one task.
    """
    by = TABLES[table].deal
    return df.repartition(*by) if by else df


def current(df: DataFrame, table: str) -> DataFrame:
    t = TABLES[table]
    df = dealt(df, table)
    if table in ("tags", "notes"):
        ranked = df.withColumn("is_upsert", F.col("op") == "upsert")
        return collapse(ranked, t.keys, t.order).where("is_upsert").drop("is_upsert")  # after ranking: a delete hides what it follows
    if table == "sessions":
        return collapse(df, t.keys, t.order, first_seen_at=F.min("first_seen_at"), last_seen_at=F.max("last_seen_at"))
    if table in ("payload_drift_events", "reconciliation_issues"):
        once = replayed_once(df)
        more = {"created_at": F.min("created_at"), "observation_count": F.sum("observation_count").cast("long")}
        if table == "reconciliation_issues":
            more["message"] = F.max(F.when(F.col("message").isNotNull(), F.struct(*t.order, "message")))["message"]
        return collapse(once, t.keys, t.order, **more)
    return collapse(df, t.keys, t.order)


def replayed_once(df: DataFrame) -> DataFrame:
    """One row for each (source, event): replays of an event are hidden. The last one stays, a resolved one of a time, and then the one of the largest row."""
    return collapse_by_struct(df, ["source_id", "event_id"], ["collected_at", "resolved"])


def collection_runs(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("domain") == "collection")


def collection_status(ledger: DataFrame) -> DataFrame:
    """The newest ledger row of each source, day and domain, runs themselves left out."""
    return collapse(ledger.where(F.col("domain") != "collection"), ["source_id", "day", "domain"], ["collected_at", "finished_at", "event_id"])


def open_diagnostics(rows: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Unresolved rows seen within ``days`` before ``now``."""
    return rows.where(~F.col("resolved") & (F.col("collected_at") >= now - F.expr(f"INTERVAL {days} DAYS")))


def newest_open(rows: DataFrame, now: Column, limit: int = 20, days: int = 90) -> DataFrame:
    """The ``limit`` newest of :func:`open_diagnostics`, newest first; ties by key, so that the list is one and the same."""
    if limit < 1:
        raise ValueError("limit must be positive")
    ties = [c for c in ("source_id", "domain", "payload_ver", "drift_key", "check_name", "issue_key") if c in rows.columns]
    return open_diagnostics(rows, now, days).orderBy(F.col("collected_at").desc_nulls_last(), *ties).limit(limit)


def token_sum(prefix: str = "") -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{prefix}{c}"), F.lit(0)) for c in TOKENS])


def exceeds(new: str, old: str, order=("collected_at", "total_tokens", "event_id")) -> Column:
    return F.struct(*[F.col(f"{new}.{c}") for c in order]) > F.struct(*[F.col(f"{old}.{c}") for c in order])


def monotone_merge(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming daily rows that exceed their stored row, with token counts that never fall below it.

    A row counts only if (collected_at, total_tokens, event_id) exceeds the stored row's. Of accepted rows each
    component is the larger of both; the total is the largest of both totals and the sum of the merged components;
    all else comes from the incoming row. Rows without a stored row are kept as they are.
    """
    keys = list(TABLES["daily_stats"].keys)
    i, s = incoming.alias("i"), stored.alias("s")
    both = i.join(s, [F.col(f"i.{k}") == F.col(f"s.{k}") for k in keys], "left")
    both = both.where(F.col("s.event_id").isNull() | exceeds("i", "s"))
    lifted = {c: F.greatest(F.col(f"i.{c}"), F.col(f"s.{c}")) for c in TOKENS}
    total = F.greatest(F.col("i.total_tokens"), F.col("s.total_tokens"), reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in lifted.values()]))
    return both.select(*[lifted[c].alias(c) if c in lifted else total.cast("long").alias(c) if c == "total_tokens" else F.col(f"i.{c}") for c in incoming.columns])


def fold_history(df: DataFrame, arrival) -> DataFrame:
    """:func:`monotone_merge` over all rows of each key in the order of ``arrival``: what publishing them one by one leaves.

    The result depends on that order, so the rows of one key meet; a key's history is short (observations of one fact).
    """
    keys = list(TABLES["daily_stats"].keys)
    rest = [c for c in df.columns if c not in keys and c not in arrival]
    row = F.struct(*[F.col(a).alias(f"a{k}") for k, a in enumerate(arrival)], F.struct(*[F.col(c) for c in rest]).alias("r"))
    order = ("collected_at", "total_tokens", "event_id")

    def step(acc, x):
        new, ahead = x["r"], F.struct(*[x["r"][c] for c in order]) > F.struct(*[acc[c] for c in order])
        lifted = {c: F.greatest(new[c], acc[c]) for c in TOKENS}
        total = F.greatest(new["total_tokens"], acc["total_tokens"], reduce(lambda a, b: a + b, [F.coalesce(y, F.lit(0)) for y in lifted.values()]))
        merged = F.struct(*[(lifted[c] if c in lifted else total.cast("long") if c == "total_tokens" else new[c]).alias(c) for c in rest])
        return F.when(ahead, merged).otherwise(acc)

    history = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("h"))
    folded = history.withColumn("s", F.aggregate(F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), F.element_at("h", 1)["r"], step))
    return folded.select(*[F.col(c) if c in keys else F.col(f"s.{c}").alias(c) for c in df.columns if c not in arrival])


def raw_and_gold(raw: DataFrame, gold: DataFrame, by: str | None = None, gold_dealt: bool = False) -> DataFrame:
    """Current daily facts over raw observations and compacted gold: the best row of both, lifted to the best gold row's components.

    Both are ranked together, for which they are shuffled once, and only the columns that are asked for; ``by``: as :func:`gathered` does it.
    ``gold_dealt``: gold is what :func:`current` has left, dealt out as the raw rows will be, and isn't shuffled again.
    """
    t = TABLES["daily_stats"]
    group = list(t.keys)
    if by is None and gold_dealt:
        both = dealt(raw.withColumn("gold__", F.lit(False)), "daily_stats").unionByName(gold.withColumn("gold__", F.lit(True)))
    else:
        both = raw.withColumn("gold__", F.lit(False)).unionByName(gold.withColumn("gold__", F.lit(True)))
        both, group = (dealt(both, "daily_stats"), group) if by is None else gathered(both, t.keys, by)
    last = W.partitionBy(*group).orderBy(*[F.col(c).desc_nulls_last() for c in t.order], "gold__")
    floor = F.max(F.when(F.col("gold__"), F.struct(*t.order, *TOKENS))).over(last.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    best = both.withColumn("floor", floor).withColumn("rank__", F.row_number().over(last)).where("rank__ = 1")
    lifted = {c: F.greatest(F.col(c), F.col(f"floor.{c}")) for c in TOKENS}
    total = F.greatest(F.col("total_tokens"), F.col("floor.total_tokens"), reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in lifted.values()]))
    own = {**lifted, "total_tokens": total.cast("long")}
    return best.select(*[own.get(c, F.col(c)).alias(c) for c in raw.columns])


#: Parts that the keys of one partition are dealt into, so that a large one is written by several tasks.
SPREAD = 16


def gathered(rows: DataFrame, keys, by: str | None) -> tuple[DataFrame, list[str]]:
    """``rows`` dealt out by ``by``, one of the keys, and a hash of the others, and what to group them by: a table partitioned by ``by`` is then written as it stands."""
    if by is None:
        return rows, list(keys)
    part = F.pmod(F.hash(*[k for k in keys if k != by]), F.lit(SPREAD))
    return rows.withColumn("deal__", part).repartition(by, "deal__"), [*keys, "deal__"]


def upsert_flagged(current_rows: DataFrame, batch: DataFrame, table: str, by: str | None = None) -> tuple[DataFrame, Column, Column]:
    """(the table after a batch, with fresh__ and wins__; whether a row was inserted; whether it was updated).

    A stored row gives way only to one that ranks after it. Sessions keep the earliest first and the latest last sighting even
    when the incoming row loses; daily facts keep the larger of each token component, and a total no less than their sum. A batch's daily
    rows of a key are merged in their ranking order first (:func:`fold_history`), in which every row exceeds the one before, so components
    are maxima, and the total of more than one row is the largest of all totals and the sum of the components. Stored and new rows meet in
    one aggregate, for which they are shuffled once, by :func:`gathered`.
    """
    t = TABLES[table]
    columns, tokens = current_rows.columns, [*TOKENS, "total_tokens"]
    both, group = gathered(current_rows.withColumn("old__", F.lit(True)).unionByName(batch.select(*columns).withColumn("old__", F.lit(False))), t.keys, by)
    row = F.struct(*t.order, *[c for c in columns if c not in t.keys and c not in t.order])
    new = lambda x: F.when(~F.col("old__"), x)
    aggs = [F.max(F.when(F.col("old__"), row)).alias("c"), F.max(new(row)).alias("b")]
    if table == "daily_stats":
        aggs += [F.min(new(F.struct(*t.order))).alias("low__"), *[F.max(new(F.col(x))).alias(f"top_{x}") for x in tokens]]
    elif table == "sessions":
        aggs += [F.min(new(F.col("first_seen_at"))).alias("first__"), F.max(new(F.col("last_seen_at"))).alias("last__")]
    met = both.groupBy(*group).agg(*aggs)
    fresh = F.col("c").isNull()
    wins = ~fresh & F.coalesce(F.col("b").isNotNull() & exceeds("b", "c", t.order), F.lit(False))
    own = {}
    if table == "sessions":
        own = {"first_seen_at": F.least("c.first_seen_at", "first__"), "last_seen_at": F.greatest("c.last_seen_at", "last__")}
    elif table == "daily_stats":
        several = F.col("low__") < F.struct(*[F.col(f"b.{x}") for x in t.order])
        got = {x: F.col(f"top_{x}") for x in TOKENS}
        got["total_tokens"] = F.when(several, F.greatest("top_total_tokens", token_sum("top_"))).otherwise(F.col("b.total_tokens"))
        lifted = {x: F.greatest(F.col(f"c.{x}"), v) for x, v in got.items()}
        lifted["total_tokens"] = F.greatest(lifted["total_tokens"], reduce(lambda x, y: x + y, [F.coalesce(lifted[x], F.lit(0)) for x in TOKENS]))
        own = {x: F.when(fresh, got[x]).when(wins, lifted[x]).otherwise(F.col(f"c.{x}")).cast("long") for x in tokens}
    plain = lambda x: F.when(fresh | wins, F.col(f"b.{x}")).otherwise(F.col(f"c.{x}"))
    after = met.select(*[F.col(x) if x in t.keys else (own[x] if x in own else plain(x)).alias(x) for x in columns], fresh.alias("fresh__"), wins.alias("wins__"))
    return after, F.col("fresh__"), F.col("wins__")


def upsert(current_rows: DataFrame, batch: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """The table after a batch, and (inserted, updated) counts of it; see :func:`upsert_flagged`."""
    after, fresh, wins = upsert_flagged(current_rows, batch, table)
    counts = after.agg(F.count(F.when(fresh, 1)).alias("inserted"), F.count(F.when(wins, 1)).alias("updated"))
    return after.drop("fresh__", "wins__"), counts
