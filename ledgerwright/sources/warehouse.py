"""Tables of immutable Parquet folders, and a commit log that names the live ones: several tables change at once or not at all."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwright.operators.collapse import upsert_flagged
from ledgerwright.operators.compaction import candidates, compact_grown, expired
from ledgerwright.sources.scratch import written

#: How Spark names the partition of null, so that it can be asked for like any other.
NULL_PART = "__HIVE_DEFAULT_PARTITION__"
#: Partition of the canonical tables: current state by what a batch touches, observations by their day of arrival.
PARTS = {"sessions": "source_id", "daily_stats": "day", "price_versions": "day"}


class Conflict(RuntimeError):
    """Another writer has committed since the base of this commit was read."""


@dataclass(frozen=True)
class Commit:
    """tables: name to {"schema": ..., "parts": {partition value: [folders]}}; at: microseconds, when the commit was made."""

    number: int = 0
    key: str = ""
    at: int = 0
    tables: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Change:
    """Rows of a table, partitioned by a column or expression: added, or in place of what the partitions that they touch hold.

    ``parts`` names further partitions whose rows go though no new row falls into them. ``gathered``: the rows of a partition are in few
    tasks already and are written by these; others are shuffled for it first.
    """

    table: str
    rows: DataFrame | None = None
    by: str | Column = ""
    replace: bool = False
    parts: tuple[str, ...] = ()
    gathered: bool = False


class Warehouse:
    """Tables under one folder. A commit is one file, put in place by a rename that fails if it is there already.

    Everything is staged in folders of its own before that, so a writer that dies leaves nothing that a reader sees, and a reader
    that has taken a commit goes on reading the same files. A commit holds the folders of all partitions of all tables: their number
    is that of days and sources, not of rows.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def _listed(self, name: str) -> list[str]:
        path = self._path(name)
        fs = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def at(self, number: int) -> Commit:
        if not number:
            return Commit()
        text = self.spark.read.text(f"{self.root}/_commits/{number:012}.json", wholetext=True).first()[0]
        return Commit(**json.loads(text))

    def head(self) -> Commit:
        """The last commit; number 0, of no tables, before the first."""
        return self.at(max([int(n[:-5]) for n in self._listed("_commits") if n.endswith(".json")], default=0))

    def committed(self, key: str) -> bool:
        if not self._listed("_commits"):
            return False
        log = self.spark.read.schema("number long, key string").option("pathGlobFilter", "*.json").json(f"{self.root}/_commits")
        return not log.where(F.col("key") == key).isEmpty()

    def as_of(self, micros: int) -> Commit:
        """The last commit made up to a time: what landed later isn't in it, whenever it says it was collected."""
        log = self.spark.read.schema("number long, at long").option("pathGlobFilter", "*.json").json(f"{self.root}/_commits")
        return self.at(log.where(F.col("at") <= micros).agg(F.max("number")).first()[0] or 0)

    def read(self, table: str, parts=None, at: Commit | None = None) -> DataFrame:
        """The rows of a table, of all or the named partitions, in the last or a given commit."""
        held = (at or self.head()).tables.get(table)
        if held is None:
            raise ValueError(f"no such table: {table!r}")
        schema = T.StructType.fromJson(held["schema"])
        folders = [f"{self.root}/{f}" for value, own in sorted(held["parts"].items()) if parts is None or value in parts for f in own]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _stage(self, change: Change) -> dict[str, str]:
        """Write the rows, one folder a partition, and name the folders by partition; a large partition is written by several tasks."""
        folder = f"{change.table}/{uuid.uuid4().hex}"
        by = F.col(change.by) if isinstance(change.by, str) else change.by
        rows = change.rows.withColumn("part__", by.cast("string"))
        rows = rows if change.gathered else rows.hint("rebalance", "part__")
        rows.write.option("compression", "zstd").partitionBy("part__").parquet(f"{self.root}/{folder}")
        return {unquote(n[7:]): f"{folder}/{n}" for n in self._listed(folder) if n.startswith("part__=")}

    def commit(self, key: str, changes: list[Change], base: Commit | None = None) -> Commit:
        """Apply the changes in order, the collection ledger's last, as one commit on top of ``base``."""
        base = base or self.head()
        tables = {name: {"schema": held["schema"], "parts": {v: list(f) for v, f in held["parts"].items()}} for name, held in base.tables.items()}
        for change in sorted(changes, key=lambda c: c.table == "collection_ledger"):
            schema = json.loads(change.rows.schema.json()) if change.rows is not None else None
            held = tables.setdefault(change.table, {"schema": schema, "parts": {}})
            if schema is not None and [f["name"] for f in held["schema"]["fields"]] != [f["name"] for f in schema["fields"]]:
                raise ValueError(f"{change.table}: other columns than the table's")
            for value in change.parts:
                held["parts"].pop(value, None)
            for value, folder in (self._stage(change) if change.rows is not None else {}).items():
                held["parts"][value] = [folder] if change.replace else [*held["parts"].get(value, []), folder]
        new = Commit(base.number + 1, key, time.time_ns() // 1000, tables)
        self._put(new)
        return new

    def _put(self, commit: Commit) -> None:
        staged, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{commit.number:012}.json")
        out = staged.getFileSystem(self._conf).create(staged, False)
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 1)
        options[0] = getattr(self._fs, "Options$Rename").NONE
        try:
            self._fs.FileContext.getFileContext(final.toUri(), self._conf).rename(staged, final, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"commit {commit.number} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the last ``keep`` commits names, staged ones of dead writers among them, and return them.

        No other writer may be at work, since what it has staged isn't named yet.
        """
        head = self.head()
        commits = [self.at(n) for n in range(max(1, head.number - keep + 1), head.number + 1)]
        named = {f for c in commits for held in c.tables.values() for own in held["parts"].values() for f in own}
        stages = {f.rpartition("/")[0] for f in named}
        gone = []
        for table in [t for t in self._listed("") if not t.startswith("_")]:
            for stage in [f"{table}/{n}" for n in self._listed(table)]:
                gone += [f"{stage}/{n}" for n in self._listed(stage) if n.startswith("part__=") and f"{stage}/{n}" not in named] if stage in stages else [stage]
        for folder in gone:
            path = self._path(folder)
            path.getFileSystem(self._conf).delete(path, True)
        return gone


def touched(rows: DataFrame, by: str | Column) -> list[str]:
    """The partitions that rows fall into; their number is that of the table's partitions at most."""
    value = F.col(by) if isinstance(by, str) else by
    return [NULL_PART if r[0] is None else r[0] for r in rows.select(value.cast("string")).distinct().collect()]


@dataclass(frozen=True)
class Persisted:
    """Inserted and updated rows by table; all zero where the run had been committed before."""

    counts: dict[str, tuple[int, int]]
    already_committed: bool = False


def persist_run(warehouse: Warehouse, run_id: str, current: dict[str, DataFrame], observed: dict[str, DataFrame], ledger: DataFrame) -> Persisted:
    """Write a collection run: upserts of current state, observations, and the collection ledger, in one commit keyed by ``run_id``.

    A run that was committed before changes nothing. Rows of another run are an error. Only partitions that the run touches are read and
    rewritten, and the counts come with that write. Two runs at a time: the second one to commit meets a Conflict and has to be repeated.
    """
    base = warehouse.head()
    if warehouse.committed(run_id):
        return Persisted({t: (0, 0) for t in current}, True)
    for name, rows in (*observed.items(), ("collection_ledger", ledger)):
        if "run_id" in rows.columns and not rows.where(~F.col("run_id").eqNullSafe(F.lit(run_id))).isEmpty():
            raise ValueError(f"{name} holds rows of another run than {run_id}")
    changes, counted = [], {}
    for name, rows in current.items():
        by = PARTS[name]
        stored = warehouse.read(name, set(touched(rows, by)), base) if name in base.tables else warehouse.spark.createDataFrame([], rows.schema)
        after, fresh, wins = upsert_flagged(stored, rows, name, by)
        counted[name] = Observation()
        after = after.observe(counted[name], F.count(F.when(fresh, 1)).alias("inserted"), F.count(F.when(wins, 1)).alias("updated"))
        changes.append(Change(name, after.drop("fresh__", "wins__"), by, replace=True, gathered=True))
    changes += [Change(name, rows, F.to_date("collected_at")) for name, rows in observed.items()]
    changes.append(Change("collection_ledger", ledger, F.to_date("collected_at")))
    warehouse.commit(run_id, changes, base)
    return Persisted({name: (o.get["inserted"], o.get["updated"]) for name, o in counted.items()})


def publish_compaction(warehouse: Warehouse, run: str, raw: str = "raw_daily_stats", gold: str = "daily_stats", progress: str = "compaction_ledger") -> bool:
    """Compact arrivals into gold: new rows in place of the touched day partitions, and the progress that says so, in one commit.

    The other days keep their files. A run that dies before the commit leaves gold and progress as they were, and its repetition
    gives the same; a run that was committed is not repeated. False if nothing had arrived.
    """
    base = warehouse.head()
    if warehouse.committed(run):
        return False
    arrived = warehouse.read(raw, at=base).withColumn("arrival_day", F.to_date("collected_at"))
    spark = warehouse.spark
    done = warehouse.read(progress, at=base) if progress in base.tables else spark.createDataFrame([], "source_id string, day date, arrival_day date, rows_done long")
    held = warehouse.read(gold, at=base) if gold in base.tables else spark.createDataFrame([], arrived.drop("arrival_day").schema)
    grown = written(candidates(arrived, done, "source_id", "day"))  # of the number of sources, days and arrival days
    days = set(touched(grown, "day"))
    if not days:
        return False
    if gold in base.tables:
        held = warehouse.read(gold, days, base)
    rows, new = compact_grown(arrived, held, grown)
    warehouse.commit(run, [Change(gold, rows, "day", replace=True, gathered=True), Change(progress, new, "day")], base)
    return True


def expire(warehouse: Warehouse, run: str, today: str, days: int = 90, raw: str = "raw_daily_stats", progress: str = "compaction_ledger") -> list[str]:
    """Drop the arrival days of a raw table that are older than ``days`` and compacted whole, in one commit; those with rows that wait for compaction stay."""
    base = warehouse.head()
    arrived = warehouse.read(raw, at=base).withColumn("arrival_day", F.to_date("collected_at"))
    old = expired(arrived, warehouse.read(progress, at=base), F.to_date(F.lit(today)), days).where("not pending")
    gone = touched(old, "arrival_day")
    if gone:
        warehouse.commit(run, [Change(raw, parts=tuple(gone))], base)
    return sorted(gone)
