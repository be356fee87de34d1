"""All relations over the fixture tables, by name: DataFrames here, their DuckDB twins in sql.py."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.functions.ids import event_id, note_id
from ledgerwright.operators import audit, calendar, collapse, compaction, curation, pricing, privacy, quality, reports
from ledgerwright.plans import fixtures
from ledgerwright.sources import payloads, scratch, tables, warehouse
from ledgerwright.streaming import ingest

TODAY = dt.date(2024, 2, 15)
NOW = "timestamp_ntz'2024-02-15 00:00:00'"


class Ledger:
    """Lazy relations over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def obs(self, name: str) -> DataFrame:
        return fixtures.SPARK[name](self.spark, self.sf_dir)

    @cached_property
    def daily(self) -> DataFrame:
        return collapse.current(self.obs("daily_obs"), "daily_stats")

    @cached_property
    def prices(self) -> DataFrame:
        return collapse.current(self.obs("price_obs"), "price_versions")

    @cached_property
    def sessions(self) -> DataFrame:
        return collapse.current(self.obs("session_obs"), "sessions")

    @cached_property
    def tags(self) -> DataFrame:
        return collapse.current(self.obs("tag_obs"), "tags")

    @cached_property
    def notes(self) -> DataFrame:
        return collapse.current(self.obs("note_obs"), "notes")

    @cached_property
    def ledger(self) -> DataFrame:
        return collapse.current(self.obs("ledger_obs"), "collection_ledger")

    @cached_property
    def drift(self) -> DataFrame:
        return collapse.current(self.obs("drift_obs"), "payload_drift_events")

    @cached_property
    def issues(self) -> DataFrame:
        return collapse.current(self.obs("issue_obs"), "reconciliation_issues")

    @cached_property
    def cost(self) -> DataFrame:
        return pricing.daily_cost(self.daily, self.prices, self.obs("daily_obs"))

    @cached_property
    def usage(self) -> DataFrame:
        return reports.daily_usage(self.cost, self.sessions)

    @cached_property
    def session_models(self) -> DataFrame:
        return reports.report_session_models(self.cost, self.sessions)

    @cached_property
    def session_rows(self) -> DataFrame:
        return reports.report_sessions(self.session_models)

    @cached_property
    def by_day(self) -> DataFrame:
        return reports.report_daily(self.usage)

    @cached_property
    def declared(self) -> DataFrame:
        """Declared totals of each day, wrong on every seventh for input and every fifth for cost."""
        sums = self.obs("daily_obs").groupBy("day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{k}") for k, c in quality.CHECKS.items()], F.sum("reported_cost_usd").alias("total_cost"))
        n = F.dayofyear("day")
        return sums.withColumn("total_input", F.col("total_input") + F.when(n % 7 == 0, 1).otherwise(0)).withColumn("total_cost", F.col("total_cost") + F.when(n % 5 == 0, F.lit(0.25)).otherwise(F.lit(0.0)))

    @cached_property
    def audited(self) -> DataFrame:
        every = audit.all_sources(self.obs("daily_obs"), self.obs("price_obs"), self.obs("session_obs"), self.obs("tag_obs"), self.obs("note_obs"), self.obs("ledger_obs"), self.obs("drift_obs"), self.obs("issue_obs"))
        return audit.audit_sources(every, self.daily, self.obs("ledger_obs"))

    @cached_property
    def raw_gold(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Raw arrivals (all rows), gold (rows collected before 1997, compacted) and progress (all arrivals before 1998, one row short on some)."""
        raw = self.obs("daily_obs").withColumn("arrival_day", F.to_date("collected_at"))
        gold = collapse.current(self.obs("daily_obs").where("collected_at < timestamp_ntz'1997-01-01 00:00:00'"), "daily_stats")
        counts = compaction.arrival_counts(raw, "source_id", "day").where("arrival_day < date'1998-01-01'")
        progress = counts.select("source_id", "day", "arrival_day", (F.col("rows_seen") - F.when(F.dayofmonth("arrival_day") == 3, 1).otherwise(0)).alias("rows_done"))
        return raw, gold, progress


FILTERS = reports.Filters(client="cli-a", exclude_models=("model-4",), tag="building", since="2024-01-10", until="2024-02-20")


def filtered(x: Ledger) -> DataFrame:
    return reports.report_where(x.usage, FILTERS, reports.session_tags(x.sessions, x.tags))


def _calendar(x: Ledger, *names: str) -> DataFrame:
    return calendar.densify(x.by_day, dt.date(2023, 12, 25), dt.date(2024, 3, 20), TODAY, list(names or ("input", "output")))


def _intensity(x: Ledger, bins: int, scale: str) -> DataFrame:
    return calendar.intensity(_calendar(x), "value", bins, scale).select("day", "value", "intensity")


def _merge(x: Ledger) -> DataFrame:
    """Rows collected from 1997 on, merged one a key into the state of all before."""
    obs = x.obs("daily_obs")
    before, after = obs.where("collected_at < timestamp_ntz'1997-01-01 00:00:00'"), obs.where("collected_at >= timestamp_ntz'1997-01-01 00:00:00'")
    return collapse.monotone_merge(collapse.current(after, "daily_stats"), collapse.current(before, "daily_stats"))


def _upsert(x: Ledger, table: str, obs: str, cut: str) -> tuple[DataFrame, DataFrame]:
    rows = x.obs(obs)
    return collapse.upsert(collapse.current(rows.where(f"collected_at < {cut}"), table), rows.where(f"collected_at >= {cut}"), table)


def _requests(x: Ledger) -> DataFrame:
    """Tag requests: the customers' own tags under the next customer's number, some of them of no valid scope."""
    return x.obs("tag_obs").where("op = 'upsert'").selectExpr("source_id", "scope", "client", "case when scope = 'client' and client = 'cli-b' then 'ws-1' else workspace end as workspace", "session_id", "concat(tag, case when session_id like '%5' then '-new' else '' end) as tag")


def _note_requests(x: Ledger) -> DataFrame:
    got = x.obs("note_obs").groupBy("source_id", "client", "session_id").agg(F.min("note").alias("low"))
    return got.select("source_id", "client", "session_id", F.expr("case when session_id like '%3' then concat(low, ' edited') else low end").alias("note"))


def _curated():
    return F.expr("timestamp_ntz'2024-03-01 00:00:00'")


def _failures(x: Ledger) -> DataFrame:
    bad = quality.check_totals(x.obs("daily_obs"), x.declared)
    return bad.select(F.lit("run-1").alias("run_id"), "check_name", "day", F.concat_ws(" ", F.lit("declared"), "declared", F.lit("found"), "found").alias("message"))


def _timed(x: Ledger) -> DataFrame:
    right = F.when(F.col("perf_timed_tokens") > 0, F.lit(1000.0) * F.col("perf_duration_ms") / F.col("perf_timed_tokens")).otherwise(F.lit(0.0))
    return x.obs("daily_obs").withColumn("reported_ms_per_1k", right + F.when(F.col("message_count") == 3, 0.5).otherwise(0.0))


def _json_payloads(x: Ledger) -> DataFrame:
    return x.spark.read.parquet(f"{x.sf_dir}/events.parquet").select(F.col("event_id").alias("payload_id"), F.col("props").alias("json"))


def _daily_payloads(x: Ledger) -> DataFrame:
    """JSON payloads of a source and day, one a session, written from the observations as a scanner would; none grows with the table."""
    e = F.struct(
        "client", F.col("session_id").alias("sessionId"), "model", "provider", F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite"),
        "reasoning", F.col("message_count").alias("messageCount"), F.col("reported_cost_usd").alias("cost"), F.struct(F.col("perf_duration_ms").alias("totalDurationMs"), F.col("perf_timed_tokens").alias("timedTokens")).alias("performance"),
    )
    rows = x.obs("daily_obs").repartition("source_id", "day", "session_id").groupBy("source_id", "day", "session_id").agg(F.sort_array(F.collect_list(F.struct("event_id", e.alias("e")))).alias("s"), F.sum("input_tokens").alias("t"))
    text = F.to_json(F.struct(F.lit("model").alias("groupBy"), F.transform("s", lambda a: a["e"]).alias("entries"), F.col("t").alias("totalInput")))
    return rows.select(F.concat(F.concat_ws("-", "source_id", F.col("day").cast("string"), "session_id"), F.lit(".json")).alias("file"), "day", F.explode(F.array(text)).alias("json"))


def _graph_payloads(x: Ledger) -> DataFrame:
    c = x.obs("daily_obs").groupBy("source_id", F.col("day").cast("string").alias("date")).agg(F.sum("total_tokens").alias("tokens"))
    return c.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("date", F.struct("tokens").alias("totals")))).alias("contributions")).select(F.col("source_id").alias("file"), F.to_json(F.struct(F.struct(F.lit("1.0").alias("version")).alias("meta"), "contributions")).alias("json"))


def _pricing_payloads(x: Ledger) -> DataFrame:
    return x.obs("price_obs").select("event_id", F.col("event_id").alias("file"), "day", F.to_json(F.struct(F.col("model").alias("modelId"), "source", F.struct(F.col("price_input_per_token").alias("inputCostPerToken"), F.col("price_output_per_token").alias("outputCostPerToken")).alias("pricing"))).alias("json"))


def _report_rows(x: Ledger) -> DataFrame:
    return x.obs("session_obs").selectExpr(
        "client", "session_id", "case when session_id like '%7' then workspace else 'ws' end as workspace", "workspace_label", "created_at", "last_active", "message_count", "array(concat('model-', message_count % 5), 'model-0') as models_used",
        "hash(event_id) as pos",
    )


def _report_payloads(x: Ledger) -> DataFrame:
    """A JSON array of sessions for each source, day of creation and session id, so that no array grows with the table."""
    r = F.struct("session_id", "client", "workspace", "workspace_label", F.unix_millis(F.col("created_at").cast("timestamp")).cast("string").alias("created_at"), "message_count", "duration_minutes")
    rows = x.obs("session_obs").groupBy("source_id", F.to_date("created_at").alias("day"), "session_id").agg(F.to_json(F.collect_list(r)).alias("json"))
    return rows.select(F.concat_ws("-", "source_id", F.col("day").cast("string"), "session_id").alias("file"), "day", "json")


def _profile(payloads_: DataFrame) -> DataFrame:
    return quality.profiles(payloads_)


CONTRACT = "path string, types array<string>, required boolean"


def _drift(x: Ledger) -> DataFrame:
    contract = x.spark.createDataFrame([("k", ["str"], True), ("gone", ["int"], True), ("left", ["int"], False)], CONTRACT)
    found = quality.diff_contract(contract, _profile(_json_payloads(x)))
    return found.groupBy("drift_key", "drift_kind", "path", "detail", "fatal").agg(F.count(F.lit(1)).alias("payloads"))


def _nested_payloads(x: Ledger) -> DataFrame:
    """A JSON object an order: its lines, some without rate, some with parts; the lines of some orders are empty or missing."""
    lines = x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.expr("collect_list(named_struct('n', l_linenumber, 'rate', case when l_tax = 0 then null else l_tax end, 'parts', case when l_suppkey % 3 = 0 then array() else array(named_struct('p', l_partkey)) end))").alias("l")
    )
    both = x.spark.read.parquet(f"{x.sf_dir}/orders.parquet").join(lines, "o_orderkey", "left")
    shown = "named_struct('id', o_orderkey, 'tag', case when o_orderkey % 4 = 0 then null else 'x' end, 'extra', case when o_orderkey % 5 = 0 then true end, 'lines', case when o_orderkey % 9 = 1 then null when o_orderkey % 10 = 0 then slice(l, 1, 0) else l end)"
    return both.select(F.col("o_orderkey").alias("payload_id"), F.expr(f"to_json({shown})").alias("json"))


def _nested_contract(x: Ledger) -> DataFrame:
    rows = [("id", ["int"], True), ("tag", ["str"], True), ("lines", ["array"], True), ("lines[].n", ["str"], True), ("lines[].rate", ["float"], True), ("lines[].parts", ["array"], True), ("lines[].parts[].p", ["int"], True), ("note", ["str"], False)]
    return x.spark.createDataFrame(rows, CONTRACT)


def _waived(x: Ledger) -> DataFrame:
    return quality.waived_paths(_nested_contract(x), _profile(_nested_payloads(x)))


def _input_rows(x: Ledger) -> DataFrame:
    counts = payloads.write_inputs({"entries": x.obs("daily_obs"), "sessions": x.obs("session_obs"), "contributions": x.obs("daily_obs").select("source_id", "day").distinct()}, scratch.shared_folder(x.spark))
    return x.spark.createDataFrame(list(counts.items()), "kind string, input_rows long")


def _targets(x: Ledger) -> DataFrame:
    """Statuses of a run that asked for every day in use; some days fail, some don't reconcile."""
    days = x.daily.select("day").distinct()
    failed = lambda n, code: F.when(F.dayofmonth("day") == n, code).alias("failure_code")
    prices = x.daily.select("day", "model", F.when((F.col("model") == "model-2") & (F.dayofmonth("day") == 5), "lookup").alias("failure_code"))
    unsafe = quality.duplicate_keys(x.obs("daily_obs")).where("dayofmonth(day) < 4")
    return quality.target_statuses(days.select("day", failed(9, "timeout")), days.select("day", failed(11, "payload")), x.daily, x.sessions, prices, x.prices, unsafe, F.lit(dt.date(2024, 2, 15)))


def _run(x: Ledger) -> DataFrame:
    run = ("run-9", "src-1", dt.datetime(2024, 2, 15, 8), dt.datetime(2024, 2, 15, 9), "host-1", "linux", "6.1", "x86_64", None, 8, 16000, "manual", "1.0", "0.1", "ok")
    return x.spark.createDataFrame([run], "run_id string, source_id string, started_at timestamp_ntz, finished_at timestamp_ntz, host string, os_name string, os_version string, architecture string, cpu_model string, cpu_count long, memory_bytes long, invoke_method string, payload_ver string, library_ver string, status string")


def _session_issues(x: Ledger) -> DataFrame:
    check = "case check_name when 'check-1' then 'models_report_session_set' when 'check-2' then 'models_report_cost' else check_name end"
    return x.issues.selectExpr("event_id", f"{check} as check_name", "case when check_name = 'check-1' then concat('cli-a/', issue_key) else issue_key end as issue_key", "translate(issue_key, '1', '2') as session_id")


def _nested_hosts(x: Ledger) -> DataFrame:
    rows = x.obs("ledger_obs").selectExpr("event_id", "host", "named_struct('line', concat('ran on ', host, '.lan'), 'more', array(concat(host, '!'), status)) as info", "map('at', concat('/var/', host)) as notes")
    return privacy.share_safe(rows).selectExpr("event_id", "host", "info.line as line", "info.more[0] as first", "notes['at'] as place")


SPLIT = "timestamp_ntz'1998-01-01 00:00:00'"


def _two_runs(x: Ledger) -> tuple[warehouse.Warehouse, list]:
    """Two collection runs in a warehouse, each repeated after the second: (the warehouse, what each of the four calls returned)."""
    w = warehouse.Warehouse(x.spark, scratch.shared_folder(x.spark))
    said = []
    for k, (run, when) in enumerate((("run-1", f"collected_at < {SPLIT}"), ("run-2", f"collected_at >= {SPLIT}")) * 2):
        ledger = x.obs("ledger_obs").where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == k % 2).withColumn("run_id", F.lit(run))
        drift = {"payload_drift_events": x.obs("drift_obs")} if run == "run-1" else {}
        said.append(warehouse.persist_run(w, run, {"daily_stats": x.obs("daily_obs").where(when), "sessions": x.obs("session_obs").where(when)}, drift, ledger))
    return w, said


def _persist_counts(x: Ledger) -> DataFrame:
    rows = [(k, t, *n, p.already_committed) for k, p in enumerate(_two_runs(x)[1], 1) for t, n in p.counts.items()]
    return x.spark.createDataFrame(rows, "step int, table_name string, inserted long, updated long, already_committed boolean")


def _snapshot(x: Ledger) -> tuple[warehouse.Warehouse, str, DataFrame]:
    w, _ = _two_runs(x)
    folder = scratch.shared_folder(x.spark)
    return w, folder, tables.capture(w, folder)


def _tampered(x: Ledger) -> DataFrame:
    """What verification says of a snapshot of which a row of one table has gone and another has changed its text."""
    _, folder, _ = _snapshot(x)
    other = f"{folder}-other"
    for name in ("daily_stats", "sessions", "collection_ledger"):
        rows = x.spark.read.parquet(f"{folder}/{name}")
        if name == "daily_stats":
            rows = rows.join(rows.agg(F.max("event_id").alias("event_id")), "event_id", "left_anti").select(*rows.columns)
        elif name == "sessions":
            rows = rows.withColumn("workspace", F.upper("workspace"))
        rows.write.parquet(f"{other}/{name}")
    x.spark.read.parquet(f"{folder}/_manifest").coalesce(1).write.parquet(f"{other}/_manifest")
    return tables.verify_snapshot(x.spark, other, ["collection_ledger", "daily_stats", "payload_drift_events", "sessions"])


def _restored(x: Ledger) -> DataFrame:
    _, folder, _ = _snapshot(x)
    w = warehouse.Warehouse(x.spark, scratch.shared_folder(x.spark))
    assert tables.restore_snapshot(w, folder, "snapshot-1", warehouse.PARTS)
    assert not tables.restore_snapshot(w, folder, "snapshot-1", warehouse.PARTS)
    return w.read("daily_stats")


def _monthly(x: Ledger) -> DataFrame:
    """The daily observations, arriving on the first of each month: arrival days in a number that a raw table keeps."""
    return x.obs("daily_obs").withColumn("collected_at", F.expr("cast(date_trunc('month', collected_at) as timestamp_ntz)"))


def _arrivals(x: Ledger, *steps: str) -> warehouse.Warehouse:
    """Raw arrivals in a warehouse: conditions add the rows that meet them, anything else publishes a compaction of that name."""
    w = warehouse.Warehouse(x.spark, scratch.shared_folder(x.spark))
    for step in steps:
        if step.startswith("collected_at"):
            w.commit(step, [warehouse.Change("raw_daily_stats", _monthly(x).where(step), F.to_date("collected_at"))])
        else:
            warehouse.publish_compaction(w, step)
    return w


BEFORE, AFTER = f"collected_at < {SPLIT}", f"collected_at >= {SPLIT}"


def _left_after_expiry(x: Ledger) -> DataFrame:
    w = _arrivals(x, BEFORE, "compaction-1", AFTER)
    warehouse.expire(w, "expiry-1", "1999-06-01")
    return w.read("raw_daily_stats").select(F.to_date("collected_at").alias("arrival_day")).distinct()


def _as_of_commit(x: Ledger) -> DataFrame:
    """Current facts as of a commit, after which older facts have arrived."""
    w = _arrivals(x, "collected_at >= timestamp_ntz'1997-01-01 00:00:00'")
    pin = w.head().at
    w.commit("late", [warehouse.Change("raw_daily_stats", _monthly(x).where("collected_at < timestamp_ntz'1997-01-01 00:00:00'"), F.to_date("collected_at"))])
    return collapse.current(w.read("raw_daily_stats", at=w.as_of(pin)), "daily_stats")


def _landed(x: Ledger, *conditions: str) -> tuple[str, str]:
    """(landing, beside): a folder of JSON lines, four files for each condition, in their order, and the name of another folder."""
    landing = scratch.shared_folder(x.spark)
    for condition in conditions:
        x.obs("daily_obs").where(condition).repartition(4, "source_id", "day", "session_id").write.mode("append").json(landing)
    return landing, scratch.shared_folder(x.spark)


def _ingested(x: Ledger) -> DataFrame:
    """Files as the observations lie, compressed, so that their number and not their size grows with the table; a third of them a batch."""
    landing, beside = scratch.shared_folder(x.spark), scratch.shared_folder(x.spark)
    for condition in (BEFORE, "message_count = 2", AFTER):
        x.obs("daily_obs").where(condition).write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(landing)
    fields = x.obs("daily_obs").schema
    files = -(-len(x.spark.read.text(landing).inputFiles()) // 3)
    for _ in range(2):
        ingest.ingest(x.spark, landing, f"{beside}/bronze", f"{beside}/check", "daily_obs", fields, buckets=16, files=files)
    return warehouse.Warehouse(x.spark, f"{beside}/bronze").read("daily_obs")


def _streamed(x: Ledger) -> DataFrame:
    landing, beside = _landed(x, "collected_at < timestamp_ntz'1996-01-01 00:00:00'", f"collected_at >= timestamp_ntz'1996-01-01 00:00:00' and {BEFORE}", AFTER)
    fields = x.obs("daily_obs").schema
    ingest.fold_stream(x.spark, landing, f"{beside}/out", f"{beside}/check", fields, files=4)
    return ingest.folded(x.spark, f"{beside}/out", fields)


def _appended(x: Ledger) -> DataFrame:
    """Prices appended by day of arrival and scanned back with the table's own schema."""
    folder = scratch.shared_folder(x.spark)
    rows = x.obs("price_obs").withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    tables.append(rows, folder, "price_versions")
    return tables.scan(x.spark, folder, "price_versions").withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz"))


def _exported(x: Ledger) -> DataFrame:
    folder = scratch.shared_folder(x.spark)
    tables.export(x.prices, folder, "json", raw=True)
    return x.spark.read.schema(x.prices.schema).json(folder)


def _rejects(x: Ledger) -> DataFrame:
    rows = x.obs("daily_obs").selectExpr("event_id", "client", "case when message_count = 2 then '' else session_id end as session_id", "case when message_count = 5 then -input_tokens - 1 else input_tokens end as input_tokens", "message_count / 6D as perf_token_coverage")
    got = payloads.check_domains(rows, ("session_id",), (), ("input_tokens",), ("perf_token_coverage",))
    return got.where(F.size("reject_reason") > 0).select("event_id", F.array_join("reject_reason", "; ").alias("reject_reason"))


def _documents(x: Ledger) -> DataFrame:
    return x.spark.read.parquet(f"{x.sf_dir}/documents.parquet")


def _secret_lines(x: Ledger) -> DataFrame:
    """Log lines with a name and value, a path and an address, of nine kinds of names, six of paths and six of addresses."""
    return x.spark.read.parquet(f"{x.sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber",
        "concat('run ', l_orderkey, ' ', element_at(array('API_KEY', 'x-auth-token', 'PGPASSWORD', 'MONKEY', 'KEYBOARD', 'tokenizer', 'my_secret_2', 'AUTH_METHOD', 'mode'), cast(l_partkey % 9 as int) + 1), element_at(array('=', ': '), cast(l_linenumber % 2 as int) + 1), 'v', l_suppkey, ' end')"
        " as line",
        "concat('at ', element_at(array('/data/a b', '~/x', 'C:\\\\u\\\\f.txt', '3/4', 'no', '(/etc/x)'), cast(l_partkey % 6 as int) + 1), ', line ', l_suppkey) as place",
        "concat('from ', element_at(array('ab', 'abc', 'abcd', 'abcde', 'a.b+c', 'a'), cast(l_partkey % 6 as int) + 1), element_at(array('@gmail.com', '@corp.example', '@sub.corp.example now'), cast(l_suppkey % 3 as int) + 1)) as mail",
    )


def _versions(x: Ledger) -> DataFrame:
    return x.spark.read.parquet(f"{x.sf_dir}/events.parquet").selectExpr(
        "event_id as version_id", "element_at(array('scheduled','manual','weekly','copy'), cast(event_id % 4 as int) + 1) as role", "case when event_id % 5 = 0 then null else date_format(ts, 'yyyy-MM-dd') end as weekly_slot",
        "event_id % 7 = 0 as pinned", "case when event_id % 11 = 0 then 'odd' else 'complete' end as state", "ts as created_at",
    )


def _coverage(x: Ledger) -> DataFrame:
    used = x.daily.select("day", "source_id", "model")
    return quality.coverage(used, x.prices, ["source_id", "model"], quality.duplicate_keys(x.obs("daily_obs")).where("duplicates > 800"))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns) if columns else df


DAILY = ("event_id", "source_id", "day", "client", "session_id", "model", *reports.TOKENS)
COST = ("source_id", "day", "client", "session_id", "model", "rate_day", "cost_usd", "cost_basis", "ms_per_1k_tokens")

QUERIES = {
    "A1_daily_payload_scan": lambda x: payloads.parse_daily(_daily_payloads(x))[0].select("file", "day", "client", "session_id", "model", "input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning", "total_tokens", "message_count", "perf_duration_ms"),
    "A2_report_scan": lambda x: payloads.parse_report(_report_payloads(x)).select("file", "client", "session_id", "workspace", "message_count", "duration_minutes", payloads.to_time(F.col("created_at")).cast("timestamp_ntz").alias("created_at")),
    "A3_contribution_days": lambda x: payloads.parse_graph(_graph_payloads(x))[0],
    "A4_rate_card_scan": lambda x: payloads.parse_pricing(_pricing_payloads(x)).select("file", "model", "source", "price_input_per_token", "price_output_per_token"),
    "A5_typed_scan": _appended,
    "A7_upsert_sessions": lambda x: _upsert(x, "sessions", "session_obs", "timestamp_ntz'1998-01-01 00:00:00'")[0].select("event_id", "source_id", "client", "session_id", "workspace", "first_seen_at", "last_seen_at"),
    "A7_upsert_daily": lambda x: _plain(_upsert(x, "daily_stats", "daily_obs", "timestamp_ntz'1998-01-01 00:00:00'")[0], *DAILY),
    "A7_upsert_counts": lambda x: _upsert(x, "daily_stats", "daily_obs", "timestamp_ntz'1998-01-01 00:00:00'")[1],
    "A7_persisted_counts": _persist_counts,
    "A7_persisted_daily": lambda x: _plain(_two_runs(x)[0].read("daily_stats"), *DAILY),
    "A6_appended_drift": lambda x: _two_runs(x)[0].read("payload_drift_events"),
    "A8_exported_prices": _exported,
    "A9_snapshot_rows": lambda x: _snapshot(x)[2].select("table", "rows"),
    "A10_tampered_snapshot": _tampered,
    "A11_restored_daily": lambda x: _plain(_restored(x), *DAILY),
    "A12_retention_plan": lambda x: compaction.retention_plan(_versions(x)).select("version_id", "keep", "reason"),
    "B2_total_tokens": lambda x: x.obs("daily_obs").select("event_id", collapse.token_sum().cast("long").alias("total_tokens")),
    "B4_session_label": lambda x: x.obs("session_obs").select("event_id", payloads.session_label(F.col("workspace_label"), F.when(F.col("message_count") % 9 != 0, F.col("created_at")), F.col("session_id")).alias("label")),
    "B6_policy_rules": lambda x: payloads.apply_rules(x.obs("price_obs"), [{"when": {"model": "model-3"}, "skip_if": {"source": "Custom"}, "replace": {r: 0.0 for r in pricing.RATES}}]).select("event_id", *pricing.RATES),
    "B7_run_outcome": lambda x: quality.run_outcome(x.obs("ledger_obs").selectExpr("run_id", "status = 'failed' and expected_count > 3 as fatal_drift", "status = 'payload_drift' as drift", "status in ('partial', 'failed') as incomplete", "domain = 'pricing' and status = 'partial' as issue")),
    "B8_provisional_days": lambda x: quality.provisional(x.obs("ledger_obs")).select("event_id", "status"),
    "B9_domain_rejects": _rejects,
    "B10_batch_checks": lambda x: payloads.check_batch(x.obs("daily_obs"), ["source_id", "day", "client", "session_id", "model"]),
    "B11_merge_sessions": lambda x: payloads.merge_sessions(_report_rows(x))[0].select("client", "session_id", "created_at", "last_active", F.array_join("models_used", ",").alias("models")),
    "B11_session_conflicts": lambda x: payloads.merge_sessions(_report_rows(x))[1],
    "B12_event_ids": lambda x: x.obs("ledger_obs").select("event_id", event_id("source_id", "run_id", F.col("day"), "domain").alias("made")),
    "B13_stamped_ledger": lambda x: quality.stamp_ledger(_targets(x), _run(x)).select("run_id", "source_id", "day", "domain", "status", "expected_count", "succeeded_count", "failure_code", "host", "os_version", "collected_at"),
    "B13_stamped_issues": lambda x: quality.stamp_diagnostics(x.issues.where("issue_key like '%3'").select("check_name", "issue_key", "message"), x.issues.where("issue_key like '%4'").select("check_name", "issue_key", "message", "created_at", "observation_count"), _run(x)),
    "B14_input_rows": _input_rows,
    "C1_current_sessions": lambda x: x.sessions,
    "C2_current_daily_stats": lambda x: _plain(x.daily, *DAILY),
    "C3_current_price_versions": lambda x: x.prices,
    "C4_current_tags": lambda x: x.tags,
    "C5_current_notes": lambda x: x.notes,
    "C6_current_collection_ledger": lambda x: x.ledger,
    "C7_current_drift": lambda x: x.drift,
    "C8_current_issues": lambda x: x.issues,
    "C9_monotone_merge": lambda x: _plain(_merge(x), *DAILY),
    "C11_collection_runs": lambda x: collapse.collection_runs(x.ledger),
    "C12_collection_status": lambda x: collapse.collection_status(x.obs("ledger_obs")),
    "C13_open_drift": lambda x: collapse.open_diagnostics(x.drift, F.expr("timestamp_ntz'2024-04-20 00:00:00'")),
    "C13_open_issues": lambda x: collapse.open_diagnostics(x.issues, F.expr("timestamp_ntz'2024-04-20 00:00:00'")),
    "C14_raw_and_gold": lambda x: _plain(collapse.raw_and_gold(x.obs("daily_obs").where("collected_at >= timestamp_ntz'1996-06-01 00:00:00'"), x.raw_gold[1]), *DAILY),
    "C15_replayed_drift": lambda x: collapse.replayed_once(x.obs("drift_obs")),
    "D1_daily_cost": lambda x: _plain(x.cost, *COST),
    "E1_session_model_stats": lambda x: reports.session_model_stats(x.cost),
    "E2_report_daily": lambda x: x.by_day,
    "E2_report_daily_filtered": lambda x: reports.report_daily(filtered(x)),
    "E3_report_models": lambda x: reports.report_models(x.usage),
    "E4_report_sessions": lambda x: x.session_rows,
    "E5_report_session_models": lambda x: x.session_models,
    "E6_report_summary": lambda x: reports.summary(x.cost),
    "E7_report_summary_models": lambda x: reports.summary_models(x.cost),
    "E13_calendar": lambda x: _calendar(x).select("day", "status", "value", "facts", "total_tokens", "cost_usd"),
    "E13_calendar_cost": lambda x: _calendar(x, "cost").select("day", "status", "value"),
    "E13_calendar_rate": lambda x: _calendar(x, "cost_per_million").select("day", "status", "value"),
    "E13_calendar_time": lambda x: _calendar(x, "session_time").select("day", "status", "value"),
    "E15_intensity_linear": lambda x: _intensity(x, 7, "linear"),
    "E15_intensity_log": lambda x: _intensity(x, 10, "log"),
    "E16_chart_series": lambda x: calendar.chart_series(x.by_day, calendar.metric(["cost"]), dt.date(2024, 3, 5), 31),
    "E17_filtered_summary": lambda x: reports.filtered_summary(x.session_models.where("client = 'cli-b'"))[0],
    "E17_filtered_models": lambda x: reports.filtered_summary(x.session_models.where("client = 'cli-b'"))[1],
    "F2_report_daily_usage": lambda x: _plain(x.usage, *COST, "workspace", "workspace_label"),
    "F3_session_tags": lambda x: reports.session_tags(x.sessions, x.tags),
    "F4_tagged_facts": lambda x: _plain(filtered(x), *COST),
    "F5_tagged_sessions": lambda x: reports.tagged_sessions(x.sessions, x.tags),
    "F5_noted_sessions": lambda x: reports.noted_sessions(x.sessions, x.notes.withColumn("note_id", note_id("source_id", "client", "session_id"))),
    "F6_missing_sessions": lambda x: reports.missing_sessions(x.cost, x.sessions),
    "F7_unresolved_runs": lambda x: audit.unresolved_runs(x.ledger),
    "G1_all_sources": lambda x: x.audited.select("source_id"),
    "G2_preflight": lambda x: audit.preflight(collapse.collection_status(x.obs("ledger_obs")), x.daily, x.prices, x.issues, x.drift, x.sessions, x.obs("daily_obs")),
    "G3_identity_sets": lambda x: audit.identity_sets(x.daily.select("source_id", "model").distinct(), x.prices.select("source_id", "model").distinct()),
    "G4_custom_models": lambda x: audit.custom_price_models(x.prices),
    "H1_session_sorts": lambda x: reports.top_by_each_sort(x.session_rows),
    "H2_newest_days": lambda x: reports.report_daily(x.usage, 16),
    "H4_note_page": lambda x: reports.note_page(x.notes.withColumn("note_id", note_id("source_id", "client", "session_id")), page=2).select("note_id", "source_id", "client", "session_id", "updated_at"),
    "I1_filtered_models": lambda x: reports.report_models(reports.report_where(x.usage, reports.Filters(source="src-1", workspace="ws-7"))),
    "I2_relation_query": lambda x: reports.relation_query({"current_price_versions": x.prices}, "current_price_versions", {"source_id": "src-2", "source": "Custom"}, 10_000),
    "I3_day_bounds": lambda x: reports.report_daily(reports.report_where(x.usage, reports.Filters(since="2024-02-01", until="2024-02-29"))),
    "K1_json_profile": lambda x: quality.json_profile(_profile(_json_payloads(x)), root=True).select("path", F.array_join("types", ",").alias("types"), "present", "payloads"),
    "K1_nested_profile": lambda x: quality.json_profile(_profile(_nested_payloads(x))).select("path", F.array_join("types", ",").alias("types"), "present", "payloads"),
    "K2_contract": lambda x: quality.build_contract(quality.json_profile(_profile(_nested_payloads(x))), ("tag",)).select("path", F.array_join("types", ",").alias("types"), "required"),
    "K3_contract_diff": _drift,
    "K3_nested_diff": lambda x: quality.diff_contract(_nested_contract(x), _profile(_nested_payloads(x))),
    "K4_empty_array_waivers": _waived,
    "K5_drift_roll_up": lambda x: quality.roll_up_drift(x.obs("drift_obs").selectExpr("'run-1' as run_id", "domain", "payload_ver", "drift_key", "detail", "struct(collected_at, event_id) as pos", "resolved as fatal")),
    "K6_check_totals": lambda x: quality.check_totals(x.obs("daily_obs"), x.declared),
    "K7_check_cost": lambda x: quality.check_cost(x.obs("daily_obs"), x.declared).select("day", F.col("declared").cast("double").alias("declared"), F.col("found").cast("double").alias("found")),
    "K8_duplicate_keys": lambda x: quality.duplicate_keys(x.obs("daily_obs")),
    "K8_withheld": lambda x: quality.withhold(x.obs("daily_obs"), quality.duplicate_keys(x.obs("daily_obs")).where("dayofmonth(day) < 20")).select("event_id"),
    "K9_check_rates": lambda x: quality.check_rates(_timed(x)).select("event_id", "reported_ms_per_1k"),
    "K10_issues": lambda x: quality.issues_of(_failures(x)).select("run_id", "check_name", "message", F.array_join(F.transform("days", lambda v: v.cast("string")), ",").alias("days")),
    "K11_resolved_issues": lambda x: quality.resolve_issues(x.issues.where("not resolved"), x.issues.where("issue_key = 'key-3'"), x.issues.select("source_id", F.lit(True).alias("fetched"), (F.col("source_id") == "src-1").alias("failed"), (F.col("source_id") == "src-2").alias("pending")), ("check-1", "check-2")).select("event_id"),
    "K12_resolved_drift": lambda x: quality.resolve_drift(x.drift.where("not resolved"), x.drift.where("drift_key like '%3'"), x.drift.select("domain", "payload_ver", (F.col("domain") == "models").alias("complete"))).select("event_id"),
    "K13_price_coverage": _coverage,
    "K13_target_statuses": _targets,
    "K14_day_plan": lambda x: audit.day_plan(x.daily.select("source_id", "day").distinct(), collapse.collection_status(x.obs("ledger_obs")), F.lit(TODAY)),
    "K14_refresh_plan": lambda x: audit.day_plan(x.daily.select("source_id", "day"), collapse.collection_status(x.obs("ledger_obs")), F.lit(TODAY), refresh=(None, dt.date(2024, 2, 10))),
    "K15_price_gaps": lambda x: audit.price_gaps(x.daily, x.prices, F.lit(TODAY)),
    "K15_session_gaps": lambda x: audit.session_gaps(x.daily, x.sessions.withColumn("created_at", F.expr("case when session_id like '%5' then null else created_at end"))),
    "K15_report_days": lambda x: audit.report_days(x.daily, x.sessions, collapse.collection_status(x.obs("ledger_obs"))),
    "K15_full_report": lambda x: audit.full_report(audit.session_gaps(x.daily, x.sessions).where("source_id = 'src-2'"), collapse.collection_status(x.obs("ledger_obs")).withColumn("domain", F.expr("case when source_id <> 'src-3' and domain = 'report' then 'report_inventory' else domain end")), x.audited.select("source_id")),
    "L1_recent_runs": lambda x: audit.recent_runs(x.ledger),
    "L2_audit_sources": lambda x: x.audited,
    "L3_same_host": lambda x: audit.same_host_sources(x.audited, F.expr("timestamp_ntz'2024-04-01 00:00:00'")),
    "L4_unresolved_targets": lambda x: audit.unresolved_targets(x.obs("ledger_obs")),
    "L5_ingest_issues": lambda x: audit.ingest_issues(x.ledger),
    "L6_newest_open_drift": lambda x: collapse.newest_open(x.drift, F.expr("timestamp_ntz'2024-04-20 00:00:00'")),
    "L7_newest_open_issues": lambda x: collapse.newest_open(x.issues, F.expr("timestamp_ntz'2024-04-20 00:00:00'")),
    "L8_backlog": lambda x: compaction.backlog(x.raw_gold[0], x.raw_gold[2], F.lit(dt.date(1998, 3, 1))),
    "M1_candidates": lambda x: compaction.candidates(x.raw_gold[0], x.raw_gold[2], "source_id", "day"),
    "M2_compact_daily": lambda x: _plain(compaction.compact_daily(*x.raw_gold, gold_dealt=True)[0], *DAILY),
    "M2_published_daily": lambda x: _plain(_arrivals(x, BEFORE, "compaction-1", AFTER, "compaction-2", "compaction-3").read("daily_stats"), *DAILY),
    "M4_published_progress": lambda x: _arrivals(x, BEFORE, "compaction-1", AFTER, "compaction-2").read("compaction_ledger"),
    "M5_left_after_expiry": _left_after_expiry,
    "M6_as_of_commit": lambda x: _plain(_as_of_commit(x), *DAILY),
    "M3_compact_tags": lambda x: compaction.compact_curation(x.obs("tag_obs").where("collected_at >= timestamp_ntz'2024-02-08 00:00:00'"), x.obs("tag_obs").where("collected_at < timestamp_ntz'2024-02-08 00:00:00'"), "tags", x.obs("tag_obs").where("op = 'delete'")),
    "M4_progress": lambda x: compaction.compact_daily(*x.raw_gold)[2],
    "M5_expired": lambda x: compaction.expired(x.raw_gold[0], x.raw_gold[2], F.lit(dt.date(1998, 6, 1))),
    "M6_pinned": lambda x: _plain(collapse.current(compaction.pinned(x.obs("daily_obs"), F.expr("timestamp_ntz'1997-07-01 00:00:00'")), "daily_stats"), *DAILY),
    "N1_pseudonyms": lambda x: privacy.pseudonyms(x.sessions.select("workspace"), "workspace", "workspace"),
    "N1_anonymised_tags": lambda x: privacy.pseudonymise(x.tags).select("event_id", "scope", "workspace", "session_id", "tag"),
    "N1_session_issues": lambda x: privacy.pseudonymise(_session_issues(x)),
    "N5_nested_hosts": _nested_hosts,
    "N2_notes_redacted": lambda x: privacy.pseudonymise(x.notes, {}).select("event_id", "note"),
    "N3_credentials": lambda x: _secret_lines(x).select("l_orderkey", "l_linenumber", privacy.redact_credentials(F.col("line")).alias("line")),
    "N4_paths": lambda x: _secret_lines(x).select("l_orderkey", "l_linenumber", privacy.redact_paths(F.col("place")).alias("place")),
    "N6_addresses": lambda x: _secret_lines(x).select("l_orderkey", "l_linenumber", privacy.mask_addresses(F.col("mail")).alias("mail")),
    "N3_redacted_documents": lambda x: _documents(x).select("doc_id", privacy.sanitize_text(F.col("text")).alias("text")),
    "N7_visible_urls": lambda x: x.spark.read.parquet(f"{x.sf_dir}/pages.parquet").select("page_id", privacy.visible(F.concat("url", F.lit("\t\n"), F.element_at(F.array(F.lit("\u200b"), F.lit("\U000e0001"), F.lit("x")), (F.col("page_id") % 3 + 1).cast("int")))).alias("shown")),
    "P1_ingested_daily": lambda x: _plain(_ingested(x), *DAILY),
    "P2_streamed_daily": lambda x: _plain(_streamed(x), *DAILY),
    "O1_add_tags": lambda x: curation.add_tags(_requests(x), x.tags, _curated(), "r1").select("scope", "client", "workspace", "session_id", "tag", "op", "updated_at"),
    "O2_rename_tags": lambda x: curation.rename_tags(x.tags.where("scope = 'session'").withColumn("new_tag", F.concat("tag", F.lit("-2"))), x.tags, _curated(), "r2").select("scope", "client", "session_id", "tag", "op", "created_at"),
    "O3_set_notes": lambda x: curation.set_notes(_note_requests(x), x.notes, _curated(), "r3").select("source_id", "client", "session_id", "note", "op", "created_at", "updated_at"),
    "O4_remove_notes": lambda x: curation.remove(x.notes.where("session_id like '%1'"), x.notes, curation.NOTE, _curated(), "r4").select("source_id", "client", "session_id", "op", "created_at"),
    "O5_note_ids": lambda x: x.notes.select("session_id", note_id("source_id", "client", "session_id").alias("note_id")),
    "O6_scope_rejects": lambda x: curation.split_by_scope(_requests(x))[1].select("scope", "client", "workspace", "session_id", "tag"),
}


def queries() -> dict:
    def bind(build):
        return lambda spark, sf_dir: build(Ledger(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
