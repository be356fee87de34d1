"""Observation tables made of the driver's tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


CLIENT = "element_at(array('cli-a','cli-b','cli-c'), cast({k} % 3 as int) + 1)"


def daily_obs(spark: SparkSession, d: str) -> DataFrame:
    z = "(case when l_partkey % 50 in (0, 4) then 0 else 1 end)"
    q, p = "cast(floor(l_quantity) as bigint)", "cast(floor(l_extendedprice) as bigint)"
    rows = _t(spark, d, "lineitem").selectExpr(
        "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyy-MM-dd'))) as event_id",
        "concat('src-', l_orderkey % 4) as source_id",
        "date_add(date'2024-01-01', cast(l_orderkey % 60 + l_linenumber % 2 as int)) as day",
        f"{CLIENT.format(k='l_orderkey')} as client",
        "concat('ses-', l_orderkey) as session_id",
        "concat('model-', l_partkey % 5) as model",
        "concat('prov-', l_suppkey % 3) as provider",
        f"{z} * {q} * 100 as input_tokens",
        f"{z} * ({p} % 5000) as output_tokens",
        f"case when l_linenumber = 7 then null else {z} * {q} * 700 end as cache_read",
        f"case when l_suppkey % 3 = 0 then {z} * l_suppkey else 0 end as cache_write",
        f"{z} * ({p} % 97) as reasoning",
        "cast(l_linenumber as bigint) as message_count",
        f"case when l_discount = 0 then null else {p} / 1024D end as reported_cost_usd",
        f"case when l_linestatus = 'O' then {p} end as perf_duration_ms",
        f"case when l_tax = 0 then 0 else {q} * 50 end as perf_timed_tokens",
        "l_shipdate as collected_at",
    )
    total = "input_tokens + output_tokens + coalesce(cache_read, 0) + cache_write + reasoning"
    return rows.withColumn("total_tokens", F.expr(total))


def price_obs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").selectExpr(
        "md5(concat('p', p_partkey)) as event_id",
        "concat('src-', p_partkey % 4) as source_id",
        "concat('model-', cast(floor(p_partkey / 4) as bigint) % 4) as model",
        "date_add(date'2024-01-05', cast(p_partkey % 50 as int)) as day",
        "case when p_brand = 'Brand#1' then 'Custom' else 'catalog' end as source",
        "p_size / 1048576D as price_input_per_token",
        "case when p_size % 5 = 0 then null else p_size / 524288D end as price_output_per_token",
        "case when p_size % 3 = 0 then null else p_size / 8388608D end as price_cache_read_per_token",
        "p_size / 2097152D as price_cache_write_per_token",
        "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(p_size) as collected_at",
    )


def session_obs(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").where("o_orderkey % 13 <> 0").withColumn("rep", F.explode(F.expr("case when o_orderkey % 4 = 0 then array(0, 1) else array(0) end")))
    return rows.selectExpr(
        "md5(concat_ws('|', 's', o_orderkey, rep)) as event_id",
        "concat('src-', o_orderkey % 4) as source_id",
        f"{CLIENT.format(k='o_orderkey')} as client",
        "concat('ses-', o_orderkey) as session_id",
        "concat('ws-', (o_custkey + rep) % 50) as workspace",
        "case when o_custkey % 5 = 0 then null else concat('Team ', o_custkey % 50) end as workspace_label",
        "o_orderdate as created_at",
        "case when o_orderkey % 11 = 0 then null else timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(cast((o_orderkey * 7) % 64 as int)) end as last_active",
        "o_orderkey % 600 as duration_minutes",
        "o_orderkey % 90 as message_count",
        "floor(o_totalprice) / 1024D as reported_cost_usd",
        "o_orderdate + make_dt_interval(rep * 3) as first_seen_at",
        "o_orderdate + make_dt_interval(rep * 3, 1) as last_seen_at",
        "o_orderdate + make_dt_interval(rep * 3) as collected_at",
    )


def tag_obs(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").withColumn("rep", F.explode(F.expr("case when c_custkey % 7 = 0 or c_custkey % 5 = 0 then array(0, 1) else array(0) end")))
    scope = "element_at(array('client','workspace','session'), cast(c_custkey % 3 as int) + 1)"
    return rows.selectExpr(
        "md5(concat_ws('|', 't', c_custkey, rep)) as event_id",
        f"{scope} as scope",
        "concat('src-', c_custkey % 4) as source_id",
        f"case when c_custkey % 3 = 1 then '' else {CLIENT.format(k='(c_custkey div 3)')} end as client",
        "case when c_custkey % 3 = 1 then concat('ws-', c_custkey % 50) else '' end as workspace",
        "case when c_custkey % 3 = 2 then concat('ses-', c_custkey) else '' end as session_id",
        "lower(c_mktsegment) as tag",
        "case when rep = 1 and c_custkey % 7 = 0 then 'delete' else 'upsert' end as op",
        "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(cast(c_custkey % 20 as int) + rep) as collected_at",
    ).withColumn("created_at", F.expr("timestamp_ntz'2024-02-01 00:00:00'")).withColumn("updated_at", F.col("collected_at"))


def note_obs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").where("role in ('user', 'system')").selectExpr(
        "md5(concat_ws('|', 'n', conv_id, turn, role, text)) as event_id",
        "concat('src-', conv_id % 4) as source_id",
        f"{CLIENT.format(k='conv_id')} as client",
        "concat('ses-', conv_id) as session_id",
        "text as note",
        "case when role = 'system' and conv_id % 2 = 0 then 'delete' else 'upsert' end as op",
        "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, cast(turn as int)) as collected_at",
        "timestamp_ntz'2024-02-01 00:00:00' as created_at",
        "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, cast(turn as int)) as updated_at",
    )


DOMAIN = {"view": "models", "click": "report", "error": "pricing", "purchase": "collection", "signup": "session_metadata"}


def ledger_obs(spark: SparkSession, d: str) -> DataFrame:
    domain = "element_at(map('view','models','click','report','error','pricing','purchase','collection','signup','session_metadata'), event_type)"
    rows = _t(spark, d, "events").selectExpr(
        "concat('src-', user_id % 4) as source_id", "concat('run-', date_format(ts, 'yyyyMMddHH')) as run_id", "date_sub(to_date(ts), cast(user_id % 3 as int)) as day",
        f"{domain} as domain", "date_trunc('hour', ts) as hour", "event_id as ev", "user_id",
    )
    got = rows.groupBy("source_id", "run_id", "day", "domain", "hour").agg(F.count(F.lit(1)).alias("expected_count"), F.max("ev").alias("ev"), F.min("user_id").alias("u"))
    return got.selectExpr(
        "md5(concat_ws('|', 'l', source_id, run_id, date_format(day, 'yyyy-MM-dd'), domain)) as event_id",
        "source_id", "run_id", "day", "domain",
        "case when domain = 'collection' then element_at(array('ok','failed','partial','payload_drift'), cast(ev % 4 as int) + 1) else element_at(array('complete','partial','failed','provisional'), cast(ev % 4 as int) + 1) end as status",
        "expected_count",
        "cast(case when ev % 4 = 0 then expected_count else floor(expected_count / 2) end as bigint) as succeeded_count",
        "concat('host-', u % 6) as host", "case when u % 2 = 0 then 'linux' else 'darwin' end as os_name", "'x86_64' as architecture", "cast(4 + u % 3 as bigint) as cpu_count", "cast(16000 as bigint) as memory_bytes",
        "case when u % 5 = 0 then null else 'cpu-x' end as cpu_model", "case when u % 7 = 0 then null else concat('6.', u % 3) end as os_version",
        "hour as started_at", "case when ev % 9 = 0 then null else hour + make_dt_interval(0, 0, 10) end as finished_at", "hour as collected_at",
    )


def _diagnostic(spark: SparkSession, d: str, kind: str, *columns: str) -> DataFrame:
    rows = _t(spark, d, "events").where(F.col("event_type") == kind).withColumn("rep", F.explode(F.expr("case when event_id % 6 = 0 then array(0, 1) when event_id % 10 = 7 then array(0, 2) else array(0) end")))
    return rows.selectExpr(
        "md5(concat_ws('|', if(rep = 2, 'e', 'd'), event_id)) as event_id", "concat('src-', user_id % 4) as source_id", *columns,
        "ts as created_at", "ts + make_dt_interval(if(rep = 1, 1, 0)) as collected_at", "event_id % 10 < 3 or rep = 2 as resolved", "cast(1 + event_id % 3 as bigint) as observation_count",
    )


def drift_obs(spark: SparkSession, d: str) -> DataFrame:
    return _diagnostic(spark, d, "error", "case when user_id % 2 = 0 then 'models' else 'report' end as domain", "'1.0' as payload_ver", "concat('unknown_field:p', user_id % 20) as drift_key", "props as detail")


def issue_obs(spark: SparkSession, d: str) -> DataFrame:
    return _diagnostic(spark, d, "signup", "concat('check-', user_id % 5) as check_name", "concat('key-', user_id % 20) as issue_key", "case when event_id % 3 = 0 then null else props end as message")


SPARK = {f.__name__: f for f in (daily_obs, price_obs, session_obs, tag_obs, note_obs, ledger_obs, drift_obs, issue_obs)}

_CLI = "(['cli-a','cli-b','cli-c'])[CAST({k} % 3 AS INT) + 1]"
_Z = "(CASE WHEN l_partkey % 50 IN (0, 4) THEN 0 ELSE 1 END)"
_Q, _P = "CAST(floor(l_quantity) AS BIGINT)", "CAST(floor(l_extendedprice) AS BIGINT)"
SQL = {
    "daily_obs": f"""
  SELECT *, CAST(input_tokens + output_tokens + coalesce(cache_read, 0) + cache_write + reasoning AS BIGINT) AS total_tokens FROM (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))) AS event_id,
    concat('src-', l_orderkey % 4) AS source_id, date '2024-01-01' + CAST(l_orderkey % 60 + l_linenumber % 2 AS INT) AS day,
    {_CLI.format(k="l_orderkey")} AS client, concat('ses-', l_orderkey) AS session_id, concat('model-', l_partkey % 5) AS model, concat('prov-', l_suppkey % 3) AS provider,
    CAST({_Z} * {_Q} * 100 AS BIGINT) AS input_tokens, CAST({_Z} * ({_P} % 5000) AS BIGINT) AS output_tokens,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST({_Z} * {_Q} * 700 AS BIGINT) END AS cache_read,
    CASE WHEN l_suppkey % 3 = 0 THEN CAST({_Z} * l_suppkey AS BIGINT) ELSE 0 END AS cache_write, CAST({_Z} * ({_P} % 97) AS BIGINT) AS reasoning,
    CAST(l_linenumber AS BIGINT) AS message_count, CASE WHEN l_discount = 0 THEN NULL ELSE {_P} / 1024.0::DOUBLE END AS reported_cost_usd,
    CASE WHEN l_linestatus = 'O' THEN {_P} END AS perf_duration_ms, CASE WHEN l_tax = 0 THEN 0 ELSE {_Q} * 50 END AS perf_timed_tokens, l_shipdate AS collected_at
  FROM lineitem)""",
    "price_obs": """
  SELECT md5(concat('p', p_partkey)) AS event_id, concat('src-', p_partkey % 4) AS source_id, concat('model-', CAST(floor(p_partkey / 4) AS BIGINT) % 4) AS model,
    date '2024-01-05' + CAST(p_partkey % 50 AS INT) AS day, CASE WHEN p_brand = 'Brand#1' THEN 'Custom' ELSE 'catalog' END AS source,
    p_size / 1048576.0::DOUBLE AS price_input_per_token, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 524288.0::DOUBLE END AS price_output_per_token,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 8388608.0::DOUBLE END AS price_cache_read_per_token, p_size / 2097152.0::DOUBLE AS price_cache_write_per_token,
    timestamp '2024-03-01' + to_days(p_size) AS collected_at
  FROM part""",
    "session_obs": f"""
  SELECT md5(concat_ws('|', 's', o_orderkey, rep)) AS event_id, concat('src-', o_orderkey % 4) AS source_id, {_CLI.format(k="o_orderkey")} AS client, concat('ses-', o_orderkey) AS session_id,
    concat('ws-', (o_custkey + rep) % 50) AS workspace, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('Team ', o_custkey % 50) END AS workspace_label, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE timestamp '2024-01-01 12:00:00' + to_days(CAST((o_orderkey * 7) % 64 AS INT)) END AS last_active,
    o_orderkey % 600 AS duration_minutes, o_orderkey % 90 AS message_count, floor(o_totalprice) / 1024.0::DOUBLE AS reported_cost_usd,
    o_orderdate + to_days(CAST(rep * 3 AS INT)) AS first_seen_at, o_orderdate + to_days(CAST(rep * 3 AS INT)) + INTERVAL 1 HOUR AS last_seen_at, o_orderdate + to_days(CAST(rep * 3 AS INT)) AS collected_at
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [0, 1] ELSE [0] END) AS rep FROM orders WHERE o_orderkey % 13 <> 0)""",
    "tag_obs": f"""
  SELECT md5(concat_ws('|', 't', c_custkey, rep)) AS event_id, (['client','workspace','session'])[CAST(c_custkey % 3 AS INT) + 1] AS scope, concat('src-', c_custkey % 4) AS source_id,
    CASE WHEN c_custkey % 3 = 1 THEN '' ELSE {_CLI.format(k="(c_custkey // 3)")} END AS client, CASE WHEN c_custkey % 3 = 1 THEN concat('ws-', c_custkey % 50) ELSE '' END AS workspace,
    CASE WHEN c_custkey % 3 = 2 THEN concat('ses-', c_custkey) ELSE '' END AS session_id, lower(c_mktsegment) AS tag,
    CASE WHEN rep = 1 AND c_custkey % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op, timestamp '2024-02-01' + to_days(CAST(c_custkey % 20 AS INT) + CAST(rep AS INT)) AS collected_at,
    timestamp '2024-02-01' AS created_at, timestamp '2024-02-01' + to_days(CAST(c_custkey % 20 AS INT) + CAST(rep AS INT)) AS updated_at
  FROM (SELECT *, unnest(CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS rep FROM customer)""",
    "note_obs": f"""
  SELECT md5(concat_ws('|', 'n', conv_id, turn, role, text)) AS event_id, concat('src-', conv_id % 4) AS source_id, {_CLI.format(k="conv_id")} AS client, concat('ses-', conv_id) AS session_id, text AS note,
    CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'delete' ELSE 'upsert' END AS op, timestamp '2024-02-01' + to_hours(CAST(turn AS INT)) AS collected_at, timestamp '2024-02-01' AS created_at, timestamp '2024-02-01' + to_hours(CAST(turn AS INT)) AS updated_at
  FROM conversations WHERE role IN ('user', 'system')""",
    "ledger_obs": """
  SELECT md5(concat_ws('|', 'l', source_id, run_id, strftime(day, '%Y-%m-%d'), domain)) AS event_id, source_id, run_id, day, domain,
    CASE WHEN domain = 'collection' THEN (['ok','failed','partial','payload_drift'])[CAST(ev % 4 AS INT) + 1] ELSE (['complete','partial','failed','provisional'])[CAST(ev % 4 AS INT) + 1] END AS status,
    n AS expected_count, CAST(CASE WHEN ev % 4 = 0 THEN n ELSE n // 2 END AS BIGINT) AS succeeded_count, concat('host-', u % 6) AS host, CASE WHEN u % 2 = 0 THEN 'linux' ELSE 'darwin' END AS os_name,
    'x86_64' AS architecture, CAST(4 + u % 3 AS BIGINT) AS cpu_count, CAST(16000 AS BIGINT) AS memory_bytes, CASE WHEN u % 5 = 0 THEN NULL ELSE 'cpu-x' END AS cpu_model, CASE WHEN u % 7 = 0 THEN NULL ELSE concat('6.', u % 3) END AS os_version,
    hour AS started_at, CASE WHEN ev % 9 = 0 THEN NULL ELSE hour + INTERVAL 10 MINUTE END AS finished_at, hour AS collected_at
  FROM (SELECT concat('src-', user_id % 4) AS source_id, concat('run-', strftime(ts, '%Y%m%d%H')) AS run_id, CAST(ts AS DATE) - CAST(user_id % 3 AS INT) AS day,
    CASE event_type WHEN 'view' THEN 'models' WHEN 'click' THEN 'report' WHEN 'error' THEN 'pricing' WHEN 'purchase' THEN 'collection' ELSE 'session_metadata' END AS domain,
    date_trunc('hour', ts) AS hour, count(*) AS n, max(event_id) AS ev, min(user_id) AS u FROM events GROUP BY 1, 2, 3, 4, 5)""",
    "drift_obs": """
  SELECT md5(concat_ws('|', CASE WHEN rep = 2 THEN 'e' ELSE 'd' END, event_id)) AS event_id, concat('src-', user_id % 4) AS source_id, CASE WHEN user_id % 2 = 0 THEN 'models' ELSE 'report' END AS domain, '1.0' AS payload_ver, concat('unknown_field:p', user_id % 20) AS drift_key, props AS detail,
    ts AS created_at, ts + to_days(CASE WHEN rep = 1 THEN 1 ELSE 0 END) AS collected_at, event_id % 10 < 3 OR rep = 2 AS resolved, CAST(1 + event_id % 3 AS BIGINT) AS observation_count
  FROM (SELECT *, unnest(CASE WHEN event_id % 6 = 0 THEN [0, 1] WHEN event_id % 10 = 7 THEN [0, 2] ELSE [0] END) AS rep FROM events WHERE event_type = 'error')""",
    "issue_obs": """
  SELECT md5(concat_ws('|', CASE WHEN rep = 2 THEN 'e' ELSE 'd' END, event_id)) AS event_id, concat('src-', user_id % 4) AS source_id, concat('check-', user_id % 5) AS check_name, concat('key-', user_id % 20) AS issue_key, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS message,
    ts AS created_at, ts + to_days(CASE WHEN rep = 1 THEN 1 ELSE 0 END) AS collected_at, event_id % 10 < 3 OR rep = 2 AS resolved, CAST(1 + event_id % 3 AS BIGINT) AS observation_count
  FROM (SELECT *, unnest(CASE WHEN event_id % 6 = 0 THEN [0, 1] WHEN event_id % 10 = 7 THEN [0, 2] ELSE [0] END) AS rep FROM events WHERE event_type = 'signup')""",
}
