"""DuckDB twins of the ledger queries: each is a body over named CTEs, and takes the CTEs that it mentions."""

from __future__ import annotations

import re

from ledgerwright.plans import fixtures

TOK = ("input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning")
ALL = (*TOK, "total_tokens")
KEY = "source_id, day, client, session_id, model"
SES = "source_id, client, session_id"
RATES = "price_input_per_token, price_output_per_token, price_cache_read_per_token, price_cache_write_per_token"
DAILY = f"event_id, {KEY}, {', '.join(ALL)}"
COST = f"{KEY}, rate_day, cost_usd, cost_basis, ms_per_1k_tokens"


def best(source: str, keys: str, order: str, where: str = "TRUE", columns: str = "*") -> str:
    by = ", ".join(f"{c.strip()} DESC NULLS LAST" for c in order.split(","))
    return f"SELECT {columns} FROM (SELECT * FROM {source} WHERE {where}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {by}) = 1"


def zero(c: str) -> str:
    return f"CAST(coalesce(sum({c}), 0) AS BIGINT)"


ZEROS = ", ".join(f"{zero(c)} AS {c}" for c in ALL)
STRICT = "CASE WHEN count(cost_usd) = count(*) THEN sum(cost_usd) END"
USABLE = "perf_duration_ms IS NOT NULL AND perf_timed_tokens > 0"
PAIRED = f"CAST(sum(CASE WHEN {USABLE} THEN perf_duration_ms END) AS BIGINT) AS paired_ms, CAST(sum(CASE WHEN {USABLE} THEN perf_timed_tokens END) AS BIGINT) AS paired_tokens"


def ratio(n: str, d: str, scale: str = "1.0") -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) * {scale}::DOUBLE / CAST({d} AS DOUBLE) END"


DAY_REPORT = f"""SELECT day, {ZEROS}, {zero("coalesce(output_tokens, 0) + coalesce(reasoning, 0)")} AS output_with_reasoning, CAST(sum(perf_duration_ms) AS BIGINT) AS duration_ms,
  count(ms_per_1k_tokens) AS measured_facts, count(*) AS facts, CASE WHEN count(DISTINCT cost_basis) = 1 THEN max(cost_basis) ELSE 'mixed' END AS cost_basis, {STRICT} AS cost_usd
FROM {{}} GROUP BY day"""
MODEL_REPORT = f"""SELECT model, client, {", ".join(ALL)}, message_count, cost_usd, {ratio("paired_ms", "paired_tokens", "1000.0")} AS ms_per_1k_tokens, {ratio("cost_usd", "total_tokens", "1000000.0")} AS cost_per_million, {ratio("cache_read", "input_tokens")} AS cache_multiplier
FROM (SELECT model, client, {ZEROS}, {zero("message_count")} AS message_count, {STRICT} AS cost_usd, {PAIRED} FROM {{}} GROUP BY model, client)"""
LIFT = "greatest({a}.total_tokens, {b}.total_tokens, " + " + ".join(f"coalesce(greatest({{a}}.{c}, {{b}}.{c}), 0)" for c in TOK) + ")"
CUT97 = "timestamp '1997-01-01'"


def lifted(a: str, b: str) -> str:
    return ", ".join(f"greatest({a}.{c}, {b}.{c}) AS {c}" for c in TOK) + f", CAST({LIFT.format(a=a, b=b)} AS BIGINT) AS total_tokens"


#: Newest metric of each sort, as in the reports.
SORTS = ("activity_day", "created_at", "last_active", "total_tokens", "input_tokens", "output_tokens", "cache_read", "cache_write", "reasoning", "cost_usd", "message_count", "ms_per_1k_tokens")

def preflight() -> str:
    """Each kind of record with its own columns, the others null."""
    from ledgerwright.operators.audit import PREFLIGHT

    own = {
        "status": ("status", "source_id day domain status expected_count succeeded_count run_id"),
        "models": ("cur_daily", "source_id day model client session_id input_tokens output_tokens cache_read cache_write reasoning total_tokens event_id collected_at"),
        "prices": ("cur_price", "source_id day model"),
        "issues": ("cur_issue", "source_id check_name issue_key"),
        "drift": ("cur_drift", "source_id domain payload_ver drift_key detail created_at observation_count"),
        "sessions": ("cur_session", "source_id client session_id created_at"),
        "missing_sessions": ("cur_daily", "source_id client session_id"),
    }
    test = {"issues": "NOT resolved", "drift": "NOT resolved", "missing_sessions": f"NOT EXISTS (SELECT 1 FROM cur_session s WHERE s.source_id = {{t}}.source_id AND s.client = {{t}}.client AND s.session_id = {{t}}.session_id)"}
    parts = [f"SELECT DISTINCT '{k}' AS kind, " + ", ".join(c if c in cols.split() else f"NULL AS {c}" for c in PREFLIGHT[1:]) + f" FROM {t} WHERE " + test.get(k, "TRUE").format(t=t) for k, (t, cols) in own.items()]
    return " UNION ALL ".join(parts)


CTES = {name: body for name, body in fixtures.SQL.items()} | {
    "cur_daily": best("daily_obs", KEY, "collected_at, total_tokens, event_id"),
    "cur_price": best("price_obs", "source_id, day, model", "collected_at, price_output_per_token, event_id"),
    "cur_session": best("session_obs", SES, "collected_at, event_id", columns=f"* REPLACE (min(first_seen_at) OVER (PARTITION BY {SES}) AS first_seen_at, max(last_seen_at) OVER (PARTITION BY {SES}) AS last_seen_at)"),
    "ranked_tag": best("(SELECT *, op = 'upsert' AS is_upsert FROM tag_obs)", "scope, client, workspace, session_id, tag", "collected_at, is_upsert, event_id"),
    "cur_tag": "SELECT * EXCLUDE (is_upsert) FROM ranked_tag WHERE is_upsert",
    "ranked_note": best("(SELECT *, op = 'upsert' AS is_upsert FROM note_obs)", SES, "collected_at, is_upsert, event_id"),
    "cur_note": "SELECT * EXCLUDE (is_upsert) FROM ranked_note WHERE is_upsert",
    "cur_ledger": best("ledger_obs", "source_id, run_id, day, domain", "collected_at, finished_at, event_id"),
    "once_drift": best("drift_obs", "source_id, event_id", "collected_at, resolved"),
    "cur_drift": best("once_drift", "source_id, domain, payload_ver, drift_key", "collected_at, resolved, event_id", columns="* REPLACE (min(created_at) OVER w AS created_at, CAST(sum(observation_count) OVER w AS BIGINT) AS observation_count)").replace(" QUALIFY", " WINDOW w AS (PARTITION BY source_id, domain, payload_ver, drift_key) QUALIFY"),
    "once_issue": best("issue_obs", "source_id, event_id", "collected_at, resolved"),
    "cur_issue": best("once_issue", "source_id, check_name, issue_key", "collected_at, resolved, event_id", columns="* REPLACE (min(created_at) OVER w AS created_at, CAST(sum(observation_count) OVER w AS BIGINT) AS observation_count, first_value(message IGNORE NULLS) OVER (PARTITION BY source_id, check_name, issue_key ORDER BY collected_at DESC, resolved DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS message)").replace(" QUALIFY", " WINDOW w AS (PARTITION BY source_id, check_name, issue_key) QUALIFY"),
    "status": best("ledger_obs", "source_id, day, domain", "collected_at, finished_at, event_id", "domain <> 'collection'"),
    "cost": f"""
  SELECT f.*, r.day AS rate_day, r.price_input_per_token, r.price_output_per_token, r.price_cache_read_per_token, r.price_cache_write_per_token,
    CASE WHEN r.day IS NOT NULL OR f.total_tokens = 0 THEN CAST(coalesce(f.input_tokens, 0) * coalesce(r.price_input_per_token, 0) + (coalesce(f.output_tokens, 0) + coalesce(f.reasoning, 0)) * coalesce(r.price_output_per_token, 0)
      + coalesce(f.cache_read, 0) * coalesce(r.price_cache_read_per_token, 0) + coalesce(f.cache_write, 0) * coalesce(r.price_cache_write_per_token, 0) AS DOUBLE) ELSE f.reported_cost_usd END AS cost_usd,
    CASE WHEN r.day = f.day THEN 'observed' WHEN r.day < f.day THEN 'carried_forward' WHEN r.day > f.day THEN 'historical_estimate' WHEN f.total_tokens = 0 THEN 'zero_usage' WHEN f.reported_cost_usd IS NOT NULL THEN 'reported' ELSE 'unknown' END AS cost_basis,
    CASE WHEN f.perf_timed_tokens > 0 THEN 1000.0::DOUBLE * f.perf_duration_ms / f.perf_timed_tokens END AS ms_per_1k_tokens
  FROM cur_daily f LEFT JOIN cur_price r ON r.source_id = f.source_id AND r.model = f.model
    AND (f.input_tokens IS NOT DISTINCT FROM 0 OR r.price_input_per_token IS NOT NULL)
    AND ((f.output_tokens IS NOT DISTINCT FROM 0 AND f.reasoning IS NOT DISTINCT FROM 0) OR r.price_output_per_token IS NOT NULL)
    AND (f.cache_read IS NOT DISTINCT FROM 0 OR r.price_cache_read_per_token IS NOT NULL)
    AND (f.cache_write IS NOT DISTINCT FROM 0 OR r.price_cache_write_per_token IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY f.source_id, f.day, f.client, f.session_id, f.model ORDER BY coalesce(r.day <= f.day, FALSE) DESC, CASE WHEN r.day <= f.day THEN r.day END DESC NULLS LAST, r.day ASC NULLS LAST) = 1""",
    "usage_": f"SELECT c.*, s.workspace, s.workspace_label FROM cost c LEFT JOIN cur_session s USING ({SES})",
    "stats": f"""
  SELECT *, {ratio("paired_ms", "paired_tokens", "1000.0")} AS ms_per_1k_tokens FROM (
  SELECT {SES}, model, max(provider) AS provider, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ALL)}, CAST(sum(message_count) AS BIGINT) AS message_count, {STRICT} AS cost_usd, {PAIRED},
    CAST(sum(perf_duration_ms) AS BIGINT) AS perf_duration_ms, count(*) AS facts, max(collected_at) AS collected_at FROM cost GROUP BY {SES}, model)""",
    "smodels": f"""
  SELECT t.*, s.workspace, s.workspace_label, s.created_at, s.last_active, u.last_usage_day, greatest(u.last_usage_day, CAST(s.last_active AS DATE)) AS activity_day,
    s.last_active IS NULL OR u.last_usage_day > CAST(s.last_active AS DATE) AS last_active_stale
  FROM stats t LEFT JOIN cur_session s USING ({SES}) LEFT JOIN (SELECT {SES}, max(day) AS last_usage_day FROM cost GROUP BY {SES}) u USING ({SES})""",
    "srows": f"""
  SELECT * EXCLUDE (paired_ms, paired_tokens), {ratio("paired_ms", "paired_tokens", "1000.0")} AS ms_per_1k_tokens, {ratio("cost_usd", "total_tokens", "1000000.0")} AS cost_per_million FROM (
  SELECT {SES}, max(workspace) AS workspace, string_agg(DISTINCT model, ', ' ORDER BY model) AS models, {ZEROS}, {zero("message_count")} AS message_count, {STRICT} AS cost_usd, CAST(sum(paired_ms) AS BIGINT) AS paired_ms, CAST(sum(paired_tokens) AS BIGINT) AS paired_tokens,
    max(last_active) AS last_active, max(activity_day) AS activity_day, max(last_usage_day) AS last_usage_day, bool_or(last_active_stale) AS last_active_stale, max(created_at) AS created_at FROM smodels GROUP BY {SES})""",
    "stags": f"""
  SELECT DISTINCT s.source_id, s.client, s.session_id, s.workspace, t.tag, t.scope AS tag_scope FROM cur_session s JOIN cur_tag t
    ON (t.scope = 'client' AND t.client = s.client) OR (t.scope = 'workspace' AND t.workspace = s.workspace) OR (t.scope = 'session' AND t.client = s.client AND t.session_id = s.session_id)""",
    "picked": f"SELECT * FROM usage_ u WHERE client = 'cli-a' AND model NOT IN ('model-4') AND day BETWEEN date '2024-01-10' AND date '2024-02-20' AND EXISTS (SELECT 1 FROM stags g WHERE g.tag = 'building' AND g.source_id = u.source_id AND g.client = u.client AND g.session_id = u.session_id)",
    "by_day": DAY_REPORT.format("usage_"),
    "days_": "SELECT CAST(unnest(generate_series(date '2023-12-25', date '2024-03-20', INTERVAL 1 DAY)) AS DATE) AS day",
    "cal": "SELECT d.day, b.* EXCLUDE (day), CASE WHEN d.day > date '2024-02-15' THEN NULL WHEN b.facts IS NULL THEN 0.0::DOUBLE ELSE CAST(b.input_tokens + b.output_tokens AS DOUBLE) END AS value, CASE WHEN d.day > date '2024-02-15' THEN 'future' WHEN b.facts IS NULL THEN 'no-recorded-usage' ELSE 'complete' END AS status FROM days_ d LEFT JOIN by_day b USING (day)",
    "valued": "SELECT day, value FROM cal",
    "declared": """
  SELECT day, CAST(coalesce(sum(input_tokens), 0) + CASE WHEN dayofyear(day) % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS total_input, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output, CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS total_cache_read,
    CAST(coalesce(sum(cache_write), 0) AS BIGINT) AS total_cache_write, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS total_messages, sum(reported_cost_usd) + CASE WHEN dayofyear(day) % 5 = 0 THEN 0.25::DOUBLE ELSE 0 END AS total_cost,
    CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS found_input, sum(CAST(CAST(reported_cost_usd AS VARCHAR) AS DECIMAL(38,18))) AS found_cost FROM daily_obs GROUP BY day""",
    "bad_totals": "SELECT day, 'total_input' AS check_name, total_input AS declared, found_input AS found FROM declared WHERE total_input <> found_input",
    "dups": "SELECT day, count(*) AS duplicates FROM (SELECT day FROM daily_obs GROUP BY day, client, session_id, model HAVING count(*) > 1) GROUP BY day",
    "runs": "SELECT * FROM cur_ledger WHERE domain = 'collection'",
    "bad_runs": "SELECT r.source_id, r.run_id, r.day, r.status, r.finished_at, r.collected_at FROM runs r WHERE r.status IN ('failed', 'partial', 'payload_drift') AND NOT EXISTS (SELECT 1 FROM runs o WHERE o.source_id = r.source_id AND o.status = 'ok' AND coalesce(o.finished_at, o.started_at) > coalesce(r.finished_at, r.started_at))",
    "bad_targets": "SELECT source_id, run_id, day, domain, status, expected_count, succeeded_count, collected_at FROM status WHERE status NOT IN ('complete', 'provisional')",
    "every_source": " UNION ".join(f"SELECT source_id FROM {t}" for t in ("daily_obs", "price_obs", "session_obs", "tag_obs", "note_obs", "ledger_obs", "drift_obs", "issue_obs")),
    "audited": f"""
  SELECT e.source_id, u.first_day, u.last_day, CAST(coalesce(r.runs, 0) AS BIGINT) AS runs, n.run_id, n.status, n.collected_at, n.host, n.os_name, n.architecture, n.cpu_count, n.memory_bytes, n.cpu_model, n.os_version
  FROM every_source e LEFT JOIN (SELECT source_id, min(day) AS first_day, max(day) AS last_day FROM cur_daily GROUP BY source_id) u USING (source_id)
  LEFT JOIN (SELECT source_id, count(DISTINCT run_id) AS runs FROM ledger_obs WHERE domain = 'collection' GROUP BY source_id) r USING (source_id)
  LEFT JOIN ({best("ledger_obs", "source_id", "collected_at, finished_at, event_id", "domain = 'collection'")}) n USING (source_id)""",
    "raw": "SELECT *, CAST(collected_at AS DATE) AS arrival_day FROM daily_obs",
    "gold": best("daily_obs", KEY, "collected_at, total_tokens, event_id", f"collected_at < {CUT97}"),
    "arrivals": "SELECT source_id, day, arrival_day, count(*) AS rows_seen FROM raw GROUP BY ALL",
    "cand": "SELECT a.*, CAST(coalesce(CASE WHEN arrival_day < date '1998-01-01' THEN rows_seen - CASE WHEN day(arrival_day) = 3 THEN 1 ELSE 0 END END, 0) AS BIGINT) AS rows_done FROM arrivals a WHERE arrival_day >= date '1998-01-01' OR day(arrival_day) = 3",
    "after97": best("daily_obs", KEY, "collected_at, total_tokens, event_id", f"collected_at >= {CUT97}"),
    "daily98a": best("daily_obs", KEY, "collected_at, total_tokens, event_id", "collected_at < timestamp '1998-01-01'"),
    "daily98b": best("daily_obs", KEY, "collected_at, total_tokens, event_id", "collected_at >= timestamp '1998-01-01'"),
    "asked": "SELECT source_id, scope, client, CASE WHEN scope = 'client' AND client = 'cli-b' THEN 'ws-1' ELSE workspace END AS workspace, session_id, concat(tag, CASE WHEN session_id LIKE '%5' THEN '-new' ELSE '' END) AS tag FROM tag_obs WHERE op = 'upsert'",
    "prof": "SELECT 'k' AS path, 'int' AS types, count(*) AS present, (SELECT count(*) FROM events) AS payloads FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "order_lines": """
  SELECT o_orderkey AS id, l.n IS NULL OR o_orderkey % 9 = 1 AS no_lines, l.n IS NOT NULL AND o_orderkey % 9 <> 1 AND o_orderkey % 10 = 0 AS no_line, l.n IS NOT NULL AND o_orderkey % 9 <> 1 AND o_orderkey % 10 <> 0 AS lines, l.n, l.rates, l.parts
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_tax <> 0) AS rates, count(*) FILTER (l_suppkey % 3 <> 0) AS parts FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""",
    "nested_prof": """
  SELECT path, types, present, (SELECT count(*) FROM orders) AS payloads, seen FROM (SELECT 'id' AS path, 'int' AS types, count(*) AS present, count(*) AS seen FROM order_lines
  UNION ALL SELECT 'tag', 'str', count(*) FILTER (id % 4 <> 0), count(*) FILTER (id % 4 <> 0) FROM order_lines UNION ALL SELECT 'extra', 'bool', count(*) FILTER (id % 5 = 0), count(*) FILTER (id % 5 = 0) FROM order_lines
  UNION ALL SELECT 'lines', 'array', count(*) FILTER (NOT no_lines), count(*) FILTER (NOT no_lines) FROM order_lines UNION ALL SELECT 'lines[].n', 'int', count(*) FILTER (lines), count(*) FILTER (lines) FROM order_lines
  UNION ALL SELECT 'lines[].rate', 'float', count(*) FILTER (lines AND rates = n), count(*) FILTER (lines AND rates > 0) FROM order_lines UNION ALL SELECT 'lines[].parts', 'array', count(*) FILTER (lines), count(*) FILTER (lines) FROM order_lines
  UNION ALL SELECT 'lines[].parts[].p', 'int', count(*) FILTER (lines AND parts = n), count(*) FILTER (lines AND parts > 0) FROM order_lines) WHERE seen > 0""",
    "monthly": "SELECT * REPLACE (CAST(date_trunc('month', collected_at) AS TIMESTAMP) AS collected_at) FROM daily_obs",
    "monthly98": best("monthly", KEY, "collected_at, total_tokens, event_id", "collected_at < timestamp '1998-01-01'"),
    "history": f"SELECT {KEY}, arg_max(event_id, (collected_at, total_tokens, event_id)) AS event_id, {', '.join(f'max({c}) AS {c}' for c in TOK)}, CAST(CASE WHEN count(DISTINCT event_id) = 1 THEN max(total_tokens) ELSE greatest(max(total_tokens), {' + '.join(f'coalesce(max({c}), 0)' for c in TOK)}) END AS BIGINT) AS total_tokens FROM daily_obs GROUP BY {KEY}",
    "targets": """
  SELECT d.day, 'models' AS domain, CASE WHEN day(d.day) = 9 THEN 'failed' WHEN u.day IS NOT NULL THEN 'partial' ELSE 'complete' END AS status, CAST(1 AS BIGINT) AS expected_count, CAST(CASE WHEN day(d.day) = 9 OR u.day IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS succeeded_count,
    CASE WHEN day(d.day) = 9 THEN 'timeout' WHEN u.day IS NOT NULL THEN 'reconciliation' END AS failure_code FROM (SELECT DISTINCT day FROM cur_daily) d LEFT JOIN (SELECT day FROM dups WHERE day(day) < 4) u USING (day)
  UNION ALL SELECT day, 'report', CASE WHEN day(day) = 11 THEN 'failed' ELSE 'complete' END, 1, CASE WHEN day(day) = 11 THEN 0 ELSE 1 END, CASE WHEN day(day) = 11 THEN 'payload' END FROM (SELECT DISTINCT day FROM cur_daily)
  UNION ALL SELECT date '2024-02-15', 'session_metadata', CASE WHEN found < wanted THEN 'partial' ELSE 'complete' END, wanted, found, CASE WHEN found < wanted THEN 'missing_sessions' END
    FROM (SELECT count(*) AS wanted, count(s.client) AS found FROM (SELECT DISTINCT client, session_id FROM cur_daily) w LEFT JOIN (SELECT DISTINCT client, session_id FROM cur_session) s USING (client, session_id))
  UNION ALL SELECT day, 'pricing', CASE WHEN unsafe THEN 'partial' WHEN found = wanted AND code IS NULL THEN 'complete' WHEN found > 0 THEN 'partial' ELSE 'failed' END, wanted, found, CASE WHEN unsafe THEN 'reconciliation' WHEN found < wanted OR code IS NOT NULL THEN coalesce(code, 'incomplete') END
    FROM (SELECT w.day, count(*) AS wanted, count(p.model) AS found, max(CASE WHEN w.model = 'model-2' AND day(w.day) = 5 THEN 'lookup' END) AS code, w.day IN (SELECT day FROM dups WHERE day(day) < 4) AS unsafe
      FROM (SELECT DISTINCT day, model FROM cur_daily) w LEFT JOIN (SELECT DISTINCT day, model FROM cur_price) p USING (day, model) GROUP BY w.day)""",
    "session_issue": "SELECT event_id, CASE check_name WHEN 'check-1' THEN 'models_report_session_set' WHEN 'check-2' THEN 'models_report_cost' ELSE check_name END AS check_name, check_name AS old_check, issue_key, translate(issue_key, '1', '2') AS session_id FROM cur_issue",
    "session_names": "SELECT v, concat('session-', CASE WHEN n <= 10 THEN (['alpha','bravo','charlie','delta','echo','foxtrot','golf','hotel','india','juliet'])[n] ELSE CAST(n AS VARCHAR) END) AS p FROM (SELECT v, row_number() OVER (ORDER BY v) AS n FROM (SELECT session_id AS v FROM session_issue UNION SELECT issue_key FROM session_issue WHERE old_check IN ('check-1', 'check-2')))",
    "note_hash": "SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(json_array(source_id, client, session_id) AS VARCHAR))) AS h FROM cur_note",
    "note_named": "SELECT *, concat('n_', rtrim(translate(to_base64(unhex(concat(substr(h, 1, 12), '5', substr(h, 14, 3), substr('89ab', CAST((position(substr(h, 17, 1) IN '0123456789abcdef') - 1) & 3 AS INTEGER) + 1, 1), substr(h, 18, 15)))), '+/', '-_'), '=')) AS note_id FROM note_hash",
    "asked_note": f"SELECT {SES}, CASE WHEN session_id LIKE '%3' THEN concat(min(note), ' edited') ELSE min(note) END AS note FROM note_obs GROUP BY {SES}",
    "vers": "SELECT event_id AS version_id, (['scheduled','manual','weekly','copy'])[CAST(event_id % 4 AS INT) + 1] AS role, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS weekly_slot, event_id % 7 = 0 AS pinned, CASE WHEN event_id % 11 = 0 THEN 'odd' ELSE 'complete' END AS state, ts AS created_at FROM events",
}


def pseudonym(column: str, prefix: str) -> str:
    n = f"dense_rank() OVER (ORDER BY {column})"
    return f"concat('{prefix}-', CASE WHEN {n} <= 10 THEN (['alpha','bravo','charlie','delta','echo','foxtrot','golf','hotel','india','juliet'])[{n}] ELSE CAST({n} AS VARCHAR) END) AS {column}"


def raw_gold(raw: str, gold: str) -> str:
    columns = f"event_id, {KEY}, collected_at, {', '.join(ALL)}"
    union = f"(SELECT {columns} FROM {raw} UNION ALL SELECT {columns} FROM {gold})"
    return f"SELECT b.event_id, b.source_id, b.day, b.client, b.session_id, b.model, {lifted('b', 'g')} FROM ({best(union, KEY, 'collected_at, total_tokens, event_id')}) b LEFT JOIN (SELECT * FROM {gold}) g USING ({KEY})"


def intensity(bins: int, share: str) -> str:
    return f"SELECT day, value, CAST(CASE WHEN value IS NULL THEN NULL WHEN value <= 0 THEN 0 ELSE least({bins - 1}, greatest(1, ceil({bins - 1} * {share}))) END AS INTEGER) AS intensity FROM valued"


def sorts() -> str:
    one = "SELECT * FROM (SELECT '{by}' AS sort, CAST(row_number() OVER (ORDER BY {by} DESC NULLS LAST, last_active DESC NULLS LAST, source_id, client, session_id) AS INTEGER) AS rank, source_id, client, session_id FROM srows) WHERE rank <= 16"
    return " UNION ALL ".join(one.format(by=by) for by in SORTS)


NOW = "timestamp '2024-04-20' - INTERVAL 90 DAY"
QUERIES = {
    "A1_daily_payload_scan": "SELECT concat(source_id, '-', day, '-', session_id, '.json') AS file, day, client, session_id, model, input_tokens, output_tokens, coalesce(cache_read, 0) AS cache_read, cache_write, reasoning, total_tokens, message_count, perf_duration_ms FROM daily_obs",
    "A2_report_scan": "SELECT concat(source_id, '-', CAST(created_at AS DATE), '-', session_id) AS file, client, session_id, workspace, message_count, duration_minutes, created_at FROM session_obs",
    "A3_contribution_days": "SELECT DISTINCT source_id AS file, '1.0' AS version, day AS date FROM daily_obs",
    "A4_rate_card_scan": "SELECT event_id AS file, model, source, price_input_per_token, price_output_per_token FROM price_obs",
    "A5_typed_scan": "SELECT event_id, source_id, model, source, NULL AS matched_key, NULL AS match_kind, day, price_input_per_token, price_output_per_token, price_cache_read_per_token, price_cache_write_per_token, collected_at FROM price_obs",
    "A7_upsert_sessions": best("session_obs", SES, "collected_at, event_id", columns=f"event_id, {SES}, workspace, min(first_seen_at) OVER (PARTITION BY {SES}) AS first_seen_at, max(last_seen_at) OVER (PARTITION BY {SES}) AS last_seen_at"),
    "A7_upsert_daily": "WITH h AS (SELECT " + KEY + ", " + ", ".join(f"max({c}) AS {c}" for c in ALL) + " FROM daily_obs WHERE collected_at >= timestamp '1998-01-01' GROUP BY ALL) SELECT coalesce(b.event_id, a.event_id) AS event_id, " + KEY + ", " + ", ".join(f"greatest(a.{c}, h.{c}) AS {c}" for c in TOK)
    + ", CAST(greatest(a.total_tokens, h.total_tokens, " + " + ".join(f"coalesce(greatest(a.{c}, h.{c}), 0)" for c in TOK) + f") AS BIGINT) AS total_tokens FROM daily98a a FULL JOIN (SELECT {KEY}, event_id FROM daily98b) b USING ({KEY}) LEFT JOIN h USING ({KEY})",
    "A7_upsert_counts": f"SELECT count(*) FILTER (a.event_id IS NULL) AS inserted, count(*) FILTER (a.event_id IS NOT NULL) AS updated FROM daily98b b LEFT JOIN daily98a a USING ({KEY})",
    "A7_persisted_counts": f"""WITH d AS (SELECT 'daily_stats' AS t, b, count(DISTINCT ({KEY})) AS n FROM (SELECT *, collected_at >= timestamp '1998-01-01' AS b FROM daily_obs) GROUP BY b UNION ALL SELECT 'sessions', b, count(DISTINCT ({SES})) FROM (SELECT *, collected_at >= timestamp '1998-01-01' AS b FROM session_obs) GROUP BY b),
o AS (SELECT 'daily_stats' AS t, count(*) AS both FROM (SELECT 1 FROM daily_obs GROUP BY {KEY} HAVING min(collected_at) < timestamp '1998-01-01' AND max(collected_at) >= timestamp '1998-01-01') UNION ALL SELECT 'sessions', count(*) FROM (SELECT 1 FROM session_obs GROUP BY {SES} HAVING min(collected_at) < timestamp '1998-01-01' AND max(collected_at) >= timestamp '1998-01-01'))
SELECT CAST(step AS INTEGER) AS step, o.t AS table_name, CASE step WHEN 1 THEN coalesce((SELECT n FROM d WHERE d.t = o.t AND NOT b), 0) WHEN 2 THEN coalesce((SELECT n FROM d WHERE d.t = o.t AND b), 0) - o.both ELSE 0 END AS inserted, CASE step WHEN 2 THEN o.both ELSE 0 END AS updated, step > 2 AS already_committed FROM o, (SELECT unnest([1, 2, 3, 4]) AS step)""",
    "A7_persisted_daily": f"SELECT {DAILY} FROM history",
    "A6_appended_drift": "SELECT * FROM drift_obs",
    "A8_exported_prices": "SELECT * FROM cur_price",
    "A9_snapshot_rows": f"SELECT 'daily_stats' AS table, count(*) AS rows FROM history UNION ALL SELECT 'sessions', count(DISTINCT ({SES})) FROM session_obs UNION ALL SELECT 'payload_drift_events', count(*) FROM once_drift UNION ALL SELECT 'collection_ledger', count(*) FROM ledger_obs",
    "A10_tampered_snapshot": "SELECT unnest(['daily_stats', 'daily_stats', 'payload_drift_events', 'sessions']) AS table, unnest(['rows', 'digest', 'missing', 'digest']) AS problem",
    "A11_restored_daily": f"SELECT {DAILY} FROM history",
    "A12_retention_plan": """WITH ok AS (SELECT * FROM vers WHERE state IN ('complete', 'failed') AND NOT pinned),
n AS (SELECT version_id FROM ok WHERE role IN ('scheduled', 'manual') ORDER BY created_at DESC, version_id LIMIT 5),
w AS (SELECT arg_min(version_id, (-epoch_us(created_at), version_id)) AS version_id, max(created_at) AS latest FROM ok WHERE role = 'weekly' AND weekly_slot IS NOT NULL GROUP BY weekly_slot ORDER BY latest DESC LIMIT 4)
SELECT version_id, reason IS NOT NULL AS keep, reason FROM (SELECT version_id, CASE WHEN state NOT IN ('complete', 'failed') THEN 'unknown state' WHEN pinned THEN 'pinned' WHEN version_id IN (SELECT version_id FROM n) THEN 'newest' WHEN version_id IN (SELECT version_id FROM w) THEN 'weekly' END AS reason FROM vers)""",
    "B2_total_tokens": "SELECT event_id, total_tokens FROM daily_obs",
    "B4_session_label": "SELECT event_id, concat(coalesce(workspace_label, 'session'), ' · ', coalesce(CASE WHEN message_count % 9 <> 0 THEN strftime(created_at, '%Y-%m-%d') END, 'unknown-date'), ' · ', right(session_id, 8)) AS label FROM session_obs",
    "B6_policy_rules": "SELECT event_id, " + ", ".join(f"CASE WHEN model = 'model-3' AND source <> 'Custom' THEN 0.0::DOUBLE ELSE {r.strip()} END AS {r.strip()}" for r in RATES.split(",")) + " FROM price_obs",
    "B7_run_outcome": "SELECT run_id, CASE WHEN bool_or(status = 'failed' AND expected_count > 3) THEN 'failed' WHEN bool_or(status = 'payload_drift') THEN 'payload_drift' WHEN bool_or(status IN ('partial', 'failed')) THEN 'partial' ELSE 'ok' END AS status FROM ledger_obs GROUP BY run_id",
    "B8_provisional_days": "SELECT event_id, CASE WHEN domain = 'models' AND status = 'complete' AND day >= CAST(started_at AS DATE) THEN 'provisional' ELSE status END AS status FROM ledger_obs",
    "B9_domain_rejects": "SELECT event_id, concat_ws('; ', CASE WHEN message_count = 2 THEN 'session_id: length' END, CASE WHEN message_count = 5 THEN 'input_tokens: negative or not finite' END, CASE WHEN message_count > 6 THEN 'perf_token_coverage: not in 0..1' END) AS reject_reason FROM daily_obs WHERE message_count IN (2, 5) OR message_count > 6",
    "B10_batch_checks": f"SELECT CAST(0 AS BIGINT) AS nulls, count(DISTINCT source_id) AS sources, CAST(0 AS BIGINT) AS bad_ids, (SELECT count(*) FROM (SELECT 1 FROM daily_obs GROUP BY {KEY} HAVING count(*) > 1)) AS repeated_keys FROM daily_obs",
    "B11_merge_sessions": "SELECT client, session_id, min(created_at) AS created_at, max(last_active) AS last_active, array_to_string(list_sort(list_distinct(flatten(list([concat('model-', message_count % 5), 'model-0'])))), ',') AS models FROM session_obs GROUP BY client, session_id HAVING NOT (count(DISTINCT CASE WHEN session_id LIKE '%7' THEN workspace ELSE 'ws' END) > 1 OR count(DISTINCT workspace_label) > 1)",
    "B11_session_conflicts": "SELECT client, session_id FROM session_obs GROUP BY client, session_id HAVING count(DISTINCT CASE WHEN session_id LIKE '%7' THEN workspace ELSE 'ws' END) > 1 OR count(DISTINCT workspace_label) > 1",
    "B12_event_ids": "SELECT event_id, md5(concat_ws('|', source_id, run_id, day, domain)) AS made FROM ledger_obs",
    "B13_stamped_ledger": """SELECT 'run-9' AS run_id, 'src-1' AS source_id, day, domain, CASE WHEN domain = 'models' AND status = 'complete' AND day >= date '2024-02-15' THEN 'provisional' ELSE status END AS status, expected_count, succeeded_count, failure_code, 'host-1' AS host, '6.1' AS os_version, timestamp '2024-02-15 08:00:00' AS collected_at
FROM (SELECT * FROM targets UNION ALL SELECT date '2024-02-15', 'collection', 'ok', NULL, NULL, NULL)""",
    "B13_stamped_issues": "SELECT 'run-9' AS run_id, 'src-1' AS source_id, check_name, issue_key, CASE WHEN issue_key LIKE '%3' THEN message END AS message, timestamp '2024-02-15 09:00:00' AS collected_at, timestamp '2024-02-15 09:00:00' AS created_at, issue_key LIKE '%4' AS resolved, CAST(CASE WHEN issue_key LIKE '%3' THEN 1 ELSE 0 END AS BIGINT) AS observation_count FROM cur_issue WHERE issue_key LIKE '%3' OR issue_key LIKE '%4'",
    "B14_input_rows": "SELECT 'entries' AS kind, count(*) AS input_rows FROM daily_obs UNION ALL SELECT 'sessions', count(*) FROM session_obs UNION ALL SELECT 'contributions', count(DISTINCT (source_id, day)) FROM daily_obs",
    "C1_current_sessions": "SELECT * FROM cur_session",
    "C2_current_daily_stats": f"SELECT {DAILY} FROM cur_daily",
    "C3_current_price_versions": "SELECT * FROM cur_price",
    "C4_current_tags": "SELECT * FROM cur_tag",
    "C5_current_notes": "SELECT * FROM cur_note",
    "C6_current_collection_ledger": "SELECT * FROM cur_ledger",
    "C7_current_drift": "SELECT * FROM cur_drift",
    "C8_current_issues": "SELECT * FROM cur_issue",
    "C9_monotone_merge": f"SELECT i.event_id, i.source_id, i.day, i.client, i.session_id, i.model, {lifted('i', 's')} FROM after97 i LEFT JOIN gold s USING ({KEY})",
    "C11_collection_runs": "SELECT * FROM runs",
    "C12_collection_status": "SELECT * FROM status",
    "C13_open_drift": f"SELECT * FROM cur_drift WHERE NOT resolved AND collected_at >= {NOW}",
    "C13_open_issues": f"SELECT * FROM cur_issue WHERE NOT resolved AND collected_at >= {NOW}",
    "C14_raw_and_gold": raw_gold("(SELECT * FROM daily_obs WHERE collected_at >= timestamp '1996-06-01')", "gold"),
    "C15_replayed_drift": "SELECT * FROM once_drift",
    "D1_daily_cost": f"SELECT {COST} FROM cost",
    "E1_session_model_stats": "SELECT * FROM stats",
    "E2_report_daily": "SELECT * FROM by_day",
    "E2_report_daily_filtered": DAY_REPORT.format("picked"),
    "E3_report_models": MODEL_REPORT.format("usage_"),
    "E4_report_sessions": "SELECT * FROM srows",
    "E5_report_session_models": "SELECT * FROM smodels",
    "E6_report_summary": f"SELECT count(DISTINCT ({SES})) AS sessions, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE {STRICT} END AS cost_usd FROM cost",
    "E7_report_summary_models": f"SELECT model, {zero('total_tokens')} AS total_tokens, {STRICT} AS cost_usd FROM cost GROUP BY model",
    "E13_calendar": "SELECT day, status, value, facts, total_tokens, cost_usd FROM cal",
    "E13_calendar_cost": "SELECT day, CASE WHEN day > date '2024-02-15' THEN 'future' WHEN facts IS NULL THEN 'no-recorded-usage' WHEN cost_usd IS NULL THEN 'unknown' ELSE 'complete' END AS status, CASE WHEN day <= date '2024-02-15' THEN CASE WHEN facts IS NULL THEN 0.0::DOUBLE ELSE cost_usd END END AS value FROM cal",
    "E13_calendar_rate": "SELECT day, CASE WHEN day > date '2024-02-15' THEN 'future' WHEN cost_usd IS NOT NULL AND total_tokens > 0 THEN 'complete' ELSE 'unknown' END AS status, CASE WHEN day <= date '2024-02-15' AND total_tokens > 0 THEN cost_usd * 1000000.0::DOUBLE / total_tokens END AS value FROM cal",
    "E13_calendar_time": "SELECT day, CASE WHEN day > date '2024-02-15' THEN 'future' WHEN facts IS NULL THEN 'no-recorded-usage' WHEN duration_ms IS NULL THEN 'unknown' WHEN measured_facts > 0 AND measured_facts < facts THEN 'partial' ELSE 'complete' END AS status, CASE WHEN day <= date '2024-02-15' THEN CASE WHEN facts IS NULL THEN 0.0::DOUBLE ELSE CAST(duration_ms AS DOUBLE) END END AS value FROM cal",
    "E15_intensity_linear": intensity(7, "(value / (SELECT max(value) FROM valued))"),
    "E15_intensity_log": intensity(10, "(ln(1 + value) / ln(1 + (SELECT max(value) FROM valued)))"),
    "E16_chart_series": "SELECT d.day, coalesce(b.cost_usd, 0.0) AS value, b.facts IS NOT NULL AND b.cost_usd IS NULL AS missing_cost FROM (SELECT CAST(unnest(generate_series(date '2024-02-04', date '2024-03-05', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN by_day b USING (day)",
    "E17_filtered_summary": f"SELECT count(*) AS sessions, {STRICT} AS cost_usd FROM srows WHERE client = 'cli-b'",
    "E17_filtered_models": f"SELECT model, {zero('total_tokens')} AS total_tokens, {STRICT} AS cost_usd FROM smodels WHERE client = 'cli-b' GROUP BY model",
    "F2_report_daily_usage": f"SELECT {COST}, workspace, workspace_label FROM usage_",
    "F3_session_tags": "SELECT * FROM stags",
    "F4_tagged_facts": f"SELECT {COST} FROM picked",
    "F5_tagged_sessions": f"SELECT s.*, g.tag, g.tag_scope FROM cur_session s JOIN stags g USING ({SES})",
    "F5_noted_sessions": f"SELECT s.*, n.note_id, n.note, n.created_at AS note_created_at, n.updated_at AS note_updated_at, n.collected_at AS note_collected_at FROM cur_session s JOIN note_named n USING ({SES})",
    "F6_missing_sessions": f"SELECT DISTINCT {SES} FROM cost c WHERE NOT EXISTS (SELECT 1 FROM cur_session s WHERE s.source_id = c.source_id AND s.client = c.client AND s.session_id = c.session_id)",
    "F7_unresolved_runs": "SELECT * FROM bad_runs",
    "G1_all_sources": "SELECT * FROM every_source",
    "G2_preflight": preflight(),
    "G3_identity_sets": "SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.model, b.model) AS model, CASE WHEN b.model IS NULL THEN 'missing' WHEN a.model IS NULL THEN 'surplus' ELSE 'both' END AS in_set FROM (SELECT DISTINCT source_id, model FROM cur_daily) a FULL JOIN (SELECT DISTINCT source_id, model FROM cur_price) b ON a.source_id = b.source_id AND a.model = b.model",
    "G4_custom_models": "SELECT DISTINCT model FROM cur_price WHERE source = 'Custom'",
    "H1_session_sorts": sorts(),
    "H2_newest_days": "SELECT * FROM by_day ORDER BY day DESC LIMIT 16",
    "H4_note_page": "SELECT note_id, source_id, client, session_id, updated_at FROM note_named ORDER BY updated_at DESC, note_id LIMIT 17 OFFSET 16",
    "I1_filtered_models": MODEL_REPORT.format("(SELECT * FROM usage_ WHERE source_id = 'src-1' AND workspace = 'ws-7')"),
    "I2_relation_query": "SELECT * FROM cur_price WHERE source_id = 'src-2' AND source = 'Custom'",
    "I3_day_bounds": DAY_REPORT.format("(SELECT * FROM usage_ WHERE day BETWEEN date '2024-02-01' AND date '2024-02-29')"),
    "K1_json_profile": "SELECT '' AS path, 'object' AS types, count(*) AS present, count(*) AS payloads FROM events UNION ALL SELECT * FROM prof",
    "K1_nested_profile": "SELECT * EXCLUDE (seen) FROM nested_prof",
    "K2_contract": "SELECT path, types, present = payloads AND path <> 'tag' AS required FROM nested_prof",
    "K3_contract_diff": "SELECT 'missing_field:gone' AS drift_key, 'missing_field' AS drift_kind, 'gone' AS path, 'required types int; absent' AS detail, TRUE AS fatal, count(*) AS payloads FROM events UNION ALL SELECT 'type_change:k', 'type_change', path, 'expected str; got int', TRUE, present FROM prof WHERE path = 'k' AND present > 0",
    "K3_nested_diff": """SELECT id AS payload_id, concat(kind, ':', path) AS drift_key, kind AS drift_kind, path, detail, kind <> 'unknown_field' AS fatal FROM (
  SELECT id, 'missing_field' AS kind, 'tag' AS path, 'required types str; absent' AS detail FROM order_lines WHERE id % 4 = 0
  UNION ALL SELECT id, 'unknown_field', 'extra', 'types bool; tolerated' FROM order_lines WHERE id % 5 = 0
  UNION ALL SELECT id, 'missing_field', p.path, concat('required types ', p.types, '; absent') FROM order_lines, (VALUES ('lines', 'array'), ('lines[].n', 'str'), ('lines[].rate', 'float'), ('lines[].parts', 'array'), ('lines[].parts[].p', 'int')) p(path, types) WHERE no_lines
  UNION ALL SELECT id, 'type_change', 'lines[].n', 'expected str; got int' FROM order_lines WHERE lines
  UNION ALL SELECT id, 'missing_field', 'lines[].rate', CASE WHEN rates = 0 THEN 'required types float; absent' ELSE 'present on 0/1 array members' END FROM order_lines WHERE lines AND rates < n
  UNION ALL SELECT id, 'missing_field', 'lines[].parts[].p', 'present on 0/1 array members' FROM order_lines WHERE lines AND parts > 0 AND parts < n)""",
    "K4_empty_array_waivers": "SELECT id AS payload_id, path FROM order_lines, (VALUES ('lines[].n'), ('lines[].rate'), ('lines[].parts'), ('lines[].parts[].p')) p(path) WHERE no_line UNION ALL SELECT id, 'lines[].parts[].p' FROM order_lines WHERE lines AND parts = 0",
    "K5_drift_roll_up": "SELECT 'run-1' AS run_id, domain, payload_ver, drift_key, count(*) AS observation_count, arg_max(detail, (collected_at, event_id)) AS detail, bool_or(resolved) AS fatal FROM drift_obs GROUP BY domain, payload_ver, drift_key",
    "K6_check_totals": "SELECT * FROM bad_totals",
    "K7_check_cost": "SELECT day, CAST(CAST(CAST(total_cost AS VARCHAR) AS DECIMAL(38,18)) AS DOUBLE) AS declared, CAST(found_cost AS DOUBLE) AS found FROM declared WHERE abs(CAST(CAST(total_cost AS VARCHAR) AS DECIMAL(38,18)) - found_cost) > 0.00000001",
    "K8_duplicate_keys": "SELECT * FROM dups",
    "K8_withheld": "SELECT event_id FROM daily_obs WHERE day NOT IN (SELECT day FROM dups WHERE day(day) < 20)",
    "K9_check_rates": "SELECT event_id, reported_ms_per_1k FROM (SELECT *, CASE WHEN perf_timed_tokens > 0 THEN 1000.0::DOUBLE * perf_duration_ms / perf_timed_tokens ELSE 0.0 END + CASE WHEN message_count = 3 THEN 0.5 ELSE 0.0 END AS reported_ms_per_1k FROM daily_obs) WHERE perf_duration_ms IS NOT NULL AND reported_ms_per_1k IS NOT NULL AND (message_count = 3 OR (perf_timed_tokens = 0 AND perf_duration_ms <> 0))",
    "K10_issues": "SELECT 'run-1' AS run_id, check_name, arg_max(concat_ws(' ', 'declared', declared, 'found', found), day) AS message, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM bad_totals GROUP BY check_name",
    "K11_resolved_issues": "SELECT event_id FROM cur_issue WHERE NOT resolved AND issue_key <> 'key-3' AND check_name IN ('check-1', 'check-2') AND source_id NOT IN ('src-1', 'src-2')",
    "K12_resolved_drift": "SELECT event_id FROM cur_drift d WHERE NOT resolved AND domain = 'models' AND NOT EXISTS (SELECT 1 FROM cur_drift a WHERE a.drift_key LIKE '%3' AND a.domain = d.domain AND a.payload_ver = d.payload_ver AND a.drift_key = d.drift_key)",
    "K13_price_coverage": """SELECT day, expected_count, succeeded_count, CASE WHEN unsafe AND succeeded_count > 0 THEN 'partial' WHEN succeeded_count = 0 THEN 'failed' WHEN succeeded_count < expected_count THEN 'partial' ELSE 'complete' END AS status
FROM (SELECT w.day, count(*) AS expected_count, count(p.model) AS succeeded_count, coalesce(w.day IN (SELECT day FROM dups WHERE duplicates > 800), FALSE) AS unsafe FROM (SELECT DISTINCT day, source_id, model FROM cur_daily) w LEFT JOIN (SELECT DISTINCT day, source_id, model FROM cur_price) p USING (day, source_id, model) GROUP BY w.day)""",
    "K13_target_statuses": "SELECT * FROM targets",
    "K14_day_plan": """WITH m AS (SELECT source_id, day, status = 'complete' AS done FROM status WHERE domain = 'models'), c AS (SELECT DISTINCT source_id, day FROM cur_daily), e AS (SELECT * FROM c UNION SELECT source_id, day FROM m WHERE NOT done)
SELECT source_id, day, reason FROM (SELECT e.*, CASE WHEN e.day >= date '2024-02-15' THEN 'open' WHEN e.day IN (SELECT c.day FROM c WHERE c.source_id = e.source_id AND c.day < date '2024-02-15') AND (SELECT count(*) FROM c WHERE c.source_id = e.source_id AND c.day < date '2024-02-15' AND c.day > e.day) < 3 THEN 'overlap'
  WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.source_id = e.source_id AND m.day = e.day AND m.done) THEN 'incomplete' END AS reason FROM e) WHERE reason IS NOT NULL""",
    "K14_refresh_plan": "WITH e AS (SELECT source_id, day FROM cur_daily UNION SELECT source_id, day FROM status WHERE domain = 'models'), g AS (SELECT source_id, coalesce(min(day) FILTER (day <= date '2024-02-10'), date '2024-02-10') AS since FROM e GROUP BY source_id) SELECT source_id, CAST(unnest(generate_series(since, date '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day, 'refresh' AS reason FROM g",
    "K15_price_gaps": "SELECT DISTINCT source_id, model FROM cur_daily f WHERE (day = date '2024-02-15' OR NOT EXISTS (SELECT 1 FROM cur_price p WHERE p.source_id = f.source_id AND p.model = f.model)) AND NOT EXISTS (SELECT 1 FROM cur_price p WHERE p.source_id = f.source_id AND p.model = f.model AND p.day = date '2024-02-15')",
    "K15_session_gaps": f"SELECT f.source_id, f.client, f.session_id, CASE WHEN s.session_id IS NULL THEN 'missing' ELSE 'undated' END AS gap FROM (SELECT DISTINCT {SES} FROM cur_daily) f LEFT JOIN cur_session s USING ({SES}) WHERE s.session_id IS NULL OR s.session_id LIKE '%5'",
    "K15_report_days": f"SELECT source_id, CAST(created_at AS DATE) AS day FROM cur_session WHERE ({SES}) IN (SELECT ({SES}) FROM cur_daily) UNION SELECT source_id, day FROM status WHERE domain = 'report' AND status <> 'complete'",
    "K15_full_report": f"SELECT source_id FROM every_source WHERE source_id NOT IN (SELECT source_id FROM status WHERE source_id <> 'src-3' AND domain = 'report' AND status = 'complete') OR source_id = 'src-2' AND EXISTS (SELECT 1 FROM cur_daily f LEFT JOIN cur_session s USING ({SES}) WHERE f.source_id = 'src-2' AND (s.session_id IS NULL OR s.created_at IS NULL))",
    "L1_recent_runs": "SELECT source_id, run_id, day, status, started_at, finished_at, host FROM runs ORDER BY started_at DESC, run_id DESC, source_id, day LIMIT 20",
    "L2_audit_sources": "SELECT * FROM audited",
    "L3_same_host": "SELECT a.source_id, b.source_id AS other_id, a.host FROM audited a JOIN audited b ON a.source_id < b.source_id AND a.host = b.host AND a.os_name = b.os_name AND a.architecture = b.architecture AND a.cpu_count = b.cpu_count AND a.memory_bytes = b.memory_bytes AND coalesce(a.cpu_model = b.cpu_model, TRUE) AND coalesce(a.os_version = b.os_version, TRUE) WHERE a.collected_at >= timestamp '2024-04-01' - INTERVAL 90 DAY AND b.collected_at >= timestamp '2024-04-01' - INTERVAL 90 DAY",
    "L4_unresolved_targets": "SELECT * FROM bad_targets",
    "L5_ingest_issues": f"""WITH t AS ({best("cur_ledger", "source_id, day, domain", "collected_at, finished_at, event_id", "domain <> 'collection'")}), b AS (SELECT source_id, run_id, day, domain, status, collected_at FROM t WHERE status NOT IN ('complete', 'provisional'))
SELECT * FROM b UNION ALL SELECT source_id, run_id, day, 'collection', status, collected_at FROM bad_runs WHERE run_id NOT IN (SELECT run_id FROM b)""",
    "L6_newest_open_drift": f"SELECT * FROM cur_drift WHERE NOT resolved AND collected_at >= {NOW} ORDER BY collected_at DESC NULLS LAST, source_id, domain, payload_ver, drift_key LIMIT 20",
    "L7_newest_open_issues": f"SELECT * FROM cur_issue WHERE NOT resolved AND collected_at >= {NOW} ORDER BY collected_at DESC NULLS LAST, source_id, check_name, issue_key LIMIT 20",
    "L8_backlog": "SELECT source_id, day, arrival_day, rows_seen - rows_done AS pending, CAST(date_diff('day', arrival_day, date '1998-03-01') AS INTEGER) AS age_days, CASE WHEN date_diff('day', arrival_day, date '1998-03-01') >= 80 THEN 'error' ELSE 'warn' END AS severity FROM cand WHERE date_diff('day', arrival_day, date '1998-03-01') >= 2",
    "M1_candidates": "SELECT * FROM cand",
    "M2_compact_daily": raw_gold("(SELECT * FROM raw WHERE day IN (SELECT day FROM cand))", "gold") + " WHERE b.day IN (SELECT day FROM cand)",
    "M2_published_daily": raw_gold("(SELECT * FROM monthly)", "monthly98"),
    "M4_published_progress": "SELECT source_id, day, CAST(collected_at AS DATE) AS arrival_day, count(*) AS rows_done FROM monthly GROUP BY ALL",
    "M5_left_after_expiry": "SELECT DISTINCT CAST(collected_at AS DATE) AS arrival_day FROM monthly WHERE collected_at >= timestamp '1998-01-01'",
    "M6_as_of_commit": best("monthly", KEY, "collected_at, total_tokens, event_id", f"collected_at >= {CUT97}", DAILY),
    "P1_ingested_daily": f"SELECT {DAILY} FROM daily_obs",
    "P2_streamed_daily": f"SELECT {DAILY} FROM history",
    "N1_session_issues": "SELECT i.event_id, i.check_name, CASE old_check WHEN 'check-1' THEN concat('cli-a/', k.p) WHEN 'check-2' THEN k.p ELSE issue_key END AS issue_key, s.p AS session_id FROM session_issue i LEFT JOIN session_names k ON k.v = i.issue_key LEFT JOIN session_names s ON s.v = i.session_id",
    "N5_nested_hosts": "SELECT event_id, h AS host, concat('ran on ', h, '.lan') AS line, concat(h, '!') AS first, '<path>' AS place FROM (SELECT event_id, concat('host-', (['alpha','bravo','charlie','delta','echo','foxtrot'])[dense_rank() OVER (ORDER BY host)]) AS h FROM ledger_obs)",
    "M3_compact_tags": "SELECT * EXCLUDE (is_upsert) FROM ranked_tag t WHERE EXISTS (SELECT 1 FROM tag_obs o WHERE o.op = 'delete' AND o.scope = t.scope AND o.client = t.client AND o.workspace = t.workspace AND o.session_id = t.session_id AND o.tag = t.tag)",
    "M4_progress": "SELECT source_id, day, arrival_day, rows_seen AS rows_done FROM cand",
    "M5_expired": "SELECT DISTINCT arrival_day, arrival_day IN (SELECT arrival_day FROM cand) AS pending FROM raw WHERE arrival_day < date '1998-06-01' - 90",
    "M6_pinned": best("daily_obs", KEY, "collected_at, total_tokens, event_id", "collected_at <= timestamp '1997-07-01'", DAILY),
    "N1_pseudonyms": "SELECT value, concat('workspace-', CASE WHEN n <= 10 THEN (['alpha','bravo','charlie','delta','echo','foxtrot','golf','hotel','india','juliet'])[n] ELSE CAST(n AS VARCHAR) END) AS pseudonym FROM (SELECT value, row_number() OVER (ORDER BY value) AS n FROM (SELECT DISTINCT workspace AS value FROM cur_session))",
    "N1_anonymised_tags": f"SELECT event_id, scope, {pseudonym('workspace', 'workspace')}, {pseudonym('session_id', 'session')}, {pseudonym('tag', 'tag')} FROM cur_tag",
    "N2_notes_redacted": "SELECT event_id, '[redacted]' AS note FROM cur_note",
    "O1_add_tags": "SELECT DISTINCT scope, client, workspace, session_id, tag, 'upsert' AS op, timestamp '2024-03-01' AS updated_at FROM asked a WHERE NOT (scope = 'client' AND workspace <> '') AND NOT EXISTS (SELECT 1 FROM cur_tag t WHERE t.scope = a.scope AND t.client = a.client AND t.workspace = a.workspace AND t.session_id = a.session_id AND t.tag = a.tag)",
    "O2_rename_tags": "SELECT scope, client, session_id, tag, 'delete' AS op, created_at FROM cur_tag WHERE scope = 'session' UNION ALL SELECT scope, client, session_id, concat(tag, '-2'), 'upsert', created_at FROM cur_tag WHERE scope = 'session'",
    "O3_set_notes": f"SELECT {SES}, a.note, 'upsert' AS op, coalesce(n.created_at, timestamp '2024-03-01') AS created_at, timestamp '2024-03-01' AS updated_at FROM asked_note a LEFT JOIN cur_note n USING ({SES}) WHERE a.note IS DISTINCT FROM n.note",
    "O4_remove_notes": f"SELECT {SES}, 'delete' AS op, created_at FROM cur_note WHERE session_id LIKE '%1'",
    "N3_credentials": "SELECT l_orderkey, l_linenumber, concat('run ', l_orderkey, ' ', (['API_KEY', 'x-auth-token', 'PGPASSWORD', 'MONKEY', 'KEYBOARD', 'tokenizer', 'my_secret_2', 'AUTH_METHOD', 'mode'])[CAST(l_partkey % 9 AS INT) + 1], CASE WHEN l_linenumber % 2 = 0 THEN '=' ELSE ': ' END, CASE WHEN l_partkey % 9 IN (0, 1, 2, 6) THEN '<redacted>' ELSE concat('v', l_suppkey) END, ' end') AS line FROM lineitem",
    "N4_paths": "SELECT l_orderkey, l_linenumber, concat('at ', (['<path> b', '<path>', '<path>', '3/4', 'no', '(<path>)'])[CAST(l_partkey % 6 AS INT) + 1], ', line ', l_suppkey) AS place FROM lineitem",
    "N6_addresses": "SELECT l_orderkey, l_linenumber, concat('from ', (['...', 'a...', 'a...', 'ab...', 'a....', '...'])[CAST(l_partkey % 6 AS INT) + 1], (['@gmail.com', '@<domain>', '@<domain> now'])[CAST(l_suppkey % 3 AS INT) + 1]) AS mail FROM lineitem",
    "N7_visible_urls": "SELECT page_id, concat(url, '\\u0009\\u000a', CASE page_id % 3 WHEN 0 THEN '\\u200b' WHEN 1 THEN '\\ue0001' ELSE 'x' END) AS shown FROM pages",
    "O5_note_ids": "SELECT session_id, note_id FROM note_named",
    "O6_scope_rejects": "SELECT scope, client, workspace, session_id, tag FROM asked WHERE scope = 'client' AND workspace <> ''",
}


def with_ctes(body: str) -> str:
    """The body, after the CTEs that it needs, each after those that it needs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                need(CTES[name])
                order.append(name)

    need(body)
    inner = body
    listed = [f"{name} AS ({CTES[name]})" for name in order]
    if inner.startswith("WITH "):
        return "WITH " + ", ".join([*listed, inner[5:]])
    return ("WITH " + ", ".join(listed) + "\n" if listed else "") + inner


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in QUERIES.items()}
