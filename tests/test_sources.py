"""Payload scans, snapshots, restores, exports, streaming ingest and what isn't expressible in SQL."""

import base64
import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerwright.functions.ids import normal_note_id, note_id
from ledgerwright.operators import privacy, quality, reports
from ledgerwright.sources import payloads, tables


def test_daily_payload_files(spark, tmp_path):
    entry = {"client": "c", "sessionId": "x", "model": "m", "provider": "p", "input": 3, "output": 4, "cacheRead": 1, "messageCount": 2, "cost": 0.5, "performance": {"totalDurationMs": 10, "timedTokens": 5}}
    (tmp_path / "golden-2026-09-10.daily.json").write_text(json.dumps({"groupBy": "model", "entries": [entry, {"client": "d", "sessionId": "y", "model": "m"}], "totalInput": 3}))
    (tmp_path / "golden-2026-09-11.daily.json").write_text(json.dumps({"groupBy": "model"}))
    (tmp_path / "golden-2026-09-12.daily.json").write_text('{"entries": [null]}')
    (tmp_path / "golden-2026-09-13.daily.json").write_text("{broken")
    entries, totals, bad = payloads.parse_daily(payloads.read_payloads(spark, str(tmp_path)))
    got = sorted(entries.select("day", "pos", "total_tokens", "perf_duration_ms").collect())
    assert [tuple(r) for r in got] == [(dt.date(2026, 9, 10), 0, 8, 10), (dt.date(2026, 9, 10), 1, 0, None)]
    assert totals.count() == 2
    assert {r["day"].day for r in bad.collect()} == {12, 13}


def test_times(spark):
    rows = [("1757462400000",), ("2025-09-10T00:00:00Z",), ("2025-09-10T00:00:00",), ("true",), ("NaN",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(payloads.to_time(F.col("v")).cast("long")).collect()]
    assert got == [1757462400, 1757462400, 1757462400, None, None, None]


def test_report_rows_merge(spark):
    cols = "client string, session_id string, workspace string, workspace_label string, created_at int, last_active int, message_count int, models_used array<string>, pos int"
    rows = [("c", "a", "w", None, 5, None, 1, ["m2"], 0), ("c", "a", "w", None, 3, 9, 2, ["m1", "m2"], 1), ("c", "a", "w", None, 4, 9, 3, None, 2), ("c", "b", "w", None, 1, 1, 1, [], 3), ("c", "b", "v", None, 1, 1, 1, [], 4)]
    merged, clashes = payloads.merge_sessions(spark.createDataFrame(rows, cols))
    row = merged.first()
    assert (row["created_at"], row["last_active"], row["message_count"], row["models_used"]) == (3, 9, 3, ["m1", "m2"])
    assert [r["session_id"] for r in clashes.collect()] == ["b"]


def test_duplicate_dates_of_a_payload(spark):
    days = [{"date": "2026-09-10"}, {"date": "2026-09-11"}, {"date": "2026-09-10"}]
    df = spark.createDataFrame([("f", json.dumps({"meta": {"version": "1"}, "contributions": days}))], "file string, json string")
    got, twice = payloads.parse_graph(df)
    assert got.count() == 2 and [str(r["date"]) for r in twice.collect()] == ["2026-09-10"]


def test_snapshot_verify_restore(spark, tmp_path):
    cols = tables.SCHEMAS["price_versions"]
    rows = [("e1", "s", "m", "x", None, None, dt.date(2026, 9, 1), 1.0, None, None, None, dt.datetime(2026, 9, 2)), ("e2", "s", "n", "x", None, None, dt.date(2026, 9, 1), 1.0, None, None, None, dt.datetime(2026, 9, 2))]
    prices = spark.createDataFrame(rows, cols)
    folder = str(tmp_path / "snap")
    tables.write_snapshot({"price_versions": prices}, folder)
    assert tables.verify_snapshot(spark, folder, ["price_versions"]).isEmpty()
    assert [tuple(r) for r in tables.verify_snapshot(spark, folder, ["price_versions", "notes"]).collect()] == [("notes", "missing")]
    target = str(tmp_path / "restored")
    assert tables.restore(spark, folder, target, "op-1") is True
    assert tables.restore(spark, folder, target, "op-1") is False
    with pytest.raises(ValueError):
        tables.restore(spark, folder, target, "op-2")
    assert spark.read.parquet(f"{target}/price_versions").count() == 2
    prices.limit(1).write.mode("overwrite").parquet(f"{folder}/price_versions")
    spark.catalog.clearCache()
    assert {r["problem"] for r in tables.verify_snapshot(spark, folder, ["price_versions"]).collect()} == {"rows", "digest"}


def test_append_rejects_nulls_and_partitions_by_arrival(spark, tmp_path):
    row = {"event_id": "e", "source_id": "s", "collected_at": dt.datetime(2026, 9, 2, 5)}
    tables.append(spark.createDataFrame([row]), str(tmp_path), "notes")
    assert (tmp_path / "notes" / "arrival_day=2026-09-02").exists()
    with pytest.raises(Exception, match="source_id is null"):
        tables.append(spark.createDataFrame([{**row, "source_id": None}], "event_id string, source_id string, collected_at timestamp"), str(tmp_path), "notes")


def test_export_is_anonymised(spark, tmp_path):
    rows = spark.createDataFrame([("secret-host", "ws", "hello"), (None, "ws", None)], "host string, workspace string, note string")
    tables.export(rows, str(tmp_path / "out"), "json")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    secret = spark.createDataFrame([("password=hunter22222 at /home/bob/x", ["token: abc"])], "message string, parts array<string>")
    tables.export(secret, str(tmp_path / "safe"), "json")
    safe = "".join(p.read_text() for p in (tmp_path / "safe").glob("*.json"))
    assert "hunter" not in safe and "bob" not in safe and "abc" not in safe and safe.count("<redacted>") == 2
    assert "secret-host" not in text and "host-alpha" in text and text.count("workspace-alpha") == 2 and "[redacted]" in text
    tables.export(rows, str(tmp_path / "raw"), "csv", raw=True)
    with pytest.raises(ValueError):
        tables.export(rows, str(tmp_path / "x"), "yaml")


def test_note_ids_equal_uuid5(spark):
    keys = [("s", "c", "x"), ('q"uote', "ünï", "日本"), ("", "a\\b", "line\nbreak")]
    got = [r[0] for r in spark.createDataFrame(keys, "a string, b string, c string").select(note_id("a", "b", "c")).collect()]
    want = ["n_" + base64.urlsafe_b64encode(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(list(k), ensure_ascii=False, separators=(",", ":"))).bytes).decode().rstrip("=") for k in keys]
    assert got == want
    rows = spark.createDataFrame([(f" {want[0]} ",), (want[0][2:],), ("n_short",)], "v string").select(normal_note_id("v")).collect()
    assert [r[0] for r in rows] == [want[0], want[0], None]


def plain_profile(value):
    """path: (types, present, records) of one payload, by looking up every path in every member."""

    def kind(v):
        return "null" if v is None else "bool" if isinstance(v, bool) else {int: "int", float: "float", str: "str", list: "array", dict: "object"}[type(v)]

    def below(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                yield f"{path}.{k}" if path else k, kind(x)
                yield from below(x, f"{path}.{k}" if path else k)
        elif isinstance(v, list):
            for x in v:
                yield from below(x, f"{path}[]")

    def arrays(v, path):
        if isinstance(v, list):
            yield path, v
        elif isinstance(v, dict):
            for k, x in v.items():
                yield from arrays(x, f"{path}.{k}" if path else k)

    out = {p: ({t}, 1, 1) for p, t in below(value, "") if "[]" not in p}
    for path, members in arrays(value, ""):
        each = [dict.fromkeys(p for p, _ in below(m, f"{path}[]")) for m in members]
        types = {}
        for m in members:
            for p, t in below(m, f"{path}[]"):
                types.setdefault(p, set()).add(t)
        for p, seen in types.items():
            out[p] = (seen, len(seen) if all(p in e for e in each) else 0, len(seen))
    return out


def excused(value, path):
    """Whether every chain that leads to the path ends in an empty array."""
    names = path.split(".")

    def chains(v, k):
        name = names[k].removesuffix("[]")
        if name:
            if not isinstance(v, dict) or name not in v:
                return [False]
            v = v[name]
        if names[k].endswith("[]"):
            if not isinstance(v, list):
                return [False]
            return [True] if not v else [c for m in v for c in (chains(m, k + 1) if k + 1 < len(names) else [False])]
        return chains(v, k + 1) if k + 1 < len(names) else [False]

    return all(chains(value, 0))


PAYLOADS = [
    {"b": [{"c": 1}, {}]}, {"b": []}, {"x": 1}, {"b": [{"c": 1.5}, {"c": None}], "e": []}, {"b": {"c": 2}}, {"b": [1, {"c": "x"}], "e": [{"z": [{"w": 1}, {}]}, {"z": []}]}, {"e": [{"z": []}, {"z": []}]},
    {"e": [{"z": []}, {}]}, {"e": [{"z": {}}]}, [], [{"a": 1}, {"a": True, "b": []}], [[{"a": 1}], [{}]], {"n": [[{"a": 1}], []]}, {"e": [[], [{"z": 1}]]}, {"d": {"e": {"f": [{"g": []}]}}}, {"b": [None]}, 7, "text", {}, None,
]
CONTRACT = [("b", ["array"], True), ("b[].c", ["float", "null"], True), ("e", ["array"], False), ("e[].z", ["array"], True), ("e[].z[].w", ["int"], True), ("[].a", ["int"], True), ("d.e.f[].g[].h", ["str"], True), ("n[][].a", ["int"], True), ("gone", ["int"], True)]


def test_profiles_contracts_and_waivers_equal_recursion(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(PAYLOADS)], "payload_id int, json string")
    profile = quality.payload_profile(quality.json_nodes(df))
    got = {}
    for r in profile.where("records > 0").collect():
        got.setdefault(r["payload_id"], {})[r["path"]] = (set(r["types"]), r["present"], r["records"])
    want = {k: p for k, v in enumerate(PAYLOADS) if (p := plain_profile(v))}
    assert got == want
    contract = spark.createDataFrame(CONTRACT, "path string, types array<string>, required boolean")
    absent = quality.absent_paths(contract, profile)
    waived = {tuple(r) for r in quality.empty_array_paths(profile, absent).collect()}
    gone = {(k, p) for k, v in enumerate(PAYLOADS) for p, _, needed in CONTRACT if needed and p not in plain_profile(v)}
    assert {(r["payload_id"], r["path"]) for r in absent.collect()} == gone
    assert waived == {(k, p) for k, p in gone if excused(PAYLOADS[k], p)} and (1, "b[].c") in waived and (2, "b[].c") not in waived
    events = set()
    for k, v in enumerate(PAYLOADS):
        found = plain_profile(v)
        for p, types, needed in CONTRACT:
            if p not in found:
                if needed and (k, p) not in waived:
                    events.add((k, f"missing_field:{p}", f"required types {', '.join(types)}; absent", True))
            elif needed and found[p][1] < found[p][2]:
                events.add((k, f"missing_field:{p}", f"present on {found[p][1]}/{found[p][2]} array members", True))
            elif found[p][0] - set(types) - ({"int"} if "float" in types else set()):
                events.add((k, f"type_change:{p}", f"expected {', '.join(types)}; got {', '.join(sorted(found[p][0]))}", needed))
        events |= {(k, f"unknown_field:{p}", f"types {', '.join(sorted(t))}; tolerated", False) for p, (t, _, _) in found.items() if p not in {c[0] for c in CONTRACT}}
    assert {(r["payload_id"], r["drift_key"], r["detail"], r["fatal"]) for r in quality.diff_contract(contract, profile).collect()} == events
    assert (0, "missing_field:b[].c", "present on 0/1 array members", True) in events


def test_contracts_of_many_payloads(spark):
    df = spark.createDataFrame([(0, '{"a": 1, "b": [{"c": 1}, {}]}'), (1, '{"a": 2.5, "b": []}'), (2, '{"a": null}')], "payload_id int, json string")
    pooled = quality.json_profile(quality.payload_profile(quality.json_nodes(df)))
    assert {r["path"]: (r["types"], r["present"], r["payloads"]) for r in pooled.collect()} == {"a": (["float", "int", "null"], 3, 3), "b": (["array"], 2, 3), "b[].c": (["int"], 0, 3)}
    assert {r["path"]: r["required"] for r in quality.build_contract(pooled).collect()} == {"a": True, "b": False, "b[].c": False}
    assert not quality.build_contract(pooled, ("a",)).where("path = 'a' and required").count()


def test_json_has_no_deepest_level(spark):
    deep = '{"a": ' * 60 + "1" + "}" * 60
    rows = [deep, '{"odd": "x\\"[[{{"}', "[" * 8 + "1.5" + "]" * 8, "[" * 40, "7", None, '{"x": NaN}', "[" * 100_000]
    nodes = quality.json_nodes(spark.createDataFrame(list(enumerate(rows)), "payload_id int, json string"))
    got = {(r["payload_id"], r["path"]): r["type"] for r in nodes.collect()}
    assert got[0, ".".join("a" * 60)] == "int" and got[1, "odd"] == "str" and got[2, "[]" * 8] == "float" and got[4, ""] == "int"
    assert all(got[k, ""] == "invalid" for k in (3, 5, 6, 7))
    assert quality.json_nodes(spark.createDataFrame([], "payload_id int, json string")).isEmpty()


def test_paths_with_blanks(spark):
    cases = {
        r"saved C:\Users\Bob Smith\my notes.txt, then left": "saved <path>, then left",
        r"see 'D:\a b\c d' and more": "see <path> and more",
        r"on \\host\share x\f.csv: read": "on <path>: read",
        r"in C:\Users\bob now": "in <path> now",
        r"C:/tmp/x y.log[3]: broken": "<path>[3]: broken",
        "http://example.org/a is a link": "http:<path> is a link",
        "ratio 3/4 and ~/x y": "ratio 3/4 and <path> y",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", privacy.redact_paths(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == cases


def test_issue_keys_share_the_pseudonym_of_their_session(spark):
    rows = [("models_report_session_set", "cli/ses-secret-1", "ses-secret-1"), ("models_report_cost", "ses-secret-2", None), ("models_payload_totals", "2026-01-01/ses-secret-1", None), ("models_report_metric", "cli/a/b", "ses-secret-1")]
    got = privacy.pseudonymise(spark.createDataFrame(rows, "check_name string, issue_key string, session_id string")).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: [x[0] for x in rows].index(r[0]))] == [("cli/session-bravo", "session-bravo"), ("session-charlie", None), ("2026-01-01/ses-secret-1", None), ("cli/session-alpha", "session-bravo")]


def test_hosts_are_replaced_in_nested_text_longest_first(spark):
    rows = [("box", ("on box2 and box", {"k": ["box2:80", None]}, 5), None), ("box2", None, "box2")]
    df = spark.createDataFrame(rows, "host string, info struct<line: string, more: map<string, array<string>>, n: int>, note string")
    got = sorted(map(tuple, privacy.share_safe(df).collect()), key=lambda r: r[0])
    assert got[0][0] == "host-alpha" and tuple(got[0][1]) == ("on host-bravo and host-alpha", {"k": ["host-bravo:80", None]}, 5) and got[1] == ("host-bravo", None, "[redacted]")


def test_input_rows_are_counted_by_the_write(spark, tmp_path):
    counts = payloads.write_inputs({"entries": spark.range(7), "sessions": spark.range(0), "contributions": spark.range(2).withColumn("x", F.lit("y"))}, str(tmp_path / "in"))
    assert counts == {"entries": 7, "sessions": 0, "contributions": 2}
    assert spark.read.parquet(str(tmp_path / "in")).count() == 9


def test_redaction(spark):
    cases = {
        "see https://bob:hunter2@example.org": "see https:<path>",
        "GET x?api_key=abc123&x=1": "GET x<redacted-query>&x=1",
        "Authorization: Bearer abcdefgh12345": "Authorization: <redacted>",
        "password = hunter22 and max_tokens=500": "password = <redacted> and max_tokens=500",
        "open /data/bob/notes.txt now": "open <path> now",
        r"open C:\Users\bob\x.txt now": "open <path> now",
        "plain text 3/4 stays": "plain text 3/4 stays",
        "PGPWD=a MY_KEY='b c' api-key=d x_MYSQL_PWD=e": "PGPWD=a MY_KEY=<redacted> api-key=<redacted> x_MYSQL_PWD=<redacted>",
        "MONKEY=1 KEYBOARD=2 TOKENIZER=3 AUTH_TYPE=4 PWD=5": "MONKEY=1 KEYBOARD=2 TOKENIZER=3 AUTH_TYPE=4 PWD=5",
        '{"client_secret": "x y", "n": 1}': '{"client_secret": <redacted>, "n": 1}',
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", privacy.sanitize_text(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == cases
    secret = 'opaque /value"\ncredential'
    text = 'opaque /value"\ncredential opaque%20%2Fvalue%22%0Acredential opaque+%2Fvalue%22%0Acredential opaque /value\\"\\ncredential'
    assert spark.createDataFrame([(text,)], "t string").select(privacy.redact_credentials(F.col("t"), (secret,))).first()[0] == " ".join(["<redacted>"] * 4)
    mail = {"abc@gmail.com": "a...@gmail.com", "a@gmail.com": "...@gmail.com", "sam+usage@outlook.com": "sa...@outlook.com", "isabelle@company.example": "is...@<domain>", "no mail": "no mail"}
    rows = spark.createDataFrame([(k,) for k in mail], "t string").select("t", privacy.mask_addresses(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == mail
    shown = spark.createDataFrame([("a\tb\u200bc\U000e0001",)], "t string").select(privacy.visible(F.col("t"))).first()[0]
    assert shown == "a\\u0009b\\u200bc\\ue0001"


def test_pseudonyms_are_consistent_and_numbered_past_ten(spark):
    rows = spark.createDataFrame([(f"h{k:02}",) for k in range(12)] * 2, "v string")
    got = {r["value"]: r["pseudonym"] for r in privacy.pseudonyms(rows, "v", "host").collect()}
    assert got["h00"] == "host-alpha" and got["h09"] == "host-juliet" and got["h10"] == "host-11" and got["h11"] == "host-12" and len(got) == 12


def test_filters_are_checked():
    with pytest.raises(ValueError):
        reports.Filters(since="2024-1-1").days()
    with pytest.raises(ValueError):
        reports.Filters(since="2024-01-02", until="2024-01-01").days()


def test_relation_queries_are_bounded(spark):
    df = spark.range(3)
    for bad in (("other", {}, 1), ("r", {"nope": 1}, 1), ("r", {}, 0), ("r", {}, 10_001)):
        with pytest.raises(ValueError):
            reports.relation_query({"r": df}, *bad)


def test_profiles_in_one_walk_equal_those_of_nodes_and_shuffle_nothing(spark):
    odd = [{"b[]": {"c": 1}, "b": [{"c": 2}, {}]}, {"b": [[], [{"c": 1}]], "": {"": 1}}]
    texts = [json.dumps(v) for v in PAYLOADS + odd] + [None, "{", '{"x": NaN}']
    df = spark.createDataFrame(list(enumerate(texts)), "payload_id int, json string")
    whole = quality.profiles(df)
    flat = whole.select("payload_id", F.inline("fields"))
    nodes = quality.payload_profile(quality.json_nodes(df))
    assert sorted(map(tuple, flat.select(*nodes.columns).collect())) == sorted(map(tuple, nodes.collect()))
    contract = spark.createDataFrame(CONTRACT, "path string, types array<string>, required boolean")
    one, two = quality.diff_contract(contract, whole), quality.diff_contract(contract, nodes)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert sorted(map(tuple, quality.waived_paths(contract, whole).collect())) == sorted(map(tuple, quality.empty_array_paths(nodes, quality.absent_paths(contract, nodes)).collect()))
    plan = one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan  # each text is read once, and no payload leaves its task
    assert sorted(map(tuple, quality.json_profile(whole).collect())) == sorted(map(tuple, quality.json_profile(nodes).collect()))


def test_json_profile_shows_the_root_where_wanted(spark):
    df = spark.createDataFrame([(0, '{"k": 1}'), (1, "{"), (2, "{}")], "payload_id int, json string")
    got = {r["path"]: (r["types"], r["present"], r["payloads"]) for r in quality.json_profile(quality.profiles(df), root=True).collect()}
    assert got == {"": (["invalid", "object"], 3, 3), "k": (["int"], 1, 3)}
