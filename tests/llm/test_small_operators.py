"""Scans, language ID, mixing, decontamination, WARC and neighbours against plain Python, with odd inputs."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerwright.llm import chains, collocations, crf, decontaminate, language, mixing, neighbours, personal_data, secret_scan, warc
from ledgerwright.llm.shared import utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **extra):
    rows = [(k, t, None, f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    for scale in (1, 20):
        emit = (rng.standard_normal((40, 3)) * scale).astype(np.float32)
        trans = rng.standard_normal((3, 3)).astype(np.float32)
        first = np.zeros(40, bool)
        first[[0, 1, 7, 13, 20, 26, 33]] = True
        got = chains.viterbi(emit, trans, first)
        cuts = [*np.flatnonzero(first), 40]
        for a, b in itertools.pairwise(cuts):
            def score(path, a=a):
                return sum(emit[a + k, x] for k, x in enumerate(path)) + sum(trans[x, y] for x, y in itertools.pairwise(path))

            best = max(score(p) for p in itertools.product(range(3), repeat=b - a))
            assert abs(score(got[a:b]) - best) < 1e-3


def test_beliefs_equal_exact_marginals_on_a_tree():
    import itertools

    rng = np.random.default_rng(1)
    emit, chain, skip = rng.standard_normal((4, 3)), rng.standard_normal((3, 3)), rng.standard_normal((3, 3))
    edges = [(np.array([[0, 1], [1, 2]]), chain), (np.array([[1, 3]]), skip)]
    got = crf.beliefs(emit, edges, rounds=60)
    total = np.zeros((4, 3))
    for p in itertools.product(range(3), repeat=4):
        w = np.exp(sum(emit[k, x] for k, x in enumerate(p)) + chain[p[0], p[1]] + chain[p[1], p[2]] + skip[p[1], p[3]])
        for k, x in enumerate(p):
            total[k, x] += w
    assert np.allclose(got, total / total.sum(1, keepdims=True), atol=1e-4)


def test_language_held_out_accuracy_and_mixed_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.op1_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    model = language.fit(docs.where(~language.held_out()))
    by = {lang: docs.where(F.col("lang") == lang).orderBy(F.desc(F.length("text"))).first()["text"][:400] for lang in ("en", "de")}
    odd = [by["en"] + "\n" + by["de"], None, "", "12 34 !!", "привет мир", "x" * 200_000]
    rows = language.label(docs_of(spark, odd), model).orderBy("doc_id").collect()
    langs = [s["lang"] for s in rows[0]["spans"]]
    assert langs[0] == "en" and langs[-1] == "de" and len(langs) <= 6
    assert [r["lang_pred"] for r in rows[1:4]] == ["und"] * 3 and [r["score"] for r in rows[1:4]] == [0.0] * 3
    assert rows[4]["lang_pred"] in model.languages and rows[5]["lang_pred"] in model.languages
    nothing = language.label(docs_of(spark, ["some text"]), language.fit(docs_of(spark, ["some text"]))).first()
    assert nothing["lang_pred"] == "und"
    assert language.label(docs_of(spark, ["a"]).limit(0), model).count() == 0


def test_secret_scan_base_spans_and_crf(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[: sf_dir.rindex('/')]}/sf0.01/documents.parquet")
    model = secret_scan.fit(docs)
    hexes = "0123456789abcdef" * 2
    odd = [None, "", f"PassWord:  'aB3+/_.=-x' AKIA{'Z' * 12} {hexes}", "token = short", "tokentokentoken=abcdefgh1", "ſecret=abcdefgh1", "ünï " + hexes, "password" + " " * 100_000, "f" * 100_000, f"the deploy key was k9X2mQ7vLp4Rt8Zw1Yb6 and the\napi key, of course {hexes[:-1]}"]
    rows = secret_scan.scan(docs_of(spark, odd), model).orderBy("doc_id").collect()
    pattern = {"assign": r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    for text, row in zip(odd, rows, strict=True):
        want = []
        for k, (kind, p) in enumerate(pattern.items()):
            for m in re.finditer(p, text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    want.append((m.start(), k, kind, m.end()))
        assert [(s["start"], s["kind"], s["end"]) for s in row["secrets"] if s["kind"] != "crf"] == [(a, c, b) for a, _, c, b in sorted(want)]
        exact = [(s["start"], s["end"]) for s in row["secrets"] if s["kind"] != "crf"]
        assert all(s["end"] <= a or b <= s["start"] for s in row["secrets"] if s["kind"] == "crf" for a, b in exact)
    assert secret_scan.scan(docs_of(spark, ["password=abcdefgh"]), None).first()["secrets"][0]["kind"] == "assign"


def test_crf_learns_a_chain():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (400, 12, 1))
    y = np.zeros((400, 12), np.int64)
    y[x[:, :, 0] == 3] = 1
    y[:, 1:][(y[:, :-1] == 1) & (x[:, 1:, 0] == 2)] = 2
    field = crf.fit_chain(x, y, [4], 3, rounds=200)
    first = np.zeros(400 * 12, bool)
    first[::12] = True
    got = chains.viterbi(field.emit([x[:, :, 0].ravel()]).astype(np.float32), field.trans.astype(np.float32), first)
    assert (got == y.ravel()).mean() > 0.99


def test_personal_data_base_spans(spark):
    odd = [
        None, "", "a@b.co, x.y+z@d-e.f.g_h@i.jk @q.r a@b", "1.2.3.4 5.1.2.3.4 256.1.1.1 1.2.3 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111", "+1 (555) 123-4567 +12 +4915112345678901234",
        "+" * 1000 + "1", "a" * 200_000, "9" * 100_000, "1." * 50_000, "ü+49 151 23456789 ü x@y.zz",
    ]
    rows = personal_data.scan(docs_of(spark, odd), None).orderBy("doc_id").collect()
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for text, row in zip(odd, rows, strict=True):
        if text and len(text) > 50_000:
            continue  # the patterns as written need quadratic time here
        want = []
        for kind, p in pattern.items():
            for m in re.finditer(p, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]():
                    want.append((kind, m.start(), m.end()))
        assert [(s["kind"], s["start"], s["end"]) for s in row["personal"]] == want, text
    assert rows[7]["personal"] == [] and rows[8]["personal"] == []


def sample_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir[: sf_dir.rindex('/')]}/sf0.1/documents.parquet").select("doc_id", "text")


def test_skip_edges_carry_a_label_to_a_repeated_token(spark, sf_dir):
    """An address without its last domains is found where it stands beside the whole one, and only there."""
    model = personal_data.fit(sample_docs(spark, sf_dir))
    near, alone = "mail anna.schmidt@corp today. later anna.schmidt@corp.example.org wrote 3 times", "mail anna.schmidt@corp today and 3 more"
    plain = "in 2021 about 12.50 for 3 items, on 2024-05-06 at 10:30"
    texts = [near, alone, plain, near, None, "", "tel 0151-23456789 or so"]
    got = personal_data.scan(docs_of(spark, texts).withColumn("personal", F.lit("clash")), model).orderBy("doc_id").collect()
    added = [[r["text"][x["start"] : x["end"]] for x in r["personal"] if x["added"]] for r in got]
    assert added == [["anna.schmidt@corp"], [], [], ["anna.schmidt@corp"], [], [], ["0151-23456789"]]
    assert [x["kind"] for x in got[0]["personal"]] == ["email", "email"]
    assert personal_data.scan(docs_of(spark, texts).limit(0), model).count() == 0


def test_secret_field_finds_what_no_pattern_names(spark, sf_dir):
    model = secret_scan.fit(sample_docs(spark, sf_dir))
    texts = ["the deploy key was k9X2mQ7vLp4Rt8Zw1Yb6 and more words here", "use ghp_16C7e42F292c6912E7710c838347Ae178B4a to push", "auth: Zk3vQ9xLp2Rt8Zw1Yb6T for it", "just plain words of a sentence, 12 of them in 2021", "see https://example.org/a/b1c2d3e4f5a6b7c8d9", None, ""]
    got = secret_scan.scan(docs_of(spark, [*texts, texts[0]]).withColumn("secrets", F.lit(1)), model).orderBy("doc_id").collect()
    found = [[(x["kind"], r["text"][x["start"] : x["end"]]) for x in r["secrets"]] for r in got]
    assert found[:3] == [[("crf", "k9X2mQ7vLp4Rt8Zw1Yb6")], [("crf", "ghp_16C7e42F292c6912E7710c838347Ae178B4a")], [("crf", "Zk3vQ9xLp2Rt8Zw1Yb6T")]]
    assert found[3:] == [[], [], [], [], found[0]]
    assert secret_scan.scan(docs_of(spark, texts).limit(0), model).count() == 0


def test_marks_alone_are_no_text(spark):
    docs = docs_of(spark, ["un deux trois quatre cinq", "one two three four five six", "one two three"]).withColumn("lang", F.element_at(F.array(F.lit("fr"), F.lit("en"), F.lit("en")), (F.col("doc_id") + 1).cast("int")))
    model = language.fit(docs)
    rows = language.label(docs_of(spark, ["\u0301\u0301 12", "one \u0301", "one two", "one two"]).withColumn("score", F.lit("clash")), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["und", "en", "en", "en"] and rows[0]["score"] == 0.0 and rows[0]["spans"] == []


def test_mixing_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 300]))) if k % 17 else None, None, rng.choice(["a", "b", None, "z"]), 0) for k in range(400)]
    rows += [rows[5]] * 2  # rows that repeat
    got = mixing.mix(spark.createDataFrame(rows, DOCS).withColumn("range", F.lit(7)).withColumn("source_key", F.lit("own")), rows_a_range=50).collect()
    assert {(r["range"], r["source_key"]) for r in got} == {(7, "own")}
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-6) for s in order)
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7), rows_a_range=50).withColumn("range", F.lit(7)).withColumn("source_key", F.lit("own")).select(*got[0].__fields__)
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_decontamination_odd_inputs(spark):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:12])), (2, "Short Item"), (3, None), (4, "..."), (5, " ".join(words[5:16]))], "item_id long, text string")
    texts = [None, "", " ".join(words), "a short, ITEM b", "short x item", " ".join(words[:9]), "é" * 100_000]
    got = decontaminate.decontaminate(docs_of(spark, [*texts, texts[2]]).withColumn("text_hash", F.lit("x")).withColumn("words", F.lit(1)), bench).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(0, 0, []), (0, 0, []), (40, 16, ["1", "5"]), (4, 2, ["2"]), (3, 0, []), (9, 0, []), (1, 0, []), (40, 16, ["1", "5"])]
    none = decontaminate.decontaminate(docs_of(spark, texts), bench.limit(0)).collect()
    assert not any(r["contaminated"] for r in none) and len(none) == len(texts)


def test_warc_round_trip_and_foreign_archives(spark, tmp_path):
    html = ["<a>", "", None, "ü" * 50_000, "<a>", "x\r\n\r\ny"]
    pages = spark.createDataFrame([(k, f"http://x/{k}", h, "extra") for k, h in enumerate(html)] + [(4, "http://x/4", "<a>", "extra")], "page_id long, url string, html string, digest string")
    got = {}
    for r in warc.round_trip(pages, str(tmp_path / "w")).collect():
        got.setdefault(r["page_id"], []).append(r)
    for k, h in enumerate(html):
        raw = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        for r in got[k]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if k == last else ("revisit", last))
    assert len(got[4]) == 2
    files = list((tmp_path / "w" / "normal").glob("*.idx"))
    for side in files:
        data = side.with_suffix("").with_suffix(".warc.gz").read_bytes() if side.name.endswith(".warc.idx") else (side.parent / side.name.replace(".idx", ".warc.gz")).read_bytes()
        for line in side.read_text().splitlines():
            offset, length, record_id = line.split()
            member = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert member.startswith(b"WARC/1.1\r\n") and record_id.encode() in member
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    base = [(k, (centres[k % 40] + 0.3 * rng.standard_normal(16)).tolist()) for k in range(3000)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0] * 3), (9004, [1.0, None] * 8)]
    same = [(5000 + k, base[20][1]) for k in range(60)]
    df = spark.createDataFrame([*base, *odd, *same], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, leaf_rows=100, visited=24).collect()
    ids = np.array([k for k, _ in base + same])
    v = np.array([x for _, x in base + same])
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        rows = sorted(found[int(ids[q])], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        score = np.einsum("d,nd->n", v[q], v)
        place = {int(i): s for i, s in zip(ids, score, strict=True)}
        assert all(abs(place[r["vec_id"]] - r["score"]) < 1e-9 for r in rows) and int(ids[q]) not in {r["vec_id"] for r in rows}
        score[q] = -np.inf
        best = np.lexsort((ids, -np.round(score, 9)))[:20]
        hits += len({r["vec_id"] for r in rows} & set(ids[best].tolist()))
        total += 20
    assert hits / total >= 0.9
    few = neighbours.search(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4
    with pytest.raises(Exception):
        neighbours.search(df.select("vec_id"), F.col("vec_id") == 0).collect()
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_visit_what_recall_needs(spark):
    v = np.random.default_rng(9).standard_normal((4000, 12))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, leaf_rows=20, visited=8).collect():  # 4 trees of 256 leaves
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 20):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits / (200 * 20) >= 0.9


def test_neighbours_in_thousands_of_leaves_that_many_queries_visit(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6000, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0, leaf_rows=4, visited=800, part_queries=2).collect():  # 4 trees of 2,048 leaves
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert len(got) == 60 and all(len(v) == 20 for v in got.values())
    found = 0
    for q, mine in got.items():
        score = np.einsum("d,nd->n", base[q], base)
        score[q] = -np.inf
        found += len(set(np.argsort(-score)[:20].tolist()) & set(mine))
        assert all(abs(score[k] - x) < 1e-12 for k, x in mine.items())
    assert found >= 0.9 * 60 * 20


def test_neighbours_of_two_lengths_and_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(d).tolist()) for d in (4, 7) for k in range(0, 90, 1 if d == 4 else 3)] + [(200 + k, rng.standard_normal(7).tolist()) for k in range(40)]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    want = {}
    for q, v in rows:
        if q % 20 == 0:
            for c, w in rows:
                if c != q and len(v) == len(w):
                    pairs = want.setdefault(q, {})
                    pairs[c] = max(pairs.get(c, -np.inf), round(float(np.dot(v, w)), 9))
    assert got == {q: sorted(p.items(), key=lambda x: (-x[1], x[0]))[:20] for q, p in want.items()}
    parts = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, part_queries=2).orderBy("query_id", "rank").collect():
        parts.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert parts == got


def test_phrases_of_a_length_are_sorted_once(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(40)) for _ in range(300)) for _ in range(3)] + [" ".join(str(k) for k in range(9000))]
    expected = Counter()
    for lang, text in zip("aabb", texts, strict=True):
        words = text.split()
        expected.update((lang, " ".join(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    sorts = []
    for name in ("argsort", "unique"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **k: sorts.append(1) or f(*a, **k))
    got = collocations.count_phrases(*utf8(pa.array(texts)), list("aabb"), 0, 3, 5, np.zeros(16, np.uint8))
    assert len(sorts) <= 1 + 5 + 2  # the tags, a sort a length, and renumbering where five words of 9,000 pass 64 bits
    found = {(r["lang"], r["phrase"]): r["n"] for r in got.to_pylist() if r["phrase"]}
    assert found == expected
