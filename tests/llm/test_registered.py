"""The registered queries on the small tables, whole, against plain Python."""

import hashlib
import re

import numpy as np
import pytest
from test_duplicates import brute_components, brute_repeats

from ledgerwright.llm import personal_data, queries

QUERIES = queries.queries()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return dict(sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op3(spark, sf_dir, texts):
    ids = list(texts)
    want = {i: (n, ids[c]) for i, (n, c) in zip(ids, brute_components(list(texts.values())), strict=True)}
    got = QUERIES["op3_ngram_jaccard_join"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_op4(spark, sf_dir, texts):
    patterns = {"assign": r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}
    least = {"assign": 8, "access": 16, "hex": 32}
    for r in QUERIES["op4_secret_scan"](spark, sf_dir).collect():
        found = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, texts[r["doc_id"]] or "") if len(m[1]) >= least[k]]
        assert [r[f"n_{k}"] for k in patterns] == [sum(x[0] == k for x in found) for k in patterns]
        base = sorted(found, key=lambda x: (x[1], list(patterns).index(x[0])))
        assert r["base_sha256"] == digest(base)
        every = [x for x in r["spans"].split(",") if x]
        assert [x for x in every if not x.startswith("crf")] == [f"{k}:{a}:{b}" for k, a, b in base]


def test_op5(spark, sf_dir, texts):
    got = QUERIES["op5_line_dedup"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == list(texts)
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.translate({c: c + 32 for c in range(65, 91)})).strip(" ")
    seen, kept = set(), set()
    for i, t in texts.items():
        seen |= {normal(x) for x in (t or "").split("\n")}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        before, after = (texts[r["doc_id"]] or "").split("\n"), (r["text"] or "").split("\n")
        assert r["n_lines"] == (0 if texts[r["doc_id"]] is None else len(before))
        rest = iter(before)
        assert r["n_removed"] == len(before) or all(x in rest for x in after)  # a subsequence
        for x in map(normal, after):
            assert not x or x not in kept
            kept.add(x)
    assert len(kept) > 0.5 * len(seen)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op5_finds_nearly_all_pairs_of_near_lines(spark, folder):
    """Pairs of different lines of 12 to 400 code points with an edit similarity of 0.9, found without any hash: of each pair one goes at least, in nine of ten."""
    from test_duplicates import near_pairs

    d = f"/root/testdata/{folder}"
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.translate({c: c + 32 for c in range(65, 91)})).strip(" ")
    texts_ = [r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect()]
    lines = sorted({x for t in texts_ for x in map(normal, t.split("\n")) if 12 <= len(x) <= 400})
    pairs = near_pairs(lines)
    kept = {normal(x) for r in QUERIES["op5_line_dedup"](spark, d).select("text").collect() for x in (r["text"] or "").split("\n")}
    found = [not (a in kept and b in kept) for a, b in pairs]
    assert len(pairs) >= 5 and sum(found) >= 0.9 * len(found)


def test_op6(spark, sf_dir, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for r in QUERIES["op6_personal_data"](spark, sf_dir).collect():
        base = []
        for k, p in patterns.items():
            for m in re.finditer(p, texts[r["doc_id"]] or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(digits) <= 19 and personal_data.luhn(digits) or k == "phone" and 8 <= len(digits) <= 15:
                    base.append((k, m.start(), m.end()))
        assert [r[f"n_{k}"] for k in patterns] == [sum(x[0] == k for x in base) for k in patterns]
        assert r["base_sha256"] == digest(base)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


def test_op9(spark, sf_dir, texts):
    got = QUERIES["op9_suffix_array_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(list(texts.items()))


def test_op2(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, v = np.array([k for k, _ in rows]), np.array([x for _, x in rows], np.float64)
    found = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, sf_dir).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {int(k) for k in ids if k % 20 == 0}
    hits = 0
    for q, near in found.items():
        score = v @ v[ids == q][0]
        place = dict(zip(ids.tolist(), score.tolist(), strict=True))
        assert all(abs(place[k] - s) < 1e-9 for k, s in near.values()) and sorted(near) == list(range(1, min(20, len(ids) - 1) + 1))
        score[ids == q] = -np.inf
        hits += len({k for k, _ in near.values()} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * sum(map(len, found.values()))
