"""Conversation repair, collocations and embedding near-dedup against plain Python."""

import functools
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerwright.llm import collocations, conversations, embeddings, queries

QUERIES = queries.queries()
CONVERSATION = "conv_id long, turn long, role string, text string"


def cheapest(symbols):
    """Cost and least audit by recursion over all edits."""

    @functools.cache
    def go(i, q, run):
        best = (0, "") if i == len(symbols) and q in ("", "a") else None
        role = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
        steps = [("I", 2, i, role, run + 1)] if run < 3 else []
        if i < len(symbols):
            s, cost = symbols[i].lower(), int(symbols[i].isupper())
            steps.append(("D", 3, i + 1, q, 0))
            if s != "x":
                steps.append(("R", 2 + cost, i + 1, role, 0))
                if s == role or s == "s" and q == "":
                    steps.append(("K", cost, i + 1, s, 0))
        for letter, cost, j, r, ins in steps:
            rest = go(j, r, ins)
            if rest is not None and (best is None or (rest[0] + cost, letter + rest[1]) < best):
                best = (rest[0] + cost, letter + rest[1])
        return best

    return go(0, "", 0)


def plain_report(rows):
    """The contract of op11 in plain Python, rows of one turn by role and digest."""
    shown = lambda x: " " if x is None else str(x)
    damaged = {}
    for conv, turn, role, text in rows:
        got = damaged.setdefault(conv, [])
        role, text, kind = shown(role), shown(text), zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            got += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, got in damaged.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = {t for t, _, _ in got if t is not None}
        seen, symbols, faults = set(), "", Counter()
        for _, role, text in got:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            s = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else s.upper() if fault else s
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(got))
        cost, audit = cheapest(symbols)
        left, rows_left, q = list(got), [], ""
        for letter in audit:
            role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[q]
            if letter == "I":
                rows_left.append((role, ""))
            else:
                _, own, text = left.pop(0)
                if letter == "D":
                    continue
                rows_left.append((own if letter == "K" else role, text))
            q = rows_left[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows_left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def test_search_equals_recursion():
    rng = np.random.default_rng(5)
    for k in range(4):
        for s in itertools.product("suaoxSUAO", repeat=k):
            assert conversations.search("".join(s)) == cheapest("".join(s))
    for _ in range(500):
        s = "".join(rng.choice(list("suaoxUASua"), rng.integers(0, 16)))
        assert conversations.search(s) == cheapest(s)


def test_a_long_conversation():
    assert conversations.search("ua" * 20_000 + "u" + "x" * 100) == (302, "K" * 40_001 + "D" * 100 + "I")


def test_op11(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_report(rows)


def test_repair_of_nulls_ties_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    pick = lambda *x: x[rng.integers(len(x))]
    rows = [(pick(1, 2, None, 7), pick(None, 0, 1, 1, 5), pick("user", "assistant", "system", None, "", "uncle", "tool"), pick("Hi.", "so", "", None, " \t", "So? ", "é!")) for _ in range(120)]
    rows += [(50 + k, t, r, f"x{t}.") for k in range(40) for t, r in enumerate(("user", "assistant"))]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], f"{CONVERSATION}, audit string, key int")
    got = conversations.report(conversations.damage(df), df)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_report(rows)
    repaired = conversations.repair(conversations.damage(df), conversations.summarise(conversations.damage(df)))
    for _, group in itertools.groupby(repaired.collect(), lambda r: r["conv_id"]):
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in group))


def test_repair_of_an_empty_table_and_of_dropped_conversations(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert conversations.report(conversations.damage(empty), empty).isEmpty()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x")], CONVERSATION)
    assert tuple(conversations.report(conversations.damage(one), one).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def plain_collocations(rows, least, longest, first, within):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: n for p, n in counts.items() if n >= least and len(p[1]) > 1}
    found = {}
    for (lang, p), a in candidates.items():
        inside = [b for (g, q), b in candidates.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= within * a for b in inside):
            score, k = min((1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    return {(lang, n, *row[3:]) for lang, rows_ in found.items() for n, row in enumerate(sorted(rows_)[:first], 1)}


@pytest.mark.parametrize("slots", [1 << 4, 1 << 10, 1 << 20])
@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_equal_brute_force(spark, slots, shards):
    """Few slots make phrases share them: counts must not change."""
    rng = np.random.default_rng(4)
    vocabulary = ["a", "B", "c", "dé", "e f", "g", "h"]
    rows = [(None if k % 5 == 0 else "und" if k % 5 == 1 else "en", None if k == 3 else "" if k == 4 else "".join(rng.choice(vocabulary, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05]) + str(rng.choice([" ", "\t ", ". ", "\n"], p=[0.7, 0.1, 0.1, 0.1])) for _ in range(rng.integers(1, 30)))) for k in range(150)]
    rows += [("en", "only once"), ("en", "q w e r t y " * 40), ("de", "Q w, e")]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, rank int, phrase string").repartition(5)
    got = collocations.collocations(df, least=6, first=25, slots=slots, shards=shards, batch_bytes=400)
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, 6, 5, 25, 100)


def test_collocations_of_partly_covered_phrases_and_an_empty_table(spark):
    rows = [("en", "big red dog"), ("en", "big red dog"), ("en", "big red"), ("en", "red dog bone"), ("en", "x " * 3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for within in (50, 75, 100):
        got = collocations.collocations(df, least=2, within=within, slots=1 << 10)
        assert {tuple(r) for r in got.collect()} == plain_collocations(rows, 2, 5, 2000, within)
    assert collocations.collocations(df.limit(0), slots=1 << 10).isEmpty()


def test_slots_are_the_same_in_both_languages(spark):
    import xxhash

    turn = lambda x: ((x << 17) | (x >> 47)) & (1 << 64) - 1
    for row in spark.createDataFrame([("und", "a"), ("é", "bé c"), ("en", "x y z w v")], "lang string, phrase string").select("lang", "phrase", collocations.slot_of().alias("s")).collect():
        want = xxhash.xxh64_intdigest(row["lang"], 42)
        for w in row["phrase"].split():
            want = turn(want) ^ xxhash.xxh64_intdigest(w, 42)
        assert row["s"] == want % collocations.SLOTS


def plain_links(rows, least=0.9):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= least] for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        reached, queue = {k}, [k]
        while queue:
            for j in near.get(queue.pop(), []):
                if j not in reached:
                    reached.add(j)
                    queue.append(j)
        least_id = None if i is None else min(rows[j][0] for j in reached)
        out.append((i, len(near.get(k, [])), least_id, i is not None and i == least_id))
    return sorted(out, key=repr)


def test_op13(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op13_embedding_near_dedup"](spark, sf_dir).collect()), key=repr) == plain_links(rows)


@pytest.mark.parametrize("part_rows", [40, 1024])
def test_near_embeddings_equal_brute_force(spark, part_rows):
    """Groups of copies, of near copies in parts and chains, of two lengths, beside unusable vectors."""
    rng = np.random.default_rng(8)
    rows = []
    for dim, n in ((16, 90), (5, 30)):
        base = rng.standard_normal((n, dim))
        rows += base.tolist() + (base[:10] * 3).tolist() + [base[0].tolist()] * 30
        rows += (base[1] + 0.02 * rng.standard_normal((120, dim))).tolist()
        at = base[2] / np.linalg.norm(base[2])
        for _ in range(25):  # each near the one before
            at = at + 0.3 * rng.standard_normal(dim) / np.sqrt(dim)
            at /= np.linalg.norm(at)
            rows.append(at.tolist())
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0, None]), (9005, [float("nan"), 1.0]), (None, [1.0, 2.0]), (9006, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, component string").repartition(3)
    got = sorted(map(tuple, embeddings.near_duplicates(df, part_rows=part_rows).collect()), key=repr)
    want = plain_links([r for r in rows if r[0] is not None]) + [(None, 0, None, False)]
    want.sort(key=repr)
    pairs = sum(r[1] for r in want)
    assert [(a[0], a[3] is not None) for a in got] == [(a[0], True) for a in want]
    assert sum(r[1] for r in got) >= 0.99 * pairs and all(a[1] <= b[1] for a, b in zip(got, want, strict=True))  # none below the limit, nearly all above it
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.02 * len(want)


def test_embeddings_of_repeated_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [3.0, 0.1])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    assert embeddings.near_duplicates(df.limit(0)).isEmpty()


@pytest.mark.parametrize("hashes", [1, 2, 3, 4])
def test_recall_of_pairs_at_the_limit(hashes):
    rng = np.random.default_rng(hashes)
    a = rng.standard_normal((500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (embeddings.bucket_keys(v, hashes, embeddings.TABLES[hashes], embeddings.PROBES).reshape(500, -1) for v in (a, b))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)]) > 0.97
