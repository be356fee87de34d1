"""Near and exact duplicates, lines, substrings and the pipeline against brute force, with odd inputs."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerwright.llm import components, jaccard, lines, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], DOCS)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(parent, k)) for k, s in enumerate(sets)]


def variants(rng, n_bases=6, copies=12):
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", "  \n\t", "one", "One", "two words", "one two three four", "a b c d e", "x " * 30_000]
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 8, 10, 12, 14, 20, 60, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += [rng.choice(vocabulary) for _ in range(rng.choice([1, 3]))]
            texts.append(rng.choice([" ", "\n", "  "]).join(words) if rng.random() < 0.1 else " ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return texts


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(7)
    texts = variants(rng)
    got = jaccard.near_duplicates(docs_of(spark, texts).withColumn("text_hash", F.lit("clash"))).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts)
    assert {r["text_hash"] for r in got} == {"clash"}


def test_subsets_find_every_pair_of_small_sets():
    for boundary in (4, 7, 9):
        for a in range(1, boundary + 1):
            for b in range(a, 4 * a // 3 + 1):
                need = jaccard.least_overlap(a, b)
                if need <= a:
                    assert need in jaccard.subset_sizes(a, boundary) and need in jaccard.subset_sizes(b, boundary)
                    assert 100 * need >= 75 * (a + b - need) and (need == 0 or 100 * (need - 1) < 75 * (a + b - need + 1))
    assert jaccard.choose_boundary({3: 10}, scan_cost=100) >= 3
    assert jaccard.choose_boundary({}) == 0


def test_repeated_rows_and_empty_tables(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f"])
    got = jaccard.near_duplicates(df.union(df)).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {0}
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_components_of_odd_graphs(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 7), (5, 300), (300, 5), (300, 2)] + [(1000, 1001 + k) for k in range(50)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    parent = list(range(1100))
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(parent, x) for a, b in edges if a != b for x in (a, b)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return edits(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9


def within(a, b, most):
    """Whether at most so many edits lead from a to b: only the diagonals that they can reach are filled."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [10**9] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new[lo - 1 : hi + 1]) > most:
            return False
        row = new
    return row[-1] <= most


def near_pairs(lines):
    """Pairs of edit similarity 0.9 or more among lines that begin or end alike or share four words in a row."""
    by = defaultdict(set)
    for k, x in enumerate(lines):
        words = x.split(" ")
        for mark in {"<" + x[:12], ">" + x[-12:], *(" ".join(words[j : j + 4]) for j in range(len(words) - 3))}:
            by[mark].add(k)
    met = {p for v in by.values() if len(v) < 200 for p in itertools.combinations(sorted(v), 2)}
    return [(lines[a], lines[b]) for a, b in sorted(met) if within(lines[a], lines[b], int(0.1 * max(len(lines[a]), len(lines[b])) + 1e-9))]


def test_aligned_edits_are_never_too_few():
    rng = random.Random(2)
    for _ in range(400):
        words = [rng.choice(["a", "bc", "bcd", "xyz", "longer"]) for _ in range(rng.randrange(1, 12))]
        other = list(words)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(other) + 1)
            other[k : k + rng.randrange(3)] = [rng.choice(["q", "bcx", "longest"]) for _ in range(rng.randrange(3))]
        other = other or ["z"]
        found, least = lines.aligned_edits(words, other, 1000), edits(" ".join(words), " ".join(other))
        assert found >= least
    assert lines.aligned_edits("a b c d".split(), "a c d".split(), 5) == 2 and lines.aligned_edits("a b".split(), "a b new".split(), 5) == 4 and lines.aligned_edits(["typos"], ["tybos"], 5) == 1


def test_lines_keep_one_of_each_group(spark):
    licence = "This work is licensed under the terms of the General Public License, version 3, or any later one."
    near = licence.replace("later one", "later ones")
    own = ["alpha beavers build clever dams each fall", "gardens have ivy jasmine kale and lilies", "many neighbours of ours play quiet records", "seven tired umpires vote with xylophones", "young zebras amble beside calm dromedaries"]
    texts = [f"{own[0]}\n{licence}\nok", f"{own[1]}\n{licence.upper()}\n OK ", f"  {licence}  \n\n{own[2]}", None, "", licence, f"{own[3]}\n{own[3]}", "x" * 100_000 + "\n" + own[4] + "\n---\n", "---\nyes", "no\n \n"]
    got = lines.dedup_lines(docs_of(spark, texts).withColumn("n_lines", F.lit("clash"))).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [texts[0], own[1], f"\n{own[2]}", None, "", "", own[3], texts[7], "yes", texts[9]]
    assert [r["n_removed"] for r in got] == [0, 2, 1, 0, 0, 1, 1, 0, 1, 0]
    assert [r["n_lines"] for r in got] == [3, 3, 3, 0, 1, 1, 2, 4, 2, 3]
    fuzzy = lines.dedup_lines(docs_of(spark, [licence, near, near])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in fuzzy] == [0, 1, 1]


def test_fuzzy_lines_against_brute_force_edit_similarity(spark):
    """Whatever goes is of one group with a kept line by edit similarity alone, and most of such groups are found whole."""
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(60)]
    texts = []
    for n in (12, 30, 60, 60, 60):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(n)]
            for _ in range(5):
                words = list(base)
                words[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(words))
    df = docs_of(spark, texts)
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similar(texts[a], texts[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    want = [find(parent, k) != k for k in range(len(texts))]
    got = [bool(r["n_removed"]) for r in lines.dedup_lines(df).orderBy("doc_id").collect()]
    assert any(want) and not any(g and not w for g, w in zip(got, want, strict=True))
    assert sum(got) >= 0.9 * sum(want)  # these differ in two words


def test_lines_with_one_word_replaced_are_found(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3000)]
    texts, near = [], []
    for n_words in (10, 12, 15, 20, 40):
        for k in range(25):
            words = [rng.choice(vocabulary) for _ in range(n_words)]
            other = list(words)
            other[rng.randrange(n_words)] = "\u6570" * 27 if n_words == 40 and k < 10 else rng.choice(vocabulary)  # 8 % of the code points, over 10 % of the bytes
            texts += [" ".join(words), "  ".join(other).upper()]
            near.append(similar(" ".join(words), " ".join(other)))
    got = [r["n_removed"] for r in lines.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert sum(got[0::2]) == 0 and sum(near) > 100
    assert not any(n and not w for n, w in zip(got[1::2], near, strict=True))
    found = [bool(n) for n, w in zip(got[1::2], near, strict=True) if w]
    assert all(found[-50:]) and sum(found) >= 0.95 * len(found)  # short lines are missed where too few words voted in the equal blocks


def test_one_line_in_every_document_and_repeated_rows(spark):
    texts = [f"the one line that stands in each and every document of all\nand number {k} of its own words {k * k}" for k in range(200)]
    df = docs_of(spark, texts)
    got = lines.dedup_lines(df.union(df.where("doc_id < 3")).union(docs_of(spark, ["the one line that stands in each and every document of all"]).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["text"])
    assert len(got) == 204 and all(len(x) == 1 for x in by.values())  # rows that repeat lose the same lines
    first = {k for k, x in by.items() if "the one line" in next(iter(x))}
    assert first == {None}  # null comes before all ids, and keeps the line


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n in [*range(30), 200, 700]:
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def brute_repeats(rows):
    seen, want = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone, mine = np.zeros(len(raw), bool), set()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            if seen.get(w, i) < i:
                gone[p : p + 50] = True
            mine.add(w)
        for w in mine:
            seen.setdefault(w, i)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return want


def test_repeated_substrings_equal_brute_force(spark):
    rng = random.Random(5)
    letter = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [letter(n) for n in (49, 50, 51, 60, 300)]
    texts = [None, "", "short", "a" * 5000, "a" * 49, "a" * 60]
    for _ in range(40):
        texts.append("".join(rng.choice([letter(rng.randrange(80)), rng.choice(passages), rng.choice(passages)[3:-2]]) for _ in range(rng.randrange(1, 8))))
    texts += [texts[10], texts[12][:100] + "x"]
    want = brute_repeats(list(enumerate(texts)))
    for many in (suffixes.MANY, 0):  # 0: every anchor's strings are dealt out one by one
        suffixes.MANY, before = many, suffixes.MANY
        got = suffixes.remove_repeats(docs_of(spark, texts).withColumn("first", F.lit("kept")).withColumn("text_hash", F.lit("kept"))).collect()
        assert {(r["first"], r["text_hash"]) for r in got} == {("kept", "kept")}
        suffixes.MANY = before
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_only_strings_of_repeated_cores_are_dealt_out(spark):
    """Documents that share 16 to 28 bytes in a row, too few for a string of 50 with its anchor, send no text to be sorted."""
    rng = random.Random(6)
    letter = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared = [letter(n) for n in range(16, 29)]
    texts = ["".join(letter(60) + x for x in rng.sample(shared, len(shared))) for _ in range(20)]
    docs = docs_of(spark, texts).withColumn("text_hash", F.lit(0).cast("long"))
    dealt = []
    for some in (docs, docs_of(spark, [*texts, letter(9) + texts[3][100:180], letter(9)]).withColumn("text_hash", F.lit(0).cast("long"))):
        bits, many = map(spark.sparkContext.broadcast, suffixes.repeated_cores(some, 64))
        dealt.append(suffixes.segments(some, bits, many, 64).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
        assert not len(many.value)
    assert dealt[0] == 0 and 2 <= dealt[1] <= 20


def test_edit_distances_of_long_lines():
    def table(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            left, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (a != b))
        return row[-1]

    rng = random.Random(3)
    for n in (0, 1, 2, 63, 64, 65, 130):
        for letters in ("ab", "abcdé😀 "):
            x = "".join(rng.choice(letters) for _ in range(n))
            y = "".join(rng.choice(["", c, c, c, c + "a", "b"]) for c in x)
            for one, two in ((x, y), (y, x), (x, x), (x, ""), ("", x)):
                want = table(one, two)
                assert lines.edit_distance(one, two, 10_000) == want
                for most in (want, max(0, want - 1), want // 2):
                    got = lines.edit_distance(one, two, most)
                    assert (got == want) if want <= most else most < got


def test_long_near_lines_are_proven(spark):
    """Lines of thousands of characters that scattered changes of letters keep alike are found; those that differ more are not."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(1500)]
    line = " ".join(words)
    pairs = spark.createDataFrame([(1, 2, 300, line, "".join(rng.choice("xyz") if rng.random() < p else c for c in line)) for p in (0.01, 0.3)], "a long, b long, edits int, norm_a string, norm_b string")
    got = lines.trimmed(pairs).collect()
    assert [(r["core_a"], r["core_b"]) for r in got] == [("", "")]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(9)
    word = lambda: rng.choice(["the", "house", "green", "river", "walks", "under", "seven", "bridges", "quietly", "morning"]) + str(rng.randrange(50))
    passage = " ".join(f"bench{k}" for k in range(12))
    clean = [" ".join(word() for _ in range(80)) for _ in range(30)]
    texts = [*clean, clean[3], clean[4] + " extra", clean[5] + " " + passage, "1234 !!", None]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = defaultdict(set)
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "source_mixing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept["language_id"] == set(range(33))
    assert 30 not in kept["line_dedup"] and kept["line_dedup"] >= set(range(30))
    assert 31 not in kept["ngram_jaccard_join"] and kept["ngram_jaccard_join"] >= set(range(30)) - {5}
    assert 32 not in kept["benchmark_decontamination"] and kept["benchmark_decontamination"] >= set(range(30)) - {5}
    assert docs.agg(F.min("taken")).first()[0] > 0
    assert sorted(p.run(spark, str(tmp_path)).select("doc_id", "taken").collect()) == sorted(docs.select("doc_id", "taken").collect())


def test_counted_characters_bound_the_edits_of_lines(spark):
    """The bound that lines have to meet before they are compared never exceeds their edits, and keeps unlike lines of one key apart."""
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        one = "".join(rng.choice("abcdeé ßxyzABC漢q") for _ in range(rng.randrange(1, 60)))
        two = list(one)
        for _ in range(rng.randrange(6)):
            two[rng.randrange(len(two)) : rng.randrange(len(two) + 1)] = rng.choice(["", "e", "漢t", "Q"])
            two = two or ["a"]
        rows.append((one, "".join(two)))
    rows.append(("e" * 700, "e" * 300))
    raw = [np.frombuffer("".join(x + "\n" for x in side).encode(), np.uint8) for side in zip(*rows, strict=True)]
    starts = [np.concatenate(([0], np.flatnonzero(x == 10)[:-1] + 1)) for x in raw]
    mixes = [lines.class_counts(x, s).tolist() for x, s in zip(raw, starts, strict=True)]
    df = spark.createDataFrame([(*r, *m) for r, m in zip(rows, zip(*mixes, strict=True), strict=True)], "one string, two string, mix_a long, mix_b long")
    got = df.select(lines.counts_apart("mix_a", "mix_b").alias("least"), F.levenshtein(lines.normal(F.col("one")), lines.normal(F.col("two"))).alias("edits")).collect()
    assert all(r["least"] <= r["edits"] for r in got) and any(r["least"] > 2 for r in got)


def test_a_pair_of_lines_counts_in_one_list_and_lone_signatures_are_left_out(spark):
    every = (1 << len(lines.CHOICES)) - 1
    block = lambda *x: sum(v << (lines.BLOCK_BITS * k) for k, v in enumerate(x))
    rows = [(1, block(1, 2, 3), block(4, 5, 6), every), (2, block(1, 2, 3), block(4, 5, 6), every), (3, block(9, 2, 3), block(4, 8, 7), every), (4, block(21, 22, 23), block(24, 25, 26), every), (5, block(1, 2, 3), block(4, 5, 6), 1 << 4)]
    nodes = spark.createDataFrame([(n, h, t, a | (30 << len(lines.CHOICES))) for n, h, t, a in rows], "node long, head long, tail long, about long")
    lists = lines.signatures(nodes).join(nodes.selectExpr("node", "head", "tail", f"cast(about & {every} as int) as keys"), "node")
    found = lists.groupBy("node").count().collect()
    assert {r["node"]: r["count"] for r in found} == {1: 15, 2: 15, 3: 3, 5: 1}
    side = lambda x: lists.select("signature", *[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("node", "pos", "head", "tail", "keys")])
    met = side("a").join(side("b"), "signature").where("a < b")
    assert sorted((r["a"], r["b"]) for r in met.where(lines.first_shared()).collect()) == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5)]


def test_grams_never_rule_out_a_pair_within_its_edits():
    rng, ones, others, made = random.Random(11), [], [], []
    for _ in range(500):
        one = "".join(rng.choice("ab é😀c") for _ in range(rng.randint(0, 60)))
        two, n = list(one), rng.randint(0, 9)
        for _ in range(n):
            k = rng.randint(0, len(two))
            two[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "b"])
        ones.append(one)
        others.append("".join(two))
        made.append(n)
    assert (lines.gram_apart(ones, others) <= np.array(made)).all()
    assert lines.gram_apart(["the quick brown fox jumps"], ["a line of other words here"])[0] > 3


def test_votes_of_long_and_short_lines():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**63, 9000, dtype=np.uint64)
    short, _ = lines.sim_blocks(words[:300], np.repeat(np.arange(30), 10), 30)
    both, _ = lines.sim_blocks(words, np.concatenate((np.repeat(np.arange(30), 10), np.full(8700, 30))), 31)
    assert (both[:30] == short).all()  # counted in lanes of a byte, and one by one where a line has more than 255 voters in a block
    mine = np.unique(words[(words >> np.uint64(33)) % np.uint64(lines.BLOCKS) == 0][30:])
    assert len(mine) > 255


def test_lines_of_few_words_share_a_key():
    """Short lines that link share one whatever their words are; others if two words differ, or two pieces of a long word."""
    rng = random.Random(3)
    keys = lambda *texts: [set(k) for k in (lambda line, key: [key[line == n].tolist() for n in range(len(texts))])(*lines.few_word_keys(list(texts)))]
    letters, words = "abcdé数 ", ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 12))) for _ in range(500)]
    linked = 0
    for n in range(900):
        one = [rng.choice(letters) for _ in range(rng.randrange(9, 50))] if n % 3 else [rng.choice(words) for _ in range(rng.randrange(8, 15))]
        other = list(one)
        for _ in range(rng.randrange(1, 5 if n % 3 else 3)):
            k = rng.randrange(len(other))
            other[k : k + rng.randrange(2)] = [rng.choice(letters if n % 3 else words)] * rng.randrange(2) if len(other) > 1 else other[:1]
        one, other = (" ".join((("" if n % 3 else " ").join(x)).split()) for x in (one, other))
        if one == other or not one or not other or (n % 3 and (min(len(one), len(other)) > lines.short_size(0.9) or not similar(one, other))):
            continue
        if n % 3 or min(len(one), len(other)) > lines.short_size(0.9):
            linked += 1
            assert set.intersection(*keys(one, other)), (one, other)
    assert linked > 250
    assert set.intersection(*keys("-" * 80, "-" * 79)) and set.intersection(*keys("数据处理是一种重要的技术" * 6, "数据处理是一种重要的技朮" + "数据处理是一种重要的技术" * 5))
    assert [len(k) for k in keys("", "a", "other text")] == [0, 0, 4]


def test_near_lines_of_few_words_are_removed(spark):
    pairs = [("copyright reserved", "copyright, reserved"), ("internationalisation", "internationalization"), ("chapter seventeen", "chapter seventen"), ("abcdefghi", "abcdefghij"), ("read the complete and unabridged documentation online", "read the complete and unabriged documentation online"), ("=" * 100, "=" * 97)]
    texts = [x for pair in pairs for x in pair] + ["chapter", "chapters", "copyright observed here"]
    assert all(similar(*p) for p in pairs)
    got = [r["n_removed"] for r in lines.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 1] * len(pairs) + [0, 0, 0]
