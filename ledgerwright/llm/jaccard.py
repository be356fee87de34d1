"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones, split by cost."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.components import connect, lean
from ledgerwright.llm.shared import cut, row_key, small_batches, utf8

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Largest size tried as the boundary between small and large sets; the work for an entry of an inverted list comes from the data.
LARGEST_SMALL = 12
#: Buckets of the counts that bound a pair's difference from below before its texts are read.
SKETCH = 256
#: Shingles kept as frequent, at most; they come last in the order of prefixes. A limit of speed, not of results.
FREQUENT = 1 << 19
#: Shingles of partners that one leader meets in one task.
PART_SHINGLES = 2_000_000

_RANDOM = np.random.default_rng(20240501).integers(0, 2**63, 256 + SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: np.ndarray, at: np.ndarray, sizes: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words (A-Z lowered, cut at ASCII space) of joined texts, and the n + 1 offsets of the texts in them; if asked for, their sizes in bytes too."""
    solid = np.zeros(len(raw) + 1, bool)
    solid[:-1] = ~_SPACE[raw]
    begins = solid[:-1].copy()
    begins[1:] &= ~solid[:-2]
    cuts = at[1:-1]
    cuts = cuts[cuts < len(raw)]
    begins[cuts] = solid[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return (np.zeros(0, np.uint64), np.zeros(len(at), np.int64), *[np.zeros(0, np.int64)] * sizes)
    after = ~solid  # a word ends at the next space or the next start
    after[starts[1:]] = True
    stops = np.flatnonzero(after)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    power = powers(_BASE, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_RANDOM[_LOWER[raw]] * power[:-1], out=total[1:])
    back = powers(_INVERSE, len(raw) + 1)
    return (mixed((total[ends] - total[starts]) * back[starts]), np.searchsorted(starts, at), *[ends - starts] * sizes)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """For each text its sorted distinct shingle hashes (uint64); a text of fewer words is one shingle, of none the empty set."""
    words, at = word_hashes(*utf8(column))
    n = max(0, len(words) - size + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(size):
        joined += words[k : k + n] * _RANDOM[256 + k]
    joined = mixed(joined ^ np.uint64(size))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1])
        elif b > a:
            yield mixed(np.array([(words[a:b] * _RANDOM[256 : 256 + b - a]).sum() ^ np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Shared elements that sets of these sizes need to link."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of n elements lists, so that each pair with a member up to ``boundary`` shares one."""
    sizes = set()
    for m in range(max(1, -(-percent * n // 100)), 100 * n // percent + 1):
        if min(n, m) <= boundary:
            c = least_overlap(n, m, percent)
            if c <= min(n, m):
                sizes.add(c)
    return sorted(sizes)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT, scan_cost: float = 4.0) -> int:
    """The largest size that counts as small, from the number of sets of each size: cheapest in subsets plus scanned entries, ``scan_cost`` each."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            total += count * sum(math.comb(n, c) for c in subset_sizes(n, boundary, percent))
            total += count * scan_cost * prefix_length(n, percent) * (n > boundary)
        return total

    return min(range(LARGEST_SMALL + 1), key=cost)


def survey(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text_hash, n, set_a, set_b, sketch) and, beside them, rows (shingle, seen) of shingles that stand in more than one document of a batch."""
    rows = docs.select(*row_key(), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in small_batches(batches, 4096, 4 << 20):
            sets = []
            for part in small_batches([batch], 4096, 1 << 20):
                sets += list(shingle_sets(part.column(2)))
            n = np.array([len(x) for x in sets], np.int64)
            every = np.concatenate(sets)
            ends = np.cumsum(n)
            zero = np.zeros(1, np.uint64)
            sums = [np.concatenate((zero, np.cumsum(mixed(every ^ np.uint64(salt))))) for salt in (0xA5A5A5A5, 0x51ED270B)]
            set_a, set_b = ((x[ends] - x[ends - n]).view(np.int64) for x in sums)
            none = pa.nulls(batch.num_rows, pa.int64())
            bucket = np.repeat(np.arange(len(n)), n) * SKETCH + (every >> np.uint64(56)).astype(np.int64) % SKETCH
            sketch = np.minimum(np.bincount(bucket, minlength=len(n) * SKETCH), 255).astype(np.uint8).reshape(len(n), SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(set_a), pa.array(set_b), pa.array([x.tobytes() for x in sketch], pa.binary()), none, none], names)
            every.sort()
            edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True]))) if len(every) else np.zeros(1, np.int64)
            seen = np.diff(edge)
            pick = seen > 1
            token = every[edge[:-1][pick]].view(np.int64)
            blank = [pa.nulls(len(token), t) for t in (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(token), pa.array(seen[pick])], names)

    names = ["doc_id", "text_hash", "n", "set_a", "set_b", "sketch", "shingle", "seen"]
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, set_a long, set_b long, sketch binary, shingle long, seen long")


def signatures(firsts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], boundary: int, percent: int = PERCENT) -> DataFrame:
    """(signature, node, pos, n): the subsets of small sets, pos 0, and the prefixes of large ones, rarest shingles first, with places; n is the set's size.

    ``firsts``: (node, text); ``frequent``: sorted shingles and the levels of their counts; others have level 0. Any fixed order is right;
    this one keeps the lists of prefixes short.
    """
    shared = firsts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        common, level = shared.value
        picks = {}  # the subsets of each small size, as index arrays
        for batch in small_batches(batches, 2048, 1 << 20):
            nodes, out, place, of, sizes, counts = batch.column(0).to_numpy(), [], [], [], [], []
            for node, x in zip(nodes.tolist(), shingle_sets(batch.column(1)), strict=True):
                n, full, before = len(x), x, len(out)
                if n > boundary:
                    length = prefix_length(n, percent)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                        x = x[np.argsort(np.where(common[at] == x, level[at], 0), kind="stable")[:length]]
                    out.append(x[:length])
                    place.append(np.arange(length, dtype=np.int32))
                if 0 < n <= 2 * boundary:
                    if n not in picks:
                        picks[n] = [np.array(list(itertools.combinations(range(n), c)), np.int64) for c in subset_sizes(n, boundary, percent)]
                    for index in picks[n]:
                        out.append(mixed(mixed(full)[index].sum(1) + np.uint64(index.shape[1])))
                        place.append(np.zeros(len(index), np.int32))
                of.append(node)
                counts.append(n)
                sizes.append(sum(map(len, out[before:])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(of, sizes)), pa.array(np.concatenate(place)), pa.array(np.repeat(np.array(counts, np.int32), sizes))], ["signature", "node", "pos", "n"])

    return firsts.mapInArrow(run, "signature long, node long, pos int, n int")


def near_enough(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose sketches allow a link: sets differ at least by the sum of the differences of their counts by bucket."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.stack([np.frombuffer(x, np.uint8) for x in batch.column(k).to_pylist()]).astype(np.int16) for k in (4, 5))
                size = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
                apart = np.abs(one - two).sum(1, dtype=np.int64)
                keep = pa.array(np.flatnonzero((100 + percent) * (size - apart) >= 2 * percent * size))
                yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in range(4)], ["a", "b", "n_a", "n_b"])

    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, n_a int, n_b int")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose sets link. ``texts``: (node, text). Each leader a meets its partners in parts of bounded size."""
    n_pairs = pairs.count()
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = cut(texts.join(lean(needed, 2 * n_pairs), "node", "left_semi").dropDuplicates(["node"]))
    hubs = pairs.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.sum("n_b") / PART_SHINGLES)).cast("int").alias("parts"))
    hubs = cut(hubs)
    dealt = pairs.join(lean(hubs, n_pairs), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"))
    members = own.select(F.col("node").alias("b"), "text").join(lean(dealt, n_pairs), "b").select("a", "part", "b", "text")
    leaders = own.select(F.col("node").alias("a"), "text").join(lean(hubs, n_pairs), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    met = members.unionByName(leaders).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        mine = np.zeros(0, np.uint64)
        for batch in small_batches(batches, 1024, 1 << 20):
            found_a, found_b = [], []
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2)), strict=True):
                if b is None:
                    mine = x
                elif len(x) and len(mine):
                    both = int((mine[np.minimum(np.searchsorted(mine, x), len(mine) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(mine) - both):
                        found_a.append(a)
                        found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return met.select("a", "b", "text").mapInArrow(run, "a long, b long")


def fits(percent: int = PERCENT):
    """Whether a list proves a pair possible: sizes near enough, and, both being sorted alike, enough elements from this shared one on.

    It must hold where the first shared element of a pair stands.
    """
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return near & (F.col("n_a") - F.col("pos_a") >= need) & (F.col("n_b") - F.col("pos_b") >= need)


def similar_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, node), one per distinct (doc_id, text), and (node, component) of the nodes with links.

    A node is a class of documents with one shingle set. Nodes meet on signatures: subsets for small sets, prefixes
    for large ones, rare shingles first.
    """
    spark = docs.sparkSession
    seen = cut(survey(docs))
    rows = seen.where("n is not null").dropDuplicates(["doc_id", "text_hash"]).withColumn("node", F.xxhash64("n", "set_a", "set_b")).select("doc_id", "text_hash", "n", "node", "sketch")
    classes = cut(rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch")))
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").count().collect()}
    counted = cut(seen.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")))
    work = counted.agg(F.sum(F.col("seen").cast("double") * F.col("seen")).alias("squares")).first()["squares"] or 0.0
    total = classes.agg(F.sum("n")).first()[0] or 1
    boundary = choose_boundary(sizes, percent, 4.0 + work / total)  # a scanned entry meets about its list's length
    levels = counted.groupBy(F.floor(F.log2("seen")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()  # one row a power of two
    least, listed = 62, 0
    for r in levels:
        listed += r["count"]
        if listed > FREQUENT:
            break
        least = r["level"]
    top = counted.where(F.col("seen") >= F.lit(1 << least)).toArrow()
    frequent = top["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    frequent = (frequent[order], np.log2(top["seen"].to_numpy() + 0.5).astype(np.int8)[order])
    keys = classes.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "node", "n")
    key = row_key()
    firsts = (
        docs.select(*key, "text")
        .join(lean(keys), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
        .select("node", "n", "text")
    )
    marks = signatures(firsts.select("node", "text"), frequent, boundary, percent)
    shared = marks.select(F.hash("signature").alias("h")).groupBy("h").count().where("count > 1").select("h")
    lists = marks.join(shared, F.hash("signature") == F.col("h")).drop("h")
    sketches = classes.select("node", "sketch")
    return rows.drop("sketch"), connect(lists, lambda: fits(percent), lambda pairs: verified(cut(near_enough(pairs, sketches, percent)), firsts, percent))[0]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Add n_shingles, component_id and class_id to every row of ``docs`` (columns doc_id, text).

    component_id: the smallest doc_id reachable by links, itself included. Null texts and texts without words
    have the empty set and are linked with nothing, not even each other. Rows that repeat get equal results; a row with
    a null doc_id gets the smallest non-null doc_id it reaches, or null. An empty table gives no rows.
    """
    docs = docs.drop("n_shingles", "component_id", "class_id")
    rows, joined = similar_classes(docs, percent)
    classed = rows.join(joined, "node", "left").withColumn("group", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    smallest = classed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    done = classed.join(lean(cut(smallest)), "group", "left").select(F.col("doc_id").alias("row__id"), F.col("text_hash").alias("row__hash"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.col("node").alias("class_id"))
    key = row_key()
    return docs.withColumn("own__hash", key[1]).join(lean(cut(done)), F.col("doc_id").eqNullSafe(F.col("row__id")) & (F.col("own__hash") == F.col("row__hash"))).drop("own__hash", "row__id", "row__hash")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "class_id")
