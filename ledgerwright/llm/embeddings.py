"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.components import components, lean
from ledgerwright.llm.neighbours import usable
from ledgerwright.llm.shared import cut, discard

LEAST = 0.9
#: Hash tables, by the number of cross-polytope hashes of a bucket key: more hashes tell more rows apart and need more tables.
TABLES = {1: 2, 2: 4, 3: 8, 4: 14}
#: Buckets of each table that a vector is put into: its own, and those next to it.
PROBES = 4
#: Rows that a bucket is to hold on average; sets the number of hashes.
BUCKET_ROWS = 8
#: Rows of a bucket that meet in one task; larger buckets are dealt out in parts, and every two parts meet in a task.
PART_ROWS = 1024
#: Rows up to which a bucket's pairs are looked at together with those of its neighbours in the stream.
SMALL = 24
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def bucket_keys(unit: np.ndarray, hashes: int, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) keys of the buckets of unit vectors; a row's first key of a table is that of its own bucket.

    A hash rotates a vector by three rounds of random signs and a Hadamard transform and names the nearest signed axis. The other
    probes replace the axis of one hash by the next or the one after it, those first that lose least.
    """
    n, dim = unit.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = unit
    random = np.random.default_rng([seed, dim])
    depth = min(3, size)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables if n else 0):
        axes, losses = [], []
        for _ in range(hashes):
            turned = padded
            for signs in random.choice([-1.0, 1.0], (3, size)):
                turned = hadamard(turned * signs)
            top = np.argpartition(-np.abs(turned), depth - 1, axis=1)[:, :depth]
            height = np.take_along_axis(turned, top, axis=1)
            order = np.argsort(-np.abs(height), axis=1, kind="stable")
            top, height = np.take_along_axis(top, order, axis=1), np.take_along_axis(height, order, axis=1)
            axes.append(2 * top + (height < 0))
            losses.append(np.abs(height[:, :1]) - np.abs(height))
        axes, losses = np.stack(axes, axis=1), np.stack(losses, axis=1)  # rows, hashes, depth
        scale = (2 * size) ** np.arange(hashes, dtype=np.int64)
        own = (axes[:, :, 0] * scale).sum(axis=1) + t * (2 * size) ** hashes
        moves = ((axes[:, :, 1:] - axes[:, :, :1]) * scale[:, None]).reshape(n, -1)
        loss = losses[:, :, 1:].reshape(n, -1)
        least = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 0] = own
        out[:, t, 1 : 1 + least.shape[1]] = own[:, None] + np.take_along_axis(moves, least, axis=1)
        out[:, t, 1 + least.shape[1] :] = own[:, None]
    return out


def hashes_for(rows: int, dim: int) -> int:
    """Hashes of a key: as many as make a bucket of evenly spread vectors hold about BUCKET_ROWS rows."""
    size = 1 << max(1, (dim - 1).bit_length())
    most = min(max(TABLES), 56 // int(math.log2(2 * size)))
    return max(1, min(most, math.ceil(math.log(max(1, rows / BUCKET_ROWS)) / math.log(2 * size))))


def normal(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of length one, in double precision."""
    rows = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def first_common(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the least key that the rows of ``a`` and ``b`` (pairs, tables, probes) share: there, and nowhere else, a pair counts."""
    open_ = np.arange(len(a))
    least = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(a.shape[1]):  # keys grow with the table
        left, right = a[open_, t], b[open_, t]
        shared = np.where((left[:, :, None] == right[:, None, :]).any(axis=2), left, np.iinfo(np.int64).max).min(axis=1)
        least[open_] = shared
        open_ = open_[shared == np.iinfo(np.int64).max]
        if not len(open_):
            break
    return least == key


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that connect what the symmetric matrix ``linked`` connects, fewer than its rows."""
    left, a, b = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            near = np.flatnonzero(linked[x] & left)
            left[near] = False
            a += [x] * len(near)
            b += near.tolist()
            queue += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


class Verifier:
    """Pairs of one task's buckets: links of each row, and pairs that connect what is linked, one fewer than the rows of a bucket at most."""

    def __init__(self, dim: int, hashes: int, tables: int, probes: int, least: float) -> None:
        self.dim, self.hashes, self.tables, self.probes, self.least = dim, hashes, tables, probes, least

    def keys(self, unit: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Bucket keys of the rows in use, at their places; only rows with a link are hashed again."""
        out = np.zeros((len(unit), self.tables, self.probes), np.int64)
        out[used] = bucket_keys(unit[used], self.hashes, self.tables, self.probes)
        return out

    def small(self, key: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of places within runs of equal keys, all runs being short."""
        a, b = [], []
        for shift in range(1, SMALL):
            at = np.flatnonzero(key[shift:] == key[:-shift]) if shift < len(key) else np.zeros(0, np.int64)
            if not len(at):
                break
            for k in range(0, len(at), 20_000):
                x = at[k : k + 20_000]
                good = np.einsum("nd,nd->n", unit[x], unit[x + shift]) >= self.least
                a.append(x[good])
                b.append(x[good] + shift)
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        if len(a):
            keys = self.keys(unit, np.unique(np.concatenate([a, b])))
            counts = first_common(keys[a], keys[b], key[a])
            a, b = a[counts], b[counts]
        return a, b

    def large(self, key: int, unit: np.ndarray, side: np.ndarray | None) -> np.ndarray:
        """The matrix of linked pairs of one bucket or part, or of two parts (``side``), those within either left out."""
        linked = unit @ unit.T >= self.least
        if side is not None:
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        keys = self.keys(unit, np.flatnonzero(linked.any(axis=1)))
        a, b = np.nonzero(np.triu(linked))
        for k in range(0, len(a), 100_000):
            x, y = a[k : k + 100_000], b[k : k + 100_000]
            counts = first_common(keys[x], keys[y], np.full(len(x), key))
            linked[x[~counts], y[~counts]] = linked[y[~counts], x[~counts]] = False
        return linked

    def verify(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, cls: np.ndarray, copies: np.ndarray, part: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cls, other, links) of whole groups, sorted by key and parts: rows with other null (-1) hold links, the others connect."""
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        links = np.zeros(len(key), np.int64)
        short = np.repeat(sizes <= SMALL, sizes) & np.repeat(low[starts] == high[starts], sizes)
        at = np.flatnonzero(short)
        ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a, b = self.small(key[at], unit[at])
        a, b = at[a], at[b]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        ends[0].append(a)
        ends[1].append(b)
        for k in np.flatnonzero(~short[starts]):
            s, e = starts[k], starts[k] + sizes[k]
            linked = self.large(int(key[s]), unit[s:e], part[s:e] if low[s] < high[s] else None)
            links[s:e] += linked @ copies[s:e]
            a, b = spanning(linked)
            ends[0].append(s + a)
            ends[1].append(s + b)
        some = np.flatnonzero(links)
        a, b = np.concatenate(ends[0]), np.concatenate(ends[1])
        return np.concatenate([cls[some], cls[a]]), np.concatenate([np.full(len(some), -1), cls[b]]), np.concatenate([links[some], np.zeros(len(a), np.int64)])


LINK = "cls long, other long, links long"


def linked_classes(classes: DataFrame, dim: int, rows: int, least: float, probes: int = PROBES, part_rows: int = PART_ROWS) -> DataFrame:
    """(cls, other, links) over classes (cls, copies, embedding) of one vector length: links of a class by bucket (other null), and pairs that connect classes."""
    hashes = hashes_for(rows, dim)
    tables = TABLES[hashes]
    verifier = Verifier(dim, hashes, tables, probes, least)

    def place(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                x = batch.slice(k, 2048)
                unit = normal(x.column(2), dim)
                keys = np.sort(bucket_keys(unit, hashes, tables, probes).reshape(x.num_rows, -1), axis=1)
                new = np.append(np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1], axis=1)
                offsets = np.append(0, np.cumsum(new.sum(axis=1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[new]))], ["cls", "keys"])

    keyed = classes.select("cls", "copies", "embedding").mapInArrow(place, "cls long, keys array<long>")
    keyed = cut(keyed.select("cls", F.explode("keys").alias("key")))
    sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    hot = cut(sizes.where(F.col("members") > part_rows).select("key", F.ceil(F.col("members") / part_rows).cast("int").alias("parts")))
    met = keyed.join(sizes.select("key"), "key", "left_semi").join(lean(hot), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "cls").join(classes, "cls")
    dealt = met.select("key", "low", "high", "part", "cls", "copies", "embedding").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "cls")

    def check(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 8192:
                whole = pa.Table.from_batches(held).combine_chunks()
                last = [whole.column(c)[n - 1].as_py() for c in range(3)]
                same = np.logical_and.reduce([whole.column(c).to_numpy() == last[c] for c in range(3)])
                end = int(np.argmax(same)) if same[-1] else n  # the last group may go on
                if end:
                    yield from out(whole.slice(0, end))
                held, n = whole.slice(end).to_batches(), n - end
        if n:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    def out(whole: pa.Table):
        whole = whole.combine_chunks()
        key, low, high, part, cls, copies = (whole.column(c).to_numpy() for c in range(6))
        unit = normal(whole.column(6).combine_chunks(), dim)
        a, b, links = verifier.verify(key, low, high, cls, copies, part, unit)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(links)], ["cls", "other", "links"])

    found = cut(dealt.mapInArrow(check, LINK))
    for table in (keyed, sizes, hot):
        discard(table)
    return found


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_column: str = "vec_id", vector_column: str = "embedding", probes: int = PROBES, part_rows: int = PART_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): the other vectors found with a cosine of ``least`` or more, and the smallest vec_id reachable by links.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing and are returned; so are rows of a null
    vec_id, whose component is null and kept false. A row that repeats id and vector counts once; two vectors of one id count as two.
    Vectors of different length don't link; each length is hashed apart. An empty table gives no rows. Columns other than the two are left out.

    Equal vectors are one class with a number of copies. A class is put into several buckets of each table; a bucket's rows are compared
    by matrix products in double precision, in parts of ``part_rows``, two at a time, so no task holds a large bucket. A pair that meets in
    several buckets counts in the one of the least key. Tasks return the links of each row, and of the pairs only as many as connect
    them, so rows stay in proportion to the buckets' rows though the links of a group grow with its square.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding"))
    good = usable(rows, "vec_id", "embedding")
    classes = good.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cls"), "copies", "least", F.size("embedding").alias("dim"), "embedding"))
    found = spark.createDataFrame([], LINK)
    lengths = classes.groupBy("dim").count().collect()  # a row for each vector length
    for length in sorted(lengths, key=lambda r: r["dim"]):
        own = classes.where(F.col("dim") == length["dim"]).select("cls", "copies", "embedding")
        found = found.unionByName(linked_classes(own, length["dim"], length["count"], least, probes, part_rows))
    links = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    label = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cls")
    named = classes.select("cls", "copies", "least", "embedding").join(links, "cls", "left").join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = cut(named.select("cls", "component", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "embedding"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(smallest, "component").select("embedding", "n_links", "component_id")
    linked = good.join(told, "embedding").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    v = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    alone = rows.where(~F.coalesce(fit, F.lit(False))).dropDuplicates().select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Over all pairs; the rows must be few.
OP13_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {LEAST}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN d ON d.a = v.vec_id"""
