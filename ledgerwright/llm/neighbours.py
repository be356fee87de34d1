"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact reranking."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwright.llm.shared import cut

TREES = 4
#: Leaves that one query visits at least, over all trees; :func:`visits_for` adds those that RECALL needs.
VISITED = 80
#: Share of the true neighbours that a sample of TRIAL_QUERIES queries must find; above 0.9, for what the sample may err.
RECALL = 0.95
TRIAL_QUERIES = 128
LEAF_ROWS = 800
#: Rows at most, about, that the split points are fitted on.
SAMPLE = 20_000
#: Neighbouring leaves of a tree that make one block; a query is sent to a block once, with the leaves that it visits there.
BLOCK_LEAVES = 32
#: Rows of one block that meet its queries in one task; larger blocks are dealt out in parts.
PART_ROWS = 32_768
#: Queries that meet one part of a block in a task; those of a block that more of them visit are dealt out too.
PART_QUERIES = 16_384
#: Rows with a vector, about, that a task hands on at a time, and scores that it holds at a time.
BATCH_ROWS, BATCH_SCORES = 8192, 1 << 21
#: Bytes of vectors that each of these numbers of rows stands for at most; longer vectors are dealt out in smaller parts.
VECTOR_BYTES = 1 << 24
NEAREST = 20
SEED = 7


@dataclass
class Forest:
    """directions: (trees, depth, dim); splits: (trees, 2**depth - 1) in heap order; rows: (trees, 2**depth) of the leaves."""

    directions: np.ndarray
    splits: np.ndarray
    depth: int
    rows: np.ndarray | None = None

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tkd->ntk", vectors, self.directions)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered over all trees."""
        along = self.project(vectors)
        trees = np.arange(len(self.directions))
        node = np.zeros(along.shape[:2], np.int64)
        for k in range(self.depth):
            node = 2 * node + 1 + (along[:, :, k] > self.splits[trees, node])
        return node - (2**self.depth - 1) + trees * 2**self.depth

    def visit(self, vector: np.ndarray, visited: int, least: int) -> list[int]:
        """Leaves in the order of one queue over all trees: the node whose widest crossed margin is least comes first."""
        along = self.project(vector[None])[0]
        queue = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        inner, found, rows = 2**self.depth - 1, [], 0
        while queue and (len(found) < visited or rows < least):
            crossed, t, node, level = heapq.heappop(queue)
            while level < self.depth:
                margin = along[t, level] - self.splits[t, node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (max(crossed, abs(float(margin))), t, 4 * node + 3 - near, level + 1))
                node, level = near, level + 1
            found.append(t * 2**self.depth + node - inner)
            rows += int(self.rows[t, node - inner])
        return found


def fit_forest(sample: np.ndarray, n_rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Forest:
    """Random directions, split at the medians of the sample; the depth follows the number of rows."""
    depth = max(0, min(14, round(math.log2(max(1, n_rows / leaf_rows)))))
    dim = sample.shape[1]
    directions = np.random.default_rng(seed).standard_normal((trees, depth, dim)) / math.sqrt(dim)
    forest = Forest(directions, np.zeros((trees, 2**depth)), depth)
    along = forest.project(sample)
    for t in range(trees):
        groups = [np.arange(len(sample))]
        for node in range(2**depth - 1):
            level, rows = (node + 1).bit_length() - 1, groups[node]
            values = along[rows, t, level]
            split = float(np.median(values)) if len(values) else 0.0
            forest.splits[t, node] = split
            groups += [rows[values <= split], rows[values > split]]
            groups[node] = None
    return forest


def visits_for(forest: Forest, queries: np.ndarray, truth: list[np.ndarray], recall: float = RECALL) -> int:
    """The least number of leaves at which a mean of ``recall`` of each query's true neighbours (truth: their vectors) is met."""
    n_leaves = len(forest.directions) * 2**forest.depth
    place, weight = [np.zeros(0, np.int64)], [np.zeros(0)]
    for vector, near in zip(queries, truth, strict=True):
        if not len(near):
            continue
        order = np.empty(n_leaves, np.int64)
        order[forest.visit(vector, n_leaves, 0)] = np.arange(n_leaves)
        place.append(order[forest.leaves(near)].min(axis=1))
        weight.append(np.full(len(near), 1 / len(near)))
    place, weight = np.concatenate(place), np.concatenate(weight)
    if not len(place):
        return 0
    order = np.argsort(place, kind="stable")
    met = np.cumsum(weight[order]) / weight.sum()
    return int(place[order][min(len(order) - 1, np.searchsorted(met, recall - 1e-9))]) + 1


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, embedding) as doubles, without null, empty and zero vectors and those with null or non-finite components."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
        .where(F.exists(v, lambda x: x != 0))
        .dropDuplicates(["vec_id", "embedding"])
    )


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def search(
    vectors: DataFrame, is_query, nearest: int = NEAREST, trees: int = TREES, visited: int = VISITED, leaf_rows: int = LEAF_ROWS, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL, part_queries: int = PART_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` largest inner products found for each row where ``is_query`` holds.

    ``is_query`` is a condition on vec_id. Unusable vectors (see :func:`usable`) take no part. Vectors of each length are searched apart,
    since only they have inner products. Rows that repeat count once; if one vec_id has several vectors, each is a query and a candidate,
    no candidate being the query's own id, and of the pairs of two ids the largest product counts. An empty table gives no rows. Of equal vectors only
    the first ``nearest`` + 1 by vec_id are indexed, since ties go to the smaller vec_id and no other can be returned.
    All rows are indexed; the split points come from a bounded sample. A block of BLOCK_LEAVES leaves with more than PART_ROWS rows is dealt out in parts, and
    so are its queries beyond ``part_queries``; every part of rows meets every part of queries in a task of its own. A query visits ``visited`` leaves, or as many
    more as a sample of the queries needs to find ``recall`` of their exact neighbours, so the share of the index follows its size.
    """
    spark = vectors.sparkSession
    good = cut(usable(vectors, id_column, vector_column).withColumn("dim", F.size("embedding")))
    found = spark.createDataFrame([], FOUND)
    for r in good.groupBy("dim").count().orderBy("dim").collect():  # a row for each vector length
        found = found.unionByName(_candidates(good.where(F.col("dim") == r["dim"]).drop("dim"), is_query, r["dim"], r["count"], nearest, trees, visited, leaf_rows, recall, part_queries))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def _candidates(good: DataFrame, is_query, dim: int, n: int, nearest: int, trees: int, visited: int, leaf_rows: int, recall: float, part_queries: int) -> DataFrame:
    """(query_id, vec_id, score) of the ``nearest`` of the leaves that a query visits in each block, over ``n`` vectors of one length."""
    spark = good.sparkSession
    copies = W.partitionBy("embedding").orderBy("vec_id")
    index = good.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= nearest + 1).drop("copy")
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / n))
    sample = good.where(draw).select("embedding").toPandas()["embedding"]  # about SAMPLE rows at most
    sample = np.stack(sample.to_list()) if len(sample) else np.zeros((1, dim))
    forest = fit_forest(sample, n, trees, leaf_rows)
    shared = spark.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            leaf = shared.value.leaves(matrix(batch.column(1), dim))
            take = pa.array(np.repeat(np.arange(batch.num_rows), trees))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), batch.column(0).take(take), batch.column(1).take(take)], ["leaf", "vec_id", "embedding"])

    placed = cut(index.select("vec_id", "embedding").mapInArrow(place, "leaf long, vec_id long, embedding array<double>"))
    rows = np.zeros(trees * 2**forest.depth, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # trees * 2 ** depth leaves at most
        rows[r["leaf"]] = r["count"]
    forest.rows = rows.reshape(trees, -1)
    trial = good.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIAL_QUERIES).collect()
    tried = np.array([r["vec_id"] for r in trial], np.int64)
    trials = np.array([r["embedding"] for r in trial], np.float64).reshape(-1, dim)

    def exact(batches):
        best = None
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            score = np.einsum("qd,nd->qn", trials, base)
            score[tried[:, None] == ids] = -np.inf
            keep = min(nearest, len(ids))
            at = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep else np.zeros((len(tried), 0), np.int64)
            new = np.take_along_axis(score, at, axis=1), base[at], ids[at]
            best = new if best is None else tuple(np.concatenate(x, axis=1) for x in zip(best, new, strict=True))
            at = np.argsort(-best[0], axis=1, kind="stable")[:, :nearest]
            best = np.take_along_axis(best[0], at, axis=1), np.take_along_axis(best[1], at[:, :, None], axis=1), np.take_along_axis(best[2], at, axis=1)
        if best is not None:
            q, c = np.nonzero(best[0] > -np.inf)
            flat = pa.array(best[1][q, c].ravel())
            vector = pa.FixedSizeListArray.from_arrays(flat, dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[2][q, c]), pa.array(best[0][q, c]), vector], ["q", "vec_id", "score", "embedding"])

    if len(tried) and visited < rows.size:
        once = placed.where(F.col("leaf") < 2**forest.depth).select("vec_id", "embedding")  # every row stands once in the first tree
        near = once.mapInArrow(exact, "q long, vec_id long, score double, embedding array<double>")
        near = near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= nearest)
        truth = [[] for _ in tried]
        for r in near.select("q", "embedding").collect():  # TRIAL_QUERIES * nearest rows at most
            truth[r["q"]].append(r["embedding"])
        visited = max(visited, visits_for(forest, trials, [np.array(x, np.float64).reshape(-1, dim) for x in truth], recall))
    width = min(BLOCK_LEAVES, 2**forest.depth)
    fit = max(64, VECTOR_BYTES // (8 * dim))
    part_rows, part_queries, batch_rows = min(PART_ROWS, fit), min(part_queries, fit), min(BATCH_ROWS, fit)
    parts = np.maximum(1, -(-rows.reshape(-1, width).sum(axis=1) // part_rows))
    fitted = spark.sparkContext.broadcast(forest)

    def blocks(forest: Forest, vector: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The blocks that a query visits, and its leaves in each."""
        leaf = np.sort(np.array(forest.visit(vector, visited, (nearest + 1) * trees), np.int64))
        block, first = np.unique(leaf // width, return_index=True)
        return block, np.split(leaf, first[1:])

    def visit(batches):
        for batch in batches:
            count = np.zeros(len(parts), np.int64)
            for vector in matrix(batch.column(1), dim):
                count[blocks(fitted.value, vector)[0]] += 1
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["block", "n"])

    askers = good.where(is_query).select("vec_id", "embedding")
    groups = np.zeros(len(parts), np.int64)
    for r in askers.mapInArrow(visit, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():  # a row for each block
        groups[r["block"]] = -(-r["n"] // part_queries)
    counted = spark.sparkContext.broadcast((forest, parts, groups))

    def ask(batches):
        forest, parts, groups = counted.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            block, part, who, leaves = [], [], [], []

            def sent():
                take = pa.array(who, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int64()), pa.array(ids).take(take), pa.array(leaves, pa.list_(pa.int64())), batch.column(1).take(take)], ["block", "part", "query_id", "leaves", "embedding"])

            for k, vector in enumerate(matrix(batch.column(1), dim)):
                for x, own_leaves in zip(*blocks(forest, vector), strict=True):
                    own = hash((int(ids[k]), int(x))) % int(groups[x])
                    for p in range(int(parts[x])):
                        block.append(int(x))
                        part.append(own * int(parts[x]) + p)
                        who.append(k)
                        leaves.append(own_leaves)
                if len(who) >= batch_rows:
                    yield sent()
                    block, part, who, leaves = [], [], [], []
            if who:
                yield sent()

    def deal(batches):
        _, parts, groups = counted.value
        for batch in batches:
            leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            block = leaf // width
            n, copies = parts[block], groups[block]  # a block without queries has no copies
            part = (((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % n.astype(np.uint64)).astype(np.int64)
            step = max(1, batch_rows // max(1, int(copies.max(initial=0))))
            for k in range(0, batch.num_rows, step):
                take = np.repeat(np.arange(k, min(k + step, batch.num_rows)), copies[k : k + step])
                if len(take):
                    group = np.arange(len(take)) - np.searchsorted(take, take)
                    yield pa.RecordBatch.from_arrays([pa.array(block[take]), pa.array(group * n[take] + part[take]), *[c.take(pa.array(take)) for c in batch.columns]], ["block", "part", "leaf", "vec_id", "embedding"])

    dealt = placed.select("leaf", "vec_id", "embedding").mapInArrow(deal, "block long, part long, leaf long, vec_id long, embedding array<double>")
    asked = askers.mapInArrow(ask, "block long, part long, query_id long, leaves array<long>, embedding array<double>")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, leaf = left["vec_id"].to_numpy(), left["leaf"].to_numpy()
        order = np.lexsort((ids, leaf))
        ids, leaf, base = ids[order], leaf[order], matrix(left["embedding"].combine_chunks(), dim)[order]
        askers, asked = right["query_id"].to_numpy(), matrix(right["embedding"].combine_chunks(), dim)
        wants = right["leaves"].combine_chunks()
        wanted, whose = wants.flatten().to_numpy(), np.repeat(np.arange(len(askers)), wants.value_lengths().to_numpy())
        out = [empty]
        for k in range(0, len(askers), 1024):
            lo, hi = np.searchsorted(whose, (k, k + 1024))
            met = []
            for x in np.unique(wanted[lo:hi]):
                begin, end = np.searchsorted(leaf, (x, x + 1))
                if begin == end:
                    continue
                mine, keep = whose[lo:hi][wanted[lo:hi] == x], min(nearest, int(end - begin))
                step = max(1, BATCH_SCORES // int(end - begin))
                for j in range(0, len(mine), step):
                    who = mine[j : j + step]
                    score = np.einsum("qd,nd->qn", asked[who], base[begin:end])  # one order of summation for every pair
                    score[askers[who, None] == ids[begin:end]] = -np.inf
                    least = np.partition(score, end - begin - keep, axis=1)[:, end - begin - keep]
                    q, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                    by = np.lexsort((c, -score[q, c], q))
                    q, c = q[by], c[by]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, c = q[place < nearest], c[place < nearest]
                    met.append((who[q], ids[begin + c], score[q, c]))
            if not met:
                continue
            q, to, score = (np.concatenate(x) for x in zip(*met, strict=True))
            for one in (True, False):  # the largest product of two ids, then the ``nearest`` of those
                by = np.lexsort((-score, to, q)) if one else np.lexsort((to, -score, q))
                q, to, score = q[by], to[by], score[by]
                stay = np.concatenate(([True], (q[1:] != q[:-1]) | (to[1:] != to[:-1]))) if one else np.arange(len(q)) - np.searchsorted(q, q) < nearest
                q, to, score = q[stay], to[stay], score[stay]
            out.append(pa.table({"query_id": askers[q], "vec_id": to, "score": score}))
        return pa.concat_tables(out)

    return dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(rank, FOUND)


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
