"""Benchmark decontamination: broadcast hash set of normalised test n-grams, token windows scanned, hits verified word by word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.shared import cut, row_key

WINDOW = 10
#: Test windows up to which their hash set is broadcast (about 16 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 4_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text):
    """Words of a text: A-Z lowered, cut at ASCII other than letters and digits; null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""), F.array().cast("array<string>"))


def windows_of(words, length: int):
    """Hash of each window of ``length`` words, by position from 1."""
    last = F.size(words) - length + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, length)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_words, hash, length, items): the distinct windows of all items; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col("item_id"), normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    cuts = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice(F.col("words"), i, length))).alias("window_words"))
    return cuts.groupBy("window_words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn("hash", F.xxhash64("window_words")).withColumn("length", F.size("window_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, occurrences, items) of the documents in which a test window occurs.

    occurrences: array of (pos, length), in words from 1, sorted. items: ids of the items with occurring windows, sorted.
    Every window of every document is hashed and probed; a hit counts only when its words equal the window's.
    """
    tests = cut(benchmark_windows(benchmark, window))
    lengths = sorted(r["length"] for r in tests.select("length").distinct().collect())  # at most `window` values
    probe = tests.select("hash", "length").distinct()
    if tests.count() <= BROADCAST_WINDOWS:
        probe = F.broadcast(probe)
    worded = docs.select(*row_key(), normal_words(F.col("text")).alias("words"))
    found = None
    for n in lengths:
        hits = worded.select("doc_id", "text_hash", F.posexplode(windows_of(F.col("words"), n)).alias("pos", "hash"))
        hits = hits.join(probe.where(F.col("length") == n), "hash", "left_semi").select("doc_id", "text_hash", (F.col("pos") + 1).alias("pos"), F.lit(n).alias("length"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = worded.where(F.lit(False)).select("doc_id", "text_hash", F.lit(1).alias("pos"), F.lit(1).alias("length"))
    places = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "length")).alias("places"))
    places = cut(places)
    again = worded.join(places.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash"), (F.col("doc_id").eqNullSafe(F.col("hit_id"))) & (F.col("text_hash") == F.col("hit_hash")))
    again = again.dropDuplicates(["doc_id", "text_hash"])
    seen = again.select("doc_id", "text_hash", F.explode("places").alias("p"), F.slice("words", F.col("p.pos"), F.col("p.length")).alias("window_words"))
    right = seen.join(tests.select("window_words", "items"), "window_words")
    return right.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set("p")).alias("occurrences"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered_words(occurrences):
    """Number of words inside any of the sorted (pos, length)."""
    nothing = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(acc, x):
        end = x["pos"] + x["length"] - 1
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["pos"] - 1))).alias("n"))

    return F.aggregate(occurrences, nothing, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add n_words, n_hit, n_items, items and contaminated to every row of ``docs``.

    Columns read: doc_id and text of ``docs``, item_id and text of ``benchmark``; other columns pass through.
    Null and empty texts have no words and no hits; rows that repeat get equal results; an empty benchmark hits
    nothing; an item without words has no window.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated")
    hits = contamination(docs, benchmark, window).select(F.col("doc_id").alias("hit__id"), F.col("text_hash").alias("hit__hash"), covered_words(F.col("occurrences")).cast("long").alias("n_hit"), "items")
    hits = cut(hits)
    key = row_key()
    both = docs.withColumn("own__hash", key[1]).withColumn("n_words", F.size(normal_words(F.col("text"))).cast("long"))
    both = both.join(hits, F.col("doc_id").eqNullSafe(F.col("hit__id")) & (F.col("own__hash") == F.col("hit__hash")), "left")
    return both.select(
        *docs.columns,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    result = decontaminate(docs, benchmark)
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), ww AS (
  SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win
  FROM iw WHERE len(w) > 0
), dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), ks AS (
  SELECT DISTINCT k FROM ww
), dn AS (
  SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win
  FROM dw, ks WHERE len(w) >= k
), h AS (
  SELECT DISTINCT rid, pos, dn.k AS k, item_id FROM dn JOIN ww ON dn.win = ww.win AND dn.k = ww.k
), c AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT rid, pos, k FROM h)) GROUP BY rid
), t AS (
  SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
