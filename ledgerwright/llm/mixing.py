"""Mixing sources to target weights: hash-random keys, range-sort within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwright.llm.shared import cut, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
ROWS_A_RANGE = 4096
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Words that each source shall give: (source_key, source, source_size) -> also target.

    The weights repeat over the sources in code-point order, null last. ``share`` of all words is divided by
    weight; where a source would pass ``epochs`` times its size it stops there and the rest is shared anew.
    Filling all sources to one level does this in one pass: sorted by size per weight, a source is full if the
    budget left after all sources before it, at its own level for all others, still suffices.
    One row per source; the windows here run over that table only.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("level", epochs * F.col("source_size") / F.col("weight"))
    before = W.orderBy("level", "source_key").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("budget") - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("left") * F.col("weight") >= epochs * F.col("source_size") * F.col("weights_left"))
    )
    open_left = F.min(F.when(~F.col("full"), F.struct("level", "source_key", "left", "weights_left"))).over(everything)
    shared = open_left["left"] * F.col("weight") / open_left["weights_left"]
    return ranked.withColumn("target", F.when(F.col("full"), (epochs * F.col("source_size")).cast("double")).otherwise(shared)).select("source_key", "source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Add size, source_size, target and taken (words that the mix takes, repeats counted) to ``docs``.

    Columns read: doc_id, source, text; all others pass through. A null text has size 0; null is a source of
    its own, last in order. Documents are ordered within their source by md5 of doc_id, so reruns agree; rows
    that repeat wholly share their key and stand next to each other. A source gives floor(target) words exactly:
    whole epochs first, then documents in order, the last one cut. An empty table gives no rows.

    Only (source, range) totals are summed over a window per source; rows are summed within one range, whose
    size stays near ``rows_a_range`` since the keys are random. No task holds a source.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    n_ranges = max(1, -(-docs.count() // rows_a_range))
    keyed = (
        docs.withColumn("size", word_count("text"))
        .withColumn("source__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
        .withColumn("key__", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("range__", F.floor(F.conv(F.substring("key__", 1, 8), 16, 10).cast("long") * F.lit(n_ranges) / F.lit(1 << 32)).cast("int"))
    )
    ranges = cut(keyed.groupBy("source__key", "range__").agg(F.max("source").alias("source"), F.sum("size").alias("range_size")))
    sources = cut(targets(ranges.groupBy(F.col("source__key").alias("source_key")).agg(F.max("source").alias("source"), F.sum("range_size").alias("source_size")), weights, share, epochs))
    ahead = W.partitionBy("source__key").orderBy("range__").rowsBetween(W.unboundedPreceding, -1)
    facts = sources.drop("source").withColumnRenamed("source_key", "source__key")
    if sources.count() <= BROADCAST_SOURCES:
        facts = F.broadcast(facts)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(ahead), F.lit(0))).select("source__key", "range__", F.col("range_start").alias("start__")).join(facts, "source__key")
    within = W.partitionBy("source__key", "range__").orderBy("key__", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    summed = (
        keyed.join(starts, ["source__key", "range__"])
        .withColumn("start__", F.col("start__") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("epochs__", whole)
    )
    rest = budget - F.col("epochs__") * F.col("source_size") - F.col("start__")
    taken = F.col("epochs__") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest))
    return summed.withColumn("taken", taken.cast("long")).select(*docs.columns, "size", "source_size", "target", "taken")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(documents: str = "documents", columns: str = "doc_id, size, source_size, target, taken", where: str = "TRUE") -> str:
    """DuckDB twin: the same order by md5, with plain windows, and the level found by trying every number of full sources."""
    return f"""
WITH d AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM {documents}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ssize FROM d GROUP BY source
), r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY 2 * ssize / w, source IS NULL DESC, source) AS rn FROM r
), f AS (
  SELECT *, (SELECT sum(ssize) FROM s) * 1.5::DOUBLE - 2 * coalesce(CAST(sum(ssize) OVER p AS BIGINT), 0) AS lft,
         (SELECT sum(w) FROM r) - coalesce(sum(w) OVER p, 0) AS wl
  FROM l WINDOW p AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT lft, wl, rn FROM f WHERE NOT lft * w >= 2 * ssize * wl ORDER BY rn LIMIT 1
), t AS (
  SELECT f.source, f.ssize,
         CASE WHEN f.lft * f.w >= 2 * f.ssize * f.wl THEN CAST(2 * f.ssize AS DOUBLE) ELSE o.lft * f.w / o.wl END AS target
  FROM f LEFT JOIN o ON TRUE
), c AS (
  SELECT d.*, t.ssize AS source_size, t.target,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start,
         CASE WHEN t.ssize > 0 THEN CAST(floor(floor(t.target) / t.ssize) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), m AS (
  SELECT *, CAST(whole * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - whole * source_size - start)) AS BIGINT) AS taken FROM c
)
SELECT {columns} FROM m WHERE {where}"""
