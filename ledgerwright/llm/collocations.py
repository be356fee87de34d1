"""Phrase collocations by dynamic itemset counting: phrase lengths interleave in cyclic scans of shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwright.llm.shared import cut, discard, small_batches, utf8

SHARDS = 3
LONGEST = 5
LEAST = 100
FIRST = 2000
#: Share, in percent, of its own occurrences from which a phrase within a longer one is dropped.
WITHIN = 100
#: Slots of the table that says since which scan a phrase has reached the threshold: one byte each, broadcast; its size is fixed.
SLOTS = 1 << 24
NEVER = 255
#: Bytes of text that are counted at a time.
BATCH_BYTES = 8 << 20
UPPER, SPACE, BREAK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t", b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(UPPER)] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACE)] = 1
_KIND[list(BREAK)] = 2


def tokenise(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, piece, text) of UTF-8 texts, in order: the lower-cased word, a number of its piece, and which text it stands in."""
    kind = _KIND[raw]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(first)
    broken = np.searchsorted(np.flatnonzero(kind == 2), starts)
    text = np.searchsorted(at, starts, side="right") - 1
    piece = broken + text  # both only grow, and a word of a later piece has one of them larger
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.flatnonzero(last) + 1 - starts)])
    data = _LOWER[raw[word]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return words, piece, text


def _rotated(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(17)) | (x >> np.uint64(47))


def count_phrases(raw: np.ndarray, at: np.ndarray, langs: list[str], scan: int, shards: int, longest: int, since: np.ndarray) -> pa.RecordBatch:
    """(lang, phrase, active, n) of a batch of texts: the occurrences of the phrases that are active in this scan.

    Single words are active from scan 0 on; a longer phrase is from the scan at which the later of its two subphrases, without its
    last and without its first word, was active and had reached the threshold by ``since``. Each is active for ``shards`` scans. The empty phrase counts
    all words. Hashes of the words, folded at every place, only look up ``since``; phrases are told apart by the dictionary codes of their words.
    """
    words, piece, text = tokenise(raw, at)
    tags, tag = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True) if langs else (np.zeros(0, str), np.zeros(0, np.int64))
    coded = words.dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang = tag[text]
    out: dict[str, list] = {"lang": [], "phrase": [], "active": [], "n": []}

    def emit(lang_code: np.ndarray, phrases: pa.Array, active: np.ndarray, n: np.ndarray) -> None:
        out["lang"].append(pa.array(tags, pa.string()).take(pa.array(lang_code)))
        out["phrase"].append(phrases.cast(pa.string()))
        out["active"].append(pa.array(active, pa.int32()))
        out["n"].append(pa.array(n, pa.int64()))

    def counted(places: np.ndarray, length: int, active: np.ndarray | None) -> None:
        """Emit the phrases of ``length`` words that begin at the places, with their number."""
        key, width, held = lang[places], len(vocabulary), len(tags)  # key numbers the phrases so far, below held
        for j in range(length):
            if held > (1 << 62) // width:  # one more word wouldn't fit into 64 bits
                found, key = np.unique(key, return_inverse=True)
                held = len(found)
            key, held = key * width + code[places + j], held * width
        order = np.argsort(key)
        edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        first, n = order[edge], np.diff(np.append(edge, len(order)))
        parts = [vocabulary.take(pa.array(code[places[first] + j])) for j in range(length)]
        phrases = parts[0] if length == 1 else pa.compute.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type))
        emit(lang[places[first]], phrases, np.zeros(len(first), np.int32) if active is None else active[first].astype(np.int32), n)

    if len(code):
        seeds = np.array([xxhash.xxh64_intdigest(t, 42) for t in tags], np.uint64)
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in vocabulary.cast(pa.large_binary()).to_pylist()], np.uint64)
        if scan < shards:
            counted(np.arange(len(code)), 1, None)
            n = np.bincount(lang, minlength=len(tags))
            emit(np.flatnonzero(n), pa.array([""] * np.count_nonzero(n)), np.zeros(np.count_nonzero(n), np.int32), n[n > 0])
        mask = np.uint64(len(since) - 1)
        folded = _rotated(seeds[lang]) ^ hashes[code]  # of the phrase of the present length that begins at a place
        ready = since[(folded & mask).astype(np.int64)]  # since which scan it may be part of a longer one
        for k in range(2, longest + 1):
            active = np.maximum(ready[:-1], ready[1:])[: len(code) - k + 1]
            places = np.flatnonzero((active <= scan) & (piece[: len(active)] == piece[k - 1 : k - 1 + len(active)]))
            if not len(places):
                break
            active = active[places]
            now = active.astype(np.int64) + shards > scan
            if now.any():
                counted(places[now], k, active[now])
            folded[places] = _rotated(folded[places]) ^ hashes[code[places + k - 1]]
            ready = np.full(len(code), NEVER, np.uint8)
            ready[places] = np.maximum(since[(folded[places] & mask).astype(np.int64)], active)
    kinds = {"lang": pa.string(), "phrase": pa.string(), "active": pa.int32(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.concat_arrays(v) if v else pa.array([], kinds[k]) for k, v in out.items()], list(out))


def slot_of(slots: int = SLOTS) -> Column:
    """The slot of (lang, phrase), as :func:`count_phrases` computes it: word hashes folded by rotation and exclusive or."""
    turn = lambda x: F.shiftleft(x, 17).bitwiseOR(F.shiftrightunsigned(x, 47))
    folded = F.aggregate(F.split("phrase", " "), F.xxhash64("lang"), lambda x, w: turn(x).bitwiseXOR(F.xxhash64(w)))
    return folded.bitwiseAND(F.lit(slots - 1))


def count(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(lang, phrase, n): exact occurrences of every phrase of up to ``longest`` words that has at least ``least`` in its lang, and of the empty phrase, which stands for all words.

    docs: lang and text, further columns are left out; null lang is und, null text is empty. Documents are dealt into ``shards``,
    which are scanned one after another, again and again. After each scan a phrase whose count has reached ``least`` is entered
    into a table of ``slots`` bytes with the number of the next scan. A longer phrase starts to count once both its subphrases are
    in the table, and ends after one full cycle, when it has met every shard once. A slot that two phrases share only starts a
    phrase early, or one that need not be counted; it still counts one full cycle, so counts are exact at any size. Counts of a scan are
    summed in each batch and task before they are shuffled. The driver holds the table alone.
    """
    spark = docs.sparkSession
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    dealt = docs.select(lang.alias("lang"), text.alias("text")).where(F.length("text") > 0)
    dealt = cut(dealt.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")), "shard")
    since = np.full(slots, NEVER, np.uint8)
    state, finished, scan, latest = None, [], 0, 0
    while scan < latest + shards:
        table = spark.sparkContext.broadcast(since)

        def read(batches, scan=scan, table=table):
            for batch in small_batches(batches, rows=1 << 20, size=batch_bytes):
                raw, at = utf8(batch.column(1))
                got = count_phrases(raw, at, batch.column(0).to_pylist(), scan, shards, longest, table.value)
                for k in range(0, got.num_rows, 50_000):
                    yield got.slice(k, 50_000)

        seen = dealt.where(F.col("shard") == scan % shards).select("lang", "text").mapInArrow(read, "lang string, phrase string, active int, n long")
        counted = seen.withColumn("reached", F.lit(None).cast("int"))
        if state is not None:
            counted = counted.unionByName(state)
        counted = counted.groupBy("lang", "phrase").agg(F.min("active").alias("active"), F.sum("n").alias("n"), F.min("reached").alias("reached"))
        reached = F.coalesce("reached", F.when(F.col("n") >= least, F.lit(scan + 1)))
        counted = counted.withColumn("reached", reached).withColumn("over", F.col("active") + shards <= scan + 1)
        before, counted = state, cut(counted.where("not over or reached is not null or phrase = ''"), "over")
        table.unpersist()
        if before is not None:
            discard(before, "over=false")
        finished.append(counted.where("over").select("lang", "phrase", "n"))
        fresh = counted.where((F.col("reached") == scan + 1) & (F.col("phrase") != "") & (F.size(F.split("phrase", " ")) < longest)).select(slot_of(slots).alias("slot"))
        words = fresh.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toPandas()  # slots / 64 rows at most
        bits = words["bits"].to_numpy(np.int64).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
        new = (words["word"].to_numpy(np.int64)[:, None] * 64 + np.arange(64))[bits.astype(bool)]
        new = new[since[new] == NEVER]
        scan += 1
        if len(new):
            if scan >= NEVER:
                raise ValueError("too many scans")
            since[new] = scan
            latest = scan
        state = counted.where("not over").drop("over")
    discard(dealt)
    discard(state, "over=false")
    got = finished[0]
    for part in finished[1:]:
        got = got.unionByName(part)
    return got


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, within: int = WITHIN, **more) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``first`` phrases of each lang by score, then a, then phrase.

    Candidates are phrases of 2 to ``longest`` words with a >= ``least`` occurrences. Of a phrase's cuts into a first part (l) and a
    rest (r) the one with the lowest score floor(1000 a n / (l r)) counts, then the one with the shorter first part; n is the number of
    words of the lang. Out go candidates inside a longer candidate that has ``within`` percent of their occurrences. Products are decimals
    of 38 digits, so scores are exact. Columns of ``docs`` besides lang and text are left out; an empty table gives no rows.
    """
    counts = cut(count(docs, least, longest, **more))
    size = F.size(F.split("phrase", " "))
    part = lambda i, n: F.array_join(F.slice("words", i, n), " ")
    candidates = counts.where(F.col("phrase") != "").where(size > 1).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words")).alias("tail"))
    known = counts.where("phrase <> ''")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    cuts = cuts.join(F.broadcast(counts.where("phrase = ''").groupBy("lang").agg(F.sum("n").alias("n"))), "lang")  # one row a lang
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    inner = candidates.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i")).select("lang", part(F.col("i"), F.col("m")).alias("phrase"), F.col("a").alias("longer"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * within))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op12_sql() -> str:
    lengths = " UNION ALL ".join(f"SELECT lang, {' || '.join(['w0', *[f"' ' || w{j}" for j in range(1, k)]])} AS phrase, {k} AS k FROM q WHERE w{k - 1} IS NOT NULL" for k in range(1, LONGEST + 1))
    ahead = ", ".join(f"lead(w0, {j}) OVER piece AS w{j}" for j in range(1, LONGEST))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {j} AS j, array_to_string(w[1:{j}], ' ') AS head, array_to_string(w[{j + 1}:], ' ') AS tail FROM cand WHERE k > {j}" for j in range(1, LONGEST))
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {m - 1}], ' ') AS phrase, a AS longer FROM (SELECT lang, w, a, unnest(range(1, k - {m - 2})) AS i FROM cand WHERE k > {m})" for m in range(2, LONGEST))
    return rf"""WITH p AS MATERIALIZED (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
u AS MATERIALIZED (SELECT lang, id, unnest(w) AS w0, unnest(range(1, len(w) + 1)) AS i FROM p),
q AS MATERIALIZED (SELECT lang, w0, {ahead} FROM u WINDOW piece AS (PARTITION BY id ORDER BY i)),
g AS ({lengths}),
f AS MATERIALIZED (SELECT lang, phrase, k, lang || chr(9) || phrase AS key, count(*) AS c FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, phrase, k, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= {LEAST}),
cuts AS ({cuts}),
scored AS (SELECT t.lang, t.phrase, t.a, t.j, h.c AS l, r.c AS r, n.n, CAST((1000::HUGEINT * t.a * n.n) // (h.c::HUGEINT * r.c) AS BIGINT) AS score
  FROM cuts t JOIN f h ON h.key = t.lang || chr(9) || t.head JOIN f r ON r.key = t.lang || chr(9) || t.tail JOIN total n ON n.lang = t.lang),
low AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, phrase, max(longer) AS longer FROM ({inner}) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {WITHIN} * a) WHERE rank <= {FIRST}"""


OP12_SQL = _op12_sql()
