"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores with a switching penalty labels spans."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwright.llm.chains import viterbi
from ledgerwright.llm.shared import code_points, small_batches

#: First code points of the script ranges, by Unicode block; letters outside all count as "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)),
}
BUCKETS = 1 << 16
SWITCH_PENALTY = 5.0
#: Labelled documents of each language that the model is fitted on, at most about.
TRAIN_DOCS_A_LANGUAGE = 5000
SMOOTHING = 0.5
#: A script is open to a language if at least this share of the language's training letters is in it.
SCRIPT_SHARE = 0.001


@lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its lower-case form if it is a letter or mark, else 0; its script + 1; and whether it is a letter."""
    lower, real = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for p in range(0x110000):
        kind = unicodedata.category(chr(p))[0]
        if kind in "LM":
            low = chr(p).lower()
            lower[p] = ord(low) if len(low) == 1 else p
            real[p] = kind == "L"
    script = np.full(0x110000, len(SCRIPTS) + 1, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] = k + 1
    return lower, script, real


def grams(points: np.ndarray, ends: np.ndarray):
    """Words (letter runs within one text) of joined texts: their starts and ends, scripts, and the bucket of each of
    their trigrams with the word's borders, word after word, with the place where each word's trigrams begin."""
    lower, script, _ = letters()
    letter = np.zeros(len(points) + len(ends) + 2, np.uint32)  # one 0 after each text, two ahead
    at = np.arange(len(points)) + 2 + np.searchsorted(ends, np.arange(len(points)), side="right")
    letter[at] = lower[points]
    is_letter = letter > 0
    starts = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
    stops = np.flatnonzero(is_letter[:-1] & ~is_letter[1:]) + 1
    used = np.flatnonzero(is_letter | np.concatenate(([False], is_letter[:-1])))
    a, b, c = letter[used - 2], letter[used - 1], letter[used]
    a = np.where(b > 0, a, 0)
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    bucket = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int32)
    first_gram = np.searchsorted(used, starts)
    back = np.zeros(len(letter), np.int64)
    back[at] = np.arange(len(points))
    word_start, word_end = back[starts], back[stops - 1] + 1
    return word_start, word_end, script[points[word_start]] if len(word_start) else np.zeros(0, np.uint8), bucket, first_gram


@dataclass
class LanguageModel:
    """Log-probability of each trigram bucket by language, and the scripts open to each language."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray
    penalty: float = SWITCH_PENALTY


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS_A_LANGUAGE, penalty: float = SWITCH_PENALTY) -> LanguageModel:
    """Count trigrams by language over at most about ``train_docs`` documents of each, chosen by a hash of doc_id.

    Columns: doc_id, text, lang; rows with a null text or lang teach nothing. What comes to the driver are the
    counts: at most BUCKETS and the scripts for each language.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 2, 0), bool), penalty)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, train_docs / n)))).otherwise(share)
    sample = rows.where(draw < share).select("lang", "text")

    def count(batches):
        for batch in small_batches(batches, 4096, 1 << 20):
            langs, text = batch.column(0).dictionary_encode(), batch.column(1)
            points, ends = code_points(text)
            ws, we, script, bucket, first_gram = grams(points, ends[1:])
            doc = np.searchsorted(ends, ws, side="right") - 1
            code = np.asarray(langs.indices)[doc]
            each = np.repeat(code, np.diff(np.append(first_gram, len(bucket))))
            width = BUCKETS + len(SCRIPTS) + 2
            table = np.bincount(each * width + bucket, minlength=len(langs.dictionary) * width)
            table += np.bincount(code * width + BUCKETS + script, we - ws, len(table)).astype(np.int64)
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(used // width)), pa.array((used % width).astype(np.int32)), pa.array(table[used])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    place = {x: k for k, x in enumerate(languages)}
    table = np.zeros((BUCKETS + len(SCRIPTS) + 2, len(languages)))
    table[counts["bucket"].to_numpy(int), counts["lang"].map(place).to_numpy(int)] = counts["n"].to_numpy()
    seen = max(1, int((table[:BUCKETS].sum(1) > 0).sum()))
    smooth = table[:BUCKETS] + SMOOTHING
    scores = np.log(smooth / (table[:BUCKETS].sum(0) + SMOOTHING * seen))
    scripts = table[BUCKETS:]
    return LanguageModel(languages, scores.astype(np.float32), (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))) & (scripts > 0), penalty)


LABELLED = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))),
])


def label(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred, score and spans to ``docs``, from the column text alone.

    spans: the stretches of one language, as (start, end, lang) in code points, from first to last letter.
    lang_pred: the language that most letters are labelled with, ties to the smaller name; score: its share of the
    letters. Null, empty and letterless texts get und, score 0 and no spans, combining marks alone being no letters; so
    does everything if nothing was learned. Rows that repeat get equal results. Input columns named like the three are
    replaced; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    schema = T.StructType([*docs.schema.fields, *LABELLED.fields])
    names, where = schema.names, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def run(batches):
        m = shared.value
        k = len(m.languages)
        lang_names = pa.array([*m.languages, "und"])
        trans = np.full((k, k), -m.penalty, np.float32)
        np.fill_diagonal(trans, 0)
        for batch in small_batches(batches, 4096, 1 << 20):
            n = batch.num_rows
            points, ends = code_points(batch.column(where))
            ws, we, script, bucket, first_gram = grams(points, ends[1:])
            if not k or not len(ws):
                none = np.zeros(n + 1, np.int32)
                spans = pa.ListArray.from_arrays(pa.array(none), pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], ["start", "end", "lang"]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(["und"] * n), pa.array(np.zeros(n)), spans], names)
                continue
            emit = np.add.reduceat(m.scores[bucket], first_gram, axis=0)
            allowed = m.scripts[script]
            allowed |= ~allowed.any(1, keepdims=True)
            emit = np.where(allowed, emit, np.float32(-1e6))
            doc = np.searchsorted(ends, ws, side="right") - 1
            first = np.ones(len(ws), bool)
            first[1:] = doc[1:] != doc[:-1]
            labels = viterbi(emit, trans, first)
            share = np.bincount(doc * k + labels, we - ws, n * k).reshape(n, k)
            real = np.concatenate(([0], np.cumsum(letters()[2][points], dtype=np.int32)))
            share[real[ends[1:]] == real[ends[:-1]]] = 0  # marks alone are no text
            total = share.sum(1)
            best = np.where(total > 0, share.argmax(1), k)
            score = share.max(1) / np.maximum(total, 1)
            opens = first.copy()
            opens[1:] |= labels[1:] != labels[:-1]
            begin = np.flatnonzero(opens)
            finish = np.append(begin[1:], len(ws)) - 1
            some = total[doc[begin]] > 0
            begin, finish = begin[some], finish[some]
            counts = np.bincount(doc[begin], minlength=n)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            base = ends[doc[begin]]
            spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(ws[begin] - base), pa.array(we[finish] - base), lang_names.take(pa.array(labels[begin]))], ["start", "end", "lang"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang_names.take(pa.array(best)), pa.array(score), spans], names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for documents whose crc32 of the id as text leaves 2 after division by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return label(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
