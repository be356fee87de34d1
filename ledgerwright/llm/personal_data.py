"""PII: exact patterns, and a skip-chain CRF whose loopy message passing keeps labels of repeated tokens consistent."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.crf import Field, beliefs, fit_pseudo
from ledgerwright.llm.secret_scan import counted, joined
from ledgerwright.llm.shared import cut, small_batches, utf8

#: The patterns of the contract. Runs are taken whole (++), which finds the same matches in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
ADDRESS = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Documents, about, that the field learns from, graphs taken at most, and tokens of one graph.
TRAIN_DOCS = 20_000
TRAIN_GRAPHS = 3000
GRAPH_TOKENS = 300
#: Variants of a training text: the text itself, and ones in which some match stands again in a form that the patterns miss.
VARIANTS = 6
#: Belief that an added span needs, digits of an added number, and digits or letters that make two tokens similar.
SURE = 0.9
ADDED_DIGITS = 7
KEY_DIGITS = 7
WORDS = 512
SIZES = [120, 48, 9, 9, WORDS]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)  # a token without any of these is never personal data
_MARK[48:58] = _MARK[64] = True
_COUNT = np.zeros((256, 8), np.int32)  # digits, @, dots, letters, hyphens, plus, parentheses, colons and slashes
_COUNT[48:58, 0] = _COUNT[64, 1] = _COUNT[46, 2] = _COUNT[65:91, 3] = _COUNT[97:123, 3] = _COUNT[128:, 3] = 1
_COUNT[45, 4] = _COUNT[43, 5] = _COUNT[[40, 41], 6] = _COUNT[[58, 47], 7] = 1


def luhn(digits: str) -> bool:
    doubled = [int(x) * 2 for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind as listed, start, end) in code points, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text) if m[1]]
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in ADDRESS.finditer(text) if m[2] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def marked_tokens(raw: np.ndarray, at: np.ndarray):
    """The tokens (runs of non-space) with a digit or @: start, end, document, place among all tokens, features."""
    solid = ~_SPACE[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    place = np.unique(np.searchsorted(start, np.flatnonzero(_MARK[raw]), side="right") - 1)
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none, none, [none] * len(SIZES)
    before = np.maximum(place - 1, 0)
    word_at, word_size = start[before], end[before] - start[before]
    start, end = start[place], end[place]
    doc = np.searchsorted(at, start, side="right") - 1
    size = end - start
    first = np.cumsum(size) - size
    index = np.arange(size.sum()) - np.repeat(first - start, size)
    counts = np.add.reduceat(_COUNT[raw[index]], first, axis=0)
    digits, ats, dots, letters, hyphens, pluses, brackets, colons = counts.T
    step = np.searchsorted([1, 4, 7, 10, 13, 16, 20], digits, side="right")
    shape = (step * 3 + np.minimum(ats, 2)) * 5 + np.minimum(dots, 4)
    texture = (((np.minimum(2, (letters + 1) // 2) * 2 + (hyphens > 0)) * 2 + (pluses > 0)) * 2 + (brackets > 0)) * 2 + (colons > 0)
    near = np.zeros(len(place), bool)
    near[1:] = (np.diff(place) == 1) & (doc[1:] == doc[:-1])
    left, right = np.full(len(place), 8), np.full(len(place), 8)
    left[1:] = np.where(near[1:], step[:-1], 8)
    right[:-1] = np.where(near[1:], step[1:], 8)
    low = raw | 32
    word = low[word_at].astype(np.int64) * 31 + low[word_at + word_size - 1].astype(np.int64) * 131 + word_size * 17
    word = np.where((place > 0) & (word_at >= at[doc]), word % (WORDS - 1) + 1, 0)
    return start, end, doc, place, [shape, texture, left, right, word]


def edges_of(raw: np.ndarray, start, end, doc, place) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbouring tokens, and skip edges from each token to the next repeated or similar one of its document."""
    near = np.flatnonzero((np.diff(place) == 1) & (doc[1:] == doc[:-1]))
    last, skip = {}, []
    text = raw.tobytes()
    for k, (a, b, d) in enumerate(zip(start.tolist(), end.tolist(), doc.tolist(), strict=True)):
        token = text[a:b].lower()
        digits = bytes(x for x in token if 48 <= x < 58)
        key = (d, token.split(b"@")[0].strip(b".,;:!?()<>[]\"'")) if b"@" in token else (d, digits[-KEY_DIGITS:]) if len(digits) >= KEY_DIGITS else (d, token.strip(b".,;:!?()<>[]\"'"))
        if key in last:
            skip.append((last[key], k))
        last[key] = k
    return np.stack((near, near + 1), 1), np.array(skip, np.int64).reshape(-1, 2)


def token_labels(text: str, start, end) -> np.ndarray:
    """Label of the base span that each token (byte positions in the text) meets: 0 none, else kind + 1."""
    labels = np.zeros(len(start), np.int64)
    for kind, a, b in base_spans(text):
        a, b = len(text[:a].encode()), len(text[:b].encode())
        labels[(start < b) & (end > a)] = kind + 1
    return labels


def disguised(text: str, variant: int) -> tuple[str, tuple[int, int, int] | None]:
    """A variant of a training text, and (kind, start, end) in bytes of a match that was put in again: an address without its last domains, a phone
    number without its country's sign, a card with dots. All draws follow from the text; variant 0 is the text itself."""
    rng = np.random.default_rng((zlib.crc32(text.encode()), variant))
    found = [x for x in base_spans(text) if x[0] != 1]
    if not variant or not found or " " not in text:
        return text, None
    kind, a, b = found[rng.integers(len(found))]
    value = text[a:b]
    form = value.split(".")[0] if kind == 0 and "." not in value.split("@")[0] else value[: value.index("@") + 1] + value[value.index("@") + 1 :].split(".")[0] if kind == 0 else re.sub("[ -]", ".", value) if kind == 2 else value.lstrip("+").replace(" ", ("", "-", " ")[rng.integers(3)])
    place = text.index(" ", int(rng.integers(0, text.rindex(" ") + 1)))
    if a <= place < b:
        return text, None
    start = len(text[: place + 1].encode())
    return f"{text[:place]} {form}{text[place:]}", (kind, start, start + len(form.encode()))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, graphs: int = TRAIN_GRAPHS) -> Field | None:
    """Pseudo-likelihood fit on a bounded sample, labelled by the exact patterns and what :func:`disguised` put in; None where the sample has no match."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000))
    sample = docs.where(draw < int(1_000_000 * min(1.0, train_docs / max(1, n)))).where(F.col("text").rlike("[0-9@]")).select("text")

    def run(batches):
        for batch in small_batches(batches, 256, 1 << 20):
            made = [disguised(text, v) for text in batch.column(0).to_pylist() for v in (range(VARIANTS) if base_spans(text) else (0,))]
            raw, at = utf8(pa.array([x for x, _ in made], pa.string()))
            start, end, doc, place, features = marked_tokens(raw, at)
            blobs, positive = [], []
            for k, (text, again) in enumerate(made):
                a, b = np.searchsorted(doc, (k, k + 1))
                labels = token_labels(text, start[a:b] - at[k], end[a:b] - at[k])
                if again:
                    labels[(start[a:b] - at[k] < again[2]) & (end[a:b] - at[k] > again[1])] = again[0] + 1
                hit = np.flatnonzero(labels)
                middle = hit[len(hit) // 2] if len(hit) else 0
                low = max(0, min(middle - GRAPH_TOKENS // 2, b - a - GRAPH_TOKENS))
                cut = slice(a + low, min(b, a + low + GRAPH_TOKENS))
                chain, skip = edges_of(raw, start[cut], end[cut], doc[cut], place[cut])
                labels = labels[low : low + GRAPH_TOKENS]
                head = np.array([len(labels), len(chain), len(skip)])
                blobs.append(np.concatenate([head, labels, *[f[cut] for f in features], chain.ravel(), skip.ravel()]).astype(np.int32).tobytes())
                positive.append(bool(len(hit)))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(positive)], ["graph", "positive"])

    found = cut(sample.mapInArrow(run, "graph binary, positive boolean"))
    order = F.xxhash64("graph")
    half = graphs * 2 // 3
    rows = found.where("positive").orderBy(order).limit(half).unionByName(found.where("not positive").orderBy(order).limit(graphs - half)).toPandas()
    if not rows["positive"].any():
        return None
    labels, features, chains, skips, base = [], [], [], [], 0
    for blob in rows["graph"]:
        x = np.frombuffer(blob, np.int32).astype(np.int64)
        n, c, s = x[:3]
        labels.append(x[3 : 3 + n])
        features.append(x[3 + n : 3 + n + n * len(SIZES)].reshape(len(SIZES), n).T)
        rest = x[3 + n + n * len(SIZES) :]
        chains.append(rest[: 2 * c].reshape(-1, 2) + base)
        skips.append(rest[2 * c : 2 * (c + s)].reshape(-1, 2) + base)
        base += n
    return fit_pseudo(np.concatenate(features), np.concatenate(labels), np.concatenate(chains), np.concatenate(skips), SIZES, 1 + len(KINDS), rounds=200, decay=2e-5)


def scan(docs: DataFrame, model: Field | None) -> DataFrame:
    """Add personal to ``docs``: array of (kind, start, end, added) in code points, by kind as listed, then start.

    All matches of the exact patterns are kept. added marks stretches beyond them of which the field is sure and that meet
    none of them. Null and empty texts have none; rows that repeat get equal results.
    """
    docs = docs.drop("personal")
    where = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

    def run(batches):
        field = shared.value
        for batch in small_batches(batches, 2048, 3 << 20):
            column = batch.column(where)
            raw, at = utf8(column)
            start, end, doc, place, features = marked_tokens(raw, at)
            belief = None
            if field is not None and len(start):
                chain, skip = edges_of(raw, start, end, doc, place)
                belief = beliefs(field.emit(features), [(chain, field.trans), (skip, field.skip)])
            marked = set(doc.tolist())
            out = []
            for k in range(batch.num_rows):
                if k not in marked:
                    out.append([])
                    continue
                text = column[k].as_py()
                spans = [(a, b, c, False) for a, b, c in base_spans(text)]
                if belief is not None:
                    a, b = np.searchsorted(doc, (k, k + 1))
                    best = belief[a:b].argmax(1)
                    sure = np.flatnonzero((best > 0) & (belief[a:b].max(1) >= SURE))
                    if len(sure):
                        spans += further(text, raw, at[k], start[a:b], end[a:b], place[a:b], best, sure, spans)
                out.append([{"kind": KINDS[c], "start": a, "end": b, "added": x} for c, a, b, x in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind_of)], [*batch.schema.names, "personal"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{columns}, personal array<struct<kind:string,start:bigint,end:bigint,added:boolean>>")


def further(text: str, raw, base: int, start, end, place, best, sure, spans) -> list[tuple[int, int, int, bool]]:
    """Stretches of sure tokens of one label that meet no exact match, without their outer punctuation."""
    encoded = text.encode()
    groups, out = [], []
    for k in sure.tolist():
        if groups and place[k] == place[groups[-1][-1]] + 1 and best[k] == best[groups[-1][-1]] and best[k] > 2:
            groups[-1].append(k)
        else:
            groups.append([k])
    for group in groups:
        a, b = int(start[group[0]] - base), int(end[group[-1]] - base)
        part = encoded[a:b]
        b -= len(part) - len(part.rstrip(b".,;:!?)>]}\"'"))
        a += len(part) - len(part.lstrip(b".,;:!?<[{\"'"))
        digits = sum(48 <= x < 58 for x in encoded[a:b])
        kind = int(best[group[0]]) - 1
        if not (b"@" in encoded[a:b] if kind == 0 else encoded[a:b].count(b".") == 3 if kind == 1 else digits >= ADDED_DIGITS):
            continue
        a, b = len(encoded[:a].decode()), len(encoded[:b].decode())
        if all(b <= x or y <= a for _, x, y, _ in spans):
            out.append((kind, a, b, True))
    return out


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs)).withColumn("exact", F.filter("personal", lambda x: ~x["added"]))
    return found.select("doc_id", *[counted("exact", k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("exact")), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"))
