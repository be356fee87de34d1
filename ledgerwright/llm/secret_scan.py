"""Secret scans: exact patterns, and a linear-chain CRF that tags tokens as secret begin, inside or outside."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.chains import viterbi
from ledgerwright.llm.crf import Field, fit_chain
from ledgerwright.llm.shared import cut, small_batches, utf8

#: The patterns of the contract.
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Documents, about, from which the CRF learns; windows of tokens taken from them at most; tokens in a window.
TRAIN_DOCS = 20_000
TRAIN_WINDOWS = 6000
WINDOW = 15
#: An added span has at least as many code points as a secret of the patterns, and not only letters or digits.
ADDED_POINTS = 8
#: What secrets look like that the patterns don't name: in all but the first of VARIANTS of a training text the secret and its keyword are
#: drawn from these, and something of a harmless shape stands somewhere.
VARIANTS = 8
HIDDEN_WORDS = ("key", "auth", "pwd", "credential", "bearer", "signature", "pin", "login")
HIDDEN_LETTERS = ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
NEIGHBOURS = 1024
SIZES = [192, 48, NEIGHBOURS, NEIGHBOURS, 25, 16]

_CLASS = np.full(256, 2, np.uint8)  # 0 separator, 1 upper, 2 lower or not ASCII, 3 digit, 4 other token character
_CLASS[:128] = 0
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(x) for x in "+/_.-"]] = 4
_COUNT = np.zeros(256, np.int64)  # upper, lower, digits, others in 16 bits each
for _k in (1, 2, 3, 4):
    _COUNT[_CLASS == _k] = 1 << (16 * (_k - 1))
_NOT_HEX = np.ones(256, np.int64)
_NOT_HEX[48:58] = _NOT_HEX[97:103] = 0
_SEPARATOR = np.zeros(256, np.uint8)  # 0 none, 1 space, 2 : or =, 3 quote, 4 other
_SEPARATOR[:128][_CLASS[:128] == 0] = 4
_SEPARATOR[[32, 9, 13]] = 1
_SEPARATOR[[58, 61]] = 2
_SEPARATOR[[34, 39]] = 3
_STEPS = np.searchsorted([4, 8, 16, 24, 32], np.arange(64), side="right").astype(np.int64)
_SWITCHES = np.searchsorted([1, 2, 3, 5, 9, 14, 20], np.arange(64), side="right").astype(np.int64)


def base_spans(text: str, may_hex: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the contract's patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if may_hex:
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def harmless(rng: np.random.Generator, word: str) -> str:
    """An address, date, version, number or name with digits, none of them a secret."""
    n = [int(x) for x in rng.integers(1, 4000, 6)]
    return (f"http://{word}.org/{word}/{n[0]}", f"https://www.{word}.com/{word}?{word}={n[0]}", f"20{n[0] % 100:02}-{n[1] % 12:02}-{n[2] % 28:02}", f"v{n[0] % 9}.{n[1] % 20}.{n[2]}", f"+{n[0]} {n[1]} {n[2]}{n[3]}", f"{word}{n[0] % 100}", f"{word}_{word}-{n[1]}", f"{word}{n[2]}@{word}.net", f"{n[0]}.{n[1]}", f"{n[0]} {n[1]}{n[2]} {n[3]}")[rng.integers(10)]


def disguised(text: str, variant: int) -> tuple[str, list[tuple[int, int]], int]:
    """A variant of a training text, the byte ranges of its secrets, and the byte at which something harmless was put in (-1: nothing).

    Variant 0 is the text itself. In others each secret is drawn anew from HIDDEN_LETTERS, at a length of 10 to 40, behind a word
    of HIDDEN_WORDS or none, so that shape and place teach, not one keyword. All draws follow from the text.
    """
    found = sorted([(*m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [(*m.span(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] + [(*m.span(), *m.span()) for m in HEX.finditer(text)])
    rng, out, spans, at = np.random.default_rng((zlib.crc32(text.encode()), variant)), [], [], 0
    size = 0  # bytes of out
    for a, b, x, y in found:
        if a < at:
            continue  # a hex run or an access key inside an assignment
        before, value = text[a:x], text[x:y]
        if variant:
            word = HIDDEN_WORDS[rng.integers(len(HIDDEN_WORDS))]
            before = ("", f"{word} ", f"{word} is ", f"{word}=", f"{word}: ", f'{word} = "')[rng.integers(6)]
            letters = HIDDEN_LETTERS[rng.integers(len(HIDDEN_LETTERS))]
            value = "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(10, 41)))
        out += [text[at:a], before, value]
        size += len((text[at:a] + before).encode())
        spans.append((size, size + len(value.encode())))
        size, at = spans[-1][1], y
    rest, mark = text[at:], -1
    if variant and " " in rest:
        words = re.findall("[A-Za-z]{3,12}", rest[:2000]) or ["word"]
        place = rest.index(" ", int(rng.integers(0, rest.rindex(" ") + 1)))
        mark = size + len(rest[: place + 1].encode())
        rest = f"{rest[:place]} {harmless(rng, words[rng.integers(len(words))].lower())}{rest[place:]}"
    return "".join(out) + rest, spans, mark


def tokens(raw: np.ndarray, at: np.ndarray):
    """Tokens of joined texts (start, end, document) and the values of their features."""
    kind = _CLASS[raw]
    solid = kind > 0
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    n = len(start)
    doc = np.searchsorted(at, start, side="right") - 1
    if not n:
        return start, end, doc, [np.zeros(0, np.int64)] * len(SIZES)
    pairs = np.empty(2 * n, np.int64)
    pairs[0::2], pairs[1::2] = start, end
    if pairs[-1] == len(raw):
        pairs = pairs[:-1]
    counts = np.add.reduceat(_COUNT[raw], pairs)[::2]
    switch = np.zeros(len(raw), np.int64)
    switch[1:] = kind[1:] != kind[:-1]
    switch[start] = 0
    other = np.add.reduceat((_NOT_HEX[raw] << 32) + switch, pairs)[::2]
    upper, lower, digit, special = (((counts >> (16 * k)) & 0xFFFF) for k in range(4))
    size = end - start
    shape = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (special > 0) + 16 * ((other >> 32) == 0) + 32 * _STEPS[np.minimum(size, 63)]
    texture = _SWITCHES[np.minimum(other & 0xFFFFFFFF, 63)] * 6 + np.minimum(5, 6 * digit // size)
    low = raw | 32
    last = np.maximum(end - 1, 0)
    word = size * 97
    for step, factor in ((start, 31), (np.minimum(start + 1, last), 1009), (np.minimum(start + 2, last), 4099), (last, 8209)):
        word = word + low[step].astype(np.int64) * factor
    word = (word ^ (word >> 9)) % (NEIGHBOURS - 1) + 1
    same = np.zeros(n, bool)
    same[1:] = doc[1:] == doc[:-1]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:] = np.where(same[1:], word[:-1], 0)
    after[:-1] = np.where(same[1:], word[1:], 0)
    mark = _SEPARATOR[raw]
    left = np.where(start > at[doc], mark[np.maximum(start - 1, 0)], 0).astype(np.int64)
    further = np.where(start - 1 > at[doc], mark[np.maximum(start - 2, 0)], 0).astype(np.int64)
    n_docs = len(at) - 1
    totals = np.bincount(doc, minlength=n_docs)
    digits = np.bincount(doc, digit > 0, n_docs) / np.maximum(1, totals)
    assigns = np.bincount(doc, left == 2, n_docs) / np.maximum(1, totals)
    file = np.searchsorted([0.001, 0.02, 0.2], digits, side="right") * 4 + np.searchsorted([0.001, 0.01, 0.1], assigns, side="right")
    return start, end, doc, [shape, texture, before, after, left * 5 + further, file[doc]]


def training_windows(docs: DataFrame, train_docs: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of windows around the secrets and harmless shapes of :func:`disguised` texts, and random ones of one text in two, from a bounded sample."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000))
    sample = docs.where(draw < int(1_000_000 * min(1.0, train_docs / max(1, n)))).where("text is not null").select("text")

    def run(batches):
        for batch in small_batches(batches, 1024, 1 << 20):
            made = []
            for text in batch.column(0).to_pylist():
                first = disguised(text, 0)
                made.append(first)
                made += [disguised(text, v) for v in (range(1, VARIANTS) if first[1] else (1,))]
            texts, spans, marks = zip(*made, strict=True)
            raw, at = utf8(pa.array(texts, pa.string()))
            start, end, doc, features = tokens(raw, at)
            if len(start) < WINDOW:
                continue
            labels = np.zeros(len(start), np.int64)
            left = []
            for k, secrets in enumerate(spans):
                low, high = np.searchsorted(doc, (k, k + 1))
                rng = np.random.default_rng(zlib.crc32(texts[k].encode()))  # by the text alone, so any split of the table teaches alike
                middle = []
                for a, b in secrets:
                    x, y = np.searchsorted(start, (at[k] + a, at[k] + b))
                    x = max(x, int(np.searchsorted(end, at[k] + a, side="right")))
                    labels[x:y] = INSIDE
                    if x < y:
                        labels[x] = BEGIN
                        middle.append(x)
                if marks[k] >= 0:
                    middle.append(min(int(np.searchsorted(start, at[k] + marks[k])), high - 1))
                if high - low < WINDOW:
                    middle = []
                else:
                    middle += [int(rng.integers(low, high))] * int(rng.integers(2))
                    left += [min(max(x - int(rng.integers(3, WINDOW - 3)), low), high - WINDOW) for x in middle]
            if not left:
                continue
            index = np.array(left)[:, None] + np.arange(WINDOW)
            flat = np.stack([f[index] for f in features], 2).astype(np.int16).reshape(len(index), -1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in flat], pa.binary()), pa.array([x.tobytes() for x in labels[index].astype(np.int8)], pa.binary()), pa.array(labels[index].any(1))], ["x", "y", "positive"])

    found = cut(sample.mapInArrow(run, "x binary, y binary, positive boolean"))
    order = F.xxhash64("x")
    half = windows // 2
    rows = found.where("positive").orderBy(order).limit(half).unionByName(found.where("not positive").orderBy(order).limit(windows - half)).toPandas()
    x = np.array([np.frombuffer(v, np.int16) for v in rows["x"]]).reshape(-1, WINDOW, len(SIZES)).astype(np.int64)
    y = np.array([np.frombuffer(v, np.int8) for v in rows["y"]]).reshape(-1, WINDOW).astype(np.int64)
    return x, y


def fit(docs: DataFrame) -> Field | None:
    """The CRF, or None where the sample holds no secret to learn from."""
    x, y = training_windows(docs)
    if not (y > 0).any():
        return None
    rng = np.random.default_rng(3)
    hide = rng.random(x.shape[:2]) < 0.5  # half of the tokens are learned from without their neighbours
    x[hide, 2] = x[hide, 3] = 0
    field = fit_chain(x, y, SIZES, 3, rounds=150, decay=2e-5)
    field.trans[OUTSIDE, INSIDE] = field.trans.min() - 2
    return Field([t.astype(np.float32) for t in field.tables], field.trans.astype(np.float32))


def scan(docs: DataFrame, model: Field | None) -> DataFrame:
    """Add secrets to ``docs``: array of (kind, start, end) in code points, by start, then kind: assign, access, hex, crf.

    The exact patterns are all kept; crf marks further stretches that the CRF tags as secrets and that meet none of
    them. Null and empty texts have none; rows that repeat get equal results.
    """
    docs = docs.drop("secrets")
    where = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        field = shared.value
        for batch in small_batches(batches, 2048, 3 << 20):
            column = batch.column(where)
            raw, at = utf8(column)
            n = batch.num_rows
            added = [[] for _ in range(n)]
            if field is not None and len(raw):
                start, end, doc, features = tokens(raw, at)
                if len(start):
                    emit = field.emit(features)
                    first = np.ones(len(start), bool)
                    first[1:] = doc[1:] != doc[:-1]
                    labels = viterbi(emit, field.trans, first)
                    hit = np.flatnonzero(labels > 0)
                    if len(hit):
                        opens = np.ones(len(hit), bool)
                        opens[1:] = (np.diff(hit) > 1) | (labels[hit[1:]] == BEGIN) | (doc[hit[1:]] != doc[hit[:-1]])
                        for a, b in zip(np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:], len(hit)), strict=True):
                            s, e, d = start[hit[a]], end[hit[b - 1]], doc[hit[a]]
                            kinds = _CLASS[raw[s:e]]
                            if (kinds == 3).any() and ((kinds == 1) | (kinds == 2)).any():
                                added[d].append((int(s - at[d]), int(e - at[d])))
            may_hex = set()
            if len(raw):  # documents that the runs of 32 and more hex bytes touch, whatever lies between texts
                edges = np.concatenate(([-1], np.flatnonzero(_NOT_HEX[raw]), [len(raw)]))
                for x in np.flatnonzero(np.diff(edges) > 32):
                    may_hex.update(range(*np.searchsorted(at, (edges[x] + 1, edges[x + 1]), side="right") - (1, 0)))
            out = []
            for k, text in enumerate(column.to_pylist()):
                spans = [] if not text else [(a, b, KINDS.index(c)) for a, b, c in base_spans(text, k in may_hex)]
                if added[k]:
                    encoded = text.encode()
                    for a, b in added[k]:
                        a, b = len(encoded[:a].decode()), len(encoded[:b].decode())
                        if b - a >= ADDED_POINTS and all(b <= x or y <= a for x, y, _ in spans):
                            spans.append((a, b, 3))
                out.append([{"kind": (*KINDS, "crf")[c], "start": a, "end": b} for a, b, c in sorted(spans, key=lambda x: (x[0], x[2]))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [*batch.schema.names, "secrets"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{columns}, secrets array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs))
    base = F.filter("secrets", lambda x: x["kind"] != "crf")
    counts = [counted("secrets", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
