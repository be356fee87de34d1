"""Suffix-array dedup of exact substrings: difference-cover suffix sorting of what may repeat, adjacent prefixes compared."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.components import lean
from ledgerwright.llm.jaccard import _INVERSE, _BASE, _RANDOM, mixed, powers
from ledgerwright.llm.shared import cut, give_back, row_key, small_batches, utf8

LENGTH = 50
#: Bytes of an anchor: the anchor of a LENGTH-byte string is the least hash of its GRAM-byte substrings.
GRAM = 16
SPAN = LENGTH - GRAM + 1
#: Bytes of a core, which decides whether a string may repeat: a string has as many on one side of its anchor, that included.
CORE = GRAM + LENGTH // 3 + 1
#: Bits of the map of repeated cores that is broadcast. A fixed size: where it fills, more text is sorted and results stay.
MAP_BITS = 28
#: Strings that one segment holds at most, text sorted at once, and runs of an anchor beyond which its strings are dealt out one by one.
SEGMENT = 64
CHUNK = 1 << 20
MANY = 65536
#: Text for each of the slices that segments are dealt into; cores, documents and bytes of segments that are dealt out at a time.
SLICE = 16 << 20
HELD = 1 << 19
DOC_BITS = 20
DOCS = 1 << DOC_BITS
HELD_BYTES = 16 << 20
MARKS = pa.schema({"slice": pa.int32(), "n_once": pa.int32(), "once": pa.binary(), "n_twice": pa.int32(), "twice": pa.binary(), "often": pa.binary(), "times": pa.binary()})
DEALT = pa.schema({"slice": pa.int32(), "n": pa.int32(), "m": pa.int32(), "about": pa.binary(), "text": pa.binary(), "spots": pa.binary()})


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of positive integers, by difference cover modulo 3.

    Sorts the triples at positions 1 and 2 modulo 3, names them, recurses on the names where some are equal, sorts the
    remaining suffixes by first value and rank of the next, and merges both orders.
    """
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda k: s[k:].tolist()), np.int64)
    padded = np.concatenate((s.astype(np.int64), np.zeros(4, np.int64)))
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a sample at n itself ends the first half where n is 1 modulo 3
    sample = np.concatenate((ones, twos))
    width = int(padded.max()) + 1
    if width < 1 << 20:
        triples = (padded[sample] * width + padded[sample + 1]) * width + padded[sample + 2]
        _, names = np.unique(triples, return_inverse=True)
    else:
        order = np.lexsort((padded[sample + 2], padded[sample + 1], padded[sample]))
        same = np.ones(len(sample), bool)
        for k in range(3):
            same[1:] &= padded[sample + k][order][1:] == padded[sample + k][order][:-1]
        same[0] = True
        names = np.empty(len(sample), np.int64)
        names[order] = np.cumsum(~same)
    names = names + 1
    if names.max() < len(sample):
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    by_sample = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[by_sample] = np.arange(1, len(sample) + 1)
    by_sample = by_sample[by_sample < n]
    zeros = np.arange(0, n, 3)
    big = len(sample) + 2
    zeros = zeros[np.argsort(padded[zeros] * big + rank[zeros + 1], kind="stable")]
    first, second = by_sample[by_sample % 3 == 1], by_sample[by_sample % 3 == 2]
    pair = lambda at: padded[at] * big + rank[at + 1]
    values = np.unique(np.concatenate((padded[zeros] * width + padded[zeros + 1], padded[second] * width + padded[second + 1])))
    three = lambda at: np.searchsorted(values, padded[at] * width + padded[at + 1]) * big + rank[at + 2]
    place = np.arange(len(zeros)) + np.searchsorted(pair(first), pair(zeros)) + np.searchsorted(three(second), three(zeros))
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zeros
    out[rest] = by_sample
    return out


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, document, anchor and core of every LENGTH-byte string inside one of the joined texts.

    The anchor is the GRAM-byte substring of least hash, the first of equal ones; the core is the hash of the CORE bytes that end or,
    if the string has too few before them, start with the anchor. Equal strings have equal ones.
    """
    n = len(raw)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[raw] * powers(_BASE, n + 1)[:-1], out=total[1:])
    back = powers(_INVERSE, n + 1)
    hashes = lambda size: mixed((total[size:] - total[:-size]) * back[: n - size + 1])
    grams = hashes(GRAM)
    least = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(grams) - SPAN + 1], least[SPAN - step :][: len(grams) - SPAN + 1])
    long = np.flatnonzero(np.diff(at) >= LENGTH)
    strings = np.diff(at)[long] - LENGTH + 1
    start = np.arange(strings.sum()) + np.repeat(at[long] - (np.cumsum(strings) - strings), strings)
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor = grams[place]
    del grams, least
    return start, np.repeat(long, strings), anchor, hashes(CORE)[place - np.where(place - start >= CORE - GRAM, CORE - GRAM, 0)]


def compressed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def expanded(data: pa.Scalar) -> bytes:
    data = data.as_py()
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers after one another, each by its first, second and further bytes, compressed."""
    return compressed(b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns))


def unpack(data: pa.Scalar, *kinds: tuple[int, type]) -> list[np.ndarray]:
    """The columns of :func:`pack`, from the length and type of each."""
    data, at, out = np.frombuffer(expanded(data), np.uint8), 0, []
    for n, kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind)[:, 0])
        at += n * size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending uint32 as differences."""
    return np.diff(x, prepend=x.dtype.type(0))


def ascending(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, (n, np.uint32))[0], dtype=np.uint32)


def repeated_cores(docs: DataFrame, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each value of the leading MAP_BITS bits of a core, set if a core of these bits occurs in two documents; and the anchors of many runs.

    An anchor of at least twice MANY runs is surely among the latter: batches name those that occur often enough there.
    """
    top = slices.bit_length() - 1
    many, often = max(1, MANY), max(1, MANY // (4 * slices))

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        value = np.sort(np.concatenate([core & ~np.uint64(DOCS - 1) | doc.astype(np.uint64) for core, doc, _ in held]))
        new = np.flatnonzero(np.concatenate(([True], value[1:] >> np.uint64(DOC_BITS) != value[:-1] >> np.uint64(DOC_BITS))))
        several = value[new] != value[np.append(new[1:], len(value)) - 1]
        value = value[new]
        edge = np.searchsorted(value, np.arange(slices, dtype=np.uint64) << np.uint64(64 - top)).tolist() + [len(value)]
        value = (value >> np.uint64(64 - top - 32)).astype(np.uint32)
        anchor, times = np.unique(np.concatenate([x for _, _, x in held]), return_counts=True)
        anchor, times = anchor[times >= often], times[times >= often].astype(np.uint32)
        at = (mixed(anchor) % np.uint64(slices)).astype(np.int64)
        anchor, times, at = (x[np.argsort(at, kind="stable")] for x in (anchor, times, at))
        cut_at = np.searchsorted(at, np.arange(slices + 1)).tolist()
        rows = []
        for k, (a, b) in enumerate(itertools.pairwise(edge)):
            once, twice, i, j = value[a:b][~several[a:b]], value[a:b][several[a:b]], cut_at[k], cut_at[k + 1]
            rows.append((k, len(once), pack(steps(once)), len(twice), pack(steps(twice)), anchor[i:j].tobytes(), times[i:j].tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(MARKS.names, r, strict=True)) for r in rows], MARKS)

    def mark(batches):
        held, size, docs_held = [], 0, 0
        for batch in small_batches(batches, 4096, 1 << 20):
            start, doc, anchor, core = anchors(*utf8(batch.column(0)))
            if not len(start):
                continue
            apart = doc[1:] != doc[:-1]
            head, first = (np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | apart))) for x in (core, anchor))
            held.append((core[head], doc[head] + docs_held, anchor[first]))
            size += len(head)
            docs_held += batch.num_rows
            if size >= HELD or docs_held > DOCS - 4096:
                yield dealt(held)
                held, size, docs_held = [], 0, 0
        if held:
            yield dealt(held)

    def found(k: int, parts: list[tuple]) -> pa.RecordBatch:
        every = np.sort(np.concatenate([x for x, _, _, _ in parts]))
        again = np.concatenate([every[1:][every[1:] == every[:-1]], *[x for _, x, _, _ in parts]])
        bit = np.zeros(1 << (MAP_BITS - top), np.uint8)
        bit[again >> np.uint32(32 - MAP_BITS + top)] = 1
        anchor, which = np.unique(np.concatenate([x for _, _, x, _ in parts]), return_inverse=True)
        anchor = anchor[np.bincount(which, np.concatenate([x for _, _, _, x in parts]), len(anchor)) >= many]
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(bit).tobytes(), 1)], pa.binary()), pa.array([anchor.tobytes()], pa.binary())], ["slice", "bits", "many"])

    def meet(batches):
        now, parts = None, []
        for batch in batches:
            for k, n, once, m, twice, anchor, times in zip(*batch.columns, strict=True):
                if k.as_py() != now and parts:
                    yield found(now, parts)
                    parts = []
                now = k.as_py()
                one, two = ascending(once, n.as_py()), ascending(twice, m.as_py())
                parts.append((np.concatenate((one, two)), two, np.frombuffer(anchor.as_py(), np.uint64), np.frombuffer(times.as_py(), np.uint32)))
        if parts:
            yield found(now, parts)

    marked = docs.select("text").mapInArrow(mark, "slice int, n_once int, once binary, n_twice int, twice binary, often binary, times binary")
    met = marked.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(meet, "slice int, bits binary, many binary")
    out, often_found = np.zeros(1 << MAP_BITS >> 3, np.uint8), [np.zeros(0, np.uint64)]
    size = len(out) // slices
    for r in met.collect():  # MAP_BITS bits in all, and as many anchors as there are runs by MANY
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        often_found.append(np.frombuffer(r["many"], np.uint64))
    return out, np.concatenate(often_found)


def segments_of(raw: np.ndarray, at: np.ndarray, known: np.ndarray):
    """Anchor, first string, bytes (start, end) and document of each run of strings of one anchor that may repeat."""
    start, doc, anchor, core = anchors(raw, at)
    index = (core >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    hit = np.flatnonzero((known[index >> 3] >> (7 - (index & 7)).astype(np.uint8)) & 1)
    start, doc, anchor = start[hit], doc[hit], anchor[hit]
    head = np.ones(len(hit), bool)
    head[1:] = (np.diff(start) > 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    group = np.flatnonzero(head)
    since = np.arange(len(hit)) - np.repeat(group, np.diff(np.append(group, len(hit))))
    group = np.flatnonzero(since % SEGMENT == 0)
    size = np.diff(np.append(group, len(hit))) + LENGTH - 1
    return anchor[group], start[group], size, doc[group]


def range_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_RANDOM[raw] * powers(_BASE, len(raw) + 1)[:-1], out=total[1:])
    return mixed((total[start + size] - total[start]) * powers(_INVERSE, len(raw) + 1)[start] ^ size.astype(np.uint64))


def places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each of several ranges."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def segments(docs: DataFrame, bits, many, slices: int) -> DataFrame:
    """The distinct segments of some batches and where they stand, dealt out by the hash of a key and compressed, one row a slice.

    The key is the anchor, so equal strings meet. Segments of the anchors in ``many`` are cut into their strings, each keyed by its own
    hash, so that no anchor is a hot group. A row has n segments in the order of their keys (about: low bits of the key, size, occurrences; text: their
    bytes) and then, segment by segment, m occurrences (spots: doc_id, text_hash, start).
    """

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        key, name, size, times, doc_id, text_hash, start = (np.concatenate([h[k] for h in held]) for k in range(7))
        raw = np.concatenate([h[7] for h in held])
        spread = mixed(key)
        at = ((spread >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
        low = spread.astype(np.uint32)
        order = np.lexsort((name, low, at))
        begin, spot = np.cumsum(size) - size, np.cumsum(times) - times
        which = places(spot[order], times[order])
        doc_id, text_hash, start = doc_id[which], text_hash[which], start[which]
        new = np.flatnonzero(np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1]))))
        times = np.add.reduceat(times[order], new)
        pick = order[new]
        at, low, size, begin = at[pick], low[pick], size[pick], begin[pick]
        edge = np.searchsorted(at, np.arange(slices + 1))
        spot_at = np.concatenate(([0], np.cumsum(times)))[edge].tolist()
        edge = edge.tolist()
        rows = []
        for k in range(slices):
            i, j, x, y = edge[k], edge[k + 1], spot_at[k], spot_at[k + 1]
            if i < j:
                about = pack(steps(low[i:j]), size[i:j].astype(np.uint8), times[i:j].astype(np.uint32))
                rows.append((k, j - i, y - x, about, compressed(raw[places(begin[i:j], size[i:j])].tobytes()), pack(doc_id[x:y], text_hash[x:y], start[x:y])))
        return pa.RecordBatch.from_pylist([dict(zip(DEALT.names, r, strict=True)) for r in rows], DEALT)

    def run(batches):
        held, size_held = [], 0
        for batch in small_batches(batches, 4096, 1 << 20):
            raw, at = utf8(batch.column(2))
            anchor, start, size, doc = segments_of(raw, at, bits.value)
            if not len(anchor):
                continue
            hot = np.isin(anchor, many.value)
            if hot.any():
                strings = np.where(hot, size - LENGTH + 1, 1)
                row = np.repeat(np.arange(len(anchor)), strings)
                start, size, doc, key = places(start, strings), np.where(hot, LENGTH, size)[row], doc[row], anchor[row]
                name = range_hashes(raw, start, size)
                key = np.where(hot[row], name, key)
            else:
                key, name = anchor, range_hashes(raw, start, size)
            order = np.lexsort((name, key))
            edge = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1]))))
            pick, doc = order[edge], doc[order]
            ids, hashes = (batch.column(k).to_numpy()[doc] for k in (0, 1))
            held.append((key[pick], name[pick], size[pick], np.diff(np.append(edge, len(order))), ids, hashes, (start[order] - at[doc]).astype(np.uint32), raw[places(start[pick], size[pick])]))
            size_held += len(held[-1][7]) + 20 * len(order)
            if size_held >= HELD_BYTES:
                yield dealt(held)
                held, size_held = [], 0
        if held:
            yield dealt(held)

    kinds = "slice int, n int, m int, about binary, text binary, spots binary"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, kinds)


def repeated_runs(raw: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, low, high, first): the runs low..high of the strings of distinct segments whose smallest document, of any segment, is below its last one.

    A run's ``first`` tells which documents of the segment lose it: those beyond the segment's smallest one, or, as
    every string of the run also starts in a smaller document, all (``first`` is then one below the smallest).
    """
    begin = np.cumsum(size) - size + np.arange(len(size))
    text = np.zeros(len(raw) + len(size), np.uint8)
    text[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
    symbol = text.astype(np.int64) + 2
    symbol[begin + size] = 1
    strings = size - LENGTH + 1
    owner = np.repeat(np.arange(len(size)), strings)
    start = places(begin, strings)
    number = np.full(len(text), -1)
    number[start] = np.arange(len(start))
    order = number[suffix_array(symbol)]
    order = order[order >= 0]
    prefix = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[start[order]]
    new = np.ones(len(order), bool)
    new[1:] = (prefix[1:] != prefix[:-1]).any(1)
    group = np.flatnonzero(new)
    least = np.minimum.reduceat(first[owner[order]], group)
    best = np.empty(len(order), np.int64)
    best[order] = np.repeat(least, np.diff(np.append(group, len(order))))
    best = first[owner] - (best < first[owner])
    edge = np.ones(len(best), bool)
    edge[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
    low = np.flatnonzero(edge)
    high = np.append(low[1:], len(best)) - 1
    use = best[low] < last[owner[low]]
    low, high = low[use], high[use]
    base = (np.cumsum(strings) - strings)[owner[low]]
    return owner[low], low - base, high - base, best[low]


def settled(rows: list[tuple]):
    """Batches of spans (doc_id, text_hash, a, b) of one slice, in columns: where strings stand that also start in a smaller document.

    Equal segments are merged first; a key that is left with one segment has nothing to be compared with and isn't sorted.
    """
    parts, raws = [], []
    for n, m, about, text, spots in rows:
        low, size, times = unpack(about, (n, np.uint32), (n, np.uint8), (n, np.uint32))
        raw, size = np.frombuffer(expanded(text), np.uint8), size.astype(np.int64)
        doc_id = unpack(spots, (m, np.int64), (m, np.int64), (m, np.uint32))[0]
        edge = np.cumsum(times, dtype=np.int64) - times
        parts.append((np.cumsum(low, dtype=np.uint32), range_hashes(raw, np.cumsum(size) - size, size), size, times, np.minimum.reduceat(doc_id, edge), np.maximum.reduceat(doc_id, edge)))
        raws.append(raw)
    key, name, size, times, first, last = (np.concatenate([p[k] for p in parts]) for k in range(6))
    raw, counts = np.concatenate(raws), [len(p[0]) for p in parts]
    del parts, raws
    begin = np.cumsum(size) - size
    order = np.lexsort((name, key))
    edge = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1]))))
    merged = np.empty(len(key), np.int64)
    merged[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(key))))
    first, last, pick = np.minimum.reduceat(first[order], edge), np.maximum.reduceat(last[order], edge), order[edge]
    size, begin, key = size[pick], begin[pick], key[pick]
    group = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(group, len(key)))
    several = np.minimum.reduceat(first, group) < np.maximum.reduceat(last, group)  # documents
    lone = group[several & (count == 1)]
    runs = [(lone, np.zeros(len(lone), np.int64), size[lone] - LENGTH, first[lone])]
    at = np.flatnonzero(np.repeat(several & (count > 1), count))
    if len(at):
        opens = np.flatnonzero(np.concatenate(([True], key[at][1:] != key[at][:-1])))
        chunk = (np.cumsum(size[at]) - size[at])[opens] // CHUNK
        for some in np.split(at, opens[1:][chunk[1:] != chunk[:-1]]):
            owner, low, high, least = repeated_runs(raw[places(begin[some], size[some])], size[some], first[some], last[some])
            runs.append((some[owner], low, high, least))
    owner, low, high, least = (np.concatenate([r[k] for r in runs]) for k in range(4))
    order = np.argsort(owner, kind="stable")
    low, high, least = low[order], high[order], least[order]
    n_runs = np.bincount(owner, minlength=len(size))
    run_at = np.cumsum(n_runs) - n_runs
    stop = 0
    for (_, m, _, _, spots), n in zip(rows, counts, strict=True):
        mine, each = merged[stop : stop + n], times[stop : stop + n]
        stop += n
        if not n_runs[mine].any():
            continue
        doc_id, text_hash, start = unpack(spots, (m, np.int64), (m, np.int64), (m, np.uint32))
        segment = np.repeat(mine, each)
        spot = np.repeat(np.arange(m), n_runs[segment])
        run = places(run_at[segment], n_runs[segment])
        use = least[run] < doc_id[spot]
        spot, run = spot[use], run[use]
        yield doc_id[spot], text_hash[spot], start[spot] + low[run], start[spot] + high[run] + LENGTH


def sorted_spans(found: DataFrame, slices: int) -> DataFrame:
    """(doc_id, text_hash, a, b), some repeated or overlapping, from the dealt :func:`segments`: each slice is sorted and compared on its own."""

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        doc_id, text_hash, a, b = (np.concatenate([h[k] for h in held]) for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(text_hash), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "text_hash", "a", "b"])

    def run(batches):
        def slices_of():
            now, rows = None, []
            for batch in batches:
                for k, n, m, *data in zip(*batch.columns, strict=True):
                    if k.as_py() != now and rows:
                        yield rows
                        rows = []
                    now = k.as_py()
                    rows.append((n.as_py(), m.as_py(), *data))
            if rows:
                yield rows

        held, size = [], 0
        for rows in slices_of():
            for spans in settled(rows):
                held.append(spans)
                size += len(spans[0])
                if size >= 20_000:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)
        give_back()

    return found.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(run, "doc_id long, text_hash long, a int, b int")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans) with the overlapping and touching ranges of each row's spans made one."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            a, b = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(len(lists)), np.diff(at)) << 32
            order = np.argsort(row + a)
            low, high = (row + a)[order], np.maximum.accumulate((row + b)[order])
            head = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1]))[: len(low)])
            ends = high[np.append(head[1:], len(high)) - 1] if len(head) else high
            low = low[head]
            values = pa.StructArray.from_arrays([pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (low, ends)], ["a", "b"])
            offsets = np.searchsorted(low >> 32, np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "text_hash", "spans"])

    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans")).mapInArrow(run, "doc_id long, text_hash long, spans array<struct<a: int, b: int>>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): disjoint byte ranges (a, b) covered by strings that start in a document of smaller doc_id."""
    slices, total = 64, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    while slices < 4096 and slices * SLICE < total:
        slices *= 2
    context = docs.sparkSession.sparkContext
    bits, many = map(context.broadcast, repeated_cores(docs, slices))
    return merged_spans(sorted_spans(segments(docs, bits, many, slices), slices))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 to ``docs`` (columns doc_id, text).

    Null and empty texts have no bytes; texts under LENGTH bytes lose none. Only documents of smaller doc_id count, so rows that
    repeat with one doc_id keep what they alone hold; a null doc_id ranks after all others. An empty table gives no rows.
    A text equal to one of a smaller doc_id goes whole, without sorting; of the others, every string of LENGTH bytes
    whose core (CORE of its bytes, equal for equal strings) may stand in two documents is sorted beside those of equal
    anchor. Text of other cores can't repeat.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    named = docs.select(*[c for c in docs.columns], F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank_id__"), F.octet_length("text").alias("octets__"), row_key()[1].alias("text_hash__"), F.hash("text").alias("more_hash__"))
    texts = named.where(f"octets__ >= {LENGTH}").groupBy("octets__", "text_hash__", "more_hash__").agg(F.min("rank_id__").alias("first__"), F.max("rank_id__").alias("last__"))
    copied = lean(cut(texts.where("first__ < last__").drop("last__")))
    with_first = named.join(copied, ["octets__", "text_hash__", "more_hash__"], "left").withColumn("whole__", F.coalesce(F.col("first__") < F.col("rank_id__"), F.lit(False))).drop("first__")
    shared_ids = not named.groupBy("rank_id__").count().where("count > 1").isEmpty()  # else doc_id alone names a row, and shorter
    with_first = with_first if shared_ids else with_first.withColumn("text_hash__", F.lit(0).cast("long"))
    sources = with_first.where(f"octets__ >= {LENGTH} and not whole__").select(F.col("rank_id__").alias("doc_id"), F.col("text_hash__").alias("text_hash"), "text")
    spans = cut(repeated_spans(sources)).withColumnsRenamed({"doc_id": "span_id__", "text_hash": "span_hash__"})
    both = with_first.join(lean(spans), (F.col("rank_id__") == F.col("span_id__")) & (F.col("text_hash__") == F.col("span_hash__")), "left")
    both = both.select(*docs.columns, "whole__", F.transform("spans", lambda x: x["a"]).alias("starts__"), F.transform("spans", lambda x: x["b"]).alias("ends__"))
    where, at = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in small_batches(batches, 2048, 8 << 20):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, whole, a, b in zip(*[batch.column(k).to_pylist() for k in (where, at, at + 1, at + 2)], strict=True):
                raw = (text or "").encode()
                gone = np.zeros(len(raw) + 1, np.int32)
                if whole:
                    gone[0], gone[len(raw)] = 1, -1
                elif a:
                    np.add.at(gone, np.array(a), 1)
                    np.add.at(gone, np.array(b), -1)
                out = np.cumsum(gone)[:-1] > 0
                n_bytes.append(len(raw))
                n_removed.append(int(out.sum()))
                n_spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes() if n_removed[-1] else raw)
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digests)], [*batch.schema.names[:at], "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return both.mapInArrow(run, f"{columns}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
