"""Conversation structure repair: the cheapest edits to a legal order of roles, by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.shared import cut

#: States of the roles kept so far: nothing, a system turn, a user turn, an assistant turn; the role that a state asks for next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
#: Where a kept role leads: (role initial, state before) to state after.
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
LEGAL = ("su", "ua", "au")
FAR = 1 << 62


def forward_edges(symbols: str, i: int, q: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, row, state) of the edits at a node of the lattice: before row ``i`` in state ``q``.

    Symbols are the initials of roles, o for any other, upper case if the row is truncated, and x for rows that must go.
    """
    out = [("I", INSERT, i, NEXT[q])]
    if i < len(symbols):
        out.append(("D", DELETE, i + 1, q))
        if (s := symbols[i]) != "x":
            cost = TRUNCATED if s.isupper() else 0
            out.append(("R", REROLE + cost, i + 1, NEXT[q]))
            if (to := KEEPS.get((s.lower(), q))) is not None:
                out.append(("K", cost, i + 1, to))
    return out


def reverse_edges(symbols: str, j: int, r: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, row, state) of the nodes from which an edit leads to row ``j`` and state ``r``."""
    before = [q for q in range(4) if NEXT[q] == r]
    out = [("I", INSERT, j, q) for q in before]
    if j:
        out.append(("D", DELETE, j - 1, r))
        if (s := symbols[j - 1]) != "x":
            cost = TRUNCATED if s.isupper() else 0
            out += [("R", REROLE + cost, j - 1, q) for q in before]
            out += [("K", cost, j - 1, q) for (c, q), to in KEEPS.items() if c == s.lower() and to == r]
    return out


def search(symbols: str) -> tuple[int, str]:
    """Cost and ASCII-least audit of the cheapest edits of a conversation's rows.

    A heap of nodes grows from the first row and one from the end; they go on while the sum of their least costs is no
    more than the best path known, so that every path of that cost has an edge whose ends both heaps have labelled. From those
    crossings the tight edges are followed to both ends; a letter leads from a node to one other, so the least audit
    takes the least letter at every node.
    """
    n = len(symbols)
    ahead, back = [FAR] * (4 * n + 4), [FAR] * (4 * n + 4)
    ahead[START] = 0
    forward, reverse = [(0, START)], []
    for q in ENDS:
        back[4 * n + q] = 0
        heapq.heappush(reverse, (0, 4 * n + q))
    best = 0 if not n else FAR
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        on = len(forward) <= len(reverse)
        heap, own, other, edges = (forward, ahead, back, forward_edges) if on else (reverse, back, ahead, reverse_edges)
        cost, node = heapq.heappop(heap)
        if cost > own[node]:
            continue
        for _, more, i, q in edges(symbols, node >> 2, node & 3):
            to = 4 * i + q
            if cost + more < own[to]:
                own[to] = cost + more
                heapq.heappush(heap, (cost + more, to))
            if cost + more + other[to] < best:
                best = cost + more + other[to]
    good: dict[int, dict[str, int]] = {}
    left, right = [], []
    for node, cost in enumerate(ahead):
        if cost <= best:
            for letter, more, i, q in forward_edges(symbols, node >> 2, node & 3):
                if cost + more + back[4 * i + q] == best:
                    good.setdefault(node, {})[letter] = 4 * i + q
                    left.append(node)
                    right.append(4 * i + q)
    seen = set()
    while left:
        if (node := left.pop()) in seen:
            continue
        seen.add(node)
        for letter, more, i, q in reverse_edges(symbols, node >> 2, node & 3):
            if ahead[4 * i + q] + more == ahead[node]:
                good.setdefault(4 * i + q, {})[letter] = node
                left.append(4 * i + q)
    seen = set()
    while right:
        if (node := right.pop()) in seen:
            continue
        seen.add(node)
        for letter, more, i, q in forward_edges(symbols, node >> 2, node & 3):
            if back[4 * i + q] + more == back[node]:
                good.setdefault(node, {})[letter] = 4 * i + q
                right.append(4 * i + q)
    audit, node = [], START
    while node in good:
        letter = min(good[node])
        audit.append(letter)
        node = good[node][letter]
    return best, "".join(audit)


_short = lru_cache(1 << 16)(search)


def cheapest_edits(symbols: str) -> tuple[int, str]:
    """:func:`search`, remembered for short conversations: many have the same roles and faults."""
    return _short(symbols) if len(symbols) <= 64 else search(symbols)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its . ! and ?, 3 repeats it, 4 makes its role user; nulls of role and text become one space."""
    kind = F.crc32(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])) % 20
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def keyed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key): nulls of role and text as one space; key is a digest of the text, which orders rows of one turn and role."""
    got = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return got.withColumn("key", F.unhex(F.md5("text")))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, blank, later, open): open where the last character that is no space isn't . ! or ?; later where the conversation has the role and text in an earlier turn."""
    said = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.md5("role"), F.hex("key")))
    got = rows.select("conv_id", "turn", "role", "key", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"), said.alias("said"))
    first = got.groupBy("said").agg(F.min(F.struct("turn")).alias("first"))
    return got.join(first, "said").select("conv_id", "turn", "role", "key", "blank", "open", (F.struct("turn") > F.col("first")).alias("later"))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is known of the rows of one conversation so far: a symbol and a few counts, no texts."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.symbols = conv_id, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.row = self.initial = None

    def add(self, turn, role: str, key: bytes, blank: bool, open_: bool, later: bool) -> None:
        initial, row = role[:1], (turn, role, key)
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.row is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        if blank:
            self.blank += 1
        elif later or row == self.row:
            self.duplicate += 1
        elif open_:
            self.truncated += 1
        s = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append("x" if blank or later or row == self.row else s.upper() if open_ else s)
        self.row, self.initial = row, initial

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest_edits("".join(self.symbols)))


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """Each conversation's rows after one another in one task, which reads them as a stream."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def summarise(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows (conv_id, turn, role, text), further columns are left out, nulls of role and text count as one space, a null conv_id
    is a conversation too and null turns come first; rows of one turn go by role and a digest of the text. An empty table gives
    no rows. Texts don't meet: a conversation's task keeps one symbol for each row, which the audit in its one cell does too.
    """
    at = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {at}, {SUMMARY}"
    ordered = _in_order(marked(keyed(rows)), "turn", "role", "key").select("conv_id", "turn", "role", "key", "blank", "open", "later")

    def read(batches):
        now, done, types = None, [], None
        for batch in batches:
            types = batch.schema
            for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.summary())
                    now = _Conversation(conv_id)
                now.add(*row)
            if len(done) > 5000:
                yield _batch(done, types)
                done = []
        if now is not None:
            yield _batch([*done, now.summary()], types)

    def _batch(done: list, types: pa.Schema) -> pa.RecordBatch:
        kinds = [types.field(0).type, *[pa.int64()] * 6, pa.string()]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return ordered.mapInArrow(read, schema)


def repair(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, pos, edit, role, text), each one's rows in order in one partition.

    audits: (conv_id, audit) of :func:`summarise` for the same rows. A conversation's audit comes first in its task, then its
    rows, which are passed on one by one; conversations of which no row is left aren't there.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    own = keyed(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text")
    first = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("key"), F.col("audit").alias("text"))
    ordered = _in_order(first.unionByName(own), "kind", "turn", "role", "key").select("conv_id", "kind", "role", "text")

    def read(batches):
        conv_id = audit = None
        at = pos = 0
        state, types = START, None

        def out(edit, role, text):
            nonlocal pos
            made.append((conv_id, pos, edit, role, text))
            pos += 1

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                out("I", NAMES[state], "")
                at += 1

        for batch in batches:
            made, types = [], batch.schema
            for c, is_row, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not is_row:
                    if audit is not None:
                        inserted()
                    conv_id, audit, at, pos, state = c, text, 0, 0, START
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "R":
                    state = NEXT[state]
                    out("R", NAMES[state], text)
                elif edit == "K":
                    state = KEEPS[role[:1], state]
                    out("K", role, text)
            if made:
                yield _rows(made, types)
        made = []
        if audit is not None:
            inserted()
        if made:
            yield _rows(made, types)

    def _rows(made: list, types: pa.Schema) -> pa.RecordBatch:
        kinds = [types.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], ["conv_id", "pos", "edit", "role", "text"])

    return ordered.mapInArrow(read, f"conv_id {kind}, pos long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over the rows of :func:`repair` as it returns them: SHA-256 of role:text, newline-joined, read as a stream."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def read(batches):
        now, hashed, types = None, None, None
        for batch in batches:
            types, done = batch.schema, []
            for c, pos, role, text in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4)], strict=True):
                if not pos:
                    if hashed is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = c, hashlib.sha256()
                hashed.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
            if done:
                yield _pairs(done, types)
        if hashed is not None:
            yield _pairs([(now, hashed.hexdigest())], types)

    def _pairs(done: list, types: pa.Schema) -> pa.RecordBatch:
        ids, found = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, types.field(0).type), pa.array(found)], ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(read, f"conv_id {kind}, repaired_sha256 string")


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """:func:`summarise` with the digest of each repaired conversation, for every conv_id of ``ids``: zeros, an empty audit and the digest of nothing where it has no rows."""
    summary = cut(summarise(rows))
    got = ids.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    for side in (summary, digests(repair(rows, summary))):
        side = side.withColumnRenamed("conv_id", "side_id")
        got = got.join(side, F.col("id").eqNullSafe(F.col("side_id")), "left").drop("side_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return got.select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damage(conversations), conversations)


#: The same by dynamic programming over the rows: after each row the cheapest, then least audit that leads to each state of the roles.
OP11_SQL = r"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS id FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id, ''), lambda ch: ord(ch)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, n: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_replace(text, '[ \t\n\x0B\x0C\r]+$', '') AS bare FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
ins(q, r, letters, made) AS (VALUES ('', '', '', []), ('', 'u', 'I', ['user:']), ('', 'a', 'II', ['user:', 'assistant:']), ('s', 's', '', []), ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']), ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']), ('a', 'a', '', []), ('a', 'u', 'I', ['user:']), ('a', 'a', 'II', ['user:', 'assistant:'])),
edit(q, letter, initial, r, cost) AS (VALUES ('', 'D', NULL, '', 3), ('s', 'D', NULL, 's', 3), ('u', 'D', NULL, 'u', 3), ('a', 'D', NULL, 'a', 3), ('', 'R', NULL, 'u', 2), ('s', 'R', NULL, 'u', 2), ('u', 'R', NULL, 'a', 2), ('a', 'R', NULL, 'u', 2), ('', 'K', 's', 's', 0), ('', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0), ('a', 'K', 'u', 'u', 0)),
w(conv_id, i, q, cost, audit, made) AS (SELECT conv_id, 0::BIGINT, '', 0::BIGINT, '', CAST([] AS VARCHAR[]) FROM s
  UNION ALL SELECT w.conv_id, f.i, edit.r, w.cost + 2 * length(ins.letters) + edit.cost + CASE WHEN f.fault = 'truncated' AND edit.letter <> 'D' THEN 1 ELSE 0 END, w.audit || ins.letters || edit.letter,
    list_concat(w.made, ins.made, CASE edit.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE edit.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] END)
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN edit ON edit.q = ins.r AND (edit.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (edit.initial IS NULL OR edit.initial = f.initial)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, edit.r ORDER BY w.cost + 2 * length(ins.letters) + edit.cost + CASE WHEN f.fault = 'truncated' AND edit.letter <> 'D' THEN 1 ELSE 0 END, w.audit || ins.letters || edit.letter) = 1),
e AS (SELECT w.conv_id, w.cost + 2 * length(ins.letters) AS cost, w.audit || ins.letters AS audit, list_concat(w.made, ins.made) AS made FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN ins ON ins.q = w.q AND ins.r IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * length(ins.letters), w.audit || ins.letters) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""
