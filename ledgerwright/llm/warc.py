"""WARC: write archives, normalise monolithic gzip (one member a record, sidecar offset index), read records back by offset."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.llm.components import lean
from ledgerwright.llm.shared import cut, shared_dir, small_batches

#: Inflated bytes after which a writer begins another archive; bytes inflated, copied or read at once.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Records that a task reads back, about, and the stretch of an archive that stays together.
READ_RECORDS = 4096
READ_BYTES = 4 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI is in, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)


def judged(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set on every page but the last of its equal payloads.

    Equality is that of the SHA-1 and size; payloads of fewer than ``least_bytes`` are never revisits. Only
    (digest, largest page_id) of repeated payloads is joined back, and pre-aggregated before any shuffle.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    many = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "latest")
    both = rows.join(lean(cut(many)), "digest", "left")
    return both.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> tuple[bytes, bytes]:
    """Header and block of one WARC record; a revisit's block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), block


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write judged pages as archives of one gzip stream each; the (path, records) written is the commit record.

    Each attempt writes files of its own name, so a repeated or speculative task never meets another's, and only those in
    the written manifest count.
    """

    def run(batches):
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        sink = None
        for batch in small_batches(batches, 1024, 8 << 20):
            for page_id, url, payload, digest, refers_to in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, gzip, records, size = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                head, block = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
                whole = head + block + b"\r\n\r\n"
                sink.write(gzip.compress(whole))
                records, size = records + 1, size + len(whole)
                if size >= ARCHIVE_BYTES:
                    sink.write(gzip.flush())
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": records}], manifest)
        if sink is not None:
            sink.write(gzip.flush())
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": records}], manifest)

    manifest = pa.schema([("path", pa.string()), ("records", pa.int64())])
    return cut(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"))


class Inflated:
    """The inflated bytes of a gzip file, of one member or many, read once from front to end."""

    def __init__(self, source) -> None:
        self.source, self.gzip, self.ready, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def fill(self) -> bool:
        raw = self.gzip.unconsumed_tail or self.gzip.unused_data
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        raw = raw or self.source.read(CHUNK)
        if not raw:
            self.ended = True
            return False
        self.ready += self.gzip.decompress(raw, CHUNK)
        return True

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        seen = 0
        while (found := self.ready.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.ready)
            if not self.fill():
                if self.ready.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        out = bytes(self.ready[: found + 4])
        del self.ready[: found + 4]
        return out

    def parts(self, size: int):
        """The next ``size`` bytes, in pieces."""
        while size:
            if not self.ready and not self.fill():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.ready[: min(size, CHUNK)])
            del self.ready[: len(piece)]
            size -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if v}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member a record, beside a sidecar .idx of "offset length record-id" lines.

    ``archives``: column path. Every file is inflated once, as a stream; at most a chunk of a record is in memory.
    Returns the written index (path, offset, length, record_id), one row a record.
    """

    def run(batches):
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source_store, source_path = open_store(path)
                name = uuid.uuid4().hex
                rows, offset = [], 0
                with (
                    source_store.open_input_stream(source_path, compression=None) as source,
                    store.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out,
                    store.open_output_stream(f"{base}/{name}.idx", compression=None) as side,
                ):
                    stream = Inflated(source)
                    while (head := stream.head()) is not None:
                        about = fields(head)
                        gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
                        length = write(out, gzip.compress(head))
                        for piece in stream.parts(int(about["content-length"]) + 4):
                            length += write(out, gzip.compress(piece))
                        length += write(out, gzip.flush())
                        side.write(f"{offset} {length} {about.get('warc-record-id', '-')}\n".encode())
                        rows.append((offset, length, about.get("warc-record-id")))
                        offset += length
                        if len(rows) >= 10_000:
                            yield index_batch(f"{folder}/{name}.warc.gz", rows)
                            rows = []
                if rows:
                    yield index_batch(f"{folder}/{name}.warc.gz", rows)

    spread = archives.select("path").repartition(max(1, archives.count()))  # one a task: hashes would put several together
    return cut(spread.mapInArrow(run, "path string, offset long, length long, record_id string"))


def write(out, data: bytes) -> int:
    out.write(data)
    return len(data)


def index_batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    offset, length, record_id = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(record_id, pa.string())], ["path", "offset", "length", "record_id"])


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long"


def read_records(index: DataFrame) -> DataFrame:
    """Read records by their offsets: payload size and digest, recomputed from the payload where the record has it."""

    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def run(batches):
        path, source = None, None
        for batch in batches:
            out = []
            for at, offset, length in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if at != path:
                    if source is not None:
                        source.close()
                    store, place = open_store(at)
                    path, source = at, store.open_input_file(place)
                whole = zlib.decompress(source.read_at(length, offset), 31)
                head, _, block = whole.partition(b"\r\n\r\n")
                about = fields(head)
                http, _, payload = block[: int(about["content-length"])].partition(b"\r\n\r\n")
                digest, kind = about["warc-payload-digest"].removeprefix("sha1:"), about["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"a payload at {at}:{offset} differs from its digest")
                size = len(payload) if kind == "response" else int(fields(http)["content-length"])
                out.append((number(about["warc-record-id"]), size, digest, kind, number(about.get("warc-refers-to")), about.get("warc-target-uri"), at, offset))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names)

    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    parts = max(2, -(-index.count() // READ_RECORDS))
    dealt = index.select("path", "offset", "length").repartition(parts, "path", F.floor(F.col("offset") / READ_BYTES))
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(run, RECORD)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives, normalise them, and read every record back from the normalised ones.

    A null html is the empty payload. Of equal payloads the largest page_id is the response; rows that repeat with one
    page_id have one type. A null page_id can't be referred to and is a revisit where its payload repeats beside a page_id.
    An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(judged(pages, least_bytes), f"{folder}/monolithic")
    index = normalise(archives, f"{folder}/normal")
    remove(spark, f"{folder}/monolithic")
    return read_records(index)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p
), m AS (
  SELECT h, max(page_id) AS latest FROM d GROUP BY h
), b AS (
  SELECT d.*, m.latest, list_transform(range(0, 32), lambda i: (
    (CAST(('0x' || substr(d.h, (i * 5) // 4 + 1, 1)) AS INTEGER) * 16 + coalesce(TRY_CAST(('0x' || substr(d.h || '0', (i * 5) // 4 + 2, 1)) AS INTEGER), 0)) >> (3 - (i * 5) % 4)) & 31) AS five
  FROM d JOIN m ON d.h = m.h
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(five, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM b"""
