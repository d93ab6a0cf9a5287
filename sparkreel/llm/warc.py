"""WARC files with a Zstandard dictionary.

Each file starts with a skippable frame that holds the dictionary; each record is one frame of its own, compressed with it.
Records whose payloads are equal are written once, as a response, and otherwise as revisits that refer to the one with the
least page_id.  Files are written by the tasks that hold the pages, under a name of their own and moved into place when whole;
only files named in the manifest of finished tasks count, so a task that is lost or runs twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bit_filter, bounded_sample, cut, maybe_in, shared_path

#: Magic number of the skippable frame that holds a dictionary, in the public WARC-Zstandard specification.
DICTIONARY_FRAME = 0x184D2A5D
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 15, 1 << 16
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with an HTTP head and the payload, or a revisit with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE_ROWS records, by least hash of page_id, of each the first SAMPLE_BYTES bytes.

    Only what the dictionary learns from is bounded; the records are written whole.  Too little to train on: the bytes themselves.
    """
    rows = pages.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html"))
    rows = bounded_sample(rows, "page_id", SAMPLE_ROWS).collect()
    samples = [record(r.page_id, r.url, r.html.encode(), None) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _writer(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        name = f"pages-{uuid.uuid4().hex}.warc.zst"
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        n, size, out = 0, 0, None
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                        out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                        size += 8 + len(dictionary)
                    frame = squeeze.compress(record(page_id, url, (html or "").encode(), refers_to))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
        finally:
            if out is not None:
                out.close()
        if n:
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return run


def _with_first(rows: DataFrame, revisits: DataFrame, limit: int) -> DataFrame:
    """``rows`` (page_id, url, html, sha) with ``refers_to``, of ``revisits`` (id, own, refers_to).

    Up to ``limit`` bytes, counted, the revisits are broadcast.  Beyond, a filter of them is, and only pages that may be among them are
    shuffled, with their html, to be joined; all others are responses and stay where they are.
    """
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("own"))
    most = limit // 120
    if revisits.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(revisits), same, "left")
    bits = cut(bit_filter(revisits.select(F.xxhash64("id", "own").alias("h"))), "filter")
    marked = maybe_in(rows.withColumn("h", F.xxhash64("page_id", "sha")), bits, "h").drop("h")
    sure = marked.where("not maybe__").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    return marked.where("maybe__").join(revisits, same, "left").select("page_id", "url", "html", "refers_to").unionByName(sure)


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``, which all tasks reach; the manifest (file, records, bytes).

    Of pages with equal payloads of at least ``min_bytes`` bytes, the least page_id's is a response and the others are
    revisits of it.  A null html is an empty payload; a null url is left out; rows that repeat the least page_id
    are each responses; a null page_id is a revisit if its payload has another page's, else a response.  More columns are ignored.
    No rows: no files.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"), F.octet_length("html").alias("size"))
    keyed = cut(keyed.where(F.col("size") >= min_bytes), "payloads")
    firsts = keyed.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keyed.join(firsts, "sha").where("refers_to is not null and (page_id is null or page_id <> refers_to)")
    revisits = revisits.select(F.col("page_id").alias("id"), F.col("sha").alias("own"), "refers_to").distinct()
    rows = pages.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    rows = _with_first(rows, cut(revisits, "revisits"), broadcast_bytes)
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    dictionary = build_dictionary(pages)
    rows = rows.select("page_id", "url", "html", "refers_to")
    return cut(rows.mapInArrow(_writer(folder, dictionary), "file string, records long, bytes long"), "manifest")


class _Reader:
    """Bytes of a stream, up to a mark or of a given number; each is copied a fixed number of times."""

    def __init__(self, stream) -> None:
        self.stream, self.buffer, self.at = stream, b"", 0

    def upto(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """What comes before ``mark``, which is passed over; null at the end of the stream."""
        have = self.buffer[self.at :]
        while (end := have.find(mark)) < 0:
            got = self.stream.read(1 << 16)
            if not got:
                if have:
                    raise ValueError("no WARC record here")
                return None
            if len(have) > most:
                raise ValueError("a record's head has no end")
            have += got
        self.buffer, self.at = have, end + len(mark)
        return have[:end]

    def take(self, n: int) -> bytes:
        parts = [self.buffer[self.at : self.at + n]]
        self.at += len(parts[0])
        n -= len(parts[0])
        while n:
            got = self.stream.read(min(n, 1 << 20))
            if not got:
                raise ValueError("a record was cut off")
            parts.append(got)
            n -= len(got)
        return b"".join(parts)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC stream."""
    reader = _Reader(stream)
    while (head := reader.upto(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
        block = reader.take(int(fields["content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")
        yield fields, block


def open_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file made by :func:`write_warc`."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no leading dictionary")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    yield from records(plain.stream_reader(stream, read_across_frames=True))


def _number(urn: str) -> int | None:
    text = urn[len("<urn:page:") : -1]
    return int(text) if text else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for file in batch.column(0).to_pylist():
            store, path = pafs.FileSystem.from_uri(file)
            rows = []
            with store.open_input_stream(path, compression=None) as stream:
                for fields, block in open_warc(stream):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != told):
                        raise ValueError(f"damaged record in {file}")
                    refers_to = fields.get("warc-refers-to")
                    rows.append((_number(fields["warc-record-id"]), size, told, fields["warc-type"], _number(refers_to) if refers_to else None))
                    if len(rows) == 10000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_warc(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records in the manifest's files; payloads are verified."""
    files = manifest.select("file")
    files = files.repartition(max(1, files.count()), "file")
    return files.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    return read_warc(write_warc(pages, shared_path(spark, "warc")))


#: The digest's hexadecimal digits, five at a time, are four base32 letters.
SQL = """
with p as (select page_id, coalesce(html, '') t, sha1(coalesce(html, '')) h from pages),
f as (select *, min(page_id) over (partition by t) first from p)
select page_id, octet_length(encode(t))::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id = first then null else first end refers_to
from f
"""
