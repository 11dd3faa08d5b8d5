"""WARC archives compressed record by record with a Zstandard dictionary embedded in a leading skippable frame.

The dictionary is trained on a bounded sample of the records that are archived: those of the distinct pages of smallest hash below a size.
Each task writes files named after its attempt; only those that the finished job lists are read. Equal payloads of
at least 100 bytes are stored once, as the response of the smallest page_id; the others become revisit records.

Defined cases: null html counts as empty; a null page_id writes an empty id and reads back as null, and never is the
response that others revisit unless no page of the payload has an id; rows that share the smallest page_id are all
responses, since a revisit names another record by its id and these have the same; control characters in a url are percent-encoded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import commit_name, fresh_path, hot_keys, materialize, open_store, prepare, table

LEAST_BYTES = 100
#: Pages in the dictionary's sample, their greatest size, and the dictionary's size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 65536, 65536
FILE_BYTES, LEVEL = 256_000_000, 3
#: Fixed values of the format: the magic number of the skippable frame that holds a dictionary, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary; where the samples are too few to train one, their raw content; never empty."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-size:] + b"WARC/1.1\r\nWARC-Type: response\r\n")[:size]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the full payload's length and leaves the payload out."""
    name = "" if page_id is None else page_id
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
    if revisit:
        head += f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
    return (head + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record; a response's payload is digested anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload doesn't match its digest")
    number = lambda x: int(x.removeprefix("<urn:page:").rstrip(">") or 0) if x != "<urn:page:>" else None
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None


def records_in(file, piece: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive (a file open for reading), each from its own frame; no more than a record and a piece of the file is held."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no leading dictionary")
    open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(file.read(size))).decompressobj
    frame, parts, data = None, [], file.read(piece)
    while data or frame:
        if frame is None:
            frame, parts = open_frame(), []
        if not data:
            raise ValueError("the archive ends within a frame")
        parts.append(frame.decompress(data))
        data = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(parts)
            frame = None
        data = data or file.read(piece)


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, first (the smallest page_id of the payload, null where nothing repeats).

    Small payloads are no one's copies and a payload that very many pages share is looked up in a broadcast table, so that no task gets more than its share."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    small, large = rows.filter(F.octet_length("payload") < least), rows.filter(F.octet_length("payload") >= least)
    repeated = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = materialize(repeated, "warc-firsts")
    hot = materialize(hot_keys(repeated, "digest").select("digest", "first"), "warc-hot")
    keys = F.broadcast(hot.select("digest"))
    often = large.join(keys, "digest", "left_semi").join(F.broadcast(hot), "digest", "left")
    rest = large.join(keys, "digest", "left_anti").join(repeated.select("digest", "first").hint("merge"), "digest", "left")
    return small.withColumn("first", F.lit(None).cast("long")).unionByName(often).unionByName(rest)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives and return them: path, records, bytes."""
    prepare(pages.sparkSession)
    # First the hashes alone, so that the driver never gets the pages of all tasks; then the pages at or below the last.
    small = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64("html").alias("h")).filter(F.octet_length("html").between(1, SAMPLE_BYTES))
    hashes = [r.h for r in small.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    chosen = small.filter(F.col("h") <= hashes[-1]).groupBy("h").agg(F.min(F.struct("page_id", "url", "html")).alias("p")).collect() if hashes else []
    bodies = [(r.p.page_id, r.p.url, r.p.html.encode()) for r in sorted(chosen, key=lambda r: r.h)]
    trained = train_dictionary([record(i, url, body, hashlib.sha256(body).hexdigest(), None, False) for i, url, body in bodies])
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True).compress
        store, root = open_store(folder)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    name, n, size = f"{commit_name()}-{len(done)}.warc.zst", 0, 8 + len(trained)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)
                frame = pack(record(page_id, url, payload, digest, first, first is not None and first != page_id))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    marked = with_revisits(pages).select("page_id", "url", "payload", "digest", "first")
    return materialize(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-files")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record."""
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{path}", compression=None) as f:
                    found = map(parse, records_in(f))
                    while rows := list(itertools.islice(found, 1000)):
                        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("path").repartition(tasks).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""
