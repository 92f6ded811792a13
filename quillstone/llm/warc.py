"""WARC archives with a Zstandard dictionary: one leading skippable frame, then one frame per record.

A dictionary of at most ``DICTIONARY_BYTES`` is trained on a bounded sample of records (about ``SAMPLE`` rows, those
with the lowest hashes, ``SAMPLE_BYTES`` of each payload; it only affects sizes) and stored in front of every archive, so an archive can be read
without any other file and every record can be decompressed on its own.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, that with the smallest id is a response and the others
are revisits, which carry only HTTP headers and refer to it.  The decision is one aggregate by digest and one equi-join
that Spark may split when a payload holds a large part of all rows.

Defined results: a null payload is empty; a null id is written without an id and never is the one referred to (if all
ids of a group are null, all are responses); rows that repeat the smallest id all are responses; a null URL is left
out; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import fixed_schema, share_of, shared_folder, small_batches, stored
from quillstone.llm.files import create, new_file, open_stream

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE, SAMPLE_BYTES = 1000, 4096
MIN_REVISIT = 100
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}/{digest}')}>"


def build_record(key, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, its HTTP header keeps the full length."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if key is not None:
        head.append(f"Page-Id: {key}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    data = stream.read(size)
    dictionary = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
    plain = io.BufferedReader(zstandard.ZstdDecompressor(**dictionary).stream_reader(stream, read_across_frames=True), 1 << 20)
    while plain.readline():
        head = {}
        while (line := plain.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name.lower()] = value
        block = plain.read(int(head["content-length"]))
        plain.read(4)
        yield head, block


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where there is too little to learn from."""
    samples = [s for s in samples if s]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_revisits(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``key``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null for responses)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy(F.col("digest").alias("same")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select("same", "first")
    joined = rows.join(first, F.col("digest") == F.col("same"), "left")
    return joined.select("key", "url", "payload", "digest", F.when(F.col("key").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


FILES = "path string, n_records bigint, n_bytes bigint"
RECORDS = "key bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Writes one archive per task; returns the table of archives."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark)
    start = F.substring(F.col(html).cast("string"), 1, SAMPLE_BYTES).alias("s")
    hashed = F.xxhash64(F.col(key), F.col(url))
    picked = pages.filter(share_of(pages, SAMPLE, hashed)).select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), start)
    picked = picked.dropDuplicates(["k", "u"]).limit(4 * SAMPLE)  # repeated rows share a hash
    records = sorted((r["k"] or 0, r["u"] or "", (r["s"] or "").encode()) for r in picked.collect())
    samples = [build_record(k, u, p, hashlib.sha256(p).hexdigest(), None, date) for k, u, p in records]
    dictionary = spark.sparkContext.broadcast(train(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = dictionary.value
        kind = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
        if kind:
            kind["dict_data"].precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **kind)
        sink, path, count, size = None, "", 0, 0
        for batch in batches:
            if batch.num_rows and sink is None:
                path = new_file(folder, f"part-{TaskContext.get().partitionId():05d}", ".warc.zst")
                sink = create(path)
                sink.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
            for k, u, p, d, r in zip(*(batch[c].to_pylist() for c in ("key", "url", "payload", "digest", "refers_to"))):
                frame = packer.compress(build_record(k, u, p, d, r, date))
                sink.write(frame)
                count, size = count + 1, size + len(frame)
        if sink is not None:
            sink.close()
            schema = fixed_schema(FILES)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, count, size), schema)], schema=schema)

    return stored(with_revisits(pages, key, url, html).mapInArrow(run, FILES), "archives")


def read_archives(archives: DataFrame, rows: int = 2000) -> DataFrame:
    """One row per record, from the archives alone; ``intact`` says whether a response's payload has its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = fixed_schema(RECORDS)

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for path in batch["path"].to_pylist():
                out = []
                with open_stream(path) as stream:
                    for head, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        fine = kind == "revisit" or length == len(payload) and hashlib.sha256(payload).hexdigest() == digest
                        key, other = head.get("page-id"), head.get("refers-to-page-id")
                        out.append((key and int(key), length, digest, kind, other and int(other), fine))
                        if len(out) == rows:
                            yield made(out)
                            out = []
                if out:
                    yield made(out)

    count = max(1, archives.count())
    return archives.select("path").repartition(count).mapInArrow(run, RECORDS)
