"""WARC archives, compressed record by record with a Zstandard dictionary that leads the file.

The writer trains one dictionary on a bounded sample of the payloads to be archived (``SAMPLE_RECORDS`` of them, by hash
of the id, ``SAMPLE_BYTES`` of each from a hashed place on; only the dictionary depends on it), puts it in a skippable frame (magic
0x184D2A5D, as in the public WARC-Zstandard draft) at the head of every file, and writes each record as a frame of its
own, so any record can be read from its offset alone. Equal payloads of ``MIN_REVISIT`` bytes or more are archived
once: the row with the largest id is a ``response``, the others are ``revisit`` records that name it.

Executors write straight to a shared folder through pyarrow's file systems (local or any that it knows by scheme),
under a name that no other attempt uses; what an attempt that was lost left behind is not in the manifest, which is
itself a stored table, so a rerun can neither mix nor repeat records. Reading goes by the manifest, one row a file.

Which rows are revisits is decided on (digest, length, id) alone; payloads move only if the revisits, a subset of ids,
are too many for Spark to broadcast. A digest that a third of all rows share is one group in an aggregation with
partial results.

Defined cases: a null payload is empty; an empty payload is a record of no bytes; rows that repeat both id and payload
are each written, and as equal largest ids they are all responses; the same id with other payloads is treated by
payload; a null id is written as an empty field and read back as null, and ranks below all ids; an empty table writes
no file; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm._common import shared_dir, short_batches, stored

MAGIC = 0x184D2A5D
MIN_REVISIT = 1000
SAMPLE_RECORDS, SAMPLE_BYTES = 1000, 4096
DICT_BYTES = 64 << 10
LEVEL = 3
#: A file is closed and the next begun at this size.
FILE_BYTES = 256 << 20

RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Empty if there is too little to learn from."""
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_head(kind: str, page_id, url: str, length: int, digest: str, refers_to, date: str) -> bytes:
    """Header block of a record. ids are plain numbers in a URN, so they survive the round trip."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {0 if kind == 'revisit' else length}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def read_archive(stream, dictionary_first: bool = True):
    """Yields (headers, payload) record by record; holds one record and a read buffer."""
    head = stream.read(8)
    dictionary = b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == MAGIC:
        dictionary = stream.read(struct.unpack("<I", head[4:])[0])
        head = b""
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    pending = head
    while True:
        frame, out = unpack.decompressobj(), io.BytesIO()
        while not frame.eof:
            if not pending and not (pending := stream.read(1 << 20)):
                if out.tell():
                    raise ValueError("the archive ends within a record")
                return
            out.write(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        raw = out.getvalue()
        end = raw.index(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[:end].decode().split("\r\n")[1:])
        payload = raw[end + 4 :]
        n = int(headers["Content-Length"])
        if payload[n:] != b"\r\n\r\n":
            raise ValueError("a record's length doesn't match its header")
        yield headers, payload[:n]


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of revisits only, from pages(page_id, payload, digest, n)."""
    long = pages.where(F.col("n") >= MIN_REVISIT).select("page_id", "digest", "n")
    largest = long.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null")
    return long.join(largest, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages to ``*.warc.zst`` files below the folder. Returns the manifest: path, records, bytes."""
    spark = pages.sparkSession
    short_batches(spark)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("bigint"))
    ids = rows.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS)
    picked = rows.join(F.broadcast(ids), "page_id", "left_semi").select(F.xxhash64("page_id").alias("h"), F.expr(f"substring(payload, 1 + cast(pmod(xxhash64(page_id, 1), greatest(length(payload) - {SAMPLE_BYTES} + 1, 1)) as int), {SAMPLE_BYTES})").alias("p")).orderBy("h", "p").limit(SAMPLE_RECORDS)
    dictionary = spark.sparkContext.broadcast(train_dictionary([bytes(r.p) for r in picked.select("p").collect()]))
    revisits = decide(rows).withColumnsRenamed({"page_id": "r_id", "digest": "r_digest"})
    typed = rows.join(revisits, (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_id")), "left").select("page_id", "url", "payload", "digest", "refers_to")
    fs, _ = filesystem(folder)
    fs.create_dir(filesystem(folder)[1], recursive=True)

    def write(batches):
        data = dictionary.value
        params = zstandard.ZstdCompressionDict(data) if data else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=params) if params else zstandard.ZstdCompressor(level=LEVEL)
        fs, base = filesystem(folder)
        path, sink, records, size = None, None, 0, 0

        def close():
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for b in batches:
            ids, urls, payloads, digests, refers = (b.column(i).to_pylist() for i in range(5))
            for page_id, url, body, digest, refers_to in zip(ids, urls, payloads, digests, refers, strict=True):
                if sink is None:
                    path, records = f"{base}/pages-{uuid.uuid4().hex}.warc.zst", 0
                    sink = fs.open_output_stream(path, compression=None)  # frames are made here, record by record
                    size = sink.write(struct.pack("<II", MAGIC, len(data)) + data)
                kind = "response" if refers_to is None else "revisit"
                head = record_head(kind, page_id, url, len(body), digest, refers_to, date)
                size += sink.write(pack.compress(head + (body if kind == "response" else b"") + b"\r\n\r\n"))
                records += 1
                if size >= FILE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return stored(typed.mapInArrow(write, "path string, records bigint, bytes bigint"))


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the manifest's files. payload_bytes and payload_digest of a response are taken from its payload, of a revisit from the response it names."""
    spark = manifest.sparkSession
    files = max(1, manifest.count())

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, _ = filesystem(folder)
                out: list[list] = [[] for _ in range(6)]
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, payload in read_archive(stream):
                        number = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                        kind = headers["WARC-Type"]
                        fresh = kind == "response"
                        digest = hashlib.sha1(payload).hexdigest() if fresh else headers["WARC-Payload-Digest"][5:]
                        if digest != headers["WARC-Payload-Digest"][5:]:
                            raise ValueError(f"the payload of record {number} doesn't match its digest")
                        refers = None if fresh else int(headers["WARC-Refers-To"][len("<urn:page:") : -1])
                        row = (int(number) if number else None, len(payload) if fresh else int(headers["X-Payload-Length"]), digest, kind, refers, payload if with_payload and fresh else None)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        if len(out[0]) >= 256:
                            yield _batch(out)
                            out = [[] for _ in range(6)]
                if out[0]:
                    yield _batch(out)

    df = manifest.select("path").repartition(files).mapInArrow(read, RECORD + ", payload binary")
    return df if with_payload else df.drop("payload")


def _batch(out):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.largest IS NULL OR g.largest = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.largest <> p.page_id THEN g.largest END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
"""
