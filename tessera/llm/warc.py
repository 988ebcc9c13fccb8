"""WARC archives with dictionary-compressed records.

``write`` makes one archive of each partition: a Zstandard dictionary is built from records of the archive, embedded in a
leading skippable frame (magic 0x184D2A5D), and every record is a frame of its own, compressed with the dictionary. Of
records with equal payloads of at least ``revisit_from`` bytes the one with the largest id is a response; the others are
revisits that refer to it and hold no payload. ``read`` gives the records back.

Archives go to the shared folder. A task writes to names of its own and returns them in its rows, which are committed as a
table by Spark: what a failed or repeated attempt has written is never read. Memory is bounded by the records from which
the dictionary is built (``SAMPLE_BYTES``) and one record.

Defined results: a null payload is empty; a null id is kept (as no record URI), is smaller than any other and refers by
nothing; of repeated ids with equal payloads one is the response and the others refer to their own id. Extra columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch

SKIPPABLE = 0x184D2A5D
#: Bytes of records that a dictionary is built from, the bytes of one that count, and the dictionary's size.
SAMPLE_BYTES, SAMPLE_RECORD, DICTIONARY = 2 << 20, 64 << 10, 64 << 10
LEVEL = 3
#: Stands for a null id inside plans.
NO_ID = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record, checked: lengths must agree, and so must the digest of a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if version != "WARC/1.1" or tail != b"\r\n\r\n" or (kind == "response" and (len(payload) != length or digest(payload) != sha)) or (kind == "revisit" and payload):
        raise ValueError("damaged WARC record")
    number = lambda x: int(v) if (v := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": sha, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def write_archive(records: Iterator[bytes], out) -> int:
    """Writes an archive to a binary stream: dictionary frame, then a frame for each record. Returns how many."""
    import zstandard

    first, size = [], 0
    for r in records:
        first.append(r)
        size += min(len(r), SAMPLE_RECORD)
        if size >= SAMPLE_BYTES:
            break
    if not first:
        return 0
    samples = [r[:SAMPLE_RECORD] for r in first]
    try:
        trained = zstandard.train_dictionary(DICTIONARY, samples, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few records: they are the dictionary themselves
        trained = b"".join(samples)[:DICTIONARY]
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
    out.write(SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
    count = 0
    for group in (first, records):
        for r in group:
            out.write(packer.compress(r))
            count += 1
    return count


def read_archive(source) -> Iterator[dict]:
    """Records of an archive, one frame in memory at a time."""
    import zstandard

    head = source.read(8)
    if not head:
        return
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("no dictionary frame")
    trained = zstandard.ZstdDecompressor().decompress(source.read(int.from_bytes(head[4:], "little")))
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    pending = b""
    while True:
        one, raw = unpacker.decompressobj(), io.BytesIO()
        while not one.eof:
            chunk = pending or source.read(1 << 18)
            pending = b""
            if not chunk:
                if raw.tell():
                    raise ValueError("archive ends inside a record")
                return
            raw.write(one.decompress(chunk))
        pending = one.unused_data
        yield parse(raw.getvalue())


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def referred(pages: DataFrame, revisit_from: int, id_col: str, payload_col: str) -> DataFrame:
    """``pages`` as (id, url, payload, revisit, refers_to)."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), url.alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    shared = rows.filter(F.length("payload") >= revisit_from).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha", "last")
    # narrow rows meet the shared digests, however many share one; then each page moves once, by its id
    named = rows.filter(F.length("payload") >= revisit_from).select("id", "sha").join(shared, "sha").distinct()
    place = F.row_number().over(Window.partitionBy("id", "sha").orderBy("url"))  # of rows that repeat the response's id one is the response
    joined = rows.join(named, ["id", "sha"], "left").withColumn("place", place)
    revisit = F.col("last").isNotNull() & ((F.col("id") != F.col("last")) | (F.col("place") > 1))
    number = lambda c: F.when(c != NO_ID, c)
    return joined.select(number(F.col("id")).alias("id"), "url", "payload", revisit.alias("revisit"), F.when(revisit, number(F.col("last"))).alias("refers_to"))


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None, revisit_from: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Writes the archives; returns the committed table of them: ``path``, ``records``, ``bytes``."""
    scratch = Scratch(spark, "warc")
    folder = (folder or scratch.path("archives")).rstrip("/")

    def run(batches):
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"

        def records():
            for batch in batches:
                for k in range(len(batch)):
                    page_id, url, payload, revisit, refers_to = (c[k].as_py() for c in batch.columns)
                    yield record(page_id, url, payload, refers_to, revisit)

        stream = records()
        one = next(stream, None)
        if one is None:
            return

        def every():
            yield one
            yield from stream

        with store.open_output_stream(f"{base}/{name}") as out:
            count = write_archive(every(), out)
            size = out.tell()
        yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return scratch.table(referred(pages, revisit_from, id_col, payload_col).mapInArrow(run, "path string, records long, bytes long"), "manifest")


#: Bytes of payloads that a batch of records read back holds, besides its last record.
READ_BYTES = 8 << 20
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the archives that a table names by ``path``, a task for each archive; with ``payload``, that too (null for revisits)."""

    def run(batches):
        names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_stream(at) as source:
                    rows: list[dict] = []
                    size = 0
                    for r in read_archive(source):
                        rows.append(r if payload else r | {"payload": None})
                        size += len(r["payload"] or b"") * payload
                        if len(rows) >= 1000 or size >= READ_BYTES:
                            yield pa.record_batch([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    # a number given, as the few bytes of the names would be merged into one task
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, READ + ", payload binary" * payload)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read(archives).drop("url")




ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p
"""
