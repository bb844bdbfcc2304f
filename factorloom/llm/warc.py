"""WARC archives without repeated payloads.

Headers (digest, size, id) are gathered by payload digest; the smallest id of equal payloads is the response
and the others become revisit records that name it. Archives are written anew with fresh headers, a
gzip member for each record, and read back in pieces, by the tasks that parse them. Then revisit records are
joined to the responses they name, so that each has its payload's size again.

A response that others may refer to has a record id that follows from its id and digest, so revisits can
name it; rows that repeat both are one capture and share it. All other record ids follow from the archive.

Rows: a null payload is empty; payloads of fewer than MIN_BYTES are always responses; a null id is no
response's name and is written as a revisit if its payload has one; rows that repeat the smallest id
are all responses; an empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import common, store

#: Smaller payloads are not worth a revisit record.
MIN_BYTES = 100
#: Payload bytes after which a writer begins a new archive.
ARCHIVE_BYTES = 32_000_000
#: Compressed bytes that a reader takes at once, and archives of a task.
READ_BYTES = 1_000_000
ARCHIVES_PER_TASK = 4
#: Up to so many repeated digests (about 80 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_DIGESTS = 200_000
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_urn(*parts: object) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}"


def resolved(pages: DataFrame) -> DataFrame:
    """Pages with digest, size, and `first` and `first_url`, the smallest id of their payload's repeats (null where there is none)."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    sized = base.withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    headers = sized.where(F.col("payload_bytes") >= MIN_BYTES).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("least"), F.count("*").alias("n"))
    repeated = headers.where("n > 1 and least is not null").select("payload_digest", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"))
    repeated = common.written(repeated, common.shared_dir(spark) + "/digests")
    if repeated.count() <= BROADCAST_DIGESTS:
        return sized.join(F.broadcast(repeated), "payload_digest", "left")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sized.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a response or a revisit; a written table names the archives that count (column file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name = f"{folder}/warc/{ctx.partitionId()}-{ctx.taskAttemptId()}"
        rows = (r for b in batches for p in common.slices(b, "html", 4_000_000) for r in p.to_pylist())
        row, number = next(rows, None), 0
        while row is not None:
            uri, size, n = f"{name}-{number}.warc.gz", 0, 0
            date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            with store.new_file(uri) as out:
                out.write(member(info(uri, date)))
                while row is not None and size < ARCHIVE_BYTES:
                    payload = row["html"].encode("utf-8", "surrogatepass")
                    out.write(member(record(row, payload, date, f"{uri}|{n}")))
                    size, n, row = size + len(payload), n + 1, next(rows, None)
            yield pa.record_batch([pa.array([uri]), pa.array([n], pa.int64())], ["file", "records"])
            number += 1

    return common.written(resolved(pages).mapInArrow(run, "file string, records long"), f"{folder}/manifest")


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def info(uri: str, date: str) -> bytes:
    body = b"software: corpus archive writer\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {date}\r\nWARC-Record-ID: <{record_urn(uri)}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def record(row: dict, payload: bytes, date: str, place: str) -> bytes:
    """A response with its payload, or a revisit with the response's headers only; `place` is unlike all others."""
    first = row["first"]
    revisit = first is not None and first != row["page_id"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    digest = row["payload_digest"]
    urn = record_urn(row["page_id"], digest) if first is not None and not revisit else record_urn(place)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {' '.join(row['url'].split())}")
    if row["page_id"] is not None:
        head.append(f"Page-Id: {row['page_id']}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_urn(first, digest)}>", f"Refers-To-Page-Id: {first}"]
        if row["first_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {' '.join(row['first_url'].split())}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def records(pieces: Iterable[bytes], step: int = 65_536) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record of an archive, given in pieces of any size; takes time linear in its size."""
    unpack, got = zlib.decompressobj(31), []
    for piece in pieces:
        for k in range(0, len(piece), step):
            chunk = piece[k : k + step]
            while chunk:
                got.append(unpack.decompress(chunk))
                chunk = unpack.unused_data
                if unpack.eof:
                    head, _, rest = b"".join(got).partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    yield fields, rest[: int(fields["Content-Length"])]
                    unpack, got = zlib.decompressobj(31), []
    if got:
        raise ValueError("the archive ends within a record")


def read_archives(spark: SparkSession, files: DataFrame | list[str], payloads: bool = False) -> DataFrame:
    """Records of archives: page_id, url, payload size and digest, type, the id a revisit refers to, and the payload if asked for.

    A revisit's size and digest are those of the response it names, which a join brings; a response's
    digest is computed from its payload and must be the one in its header.
    """
    from hashlib import sha256

    if isinstance(files, list):
        files = spark.createDataFrame([(x,) for x in files], "file string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                out, size = [], 0
                for head, body in records(store.pieces(uri, READ_BYTES)):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    payload, said = body.partition(b"\r\n\r\n")[2], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    original = head["WARC-Type"] == "response"
                    if original and sha256(payload).hexdigest() != said:
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    page, refers = head.get("Page-Id"), head.get("Refers-To-Page-Id")
                    out.append((page and int(page), head.get("WARC-Target-URI"), len(payload) if original else None, said, head["WARC-Type"], refers and int(refers), payload if payloads and original else None))
                    size += len(payload) if payloads else 0
                    if size > 4 * READ_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split(" ")[0] for x in RECORD.split(", ")])

    tasks = max(1, files.count() // ARCHIVES_PER_TASK, min(files.count(), spark.sparkContext.defaultParallelism))
    return files.select("file").distinct().repartition(tasks, "file").mapInArrow(parse, RECORD)


def with_originals(found: DataFrame) -> DataFrame:
    """Join revisit records to the responses they name and take over their sizes and, if there, payloads.

    Only responses that some revisit names go to the join; both sides are salted, as one response
    may be named by very many revisits.
    """
    taken = [x for x in ("payload_bytes", "payload") if x in found.columns]
    named = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("to"), F.col("payload_digest").alias("by")).distinct()
    originals = found.where("record_type = 'response'").join(named, (F.col("page_id") == F.col("to")) & (F.col("payload_digest") == F.col("by")), "left_semi")
    originals = originals.select(F.col("page_id").alias("to"), F.col("payload_digest").alias("by"), *(F.col(x).alias(f"own_{x}") for x in taken)).dropDuplicates(["to", "by"])
    salted = originals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = found.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = revisits.join(salted, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("by")) & (revisits.salt == salted.salt), "left")
    whole = joined.select(*(F.col(f"own_{x}").alias(x) if x in taken else F.col(x) for x in found.columns))
    return found.where("record_type = 'response'").unionByName(whole)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages to archives, read them back and resolve the revisits."""
    made = write_archives(pages, folder)
    headers = common.written(read_archives(pages.sparkSession, made).drop("payload"), f"{folder}/headers")
    return with_originals(headers)
