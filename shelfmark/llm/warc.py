"""WARC archives: a writer, and a sequential reader.

Every record is a gzip member of its own. The reader goes through an archive once: it feeds the
bytes to an incremental zlib decompressor, which stops at each member's end, frames the block by its
Content-Length, checks block and payload digests and hands the record on; it never holds more
than one record and one piece of the file.

Of records with equal payloads the one with the largest id is stored as a response; the
others are revisit records that refer to it and keep the HTTP header alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm._files import opened, reachable
from shelfmark.llm._joins import split_join
from shelfmark.session import work_folder

ARCHIVE_BYTES = 64 << 20  # a task begins another archive after so many
PIECE = 1 << 18
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
_ID = re.compile(r"<urn:page:(-?\d+)>")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid4()}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not yet packed. Control characters of a URL are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a file that comes in pieces."""
    unpacker, parts = zlib.decompressobj(31), []
    fresh = True
    for piece in pieces:
        while piece:
            parts.append(unpacker.decompress(piece))
            fresh = False
            piece = b""
            if unpacker.eof:
                piece = unpacker.unused_data
                yield b"".join(parts)
                unpacker, parts, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("the archive ends inside a record")


def parse(member: bytes) -> dict:
    """A record's fields; the block is framed by Content-Length and its digests must hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block does not end where Content-Length says")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != stated or fields["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("payload digest")
    page, target = _ID.fullmatch(fields["warc-record-id"]), _ID.fullmatch(fields.get("warc-refers-to", ""))
    return {
        "page_id": int(page[1]) if page else None,
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": int(target[1]) if target else None,
        "payload_bytes": stated,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload": payload if kind == "response" else None,
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Archives of a task, under names of their own: an attempt that fails is in no manifest."""
    store, base = opened(folder)
    store.create_dir(base, recursive=True)
    done, out, size, count = [], None, 0, 0
    part, attempt = TaskContext.get().partitionId(), uuid4().hex

    def close() -> None:
        nonlocal out, size, count
        if out is not None:
            out.close()
            done[-1] += (count, size)
        out, size, count = None, 0, 0

    for batch in batches:
        for page, url, payload, target in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if out is None:
                name = f"part-{part:06d}-{attempt}-{len(done):04d}.warc.gz"
                done.append((f"{folder}/{name}",))
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            data = pack(record(page, url, payload, target))
            out.write(data)
            size, count = size + len(data), count + 1
            if size >= ARCHIVE_BYTES:
                close()
    close()
    yield pa.RecordBatch.from_arrays(
        [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"]
    )


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = 0
            store, name = opened(path)
            with store.open_input_stream(name, compression=None) as source:
                rows, size = [], 0
                for member in members(iter(lambda: source.read(PIECE), b"")):
                    row = parse(member)
                    seen += 1
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) == 512 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
            if seen != told:
                raise ValueError(f"{path}: {seen} records, its manifest says {told}")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write a record for every page below ``folder`` (a path every executor reaches) and return the
    written manifest: path, records, bytes.

    A NULL payload is an empty one. Pages whose payload has ``min_bytes`` or more and also belongs to a larger
    id become revisits; rows that repeat the largest id stay responses, and so do rows without
    an id. A NULL URL is left out. Other columns are not read. A folder that tasks cannot open raises ValueError.
    """
    reachable(folder)
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    last = (
        rows.filter((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("key")
        .agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("key", "target")
    )
    target = F.when(F.col("page_id") < F.col("target"), F.col("target"))
    rows = split_join(rows, last, ["key"], "left").select("page_id", "url", "payload", target.alias("target"))
    rows.mapInArrow(partial(_write, folder=f"{folder}/archives"), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest lists: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and payload (NULL for revisits, or for all with ``payloads=False``).

    A record that is cut short, or whose digest fails, raises, and so does a file that holds another number of records than its
    manifest says (as one that was cut between two records). An empty manifest gives no rows.
    """
    files = manifest.count()
    return manifest.select("path", "records").repartition(max(1, files)).mapInArrow(partial(_read, payloads=payloads), RECORDS)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = work_folder(spark, "warc")
    return read_archives(write_archives(pages, folder), payloads=False)
