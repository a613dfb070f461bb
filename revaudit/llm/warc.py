"""WARC archives: written with one gzip member a record, read sequentially.

The reader takes a file piece by piece, inflates one member at a time with zlib, takes the header up to the empty line
and then exactly Content-Length bytes, and compares the digests of block and payload with the header. It never holds
more than one record.

Equal payloads are stored once: the record of the smallest page_id is a response, the others are revisits of it. Equal
payloads are found by a grouped aggregation over digests, so that a large group of copies is never in one place.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import shared_dir, ship, struct_of

#: An archive is closed and a new one begun beyond so many bytes; pieces that the reader takes from it.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 18
#: So many groups of equal payloads at most are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Payloads of more rows than 1 / SHARE of all are broadcast all the same: no more than SHARE.
SHARE = 50_000
DATE = datetime(2026, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    name = (name or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def record(page, url: str | None, payload: bytes, first=None, revisit: bool = False, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header, which tells the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + deflate.flush()


def members(pieces: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of one gzip member after another; each must be read to its end before the next."""
    source, rest, state = iter(pieces), b"", {"open": False}

    def inflate() -> Iterator[bytes]:
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            rest = rest or next(source, b"")
            ended = not rest
            out = z.decompress(rest, PIECE)  # at most so much; what zlib still holds comes with the next call
            rest = z.unused_data if z.eof else z.unconsumed_tail
            if out:
                yield out
            elif ended and not z.eof:
                raise ValueError("an archive ends within a record")
        state["open"] = False

    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        state["open"] = True
        yield inflate()
        if state["open"]:
            raise ValueError("a record was not read to its end")


def read_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record. A block that isn't as long as it says, or whose digest differs, is an error."""
    for member in members(pieces):
        held = bytearray()
        for out in member:
            held += out
            if (end := held.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise ValueError("a record has no header")
        first, *lines = bytes(held[:end]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(head["content-length"])
        for out in member:
            held += out
            if len(held) > end + 8 + length:
                raise ValueError("a record is longer than its Content-Length")
        block = bytes(held[end + 4 : end + 4 + length])
        if len(held) != end + 8 + length or held[-4:] != b"\r\n\r\n":
            raise ValueError("a record is not as long as its Content-Length")
        if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"block digest of {head.get('warc-record-id')} differs")
        yield head, block


def parse(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload or None) with checked digests."""
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = head["warc-payload-digest"].partition(":")[2], head["warc-type"]
    if kind == "response" and (len(payload) != stated or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest or length")
    page = page_of(head["warc-record-id"])
    return page, head["warc-target-uri"], stated, digest, kind, page_of(head.get("warc-refers-to")), payload if kind == "response" else None


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def originals(pages: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """(digest, first, rows): the smallest key of each payload of ``least`` bytes or more that several rows have."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.unhex(F.sha1(body)).alias("digest"), F.col(key).alias("k"), F.octet_length(body).alias("n"))
    groups = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("rows"))
    return groups.filter("rows > 1 and first is not null").select("digest", "first", "rows")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write a record for every row to ``part-*.warc.gz`` below ``path``, in a folder that all executors share; returns
    the manifest (path, records, bytes), itself written there.

    A null payload is empty, a null url is ``about:blank``. Among equal payloads each row with the smallest key is a
    response; rows with a null key are revisits of it, or responses where no key is known. A task that runs again
    writes the same names again, by an atomic move.
    """
    spark = pages.sparkSession
    ship(spark)
    first = originals(pages, key, payload, least).persist(StorageLevel.MEMORY_AND_DISK)
    small = first.count() <= BROADCAST_GROUPS
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), body.alias("p"), F.unhex(F.sha1(body)).alias("digest"))
    if small:
        rows = rows.join(F.broadcast(first.drop("rows")), "digest", "left").select("k", "u", "p", "first")
    else:
        # Payloads of many rows are fewer than SHARE, so they are broadcast; their rows join the others by a digest of
        # their own, and no task gets all copies of a page.
        many = F.col("rows") >= max(2, pages.count() // SHARE)
        rows = rows.join(F.broadcast(first.filter(many).select("digest", F.col("first").alias("many"))), "digest", "left")
        rows = rows.withColumn("digest", F.when(F.col("many").isNull(), F.col("digest")).otherwise(F.unhex(F.sha1(F.concat("digest", F.coalesce(F.col("k").cast("string"), F.lit("")).cast("binary"))))))
        rows = rows.join(first.filter(~many).select("digest", "first"), "digest", "left").select("k", "u", "p", F.coalesce("many", "first").alias("first"))
    schema = struct_of("path string, records long, bytes long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, top = _place(path)
        store.create_dir(top, recursive=True)
        done, out, name, records, size = [], None, "", 0, 0

        def close() -> None:
            out.close()
            store.move(f"{name}.{context.taskAttemptId()}", name)
            done.append((name, records, size))

        for batch in batches:
            for page, link, data, original in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{top}/part-{context.partitionId():06d}-{len(done):05d}.warc.gz"
                    out, records, size = store.open_output_stream(f"{name}.{context.taskAttemptId()}", compression=None), 0, 0
                revisit = original is not None and page != original and len(data) >= least
                member = record(page, link, data, original, revisit)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)

    rows.mapInArrow(run, schema).write.parquet(f"{path}/manifest")
    first.unpersist()
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def read_archives(manifest: DataFrame, store_uri: str, payloads: bool = True) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all archives."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    arrow = to_arrow_schema(struct_of(schema))
    width = len(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _place(store_uri)

        def pack(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(name, compression=None) as f:
                    rows, size = [], 0
                    for head, block in read_records(iter(lambda f=f: f.read(PIECE), b"")):
                        rows.append(parse(head, block)[:width])
                        size += len(block)
                        if size > 8 << 20 or len(rows) >= 2000:
                            yield pack(rows)
                            rows, size = [], 0
                    if rows:
                        yield pack(rows)

    # Each archive is a unit of work, so they are dealt out by name.
    spread = manifest.select("path").repartition(max(manifest.rdd.getNumPartitions(), manifest.sparkSession.sparkContext.defaultParallelism * 2), "path")
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, payloads: bool = False, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read these back."""
    path = f"{shared_dir(pages.sparkSession)}/warc"
    return read_archives(write_archives(pages, path, least=least), path, payloads)
