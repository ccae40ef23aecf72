"""WARC archives: a writer of gzip members and a splittable reader.

Writing: every row becomes a record in a gzip member of its own. Among rows with equal
payloads the one with the largest id is written as a response, the others as revisits
that refer to it and hold no payload. Every task writes its own files under names that
no other attempt uses; the table of files written by successful attempts is returned,
so what a lost attempt left behind is never read.

Reading: the files are cut into byte ranges. A task looks for the gzip magic in its
range, validates a candidate by decoding the start of the member and finding a WARC
header there, and owns the records that start inside its range; it reads the last of
them to its end, beyond the range. Magic bytes inside compressed data fail to decode.
A member that begins as a record and breaks off is an error, not a gap.

Files are opened by the tasks: a path or ``file:`` uri directly, any other uri by the
Arrow file system of its scheme.

Nulls and odd input: a null payload is empty; a null url is written as an empty one; a
null id is written as ``null``, never referred to, and read back as null; rows with the
same largest id and payload are all responses; an empty table writes no files and
gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import session
from wardline.llm import common

SPLIT = 8 << 20
FILE = 256 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, bytes long, records long"
RECORDS = (
    "page_id long, target_uri string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, stated_digest string, payload binary"
)
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20


def open_uri(uri: str, mode: str):
    """A binary file of a path or uri, for ``rb`` or ``wb``."""
    if "://" in uri and not uri.startswith("file:") or uri.startswith("viewfs:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        return store.open_input_file(path) if mode == "rb" else store.open_output_stream(path)
    path = re.sub("^file:(//)?", "", uri)
    if mode == "wb":
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, mode)


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC states it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member; ``refers_to`` makes it a revisit."""
    revisit = refers_to is not None
    # Neither a line break nor a control character may end up in a header.
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    block += b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {address}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    body = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return zlib.compress(body, LEVEL, 31)


def referred(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and ``refers_to``: the id of the row whose payload it repeats."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"),
        F.sha1(payload).alias("sha"),
    )
    groups = (
        rows.where(F.octet_length("payload") >= least).groupBy("sha")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1").select("sha", "largest")
    )
    again = ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(groups, "sha", "left").select(
        "page_id", "url", "payload", F.when(again, F.col("largest")).alias("refers_to")
    )


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of ``rows`` (page_id, url, payload, refers_to); the files that were written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files = uuid.uuid4().hex, []
        out, size, count = None, 0, 0
        try:
            for batch in common.slices(batches):
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        path = f"{folder}/{name}-{len(files):05d}.warc.gz"
                        out, size, count = open_uri(path, "wb"), 0, 0
                    member = record(*row)
                    out.write(member)
                    size, count = size + len(member), count + 1
                    if size > FILE:
                        out.close()
                        files.append((path, size, count))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            files.append((path, size, count))
        columns = list(zip(*files)) if files else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
            ["path", "bytes", "records"],
        )

    made = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, FILES)
    return common.cut_lineage(made)


def members(source, low: int, high: int) -> Iterator[bytes]:
    """Contents of the records that start at ``low`` or later and before ``high``."""
    at = low
    buffer, start = b"", low  # bytes of the file from ``start`` on

    def fill() -> bool:
        nonlocal buffer
        source.seek(start + len(buffer))
        more = source.read(_READ)
        buffer += more
        return bool(more)

    while at < high:
        buffer, start = buffer[at - start :], at
        found = buffer.find(_MAGIC)
        if found < 0:
            if not fill():
                return
            if buffer.find(_MAGIC) < 0:
                at = start + max(0, len(buffer) - len(_MAGIC) + 1)
            continue
        at = start + found
        if at >= high:
            return
        buffer, start = buffer[found:], at
        decoder, parts, used = zlib.decompressobj(31), [], 0
        valid = None
        while not decoder.eof:
            if used == len(buffer) and not fill():
                if valid:
                    raise ValueError(f"the record at byte {at} breaks off")
                valid = False
                break
            try:
                parts.append(decoder.decompress(buffer[used : used + _READ]))
            except zlib.error as error:
                if valid:
                    raise ValueError(f"the record at byte {at} is damaged") from error
                valid = False
                break
            used += len(buffer[used : used + _READ])
            if valid is None:
                begun = b"".join(parts)
                if len(begun) >= 7 or decoder.eof:
                    valid = begun.startswith(b"WARC/1.")
                    if not valid:
                        break
        if valid:
            yield b"".join(parts)
            at += used - len(decoder.unused_data)
        else:
            at += 1


def parsed(content: bytes, keep: bool) -> tuple:
    """The fields of a record; the payload itself only if ``keep``."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"]
    stated = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        size, own = int(length[1]) if length else None, stated
    else:
        size, own = len(payload), digest(payload)

    def number(name: bytes):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    return (
        number(b"warc-record-id"), fields.get(b"warc-target-uri"), kind, number(b"warc-refers-to"),
        size, own, stated, payload if keep and kind != "revisit" else None,
    )


def read(files: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (path, bytes), read by ranges of ``split`` bytes."""
    ranges = files.select(
        "path", "bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)),
                             F.lit(split).cast("long"))).alias("low"),
    ).select("path", "low", F.least(F.col("low") + split, F.col("bytes")).alias("high"))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
             pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with open_uri(path, "rb") as source:
                    for content in members(source, low, high):
                        rows.append(parsed(content, payloads))
                        held += len(content) if payloads else 200
                        if held > 8 << 20:
                            yield _batch(rows, kinds, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    # As many tasks as ranges: a range's row is small, but what it stands for is not.
    count = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0]
    return ranges.repartition(int(count or 1), "path", "low").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names
    )


def archive(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in a new shared folder; their files."""
    return write(referred(pages, least), session.work_path(spark, "warc"))
