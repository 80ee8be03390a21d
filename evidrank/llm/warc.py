"""WARC archives: a writer of gzip members, one per record, and a splittable reader.

Writing: pages with equal payloads of at least ``least`` bytes share one response record, that of the smallest page_id;
the others become revisit records that name it. Every task writes files of its own under a fresh name and returns their
names as rows; only the rows of tasks that count reach the manifest, so a retried or doubled task leaves at most a file
that nobody reads.

Reading: a file's bytes are cut into ranges. A task looks for the gzip magic in its range, takes a candidate for a
member only if it inflates to a well-formed WARC record whose length and checksum agree, reads past the end of the
range to finish the last one, and owns the records that begin inside the range: each record is read exactly once.

NULL html is an empty payload. A NULL page_id is kept, always a response, and never referred to; rows that repeat the
smallest page_id are responses too. A NULL url leaves the header out. Other columns are ignored; an empty table gives
an empty archive.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrank.llm.common import settled
from evidrank.sources.stages import scratch_folder

LEAST, LEVEL, FILE_BYTES, SPLIT_BYTES = 100, 4, 128 << 20, 8 << 20
#: Reading tasks, at most, for each slot of the cluster.
RANGES_A_SLOT = 64
_MAGIC, _STEP = b"\x1f\x8b\x08", 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    return f"{scratch_folder(spark)}/evidrank-cuts/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, and the page_id it refers to, if any."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest")
    first = first.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    # A table of its own: the join then meets plain shuffles on both sides, and a payload that fills a third of the
    # rows can be split over tasks.
    first = settled(first.select("digest", "first_id"))
    refers = F.when(F.col("first_id") != F.col("page_id"), F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{uuid.uuid5(uuid.NAMESPACE_URL, digest) if page_id is None else page_id}>")
    head.append("WARC-Date: 1970-01-01T00:00:00Z")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records (page_id, url, payload, digest, refers_to) under the folder; returns the manifest (path, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, out, done, count = TaskContext.get().partitionId(), None, 0, 0
        names, sizes = [], []

        def close() -> None:
            if out is not None:
                out.close()
                sizes.append(done)

        for rows in batches:
            for values in zip(*(c.to_pylist() for c in rows.columns)):
                if out is None or done >= file_bytes:
                    close()
                    name = f"part-{part:06d}-{count:04d}-{uuid.uuid4().hex}.warc.gz"
                    out, done, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, count + 1
                    names.append(name)
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = squeeze.compress(_record(*values)) + squeeze.flush()
                out.write(member)
                done += len(member)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    files = records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "name string, bytes long")
    return settled(files.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), "bytes"))


def _member(read, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at ``at`` and where the member ends; None if there is none."""
    inflate, out, begun, checked = zlib.decompressobj(31), [], at, False
    while not inflate.eof:
        data = read(at, _STEP)
        if not data:
            return None
        at += len(data)
        try:
            out.append(inflate.decompress(data))
        except zlib.error:
            return None
        if not checked and sum(map(len, out)) >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            checked = True
    end = at - len(inflate.unused_data)
    return (b"".join(out), end) if checked and end > begun else None


def _parsed(record: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a well-formed record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not gap or not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return fields, rest[:-4]


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of every record whose member begins in [start, end) of a seekable file."""
    file.seek(start)
    held = file.read(end - start + len(_MAGIC) - 1)

    def read(at: int, n: int) -> bytes:
        if at - start + n <= len(held):
            return held[at - start : at - start + n]
        file.seek(at)
        return file.read(n)

    at = start
    while (found := held.find(_MAGIC, at - start)) >= 0 and start + found < end:
        at = start + found
        member = _member(read, at)
        parsed = member and _parsed(member[0])
        if not parsed:
            at += 1
            continue
        yield at, *parsed
        at = member[1]
        if at >= end:
            return


_READ = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string())]
    + [("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())]
)
_READ_SQL = (
    "path string, offset long, record_type string, page_id long, url string, refers_to long, payload_digest string, "
    "payload_length long, payload binary"
)


def _row(path: str, at: int, fields: dict[str, str], block: bytes) -> tuple:
    kind, refers = fields.get("warc-type"), fields.get("warc-refers-to", "")
    page, length = fields.get("x-page-id"), fields.get("x-payload-length")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    refers_to = int(refers.removeprefix("<urn:page:").rstrip(">")) if refers else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    return path, at, kind, page and int(page), fields.get("warc-target-uri"), refers_to, digest, length and int(length), payload


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record of the manifest's files; a range of bytes is the unit of work, not a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranges in batches:
            for path, size, start in zip(*(c.to_pylist() for c in ranges.columns)):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for found in records_in(file, start, min(size, start + split_bytes)):
                        rows.append(_row(path, *found))
                        held += len(found[2])
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    # A fixed number of tasks: rows that name ranges are tiny, and would else be merged into one task that reads all.
    number = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    slots = manifest.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(min(int(number), RANGES_A_SLOT * slots), "path", "start").mapInArrow(run, _READ_SQL)
