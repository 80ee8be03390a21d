"""Lines of text files with their places: plain, gzip and block-gzip files, the first and the last cut into byte ranges.

Block gzip (the form in which large genome tables are shipped, as ``.bgz`` or ``.gz``) is a row of gzip members of at
most 64 KiB, each with its own size in an extra header field. A range finds the first member that begins inside it,
accepts a candidate only if it inflates with the right checksum and length, and goes on from member to member. What a
file is, is told by its first bytes, not by its name. An ordinary gzip file cannot be entered in the middle: the range
at offset 0 reads all of it, the others nothing.

A line belongs to the range in which the line before it ends; a range past the beginning of the file therefore leaves
out what comes before its first line break, and reads on after its end up to one. Every line has one owner, so lost
executors or doubled tasks change nothing.

A place is a number that grows along the file: the byte offset of the line, in block-gzip files the offset of the
member times 65,536 plus the offset in it. Head lines are told by their places alone; rows that repeat them are rows.

The sink writes block gzip, one file per task, into a folder of the job that becomes visible when the job commits.

Files are opened through ``pyarrow.fs``, which knows file, hdfs, s3, gs and abfs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "evidrank_lines"
RANGE_BYTES = 16 << 20
#: Bytes handled at a time; lines leave a task in batches of about this size.
_STEP = 1 << 20
_GZIP, _EXTRA = b"\x1f\x8b\x08", 4
_BLOCK_DATA = 65_280
#: The empty member that ends a block-gzip file: a fixed value of the format.
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_LINES = pa.schema([("path", pa.string()), ("place", pa.int64()), ("line", pa.string())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; Hadoop's names for S3 are understood."""
    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else path)


def _open(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def block_size(head: bytes) -> int | None:
    """Size of the block-gzip member that begins with these bytes; None if they do not begin one."""
    if len(head) < 18 or head[:3] != _GZIP or not head[3] & _EXTRA:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def block_data(member: bytes) -> bytes | None:
    """What a member holds; None unless it is whole and its checksum is right."""
    inflate = zlib.decompressobj(31)
    try:
        data = inflate.decompress(member)
    except zlib.error:
        return None
    return data if inflate.eof and not inflate.unused_data else None


class _Window:
    """Reads of a seekable file that mostly go forward, served from one held stretch."""

    def __init__(self, file):
        self.file, self.start, self.held = file, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, _STEP))
        return self.held[at - self.start : at - self.start + n]


def block_pieces(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, data) of the members from the first that begins in [start, end) on, to the end of the file."""
    window, at = _Window(file), start
    while at < end:  # find a member
        near = window.read(at, min(_STEP // 2, end - at + 2))
        found = near.find(_GZIP)
        if found < 0:
            at += max(1, len(near) - 2)
            continue
        at += found
        size = block_size(window.read(at, 4096)) if at < end else None
        if size and block_data(window.read(at, size)) is not None:
            break
        at += 1
    if at >= end:
        return
    while size := block_size(window.read(at, 4096)):
        data = block_data(window.read(at, size))
        if data is None:
            raise ValueError(f"broken block-gzip member at byte {at}")
        yield at << 16, data
        at += size
    if window.read(at, 1):
        raise ValueError(f"no block-gzip member at byte {at}")


def plain_pieces(file, start: int) -> Iterator[tuple[int, bytes]]:
    file.seek(start)
    while data := file.read(_STEP):
        yield start, data
        start += len(data)


def gzip_pieces(file) -> Iterator[tuple[int, bytes]]:
    """Data of a gzip file of any number of members, with its place in the whole data."""
    place, inflate = 0, zlib.decompressobj(31)
    while raw := file.read(_STEP):
        while raw:
            data = inflate.decompress(raw, _STEP)
            if data:
                yield place, data
                place += len(data)
            raw = inflate.unconsumed_tail
            if inflate.eof:
                raw, inflate = inflate.unused_data, zlib.decompressobj(31)
    if rest := inflate.flush():
        yield place, rest


def owned(pieces: Iterator[tuple[int, bytes]], first: bool, edge: int | None) -> Iterator[tuple[np.ndarray, bytes]]:
    """(places of the lines, their bytes, all whole lines) of one range, in stretches.

    ``first``: the range begins the file. ``edge``: the place from which on pieces belong to others (None: none do); of
    those only what precedes the first line break, and the break, still belongs here.
    """
    rest, starts, offsets = b"", [], []  # bytes without a break yet, and the places of the pieces they come from
    skipping = not first

    def stretch(data: bytes) -> tuple[np.ndarray, bytes]:
        begins = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[:-1] + 1])
        piece = np.searchsorted(np.array(offsets), begins, "right") - 1
        return np.array(starts)[piece] + begins - np.array(offsets)[piece], data

    for place, data in pieces:
        past = edge is not None and place >= edge
        if skipping:
            cut = data.find(b"\n") + 1
            if past:
                return  # no line begins in this range
            if not cut:
                continue
            place, data, skipping = place + cut, data[cut:], False
        last = past and b"\n" in data
        if last:
            data = data[: data.find(b"\n") + 1]
        if data:
            starts.append(place)
            offsets.append(len(rest))
            rest += data
        if last or len(rest) >= _STEP:
            cut = rest.rfind(b"\n") + 1
            if cut:
                yield stretch(rest[:cut])
                at = int(np.searchsorted(np.array(offsets), cut, "right")) - 1
                place, rest = starts[at] + cut - offsets[at], rest[cut:]
                starts, offsets = ([place], [0]) if rest else ([], [])
        if last:
            return
    if rest:
        yield stretch(rest if rest.endswith(b"\n") else rest + b"\n")


def _texts(data: bytes) -> pa.Array:
    lines = data.split(b"\n")[:-1]
    if b"\r" in data:
        lines = [x[:-1] if x.endswith(b"\r") else x for x in lines]
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    after: int
    heads: int


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that the range owns, whose place is past ``after``; with ``heads`` only so many, from the start."""
    with _open(part.path) as file:
        head = file.read(4096)
        file.seek(0)
        if block_size(head):
            pieces, edge = block_pieces(file, part.start, part.end), part.end << 16
        elif head[:2] == _GZIP[:2]:
            if part.start:
                return
            pieces, edge = gzip_pieces(file), None
        else:
            pieces, edge = _split_at(plain_pieces(file, part.start), part.end), part.end
        left = part.heads
        for places, data in owned(pieces, not part.start, edge):
            texts = _texts(data)
            if part.heads:
                places, texts = places[:left], texts[:left]
                left -= len(places)
            keep = places > part.after
            if not keep.all():
                places, texts = places[keep], texts.filter(pa.array(keep))
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(places), pa.string()), pa.array(places, pa.int64()), texts], schema=_LINES)
            if part.heads and left <= 0:
                return


def _split_at(pieces: Iterator[tuple[int, bytes]], edge: int) -> Iterator[tuple[int, bytes]]:
    """The same pieces, with one that reaches over the edge cut there."""
    for place, data in pieces:
        if place < edge < place + len(data):
            yield place, data[: edge - place]
            yield edge, data[edge - place :]
        else:
            yield place, data


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.heads, self.bytes = int(options.get("heads", 0)), int(options.get("range", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        parts = []
        for path, after in self.files:
            store, name = _store(path)
            size = store.get_file_info(name).size or 0
            step = size if self.heads else self.bytes
            parts += [Range(path, at, min(size, at + step), after, self.heads) for at in range(0, size, max(1, step))]
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class BlockGzipWriter(DataSourceArrowWriter):
    """Block-gzip files of the lines of a one-column frame, each below the head lines."""

    def __init__(self, options, overwrite: bool):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".bgz")
        self.head = "".join(f"{h}\n" for h in json.loads(options.get("head", "[]"))).encode()
        self.job, self.overwrite = uuid.uuid4().hex, overwrite

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, root = _store(self.path)
        return store, root, f"{root}/_{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _, folder = self._folder()
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            held = self.head
            for rows in iterator:
                held += b"".join([(v or "").encode() + b"\n" for v in rows.column(0).to_pylist()])
                while len(held) >= _BLOCK_DATA:
                    out.write(packed_block(held[:_BLOCK_DATA]))
                    held = held[_BLOCK_DATA:]
            if held:
                out.write(packed_block(held))
            out.write(_END)
        return _Written(name)

    def commit(self, messages) -> None:
        store, root, folder = self._folder()
        old = store.get_file_info(fs.FileSelector(root)) if self.overwrite else []
        for message in messages:
            if message:
                store.move(f"{folder}/{message.name}", f"{root}/{message.name}")
        for info in old:
            if info.is_file:
                store.delete_file(info.path)
        store.delete_dir(folder)

    def abort(self, messages) -> None:
        store, _, folder = self._folder()
        store.delete_dir_contents(folder, missing_dir_ok=True)


def packed_block(data: bytes) -> bytes:
    """One block-gzip member of at most 65,280 bytes of data."""
    squeeze = zlib.compressobj(5, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = _GZIP + bytes([_EXTRA]) + b"\0\0\0\0\0\xff" + struct.pack("<HHHH", 6, 0x4342, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, place long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockGzipWriter:
        return BlockGzipWriter(self.options, overwrite)


def _source(spark: SparkSession, files: list[tuple[str, int]], **options) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format(NAME).options(files=json.dumps(files), **options).load()


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files of a path, which may name files, folders or patterns; listed, not opened."""
    return sorted(spark.read.text(path).inputFiles())


def read_lines(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, place and line of every line past the given place (-1: all) of each (path, place)."""
    return _source(spark, files, range=str(range_bytes))


def read_heads(spark: SparkSession, files: list[str], lines: int) -> dict[str, list[tuple[int, str]]]:
    """The first lines of each file with their places; one job, and only those lines reach the driver."""
    found: dict[str, list[tuple[int, str]]] = {}
    if files:
        for path, place, line in _source(spark, [(f, -1) for f in files], heads=str(lines)).collect():
            found.setdefault(path, []).append((place, line))
    return {path: sorted(rows) for path, rows in found.items()}


def write_block_gzip(lines: DataFrame, path: str, head: list[str] = (), suffix: str = ".bgz") -> None:
    """Write the one column of ``lines`` as block gzip, a file per task, each below the head lines."""
    lines.sparkSession.dataSource.register(LineSource)
    lines.write.format(NAME).mode("append").options(path=path, head=json.dumps(list(head)), suffix=suffix).save()
