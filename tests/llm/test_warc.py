import hashlib
import io
import zlib

import pytest
from llm_data import plain

from evidrank.llm import warc

BIG = "<html>" + "x y z " * 60


def pages(spark):
    made = [(5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (1, "http://a/1", None), (2, "http://a/2", "")]
    made += [(4, "http://a/ b\r\nX: y", "short"), (6, "http://a/6", "short"), (None, "http://a/n", BIG), (3, "http://a/3", BIG)]
    made += [(7, "http://ä/7", "ü" * 50), (8, "http://a/8", "ü" * 50), (10, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 40)]
    made += [(100 + k, f"http://b/{k}", f"page {k} " * (k * 7 % 90)) for k in range(60)]
    made += [(200, "http://long", "é long text " * 40_000)]
    return spark.createDataFrame(made, "page_id long, url string, html string")


def archive(spark, table, **options):
    return warc.write(warc.with_revisits(table), warc.archive_folder(spark), **options)


@pytest.mark.parametrize("split", [700, 4096, 8 << 20])
def test_round_trip(spark, split):
    table = pages(spark)
    rows = table.collect()
    first = {}
    for r in rows:
        data = (r.html or "").encode()
        if r.page_id is not None and len(data) >= 100:
            first[data] = min(r.page_id, first.get(data, r.page_id))
    want = []
    for r in rows:
        data = (r.html or "").encode()
        refers = first.get(data) if r.page_id is not None and first.get(data) != r.page_id else None
        want.append((r.page_id, "revisit" if refers is not None else "response", refers, hashlib.sha256(data).hexdigest(), len(data), None if refers is not None else data))
    got = warc.read(archive(spark, table), split).collect()
    seen = [(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_length, r.payload and bytes(r.payload) or (b"" if r.record_type == "response" else None)) for r in got]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/5"} and {r.url for r in got if r.page_id == 9} == {None}


def test_files_are_plain_gzip_members_of_bounded_size(spark):
    manifest = archive(spark, pages(spark), file_bytes=2000).collect()
    assert len(manifest) > 3
    records = 0
    for row in manifest:
        data = open(row.path.removeprefix("file:"), "rb").read()
        assert len(data) == row.bytes
        while data:
            inflate = zlib.decompressobj(31)
            assert inflate.decompress(data).startswith(b"WARC/1.1\r\n")
            data = inflate.unused_data
            records += 1
    assert records == pages(spark).count()


def test_false_magic_is_passed_over():
    record = warc._record(1, "u", b"payload", "d", None)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = squeeze.compress(record) + squeeze.flush()
    noise = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = noise.compress(b"no record") + noise.flush()
    data = b"\x1f\x8b\x08\x00junk" + other + member + b"\x1f\x8b\x08" + member[:-9]
    found = list(warc.records_in(io.BytesIO(data), 0, len(data)))
    assert [at for at, *_ in found] == [data.index(member)]


def test_ranges_own_what_begins_in_them():
    members = b""
    starts = []
    for k in range(20):
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        starts.append(len(members))
        members += squeeze.compress(warc._record(k, "u", b"p" * k, "d", None)) + squeeze.flush()
    for step in (1, 17, 150, 10_000):
        found = [at for a in range(0, len(members), step) for at, *_ in warc.records_in(io.BytesIO(members), a, min(len(members), a + step))]
        assert found == starts


def test_extra_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    table = pages(spark)
    clash = table.select("*", *[F.lit("x").alias(n) for n in ("digest", "payload", "refers_to", "first_id", "path")])
    pick = lambda df: plain(df.select("page_id", "record_type", "refers_to", "payload_digest"))
    assert pick(warc.read(archive(spark, clash))) == pick(warc.read(archive(spark, table)))
    assert warc.read(archive(spark, table.limit(0))).count() == 0
