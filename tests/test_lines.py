"""The line source: every line once, whatever the form of the file and wherever it is cut."""

import gzip
import random

import pytest
from helpers import rows

from evidrank.sources import delimited, lines


def made(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choices("abc\té日", k=pick.choice([0, 1, 3, 40, 700]))) for _ in range(n)]


def packed(data, size):
    return b"".join(lines.packed_block(data[i : i + size]) for i in range(0, len(data), size)) + lines._END


def read(path, size, step):
    parts = [lines.Range(path, at, min(size, at + step), -1, 0) for at in range(0, size, step)]
    found = [(p, t) for part in parts for b in lines.read_range(part) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    return found


@pytest.mark.parametrize("form", ["plain", "gzip", "blocks", "tiny blocks"])
@pytest.mark.parametrize("end", ["", "\n"])
@pytest.mark.parametrize("seed", range(3))
def test_every_line_once_whatever_the_ranges(tmp_path, form, end, seed):
    wanted = [*made(seed, 60), "last"]
    data = ("\n".join(wanted) + end).encode()
    body = {"plain": data, "gzip": gzip.compress(data[:50]) + gzip.compress(data[50:]), "blocks": packed(data, 2000), "tiny blocks": packed(data, 7)}[form]
    path = tmp_path / "x"
    path.write_bytes(body)
    for step in [1, 3, 17, 64, 500, 5000, 10**6]:
        found = read(str(path), len(body), step)
        assert [t for _, t in found] == wanted
        assert [p for p, _ in found] == sorted({p for p, _ in found})


def test_false_members_and_broken_files(tmp_path):
    fake = lines.packed_block(b"never")[:-4] + b"\0\0\0\0"  # the length at its end is wrong
    stored = b"one\n" + fake + b"\ntwo\n"
    body = lines.packed_block(b"zero\n") + lines.packed_block(stored) + lines._END
    path = tmp_path / "x.bgz"
    path.write_bytes(body)
    whole = [t for _, t in read(str(path), len(body), 10**6)]
    for step in (1, 5, 30):
        assert [t for _, t in read(str(path), len(body), step)] == whole
    assert whole[:2] == ["zero", "one"] and whole[-1] == "two"
    path.write_bytes(body[:-10])
    with pytest.raises(ValueError):
        read(str(path), len(body) - 10, 10**6)


def test_carriage_returns_bad_bytes_and_empty_files(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"a\r\nb\xff\r\n\r\nc")
    assert [t for _, t in read(str(path), 11, 4)] == ["a", "b�", "", "c"]
    path.write_bytes(b"")
    assert read(str(path), 0, 4) == []


def test_block_gzip_is_read_by_several_tasks(spark, tmp_path):
    wanted = [(str(k), f"v{k * 7919 % 1000}") for k in range(20_000)]
    frame = spark.createDataFrame([("\t".join(r),) for r in wanted], "value string").coalesce(1)
    lines.write_block_gzip(frame, f"file://{tmp_path}/out", head=["id\tx"])
    (file,) = (tmp_path / "out").iterdir()
    assert file.suffix == ".bgz" and gzip.decompress(file.read_bytes()).decode().splitlines()[1:] == ["\t".join(r) for r in wanted]
    df = delimited.read_delimited(spark, str(tmp_path / "out"), range_bytes=file.stat().st_size // 5)
    assert df.rdd.getNumPartitions() >= 5
    assert sum(1 for p in df.rdd.glom().collect() if p) >= 2
    assert rows(df) == sorted(wanted)
    file.rename(tmp_path / "out" / "same.gz")
    assert rows(delimited.read_delimited(spark, str(tmp_path / "out"))) == sorted(wanted)


def test_rows_that_repeat_the_head_stay_and_one_job_reads_all_heads(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.tsv").write_text(f"# made\nid\tx\n{k}\t1\nid\tx\n# made\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("heads", "heads")
    df = delimited.read_delimited(spark, str(tmp_path), comment="#")
    jobs = len(tracker.getJobIdsForGroup("heads"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1
    assert rows(df) == sorted([("# made", None)] * 6 + [("id", "x")] * 6 + [(str(k), "1") for k in range(6)], key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_preamble_rows_like_heads_stay(spark, tmp_path):
    head = "#1.2\n2\t1\nName\tDescription\tA\n"
    (tmp_path / "a.gct").write_text(head + "#1.2\nName\tDescription\tA\n2\t1\nx\ty\t3\n")
    (tmp_path / "b.gct").write_text("#1.2\n2\t1\n")  # no header, no rows
    want = [("#1.2", None, None), ("2", "1", None), ("Name", "Description", "A"), ("x", "y", "3")]
    assert rows(delimited.read_preamble(spark, [str(tmp_path / "a.gct"), str(tmp_path / "b.gct")])) == want


def test_paths_with_spaces_and_signs(spark, tmp_path):
    folder = tmp_path / "a b%20c+d"
    folder.mkdir()
    (folder / "x y.tsv.gz").write_bytes(gzip.compress(b"id\tx\n1\t2\n"))
    assert rows(delimited.read_delimited(spark, str(folder))) == [("1", "2")]
    lines.write_block_gzip(spark.createDataFrame([("3\t4",)], "v string"), str(folder / "out"), head=["id\tx"])
    assert rows(delimited.read_delimited(spark, str(folder / "out"))) == [("3", "4")]


def test_files_with_other_columns_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.tsv.gz").write_bytes(gzip.compress(b"id\tx\n1\t2\n"))
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress(b"y\tid\n3\t4\n"))
    df = delimited.read_delimited(spark, str(tmp_path))
    assert rows(df, "id", "x", "y") == [("1", "2", None), ("4", None, "3")]
