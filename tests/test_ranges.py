"""Files of lines by byte ranges: every cut, resumed reads, torn tails, and a file larger than a task reads at once."""

import random

import pytest
from pyspark.sql import functions as F

from snagline.sources import files, ranges


def some_bytes(rng):
    return b"".join(rng.choice([b"\n", b"a", b"bc\n", "é".encode(), b"\r\n", b"x" * rng.randrange(9)]) for _ in range(rng.randrange(30)))


def plainly(data, offset=0, number=0):
    """(line, begin, text) of the complete lines behind an offset."""
    out, at = [], offset
    for line in data[offset:].split(b"\n")[:-1]:
        out.append((number + len(out), at, line))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_every_range_owns_the_lines_that_begin_in_it(tmp_path, monkeypatch, step):
    monkeypatch.setattr(ranges, "STEP_BYTES", 4)
    rng, path = random.Random(step), tmp_path / "f"
    for _ in range(150):
        data = some_bytes(rng)
        path.write_bytes(data)
        cuts = [ranges.Range(str(path), a, min(len(data), a + step), len(data)) for a in range(0, len(data), step)]
        got = [(at, line) for r in cuts for at, line in ranges.lines_of(r)]
        assert got == [(at, line) for _, at, line in plainly(data)], data
        assert [ranges.feeds_of(r) for r in cuts] == [len(list(ranges.lines_of(r))) for r in cuts], data
        at, tail = ranges.tail_of(str(path), len(data))
        assert (at, tail) == (len(data) - len(data.split(b"\n")[-1]), data.split(b"\n")[-1])


def test_lines_of_many_files(spark, tmp_path):
    rng = random.Random(9)
    want, tails = set(), {}
    for i in range(6):
        data = b"".join(b"%d %s\n" % (n, b"y" * rng.randrange(200)) for n in range(rng.randrange(80))) + rng.choice([b"", b"torn"])
        (tmp_path / "sub").mkdir(exist_ok=True)
        path = tmp_path / ("sub" if i % 2 else ".") / f"f {i}.jsonl"
        path.write_bytes(data)
        uri = "file://" + str(tmp_path) + ("/sub/" if i % 2 else "/") + f"f%20{i}.jsonl"
        want |= {(uri, n, at, line.decode()) for n, at, line in plainly(data)}
        tails[uri] = (len(data) - len(data.split(b"\n")[-1]), data.split(b"\n")[-1].decode())
    (tmp_path / "other.txt").write_text("no\n")
    lines = files.complete_lines(spark, str(tmp_path), pattern="*.jsonl", range_bytes=64)
    assert {(r["path"], r["line"], r["begin"], r["text"]) for r in lines.collect()} == want
    assert {r["path"]: (r["offset"], r["tail"]) for r in files.pending_tails(spark, str(tmp_path), pattern="*.jsonl").collect()} == tails
    listed = files.listed(spark, str(tmp_path), str(tmp_path / "sub")).collect()
    assert {r["path"] for r in listed} == set(tails) and all(len(r["prefix"]) == min(4096, r["size"]) for r in listed)


def test_a_file_that_grows_is_read_on(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    whole = b"".join(b'{"n":%d}\n' % n for n in range(50)) + b'{"torn":'
    for cut in (0, 1, 5, 200, len(whole) - 3, len(whole)):
        path.write_bytes(whole[:cut])
        first = [tuple(r) for r in files.complete_lines(spark, str(path), range_bytes=40).collect()]
        tail = files.pending_tails(spark, str(path)).first()
        offsets = spark.createDataFrame([(tail["path"], tail["offset"], len(first))], "path string, offset long, line int")
        path.write_bytes(whole)
        more = [tuple(r) for r in files.complete_lines(spark, str(path), offsets=offsets, range_bytes=40).collect()]
        rows = sorted({*first, *more})
        assert [(n, at, t.encode()) for _, n, at, t in rows] == plainly(whole)
        assert not {*first} & {*more}
    with pytest.raises(Exception, match="is read from byte"):
        beyond = spark.createDataFrame([("file://" + str(path), len(whole) + 1, 0)], "path string, offset long, line int")
        files.complete_lines(spark, str(path), offsets=beyond).collect()


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "large.jsonl"
    line = b'{"type":"user","text":"' + b"z" * 1000 + b'"}\n'
    path.write_bytes(line * 20_000 + b"w" * (3 << 20))
    lines = files.complete_lines(spark, str(path), range_bytes=1 << 20)
    assert ranges.read(spark, (str(path),), "lines", range_bytes=1 << 20).rdd.getNumPartitions() > 15
    row = lines.agg(F.count("*"), F.max("line"), F.max("begin"), F.count_distinct("line")).first()
    assert tuple(row) == (20_000, 19_999, 19_999 * len(line), 20_000)


def test_no_files(spark, tmp_path):
    assert files.complete_lines(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        files.complete_lines(spark, str(tmp_path / "nowhere")).collect()
