"""Capture by byte offset: appended, partial, truncated and long files, over restarts."""

import io
import random

from sparkloom.sources import capture as C
from sparkloom.streaming.jobs import append_to


def taken(spark, folder, job, **options):
    rows = append_to(C.captured(spark, f"file://{folder}", **options), f"file://{job}")
    return sorted((r.path.rsplit("/", 1)[1], r.start, r.line) for r in rows.collect())


def test_each_line_once_over_restarts(spark, tmp_path):
    folder, job = tmp_path / "in", tmp_path / "job"
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_text("one\ntwo\nthr")
    (folder / "_hidden.jsonl").write_text("x\n")
    (folder / "notes.txt").write_text("x\n")
    assert taken(spark, folder, job) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    assert len(taken(spark, folder, job)) == 2  # nothing new
    a.write_text("one\ntwo\nthree\nfour")  # the last line's end comes later
    b.write_text("\nb1 é\n")
    third = taken(spark, folder, job)
    assert third == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "three"), ("b.jsonl", 1, "b1 é")]
    b.write_text("new\n")  # replaced by a shorter file
    a.write_text("one\ntwo\nthree\nfour\n")
    last = taken(spark, folder, job)
    assert set(last) - set(third) == {("b.jsonl", 0, "new"), ("a.jsonl", 14, "four")} and len(last) == 6


def test_ranges_and_needle(spark, tmp_path):
    """Lines over the bounds of ranges come once; a line without the needle doesn't come."""
    folder = tmp_path / "in"
    folder.mkdir()
    rnd = random.Random(1)
    lines = ["x" * rnd.randint(0, 300) + ("needle" if i % 3 else "") + str(i) for i in range(500)]
    (folder / "a.jsonl").write_text("\n".join(lines) + "\n")
    got = taken(spark, folder, tmp_path / "job", rangeBytes="97", needle="needle")
    assert sorted(line for _, _, line in got) == sorted(line for line in lines if "needle" in line)


def test_old_files_and_no_files(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    assert taken(spark, folder, tmp_path / "none") == []
    (folder / "a.jsonl").write_text("old\n")
    os.utime(folder / "a.jsonl", (1, 1))
    (folder / "b.jsonl").write_text("new\n")
    assert taken(spark, folder, tmp_path / "job", maxAgeDays="14") == [("b.jsonl", 0, "new")]


def test_any_ranges():
    rnd = random.Random(7)
    for _ in range(300):
        data = "".join(rnd.choice(["a", "bb", "\n", "\n"]) for _ in range(rnd.randint(0, 40))).encode()
        stop = C.behind_last_line(io.BytesIO(data), len(data))
        assert stop == data.rfind(b"\n") + 1
        first = C.behind_last_line(io.BytesIO(data), rnd.randint(0, stop)) if stop else 0
        most, block = rnd.randint(1, 9), rnd.randint(1, 5)
        got = [x for p in C.ranges({"f": first}, {"f": stop}, most) for x in C.lines_of(C._Buffered(io.BytesIO(data), block), p)]
        at, want = first, []
        for line in data[first:stop].split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want
    assert C.ranges({"f": 9}, {"f": 4}) == [C.Range("f", 0, 0, 4)]
