import hashlib
import re
from pathlib import Path

from fixtures import pages

from barloom.llm import warc

BIG = "<p>" + "é long payload " * 900
ROWS = [
    (1, "http://a/x", BIG), (2, "http://a/y", BIG), (3, None, BIG), (4, "http://b", "short"), (5, "http://b", "short"), (6, "http://c", None), (7, "http://c", ""),
    (8, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nX" * 60), (9, "u\r\nX: y", "\r\n\r\n" + "z\r\n\r\n" * 400 + "\r\n\r\n"), (None, "n", BIG), (None, "n2", "null id"),
    (10, "w", "twice " * 300), (10, "w", "twice " * 300), (11, "r", "WARC/" * 500 + "\r\n"), (12, "e", "日本語" * 5000),
]


def expected(rows):
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        top = max(same) if same else None
        again = len(raw) >= 1000 and p != top
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return out


def check(spark, path, rows, segment):
    warc.write_archive(pages(spark, rows), str(path), segment)
    got = [tuple(r) for r in warc.read_records(spark, str(path)).collect()]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_round_trip_whole(spark, tmp_path):
    check(spark, tmp_path / "w", ROWS, warc.SEGMENT)


def test_round_trip_in_segments(spark, tmp_path):
    check(spark, tmp_path / "w", ROWS, 700)


def test_files_are_warc(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), str(tmp_path / "w"), 2000)
    seen = 0
    for f in Path(tmp_path / "w").glob("part-*"):
        data, at = f.read_bytes(), 0
        while at < len(data):  # a plain reader that follows Content-Length
            end = data.index(b"\r\n\r\n", at)
            head = data[at:end].decode()
            assert head.startswith("WARC/1.1\r\nWARC-Type: ")
            n = int(re.search(r"\r\nContent-Length: (\d+)", head)[1])
            assert data[end + 4 + n:end + 8 + n] == b"\r\n\r\n"
            at, seen = end + 8 + n, seen + 1
    assert seen > len(ROWS)


def test_empty_table(spark, tmp_path):
    warc.write_archive(pages(spark, []), str(tmp_path / "w"))
    assert warc.read_records(spark, str(tmp_path / "w")).count() == 0


def test_marks_completed_by_what_follows(spark, tmp_path):
    """A mark at the end of a payload, of a segment or of a url gets its line end from the record."""
    mark = "WARC/1.1"
    rows = [(1, "http://a/", "text " + mark), (2, f"http://a/{mark}", "text"), (3, f"http://a/{mark}\r\n{mark}", mark), (4, mark, "x" * 692 + mark + "\r\n" + mark),
            (5, "http://a/", ("y" * 692 + mark) * 4), (6, None, mark + "\r"), (7, "", mark + "\r\n" + mark + "\n"), (8, "u", f"\r\n\r\n{mark}\r\nWARC-Type: response\r\n\r\n"), (9, "u", "WARC/")]
    check(spark, tmp_path / "whole", rows, warc.SEGMENT)
    check(spark, tmp_path / "cut", rows, 700)
