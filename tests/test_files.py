"""Inventories and bounded reads of files with odd names, long lines, other bytes and no last newline."""

import hashlib
import os

from millrace.sources import files

CONTENT = {
    "a b/f1.txt": b"one\ntwo\n", "a b/node_modules/z.txt": b"no\n", "x+y/\xc3\xa9%20.txt".encode("latin-1").decode(): "".join(f"line {i} é\n" for i in range(5000)).encode(), "long.txt": b"x" * 5000,
    "long then more.txt": b"y" * 299 + b"\n" + b"z" * 900, "empty.txt": b"", "bad.txt": b"ok\n\xff\xfe\n", "late.txt": b"ok\n" * 100 + b"\xff\n", "last.txt": b"a\nb", "crlf.txt": b"a\r\nb\r\n\r\n", "exact.txt": b"q" * 300, "blank.txt": b"\n\n\n", "d/one.py": b"x = 1\n",
}


def put(folder):
    for name, data in CONTENT.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}") or folder, exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)


def want(data, limit):
    lines, ends = [], 0
    parts = data.split(b"\n")
    for i, line in enumerate(parts):
        if i == len(parts) - 1 and not line:
            break
        end = min(ends + len(line) + 1, len(data))
        if end > limit:
            break
        lines.append(line)
        ends = end
    if not lines:
        return ("structural_only", None, None, None)
    text = b"\n".join(lines)
    try:
        text.decode()
    except UnicodeDecodeError:
        return ("unreadable", None, None, None)
    return ("complete" if ends == len(data) else "partial_lexical", len(lines), ends, hashlib.sha256(text).hexdigest())


def test_coverage_of_files(spark, tmp_path):
    put(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    listed = files.inventory(spark, str(tmp_path))
    names = {n for n in CONTENT if "node_modules" not in n and CONTENT[n]}
    assert {r.name: r.length for r in listed.collect()} == {n: len(CONTENT[n]) for n in names}
    for limit in (300, 1 << 20):
        got = {r.name: (r.coverage, r.covered_lines, r.covered_bytes, r.sha256) for r in files.coverage(listed, files.bounded_lines(spark, str(tmp_path), limit)).collect()}
        assert got == {n: want(CONTENT[n], limit) for n in names}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_listings_that_are_cut_short(spark, tmp_path):
    put(tmp_path)
    rows = files.inventory(spark, str(tmp_path), "*.txt", most=3).collect()
    names = sorted(r.name for r in rows)
    assert {r.name for r in rows if r.listed} == set(names[:3]) and "d/one.py" not in names
    assert {r.name for r in files.inventory(spark, str(tmp_path), "*.py").collect()} == {"d/one.py"}
    assert "a b/node_modules/z.txt" in {r.name for r in files.inventory(spark, str(tmp_path), ignored=()).collect()}
