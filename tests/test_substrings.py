"""Substring search against contains on all pairs: short patterns, other scripts, hot runs, odd rows and empty tables."""

import random

import pytest

from millrace.operators import substrings


@pytest.mark.parametrize("most", [None, 3])
def test_against_all_pairs(spark, most):
    draw = random.Random(4)
    names = [(i, "".join(draw.choice("abcé漢_%") for _ in range(draw.randrange(0, 12)))) for i in range(1500)] + [(5000 + i, f"hot_common_{i % 400}") for i in range(2000)] + [(-1, None), (-2, "")]
    patterns = ["a", "é", "漢", "ab", "abc", "b_%", "hot", "common_1", "_common_", "nothere", "hot_common_399", "", None, "a", "zz", "%", "x" * 300, "aaa", "🙂"] + ["".join(draw.choice("abcé") for _ in range(4)) for _ in range(40)]
    got = substrings.containing(spark.createDataFrame(names, "id long, name string").repartition(6), "name", spark.createDataFrame([(p,) for p in patterns], "pattern string"), "pattern", most, ["id"])
    want = set()
    for p in {p for p in patterns if p}:
        held = sorted((len(n), n, i) for i, n in names if n is not None and p in n)
        want |= {(p, i) for _, _, i in held[:most]}
    rows = [(r.pattern, r.id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_empty_tables(spark):
    names, patterns = spark.createDataFrame([(1, "abc")], "id long, name string"), spark.createDataFrame([("b",)], "pattern string")
    assert substrings.containing(names.limit(0), "name", patterns, "pattern").collect() == [] and substrings.containing(names, "name", patterns.limit(0), "pattern").collect() == []
    assert [tuple(r) for r in substrings.containing(names, "name", patterns, "pattern").collect()] == [(1, "abc", "b")]
