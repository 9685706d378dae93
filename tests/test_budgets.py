"""Sequential choices against loops: large groups, nulls, ties and empty tables."""

import random

from millrace.operators import budgets


def rows_of(n):
    rng = random.Random(11)
    return [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 40}", i // 4, None if i % 17 == 0 else float(rng.randrange(1, 60))) for i in range(n)]


def groups(rows):
    out = {}
    for g, i, v in rows:
        out.setdefault(g, []).append((i, v))
    return out


def test_skips_against_a_loop(spark):
    rows = rows_of(20_000)
    frame = spark.createDataFrame(rows, "g string, i long, v double").repartition(7)
    want = []
    for g, items in groups(rows).items():
        used = 0.0
        for i, v in sorted(items, key=lambda x: (x[0], x[1] or 0)):
            if v is not None and used + v <= 5000:
                used += v
                want.append((g, i, used))
    got = [tuple(r) for r in budgets.skip_if_too_big(frame, "g", "i", "v", 5000.0).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert budgets.skip_if_too_big(frame.limit(0), "g", "i", "v", 5.0).count() == 0


def test_bands_against_a_loop(spark):
    rows = rows_of(20_000)
    frame = spark.createDataFrame(rows, "g string, i long, v double").repartition(7)
    want = []
    for g, items in groups(rows).items():
        band, leader = 0, None
        for i, v in sorted(items, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])):
            if band == 0 or (v is None) != (leader is None) or (v is not None and v < leader * 0.95):
                band, leader = band + 1, v
            want.append((g, i, band))
    got = [tuple(r) for r in budgets.tie_bands(frame, "g", "i", "v", 0.05).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert budgets.tie_bands(frame.limit(0), "g", "i", "v", 0.05).count() == 0
