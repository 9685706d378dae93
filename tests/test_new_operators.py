"""Operators without SQL against loops, and shared steps on hot keys, empty tables and nulls."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import expansion, graph, lifecycle
from millrace.sources.tables import join_hot, shared_dir


def grown(lines, centre, most):
    first = last = centre
    used = len(lines[centre]) + 1
    while True:
        before = used, first, last
        if first > 0 and used + len(lines[first - 1]) + 1 <= most:
            first -= 1
            used += len(lines[first]) + 1
        if last < len(lines) - 1 and used + len(lines[last + 1]) + 1 <= most:
            last += 1
            used += len(lines[last]) + 1
        if (used, first, last) == before:
            return first, last


def test_windows_fit_like_a_loop(spark):
    texts = ["", "a", "\n\n\n", "x" * 50, "\n".join("y" * (i % 9) for i in range(40)), "long " * 30 + "\nb\nc", "\n".join(str(i) for i in range(200))]
    rows = [(i, t.split("\n"), len(t.split("\n")) // 2) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id long, lines array<string>, centre int")
    for most in (1, 10, 60, 400):
        got = {r.id: (r.f.first, r.f.last) for r in frame.select("id", lifecycle.fitted(F.col("lines"), F.col("centre"), most).alias("f")).collect()}
        assert got == {i: grown(lines, centre, most) for i, lines, centre in rows}


def test_expansion_against_loops(spark):
    edges = [(f"n{i}", f"n{(i * 7 + j) % 40}", ("calls", "imports", "references")[(i + j) % 3]) for i in range(40) for j in range(5) if i != (i * 7 + j) % 40]
    edges += [("n1", "n2", "calls"), ("n1", "n2", "imports")]
    seeds = [("n1", 1), ("n5", 2), ("n9", 3)]
    frame, first = spark.createDataFrame(edges, "a string, b string, kind string"), spark.createDataFrame(seeds, "node string, rank int")
    both = {(a, b, k) for a, b, k in edges} | {(b, a, expansion.REVERSED[k]) for a, b, k in edges}
    incoming = {}
    for a, b, _ in edges:
        incoming.setdefault(b, set()).add(a)
    scores, front = {}, [(n, 1 / r) for n, r in seeds]
    for decay in (0.5, 0.25):
        following = []
        for origin, strength in front:
            best = {}
            for a, b, k in both:
                if a == origin:
                    best[b] = max(best.get(b, 0), round(strength * decay * expansion.PRIORS[k] / math.log(2 + len(incoming.get(b, ()))), 9))
            for b, value in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:8]:
                scores[b] = scores.get(b, 0) + value
                following.append((b, value, origin))
        front = [(b, v) for b, v, _ in sorted(following, key=lambda x: (-x[1], x[0], x[2]))[:20]]
    want = sorted(((n, round(s, 6)) for n, s in scores.items()), key=lambda x: (-x[1], x[0]))[:20]
    got = sorted(((r.node, r.score) for r in expansion.expand_graph(first, frame).collect()), key=lambda x: (-x[1], x[0]))
    assert [n for n, _ in got] == [n for n, _ in want] and all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, want, strict=True))
    assert expansion.expand_graph(first.limit(0), frame).count() == expansion.expand_graph(first, frame.limit(0)).count() == 0


def test_pagerank_against_a_loop(spark):
    edges = [(f"n{i}", f"n{(i * 3 + 1) % 12}") for i in range(12) if i != (i * 3 + 1) % 12]
    near = {}
    for a, b in set(edges):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = restart = {"n0": 0.5, "n3": 0.5}
    for _ in range(16):
        now = {n: 0.25 * r for n, r in restart.items()}
        for a, held in score.items():
            for b in near.get(a, ()):
                now[b] = now.get(b, 0) + 0.75 * held / len(near[a])
        score = now
    got = {r.node: r.score for r in graph.personalised_pagerank(spark.createDataFrame([("n0",), ("n3",)], "node string"), spark.createDataFrame(edges, "a string, b string").distinct()).collect()}
    assert all(abs(got.get(n, 0) - s) < 1e-6 for n, s in score.items())


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3000).selectExpr("if(id < 2500, 1, id) as k", "id")
    facts = rows.groupBy("k").count().withColumn("fact", F.col("k") * 2)
    plain = rows.join(facts, "k")
    for least in (10, 10**9):
        got = join_hot(rows, facts, "k", "count", least)
        assert got.count() == 3000 and got.select(*plain.columns).exceptAll(plain).count() == 0
    assert join_hot(rows.limit(0), facts.limit(0), "k", "count").count() == 0


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, name, otherwise=None):
            return {"spark.master": "yarn"}.get(name, otherwise)

    with pytest.raises(ValueError):
        shared_dir(type("Session", (), {"conf": Conf()})())
