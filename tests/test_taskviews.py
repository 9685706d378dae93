"""Views of a graph against a loop for each task, on random graphs, hubs, ties and empty tables."""

import random

import pytest

from millrace.operators import taskviews
from millrace.plans import taskviews as plans

HITS, EDGES = "task_id int, node long, score long", "a long, b long, kind string, resolved boolean"


def loop(hits, edges):
    support, out = {}, []
    for a, b, _, _ in edges:
        if a != b:
            support.setdefault(a, set()).add(b)
            support.setdefault(b, set()).add(a)
    strong = {}
    for a, b, k, r in edges:
        strong[a, b, k] = strong.get((a, b, k), False) or bool(r)
    for task in sorted({t for t, _, s in hits if s > 0}):
        score = {}
        for t, n, s in hits:
            if t == task and s > 0:
                score[n] = max(s, score.get(n, 0))
        seeds = sorted(score, key=lambda n: (-score[n], n))[:4]
        near = set(seeds)
        for _ in range(2):
            near |= {m for n in near for m in support.get(n, ())}
        total = sum(score[s] for s in seeds)
        personal = {n: score[n] / total if n in seeds else 0.0 for n in near}
        rank = dict(personal)
        for _ in range(16):
            new = {n: 0.25 * personal[n] for n in near}
            for n in near:
                inside = support.get(n, set()) & near
                for m in inside:
                    new[m] += 0.75 * rank[n] / len(inside)
                if not inside:
                    for m in seeds:
                        new[m] += 0.75 * rank[n] * personal[m]
            rank = new
        chosen = [*seeds, *(n for n in sorted(near, key=lambda n: (-round(rank[n], 9), n)) if n not in seeds)][:12]
        out += [(task, "seed" if n in seeds else "node", i, n, None, None, None) for i, n in enumerate(chosen, 1)]
        shown = sorted((e for e in strong if e[0] in chosen and e[1] in chosen), key=lambda e: ({"calls": 0, "imports": 1}.get(e[2], 2), e))[:16]
        out += [(task, "edge", i, None, *e) for i, e in enumerate(shown, 1)]
        for part, turn in (("upstream", -1), ("downstream", 1)):
            pairs = {(a, b)[::turn] for a, b, k in shown if strong[a, b, k] and k != "references"}
            one = {y for x, y in pairs if x in seeds}
            two = {y for x, y in pairs if x in one} - one
            found = [n for far in (one, two) for n in sorted(far - set(seeds))][:6]
            out += [(task, part, i, n, None, None, None) for i, n in enumerate(found, 1)]
        calls = {(a, b) for a, b, k in shown if k == "calls" and strong[a, b, k]}
        paths = []
        for s in seeds:
            for target in sorted(b for a, b in calls if a == s):
                tails = sorted(b for a, b in calls if a == target and b not in (s, target))
                paths.append((tails[0] if tails else target, s, target))
        out += [(task, "path", i, end, s, target, "calls") for i, (end, s, target) in enumerate(paths[:2], 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("task_id", "part", "place", "node", "a", "b", "kind").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_views_against_a_loop(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60), draw.choice(["calls", "calls", "imports", "references"]), draw.choice([True, True, False, None])) for _ in range(90)]
    edges += [(7, draw.randrange(60), "imports", True) for _ in range(20)] + edges[:10]
    hits = [(t, draw.randrange(70), draw.randrange(0, 4)) for t in range(12) for _ in range(draw.randrange(0, 8))] + [(50, 900, 3), (51, 7, 0)]
    got = taskviews.task_views(spark.createDataFrame(hits, HITS).repartition(3), spark.createDataFrame(edges, EDGES).repartition(5))
    assert rows_of(got) == loop(hits, edges)


def test_given_tables_and_empty_ones(spark):
    hits, edges = plans.task_graph(spark, "/root/testdata/sf0.001")
    got = rows_of(taskviews.task_views(hits, edges))
    assert got == loop([tuple(r) for r in hits.collect()], [tuple(r) for r in edges.collect()])
    nodes = {}
    for task, part, place, node, a, b, _ in got:
        assert place <= {"seed": 4, "node": 12, "edge": 16, "path": 2}.get(part, 6)
        nodes.setdefault(task, set()).update([node] if part in ("seed", "node") else [])
    assert all({x for x in (node, a, b) if x is not None} <= nodes[task] for task, part, _, node, a, b, _ in got)
    assert rows_of(taskviews.task_views(hits.limit(0), edges)) == [] and {r[1] for r in rows_of(taskviews.task_views(hits, edges.limit(0)))} == {"seed"}
