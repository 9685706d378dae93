"""Dependency states against a walk down each name's needs, on random graphs with cycles, and on odd rows."""

import random

import pytest

from millrace.operators import dependencies

NEEDS, NAMES, STATES = "name string, dep string, relation string, grp long, operation string", "name string", "name string, state string"


def walk(root, needs, names, states, operation):
    """(reaches a cycle, items by kind) by plain recursion with a path."""
    state = lambda d: states.get(d, "unknown" if d in names else "missing")
    items, seen, cyclic = set(), set(), [False]

    def visit(name, path):
        if name in path:
            cyclic[0] = True
            return
        if name in seen:
            return
        groups = {}
        for _, dep, relation, grp, op in (n for n in needs if n[0] == name):
            if relation == "all_of" or (relation == "conditional" and op == operation is not None):
                if state(dep) != "available":
                    items.add((state(dep), dep))
                if dep in names:
                    visit(dep, [*path, name])
            elif relation == "any_of":
                groups.setdefault(grp, []).append(state(dep))
            elif relation == "optional" and state(dep) == "missing":
                items.add(("optional", dep))
        for grp, own in groups.items():
            if "available" not in own:
                items.add(("missing" if set(own) == {"missing"} else "unknown", f"any_of:{'' if grp is None else grp}"))
        seen.add(name)

    visit(root, [])
    return cyclic[0], items


def random_graph(seed, n=60):
    draw = random.Random(seed)
    name = [f"n{i}" for i in range(n)]
    needs = []
    for i in range(n):
        for _ in range(draw.randrange(4)):
            relation = draw.choice(["all_of", "all_of", "any_of", "any_of", "optional", "conditional"])
            back = draw.random() < 0.05
            relation = "all_of" if back else relation
            j = draw.randrange(i, min(i + 4, n)) if back else draw.randrange(max(i, 1))
            needs.append((name[i], name[j] if draw.random() < 0.85 else f"x{j}", relation, draw.randrange(2) if relation == "any_of" else None, draw.choice(["open", "close"]) if relation == "conditional" else None))
    needs += [("n50", "n40", "all_of", None, None), ("n40", "n50", "all_of", None, None)]
    states = {x: draw.choice(["missing", "unknown"] + ["available"] * (1 if seed % 2 else 12)) for x in [*name, *(f"x{i}" for i in range(n))] if draw.random() < 0.9}
    return needs, name, states


@pytest.mark.parametrize("seed, operation", [(1, "open"), (2, None), (4, "close")])
def test_states_against_a_walk(spark, seed, operation):
    needs, names, states = random_graph(seed)
    frames = spark.createDataFrame(needs + needs[:20], NEEDS).repartition(4), spark.createDataFrame([(n,) for n in names], NAMES), spark.createDataFrame(list(states.items()), STATES)
    got = {r.name: r for r in dependencies.dependency_states(*frames, operation).collect()}
    assert set(got) == set(names)
    every = set()
    for n in names:
        cyclic, items = walk(n, needs, set(names), states, operation)
        least = {k: min((i for kind, i in items if kind == k), default=None) for k in ("missing", "unknown", "optional")}
        status = "cycle" if cyclic else "missing" if least["missing"] else "unknown" if least["unknown"] else "degraded" if least["optional"] else "satisfied"
        assert got[n].status == status, n
        if not cyclic:
            assert (got[n].first_missing, got[n].first_unknown, got[n].first_optional) == tuple(least.values())
        every.add(status)
    roots = spark.createDataFrame([(n,) for n in names[::7]] + [("absent",)], NAMES)
    items = {}
    for r in dependencies.dependency_items(roots, *frames, operation).collect():
        items.setdefault(r.name, []).append((r.kind, r.item))
    assert {n: sorted(x) for n, x in items.items()} == {n: sorted(x) for n in names[::7] if (x := walk(n, needs, set(names), states, operation)[1])}
    assert "cycle" in every and len(every) >= 3


def test_odd_needs(spark):
    needs = [("a", "a", "all_of", None, None), ("b", "a", "all_of", None, None), ("c", None, "all_of", None, None), ("d", "e", "all_of", None, None), ("d", "e", "all_of", None, None), ("e", "f", "any_of", None, None), (None, "a", "all_of", None, None), ("unlisted", "e", "all_of", None, None), ("f", "g", "conditional", None, None)]
    names, states = [("a",), ("b",), ("c",), ("d",), ("e",), ("f",), ("f",), (None,)], [("e", "available"), ("f", "available"), ("f", "available"), ("g", None)]
    frames = spark.createDataFrame(needs, NEEDS), spark.createDataFrame(names, NAMES), spark.createDataFrame(states, STATES)
    got = {r.name: r.status for r in dependencies.dependency_states(*frames).collect()}
    assert got == {"a": "cycle", "b": "cycle", "c": "satisfied", "d": "satisfied", "e": "satisfied", "f": "satisfied"}
    empty = [f.limit(0) for f in frames]
    assert dependencies.dependency_states(*empty).collect() == [] and dependencies.dependency_items(frames[1].limit(0), *frames).collect() == []
