"""States of revisions, one case for each, and settings merged in any split."""

import random

from pyspark.sql import functions as F

from millrace.operators import overlays

REVISION = "revision_id string, kind string, artifact_id string, scope string, slot string, live boolean, policy string, package string, base string, supported boolean, families int, dependencies array<string>, parents array<string>"


def revision(name, kind="skill_overlay", artifact="a", scope="repo", slot="s", live=True, policy="p", package="k", base="b", supported=True, families=1, dependencies=None, parents=None):
    return (name, kind, artifact, scope, slot, live, policy, package, base, supported, families, dependencies, parents)


def states(spark, revisions, applies=None, **more):
    matches = [("q", r[0], (applies or {}).get(r[0], True)) for r in revisions]
    frame = overlays.resolved(spark.createDataFrame(matches + matches[:1], "request_id string, revision_id string, applies boolean"), spark.createDataFrame(revisions, REVISION), spark.createDataFrame([("skill_overlay", x, "b") for x in "abcdefgh"] + [("retrieval_profile", "a", "b")], "kind string, artifact_id string, digest string"), ["skill_overlay", "retrieval_profile"], "p", "k", more.pop("most", 9), **more)
    return {r.revision_id: r.state for r in frame.collect()}


def test_each_state(spark):
    rows = [
        revision("off", live=False), revision("null", live=None), revision("kind", kind="verification_hint"), revision("policy", policy="old"), revision("package", package=None),
        revision("no", artifact="b"), revision("forgotten", supported=False), revision("needs", artifact="c", dependencies=["no"]), revision("chain", artifact="d", dependencies=["needs", None]),
        revision("nobase", artifact="z"), revision("rebased", artifact="e", base="old"), revision("one", artifact="f"), revision("two", artifact="f"), revision("other", artifact="f", slot="t"),
        revision("fine", dependencies=["other"]),
    ]
    got = states(spark, rows, {"no": None})
    assert got == {"off": "not_approved", "null": "not_approved", "kind": "capability_unavailable", "policy": "stale_base", "package": "stale_base", "no": "not_applicable", "forgotten": "insufficient_evidence", "needs": "insufficient_evidence", "chain": "active", "nobase": "capability_unavailable", "rebased": "stale_base", "one": "conflict", "two": "conflict", "other": "active", "fine": "active"}
    assert states(spark, [revision("x")], shadow=True) == {"x": "shadow"}


def test_layers_and_budgets(spark):
    rows = [revision("g", scope="global"), revision("r", parents=["g"]), revision("g2", "skill_overlay", "b", "global", live=False), revision("r2", artifact="b", parents=["g2"]), revision("g3", artifact="c", scope="global"), revision("r3", artifact="c", parents=["gone"])]
    assert states(spark, rows) == {"g": "active", "r": "active", "g2": "not_approved", "r2": "stale_base", "g3": "active", "r3": "active"}
    many = [revision(f"x{i}", artifact="abcdefgh"[i], scope="global" if i % 2 else "repo", families=i) for i in range(6)]
    assert states(spark, many, most=4) == {"x0": "active", "x1": "budget_omitted", "x2": "active", "x3": "budget_omitted", "x4": "active", "x5": "active"}
    profiles = [revision("p1", "retrieval_profile"), revision("p2", "retrieval_profile", slot="t")]
    assert states(spark, profiles) == {"p1": "conflict", "p2": "conflict"} and states(spark, profiles[:1]) == {"p1": "active"}


def test_settings_in_any_split(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(5), draw.randrange(9), draw.choice(["limit", "other", "plain"]), draw.choice([None, "1", "5", "10", "25"])) for _ in range(400)]
    want = {}
    for q in range(5):
        for key in ("limit", "other", "plain"):
            own = [(layer, v) for r, layer, k, v in rows if (r, k) == (q, key) and v is not None]
            if key == "limit":
                value = min(own, key=lambda x: (float(x[1]), x[0]))
                want[q, key] = (value[1], value[0])
            else:
                top = max(x[0] for x in own)
                want[q, key] = (min(v for layer, v in own if layer == top), top)
    for parts in (1, 3, 17):
        frame = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "request_id int, layer int, key string, value string").repartition(parts)
        assert {(r.request_id, r.key): (r.value, r.layer) for r in overlays.merged_settings(frame, ["limit"]).collect()} == want
    assert overlays.merged_settings(frame.filter(F.lit(False)), []).collect() == []
