"""Lineage of paths and hotspots against loops."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.operators import hotspots
from millrace.operators.lineage import lineage

CHANGES = "path string, source string, kind string, score int"


def followed(path, moves, current, hops=8):
    """Current path and label, hop by hop."""
    at, met = path, {path}
    for _ in range(hops):
        rows = moves.get(at, [])
        if not rows:
            return None, "unresolved"
        to = rows[0][0]
        if len({r[0] for r in rows}) > 1 or any(r[1] == "C" for r in rows) or min(100 if r[2] is None else r[2] for r in rows) < 50 or to in met:
            return None, "ambiguous"
        if to in current:
            return to, "supported_rename"
        at = to
        met.add(to)
    return None, "unresolved"


def test_lineage_against_a_loop(spark):
    draw = random.Random(3)
    rows = [(f"p{draw.randrange(400)}", f"p{draw.randrange(400)}", draw.choice("RRRRRRRRCM"), draw.choice([None, 100, 80, 50, 49, 90])) for _ in range(260)]
    rows += [(f"q{i + 1}", f"q{i}", "R", 100) for i in range(12)]  # longer than the hops
    rows += [("hub", f"h{i}", "R", 90) for i in range(1500)] + [("kept", "hub", "R", None)]  # a hot key
    rows += [(None, "x", "R", 100), ("y", None, "R", 100), ("z", "z", "R", 100), (None, None, None, None), ("in place", "other", None, 1)] + rows[:30]
    current = ["kept", "q12", None, "kept", *[f"p{i}" for i in range(0, 400, 7)]]
    moves, past = defaultdict(list), set()
    for path, source, kind, score in rows:
        if path is not None:
            past.add(path)
        if kind in ("R", "C") and path is not None and source is not None:
            moves[source].append((path, kind, score))
            past.add(source)
    want = {p: followed(p, moves, set(current)) for p in past - set(current)}
    frame, now = spark.createDataFrame(rows, CHANGES), spark.createDataFrame([(c,) for c in current], "path string")
    got = [(r.path, (r.current, r.label)) for r in lineage(frame, now).collect()]
    assert len(got) == len(want) and dict(got) == want and {v[1] for v in want.values()} == {"unresolved", "ambiguous", "supported_rename"}
    assert want["q3"] == (None, "unresolved") and want["q4"] == ("q12", "supported_rename") and want["h7"] == ("kept", "supported_rename")
    assert lineage(frame.limit(0), now).collect() == []


def history(seed):
    draw = random.Random(seed)
    commits = [(i, i, draw.random() < 0.3, draw.random() < 0.1, draw.random() < 0.1, draw.random() < 0.1) for i in range(60)]
    touches = [(i, f"d{draw.randrange(3)}/p{draw.randrange(8)}") for i in range(60) for _ in range(draw.randrange(1, 6))]
    touches += [(59, f"wide/p{i}") for i in range(40)] + [(58, "d0/p0")] * 3 + [(None, "d0/p0"), (1, None), (999, "d0/p1")]
    refs = [(i, f"r{draw.randrange(9)}") for i in range(60) if draw.random() < 0.5]
    symbols = [(i, p, f"s{draw.randrange(6)}") for i, p in touches if i is not None and p is not None and draw.random() < 0.6]
    return commits, touches, refs, symbols


def looped(commits, touches, refs, symbols):
    """path -> counts, recency and penalty."""
    paths = defaultdict(set)
    for i, p in touches:
        if i is not None and p is not None and i < 60:
            paths[i].add(p)
    edits, fixes, released, recency, incidents, seen, together = Counter(), Counter(), Counter(), {}, defaultdict(set), defaultdict(set), Counter()
    for i, place, fix, release, bulk, merge in commits:
        if merge:
            continue
        for c, p, s in symbols:
            if c == i:
                seen[p].add(s)
        bulk = bulk or len(paths[i]) > hotspots.MOST_PATHS
        for p in paths[i]:
            released[p] += bulk or release
            if not bulk:
                edits[p] += 1
                fixes[p] += fix
                recency[p] = max(recency.get(p, 0), 1 - place / len(commits))
                incidents[p] |= {r for c, r in refs if c == i}
                together.update((p, q) for q in paths[i] if q != p)
    partners = Counter(p for (p, _), n in together.items() if n >= 2)
    counts = {"edits": edits, "fixes": fixes, "incidents": {p: len(v) for p, v in incidents.items()}, "symbols": {p: len(v) for p, v in seen.items()}, "partners": partners}
    return edits, recency, released, counts


def test_hotspots_against_a_loop(spark):
    for seed in (1, 2):
        commits, touches, refs, symbols = history(seed)
        edits, recency, released, counts = looped(commits, touches, refs, symbols)
        tops = {c: max((math.log1p(n) for p, n in own.items() if p in edits), default=0) for c, own in counts.items()}
        frames = [
            spark.createDataFrame(touches, "commit int, path string"),
            spark.createDataFrame(commits, "commit int, place int, fix boolean, release boolean, bulk boolean, merge boolean"),
            spark.createDataFrame(refs + refs[:5], "commit int, ref string"),
        ]
        for known in (spark.createDataFrame(symbols, "commit int, path string, symbol string"), None):
            got = {r.path: r for r in hotspots.features(*frames, known).collect()}
            assert set(got) == set(edits)
            for p, r in got.items():
                own = {c: round(recency[p] if c == "recency" else math.log1p(counts[c].get(p, 0)) / tops[c] if tops[c] else 0.0, 4) for c in hotspots.WEIGHTS if c != "symbols" or known is not None}
                assert all(abs(r[c] - v) < 1.01e-4 for c, v in own.items())
                penalty = released[p] / (edits[p] + released[p])
                score = sum(hotspots.WEIGHTS[c] * v for c, v in own.items()) / sum(hotspots.WEIGHTS[c] for c in own) - penalty * 0.5
                assert abs(r.score - score) < 3e-4 and abs(r.penalty - penalty) < 1e-4
                assert r.reasons.split(",") == sorted(own, key=lambda c: (-hotspots.WEIGHTS[c] * r[c], list(own).index(c)))[:2]
        assert hotspots.features(*[f.limit(0) for f in frames]).collect() == []


def test_choice_of_hotspots_against_a_loop(spark):
    draw = random.Random(5)
    for n in (3, 40, 400):
        paths = [f"{draw.choice(['a', 'b/c', 'd'])}/p{i}" for i in range(n)] + [f"m{i}/only" for i in range(4)] + ["bare"]
        scores = [(p, draw.randrange(5) / 4) for p in paths if draw.random() < 0.8]
        degrees = [(p, draw.randrange(4)) for p in paths]
        target = min(200, max(1, math.ceil(len(paths) * 15 / 100)))
        cap, used, want = max(2, math.ceil(target * 3 / 10)), Counter(), {}
        ordered = sorted(scores, key=lambda r: (-r[1], r[0]))
        for p, s in ordered:
            folder = p.rpartition("/")[0]
            if len(want) < target and used[folder] < cap:
                used[folder] += 1
                want[p] = (s, "ranked")
        for p, _ in sorted((r for r in degrees if r[1] > 0 and r[0] not in want), key=lambda r: (-r[1], r[0]))[: max(1, math.ceil(target / 10))]:
            want[p] = (0.0, "in_degree")
        covered = {p.split("/")[0] for p in want if "/" in p}
        for p, s in ordered:
            if "/" in p and p.split("/")[0] not in covered and p not in want:
                want[p] = (s, "module")
                covered.add(p.split("/")[0])
        rows, linked = spark.createDataFrame(scores, "path string, score double"), spark.createDataFrame(degrees, "path string, degree int")
        got = {r.path: (r.score, r.why) for r in hotspots.chosen(rows, spark.createDataFrame([(p,) for p in paths], "path string"), linked).collect()}
        assert got == want
    assert hotspots.chosen(rows.limit(0), linked.select("path").limit(0), linked.filter(F.lit(False))).collect() == []
