"""Named paths and phrases, rankings that answers and outsiders join, stored records, against loops and on odd rows."""

import random
import re

import pytest

from millrace.operators import graph, inspection, records
from millrace.operators.packets import known_before
from millrace.operators.statistics import bootstrap
from millrace.plans import registry
from millrace.sources.records import commit_changes


def named(text, path, project):
    """The line of the earliest mention, None without one; no mention raises."""
    found = []
    for form in (path, "./" + path, project + "/" + path):
        for m in re.finditer(re.escape(form), text or ""):
            before, after = text[: m.start()][-1:], text[m.end() :]
            ends = after[:1] == "." and (len(after) == 1 or after[1].isspace())
            if (before.isalnum() or before in tuple("_./@~-")) or not (ends or not after or not (after[0].isalnum() or after[0] in "_./@~-")):
                continue
            line = re.match(r"(?::|#L)([1-9][0-9]{0,7})(?![0-9])", after)
            found.append((m.start(), int(line[1]) if line else None))
    return min(found, key=lambda f: f[0])[1]


def test_explicit_paths_against_loops(spark):
    paths = ["a.py", "src/a.py", "my dir/b c.txt", "w(x)/y.js", "é/ü.py", r"odd\E+.md", "a.p", "Makefile"]
    texts = ["", None, "fix a.py", "see ./a.py:12 and a.py:3", "src/a.py.", "in my dir/b c.txt#L7, ok", "xa.py a.pyc", "/p/src/a.py:0", "/q/src/a.py", "w(x)/y.js!", "é/ü.py:123456789", r"odd\E+.md:5", "a.p. a.py..", "Makefile.\nMakefile:4", "-a.py (a.py)", "x " * 20000 + "src/a.py:99"]
    tasks = spark.createDataFrame(list(enumerate(texts)), "task_id long, text string")
    got = {(r.task_id, r.path): r.line for r in inspection.explicit_paths(tasks, spark.createDataFrame([(p,) for p in paths * 2], "path string"), "/p").collect()}
    want = {}
    for i, text in enumerate(texts):
        for path in paths:
            try:
                want[i, path] = named(text, path, "/p")
            except ValueError:
                pass
    assert got == want
    assert len(want) > 10


@pytest.mark.parametrize("block", [1, 256])
def test_phrases_against_loops(spark, block):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("aa", "b", "ccc", "d.", "")) for _ in range(n)) for n in (0, 1, 5, 40, 40, 3000)] + [None]
    phrases = ["aa", "b", "a b", "aa b ccc", "c d. aa", " ", "", None, "b  b", "ccc d. aa b", "none such words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")
    got = sorted(map(tuple, inspection.phrase_hits(docs, "doc_id", asked, block).collect()))
    assert got == sorted((j, i) for j, p in enumerate(phrases) for i, t in enumerate(texts) if p and t and p in t)


def test_short_terms(spark):
    rows = ["Why does (FastAPI) fail with c++ and x@y.z, /etc/passwd 12345 a1b2c; redis redis?", None, "", "sk-abcdefghijklmnopqrstuv ok go", " ".join(f"w{c}w" for c in "abcdefghijkl")]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    got = {r.i: (r.t.terms, r.t.dropped) for r in frame.select("i", inspection.short_terms(frame.text).alias("t")).collect()}
    assert got == {0: ("does fastapi fail c++ a1b2c redis", 3), 1: ("", 0), 2: ("", 0), 3: ("ok go", 1), 4: (" ".join(f"w{c}w" for c in "abcdefgh"), 0)}


def test_integration_and_insertion(spark):
    ranked = spark.createDataFrame([("q", k, i, k == "c") for i, k in enumerate("abcde", 1)], "query_id string, path string, rank int, pinned boolean")
    outside = spark.createDataFrame([("q", "e", 1), ("q", "zz", 2), ("q", "c", 3), ("q", "b", 4), ("q", "e", 9)], "query_id string, path string, at int")
    order = lambda frame: [r.path for r in sorted(frame.collect(), key=lambda r: r.place)]
    assert order(inspection.integrated(ranked, outside, "path", "seeds")) == list("abcde")
    assert order(inspection.integrated(ranked, outside, "path", "replace")) == list("cebad")
    value = lambda k: 1 / (20 + "abcde".index(k) + 1) + (1 / (20 + "ecb".index(k) + 1) if k in "ecb" else 0)
    assert order(inspection.integrated(ranked, outside, "path", "weighted")) == ["c"] + sorted("abde", key=lambda k: -value(k))
    assert order(inspection.integrated(ranked, outside.limit(0), "path", "replace")) == list("cabde")
    with pytest.raises(ValueError):
        inspection.integrated(ranked, outside, "path", "other")
    found = spark.createDataFrame([("q", "b", 9.0), ("q", "e", 0.5), ("q", "new", 1.0)], "query_id string, path string, score double")
    assert order(inspection.inserted(ranked.drop("pinned"), found, 2, 3)) == ["a", "b", "new", "e", "c", "d"]


def test_records_on_odd_rows(spark):
    stored = spark.createDataFrame([(1, 5, "x"), (2, 50, "y"), (None, 1, "z")], "id int, size int, text string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id int")
    assert {r.id: (r.state, r.text) for r in records.fetched(asked, stored, "id", "size", 10).collect()} == {1: ("read", "x"), 2: ("too large", None), 3: ("missing", None)}
    trials = spark.createDataFrame([(1, "new", "done", True), (2, "old", "done", False), (3, "new", "infrastructure_error", False), (4, "old", None, None)], "n int, arm string, status string, success boolean")
    for upto, want in ((3, [(True, False)]), (4, [])):
        rows = trials.filter(f"n <= {upto}").selectExpr("*", "'c' client", "'f' fixture", "1 repetition", "1.0 cost")
        assert [(r.candidate, r.incumbent) for r in records.paired_trials(rows, "n", "new", "old").collect()] == want
    assert records.paired_trials(rows.limit(0), "n", "new", "old").count() == 0
    old = spark.createDataFrame([("skills", "a", None, "verified"), ("tools", "b", "s", "missing"), ("tools", "c", None, "blocked"), ("mcps", "d", None, "exposed"), ("mcps", "e", None, "auth_required"), ("mcps", "f", None, None)], "list string, id string, server string, status string")
    new = records.upgraded(old)
    back = records.projected(new, new.filter("observation is not null").select("id", "observation.*"))
    assert {(r.list, r.id, r.status) for r in back.collect()} == {(r.list, r.id, r.status or "unknown") for r in old.collect()}


def test_commit_changes(spark):
    blocks = ["s1\x02100\x02Fix it\n\nM\ta\nR090\told\tb\nD\tgone", "s2\x02x\x02no time\nM\ta", "s3\x02200\x02none\n", "broken", "s4\x02 300\x02many\nM\ta\nM\ta\nA\tb\nA\tc\nC\ta\tzz", ""]
    frame, known = spark.createDataFrame([(b,) for b in blocks + [None]], "block string"), spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    got = {r.sha: (r.stamp, r.touched, r.capped, r.paths, [tuple(x) for x in r.renames]) for r in commit_changes(frame, known, 2).collect()}
    assert got == {"s1": (100, 2, False, ["a", "b"], [("old", "b", 90)]), "s3": (200, 0, False, [], []), "s4": (300, 3, True, ["a", "b"], [])}


def test_reached_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "b")], "a string, b string")
    assert {r.node for r in graph.reached(spark.createDataFrame([("a",), ("a",)], "node string"), edges).collect()} == {"b", "c", "d"}
    assert graph.reached(spark.createDataFrame([], "node string"), edges).count() == 0


def test_known_before_on_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 7}", i, None if i % 4 == 0 else rng.random()) for i in range(3000)]
    got = {r.i: (r.earlier, r.best_before) for r in known_before(spark.createDataFrame(rows, "g string, i long, v double"), "g", "i", "v", 8).collect()}
    seen, want = {}, {}
    for g, i, v in rows:
        n, best = seen.get(g, (0, None))
        want[i] = n, best
        seen[g] = n + 1, best if v is None else v if best is None else max(best, v)
    assert got == want


def test_bootstrap_by_broadcast_and_by_join(spark):
    pairs = spark.createDataFrame([(f"f{i}", i / 7, (i * 3 % 11) / 5) for i in range(60)], "family string, a double, b double")
    one, other = ({r.round_no: round(r["mean"], 9) for r in bootstrap(pairs, 20, n).collect()} for n in (1000, 10))
    assert one == other and len(one) == 20
    assert bootstrap(pairs.limit(0), 20).count() == 0


def test_requests_repeat_within_a_session(spark):
    rows = [(1, "s", "files", "a"), (2, "s", "files", "a"), (3, "t", "files", "a"), (4, "s", "shell", "a"), (5, None, "files", "a"), (6, None, "files", "a"), (7, "s", None, "a"), (8, "s", "files", None)]
    got = {r.n: r.state for r in inspection.answered(spark.createDataFrame(rows, "n int, session string, op string, value string"), "n").collect()}
    assert got == {1: "run", 2: "repeated", 3: "run", 4: "rejected", 5: "run", 6: "repeated", 7: "rejected", 8: "rejected"}


def test_each_query_here_has_sql():
    from millrace.plans import inspection as plans

    mine = [n for n, f in registry.QUERIES.items() if f.__module__ == plans.__name__]
    assert len(mine) > 20 and set(mine) <= set(registry.ORACLES)
