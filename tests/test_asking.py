"""Weights by spelling, pins and answers against loops, with odd rows."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.functions import requests, tokens
from millrace.functions.tokens import IDENTIFIER, PARTS
from millrace.operators import asking, index, scorers

DULL = requests.GENERIC
ASKED = [
    ("a", "Fix QueryPlanner.run(plan) in src/app/query_plan.py, like `make_it` and pkg.mod.TestSet"), ("b", "queries are slow when HTTP2 streams close"), ("c", None), ("d", ""),
    ("e", "See lib/util.py or util.py: boxes, boxes!"), (None, "load_table fails"), ("f", "the code"), ("g", "x.y.z zz" + " load_table" * 3000),
]
DOCS = [
    (1, "def load_table(name): return QueryPlanner", "src/app/query_plan.py"), (2, "load_table load_table QueryPlanner.run", "lib/util.py"), (3, None, "old/lib/util.py"), (4, "", None),
    (5, "query query box stream HTTP2 HTTP2 close slowly", "a/util.py"), (6, "word " * 5000 + "load_table", "b/c/util.py"), (7, "make_it run make TestSet", "x/xutil.py"), (None, "load_table", "n/util.py"),
]


def normal(w):
    w = w.lower()
    if w.endswith("ies") and len(w) > 4:
        return w[:-3] + "y"
    return w[:-1] if w.endswith("s") and len(w) > 3 and not w.endswith(("ss", "us", "is")) else w


def expand(name):
    small = [p for p in re.findall(PARTS, name) if len(p) > 1]
    whole = [name] if len(small) > 1 or re.search("[A-Z]", name) else []
    return list(dict.fromkeys(whole + [normal(p) for p in small]))


def spelled(row):
    named = defaultdict(float)
    for n in [*row.symbols, *row.identifiers, *(p for d in row.dotted for p in d.split("."))]:
        named[n] = 3.0
    return named


def loop_terms(row):
    named, terms = spelled(row), defaultdict(float)
    for p in row.paths:
        named.update({w: 3.0 for w in re.findall(IDENTIFIER, p.rsplit("/", 1)[-1].split(".")[0])})
    for name, w in named.items():
        for at, t in enumerate(expand(name)):
            if at == 0 or t not in DULL:
                terms[t] = max(terms[t], w if at == 0 else w / 2)
    for c in row.concepts:
        terms[normal(c)] = max(terms[normal(c)], 1.0)
    return dict(terms)


def frames(spark):
    return spark.createDataFrame(ASKED, "id string, text string"), spark.createDataFrame(DOCS, "doc long, text string, path string")


def test_terms_and_names_weigh_by_spelling(spark):
    analysis = requests.analysed(frames(spark)[0], "text").cache()
    rows = {r.id: r for r in analysis.collect()}
    got, names = defaultdict(dict), defaultdict(dict)
    for r in asking.weighed_terms(analysis, "id").collect():
        assert r.term not in got[r.query_id]
        got[r.query_id][r.term] = r.w
    for r in asking.weighed_names(analysis, "id").collect():
        names[r.query_id][r.term] = r.w
    assert {k: v for k, v in got.items() if v} == {k: t for k, r in rows.items() if (t := loop_terms(r))}
    assert {k: v for k, v in names.items() if v} == {k: t for k, r in rows.items() if (t := {**{c: 1.0 for c in r.concepts}, **spelled(r)})}
    assert got["a"]["QueryPlanner"] == 3.0 and got["a"]["planner"] == 1.5 and got["a"]["plan"] == 1.5 and got["b"]["query"] == 1.0 and "test" not in got["a"]
    analysis.unpersist()


def test_pins_are_whole_or_last_steps_and_few(spark):
    asked, docs = frames(spark)
    analysis = requests.analysed(asked, "text")
    got = {(r.query_id, r.doc) for r in asking.pinned(analysis, "id", docs, "doc").collect()}
    assert got == {("a", 1), ("e", 2), ("e", 3)}  # five files end in util.py: too many; xutil.py is another name
    every = {(r.query_id, r.doc) for r in asking.pinned(analysis, "id", docs, "doc", 9).collect()}
    assert every - got == {("e", 5), ("e", 6), ("e", None)}


def loop_answers(analysis, docs, defining, keep, budget):
    counts = {d: Counter(re.findall(IDENTIFIER, t or "")) for d, t, _ in docs}
    post = {d: Counter() for d in counts}
    for d, c in counts.items():
        for name, n in c.items():
            for t in expand(name):
                post[d][t] += n
    n, length = len(docs), {d: sum(c.values()) for d, c in counts.items()}
    mean, distinct = sum(length.values()) / n, sum(len(p) for p in post.values()) / n
    df = Counter(t for p in post.values() for t in p)
    idf = lambda t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
    out = []
    for row in analysis:
        lists = [defaultdict(float) for _ in range(3)]
        for t, w in loop_terms(row).items():
            for d in (d for d in docs if d[0] is not None and post[d[0]][t]):
                d, tf = d[0], post[d[0]][t]
                lists[0][d] += w * idf(t) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[d] / mean))
                lists[1][d] += w * idf(t) ** 2 / (1 + math.log(1 + len(post[d]) / distinct))
        for name, w in spelled(row).items():
            held = [d for d in counts if counts[d][name] and (d, name) not in defining]
            for d in held:
                if d is not None:
                    lists[2][d] += w * (1 + math.log(counts[d][name])) / math.log(2 + len(held))
        fused, agree = defaultdict(float), Counter()
        for scores in lists:
            for rank, (d, _) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0])), 1):
                fused[d] += 1 / (20 + rank)
                agree[d] += 1
        pins = set()
        for p in row.paths:
            fits = {d for d, _, path in docs if path and (path == p or path.endswith("/" + p))}
            pins |= fits - {None} if len(fits) <= 3 else set()
        order = sorted({*fused, *pins}, key=lambda d: (d not in pins, -round(fused[d], 9), d))[:keep]
        spent = 0
        for rank, d in enumerate(order, 1):
            size = -(-len(next(t or "" for k, t, _ in docs if k == d)) // 4)
            spent += size
            out.append((row.id, d, rank, round(fused[d], 6), agree[d], d in pins, size, spent <= budget))
    return out


def test_answers_are_those_of_a_loop(spark):
    asked, docs = frames(spark)
    defining = [(1, "load_table"), (1, "load_table"), (7, "make_it")]
    analysis = requests.analysed(asked.filter("id is not null"), "text").collect()
    got = asking.answered(asked, "id", docs, "doc", paths=docs.select("doc", "path"), defining=spark.createDataFrame(defining, "doc long, term string"), change={"keep": 4}, budget=30)
    mine = sorted((r.query_id, r.doc, r["rank"], round(r.score, 6), r.agree, r.pinned, r.tokens, r.delivered) for r in got.collect())
    assert mine == sorted(loop_answers(analysis, [d for d in DOCS if d[0] is not None], set(defining), 4, 30))
    assert {r[0] for r in mine} == {"a", "b", "e", "g"} and any(not r[7] for r in mine) and any(r[5] and r[4] == 0 for r in mine)


def test_nothing_asked_or_nothing_there(spark):
    asked, docs = frames(spark)
    assert asking.answered(asked.limit(0), "id", docs, "doc").count() == 0
    assert asking.answered(asked, "id", docs.limit(0), "doc", paths=docs.limit(0)).count() == 0
    names = spark.createDataFrame([("q", "it", 3.0)], "query_id string, term string, w double")
    held = spark.createDataFrame([(1, "it", 2), (2, "it", 1)], "doc long, term string, tf long")
    got = {r.doc for r in scorers.references(names, held, "doc", held.filter("doc = 1").select("doc", "term")).collect()}
    assert got == {2}


def test_only_what_is_asked_is_written(spark, monkeypatch):
    docs = [(d, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}_{d}" for i in range(300)) + " load_table queries" * (1 + d % 3)) for d in range(20)]
    rows, write = {}, asking.written

    def counted(frame, label):
        out = write(frame, label)
        rows[label] = out.count()
        return out

    for module in (asking, index, scorers):
        monkeypatch.setattr(module, "written", counted, raising=False)
    asked = spark.createDataFrame([("a", "load_table fails"), ("b", "slow queries")], "id string, text string")
    got = asking.answered(asked, "id", spark.createDataFrame(docs, "doc long, text string"), "doc").collect()
    assert Counter(r.query_id for r in got) == {"a": 10, "b": 10}
    assert max(rows.values()) <= 20 * 6, rows  # of 300 names and 900 terms in a document: asked terms and names, and one row for the others


def test_scorers_that_are_summed_together_are_those_alone(spark):
    docs = [(d, f"alpha {'beta ' * (d % 4)}gamma{d % 3} boxes HTTP2 load_table" if d % 5 else None) for d in range(40)] + [(3, "alpha alpha delta")]
    terms = spark.createDataFrame([(q, t, w) for q in range(3) for t, w in (("alpha", 1.0), ("beta", 1.5 + q), ("gamma", 3.0), ("box", 0.5), ("HTTP2", 3.0), ("nowhere", 1.0))], "query_id long, term string, w double")
    frame = spark.createDataFrame(docs, "doc long, text string")
    postings, counts, facts = index.asked_index(frame, "doc", "text", terms, spark.createDataFrame([("boxes",), ("load_table",)], "term string"))
    every = index.identifier_postings(frame, "doc", "text")
    plain = lambda f: sorted(tuple(r) for r in f.collect())
    assert plain(postings) == plain(every.join(terms.select("term").distinct(), "term", "left_semi").select("doc", "term", "tf"))
    assert plain(counts) == plain(index.identifier_counts(frame, "doc", "text").filter("id in ('boxes', 'load_table')"))
    distinct = Counter(r.doc for r in every.collect())
    assert plain(facts.select("doc", "len", "distinct_terms", "chars")) == sorted((d, len(re.findall(IDENTIFIER, t or "")), distinct[d], len(t or "")) for d, t in docs)
    got = scorers.voted(["bm25", "rare"], terms, postings, "doc", facts, 7)
    for name, alone in (("bm25", scorers.bm25), ("rare", scorers.rare_terms)):
        mine = plain(got.filter(F.col("source") == name).select("query_id", "doc", "score", "rank"))
        assert mine == plain(scorers.ranked(alone(terms, every, "doc", facts=facts), "doc", 7).select("query_id", "doc", "score", "rank"))
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc#", got._jdf.queryExecution().executedPlan().toString())


def test_identifiers_in_steps_expand_as_at_once(spark):
    odd = "word words ss bus ies flies a1 ab12cd _ __ _a a_b foo_foo foo_foos HTTPServer HTTP2 iOS xX AbcDef abc_def1 queries A_B is boxes x1y2".split()
    counts = spark.createDataFrame([(k, w, 2) for k in (1, 2) for w in odd], "doc long, id string, n long")
    want = Counter()
    for w in odd:
        want.update({t: 2 for t in expand(w)})
    assert {(r.doc, r.term): r.tf for r in index.expanded(counts, "doc").collect()} == {(k, t): n for k in (1, 2) for t, n in want.items()}
    assert {r.id: r.t for r in counts.select("id", tokens.expand(F.col("id")).alias("t")).collect()} == {w: expand(w) for w in odd}
