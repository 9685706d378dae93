"""Results that hold whatever the order, number or likeness of rows is, and work that grows no faster than they do."""

import random

from pyspark.sql import functions as F

from millrace.operators import choices, evidence, graph, inspection, lineage, packets, resolve, scorers
from millrace.sources import records, tables


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_blocks_that_are_dealt_anew_on_each_reading(spark):
    @F.udf("string")
    def dealt(key):
        paths = [f"p{(key * 7 + i) % 50}" for i in range(6)]
        random.SystemRandom().shuffle(paths)
        return f"{key}\n\n" + "\n".join(paths)

    blocks = spark.range(200).select(dealt.asNondeterministic()("id").alias("block"))
    universe = spark.range(50).select(F.concat(F.lit("p"), "id").alias("path"))
    got = {r.stamp: r.paths for r in records.commit_paths(blocks, universe, 6).collect()}
    assert got == {k: sorted(f"p{(k * 7 + i) % 50}" for i in range(6)) for k in range(200)}
    assert records.commit_paths(blocks, universe, 5).isEmpty()


def test_bindings_make_no_pairs_and_share_a_key_among_tasks(spark):
    ops = [(i, float(i % 97) if i % 13 else None, "k" if i % 5 else None) for i in range(400)] + [(7, 96.0, "k"), (None, 0.0, "k"), (900, 1e9, "k"), (901, 3.0, "other")]
    held = [(f"s{i}", i % 4 if i % 11 else None, float(i % 89) if i % 17 else None, "k" if i % 7 else None) for i in range(300)]
    frames = spark.createDataFrame(ops, "operation long, needs double, key string"), spark.createDataFrame(held, "instance string, health int, access double, key string")
    first = lambda h: ((h[1] is not None, h[1] or 0), h[0])
    best = {}
    for o, needs, key in ops:
        fits = [h for h in held if None not in (o, needs, key, h[2]) and h[3] == key and h[2] >= needs]
        best[o] = min([*fits, *([best[o]] if best.get(o) else [])], key=first, default=None)
    want = sorted(((o, *(best[o][:2] if best[o] else (None, None))) for o, *_ in ops), key=repr)
    for parts in (1, 7):
        got = resolve.bound(*frames, ["key"], parts)
        assert rows_of(got) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "(access" not in got._jdf.queryExecution().toString()


def test_walks_read_the_scores_once_in_an_iteration(spark, monkeypatch):
    joins, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda f, label: joins.append((label, f._jdf.queryExecution().optimizedPlan().toString().count("Join "))) or write(f, label))
    pairs = sorted({(f"n{i % 9}", f"m{i * 5 % 7}") for i in range(40)})
    seeds = ["n1", "m3", "alone"]
    got = {r.node: r.score for r in graph.personalised_pagerank(spark.createDataFrame([(s,) for s in seeds], "node string"), spark.createDataFrame(pairs, "a string, b string"), 8).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = {s: 1 / 3 for s in seeds}
    for _ in range(8):
        new = {}
        for node, s in score.items():
            for other in near.get(node, ()):
                new[other] = new.get(other, 0.0) + 0.75 * s / len(near[node])
        kept = sum(new.values())
        score = {k: new.get(k, 0.0) + (1 - kept) / 3 * (k in seeds) for k in {*new, *seeds}}
    assert got.keys() == score.keys() and all(abs(got[k] - score[k]) < 1e-12 for k in score)
    assert max(n for label, n in joins if label == "scores") <= 8


def test_best_paths_are_those_of_all_evidence(spark):
    rows = [(i, f"stem{i % 3}", [f"stem{i % 3}", "com"], [("en", "fr")[i % 2], str(i // 2)]) for i in range(60)] + [(99, None, None, [])]
    paths = spark.createDataFrame(rows, "id long, stem string, stem_tokens array<string>, directory_tokens array<string>")
    asked = [(q, t, w) for q in range(12) for t, w in (("en", 1.0), ("stem1", 1.0 + q % 2), ("stem", 1.0), (str(q), 0.5), ("nowhere", 1.0))]
    queries = spark.createDataFrame(asked, "query_id long, term string, w double")
    every = rows_of(scorers.ranked(evidence.path_evidence(queries, paths, "id"), "id", 7))
    for few in (0, 2, 8, 1000):
        assert rows_of(scorers.ranked(evidence.best_paths(queries, paths, "id", 7, few=few), "id", 7)) == every
    many = evidence.best_paths(queries, paths, "id", 7, few=2)
    assert many.count() < evidence.path_evidence(queries, paths, "id").count()


def test_best_paths_make_no_pairs_of_classes(spark):
    store = spark._jsparkSession.sharedState().statusStore()

    def most_rows(since):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        most, runs = 0, store.executionsList()
        for run in (runs.apply(i).executionId() for i in range(runs.size())):
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size() if run > since else 0)):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
        return most, max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)

    rows = [(i, "www", ["www", "com"], [f"w{a}", f"w{b}"]) for i, (a, b) in enumerate((a, b) for a in range(36) for b in range(a))]
    rows += [(1000 + i, f"shop-{i}", [f"shop-{i}"], ["www"] + [f"d{j}" for j in range(9)]) for i in range(30)]
    paths = spark.createDataFrame(rows, "id long, stem string, stem_tokens array<string>, directory_tokens array<string>")
    asked = [(i, t, w) for i, stem, _, dirs in rows for t, w in ((stem, 1.0), (stem, 0.5), (stem[:6], 1.0), *((d, 1.0) for d in dirs))]
    queries = spark.createDataFrame(asked, "query_id long, term string, w double")
    began = most_rows(1 << 60)[1]
    got = rows_of(scorers.ranked(evidence.best_paths(queries, paths, "id", 5, few=5), "id", 5))
    made = most_rows(began)[0]
    assert got == rows_of(scorers.ranked(evidence.path_evidence(queries, paths, "id"), "id", 5))
    assert 0 < made < 50_000, made  # classes that met one by one: some 400,000 pairs


def test_texts_are_read_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        met.add(1)
        return x

    f = spark.range(20).withColumn("n", (F.col("id") % 3).cast("int"))
    no = F.lit(False)
    score = choices.additive(no, no, counted.asNondeterministic()("n"), F.lit("source"), no, F.col("id") == 0)
    got = {r.id: r.score for r in f.select("id", score.alias("score")).collect()}
    assert got == {i: (1 if i == 0 else None, 1, 2)[i % 3] if i % 3 or i == 0 else None for i in range(20)} and met.value == 20


def test_sums_of_several_sizes_are_dealt_once(spark, monkeypatch):
    labels, write = [], packets.written
    monkeypatch.setattr(packets, "written", lambda f, label: labels.append(label) or write(f, label))
    f = spark.createDataFrame([("a" if i % 3 else None, i, i % 4, 1) for i in range(50)], "g string, o int, s int, one int")
    got = rows_of(packets.running_sums(f, "g", "o", {"used": "s", "place": "one"}, 5).select("o", "used", "place"))
    same = lambda i: [k for k in range(i + 1) if bool(k % 3) == bool(i % 3)]
    assert got == sorted(((i, sum(k % 4 for k in same(i)), len(same(i))) for i in range(50)), key=repr) and labels == ["ranges"]


def test_partitions_follow_rows_and_settings_come_back(spark):
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    with tables.wide(spark, tables.ROWS_EACH * 20):
        assert spark.conf.get(name) == "20"
    with tables.wide(spark, 3), tables.shuffled(spark):
        assert spark.conf.get(name) == was and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert spark.conf.get(name) == was and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_claims_without_names_and_empty_tables(spark):
    claims = spark.createDataFrame([(1, "A.f()"), (1, "f"), (1, "g"), (1, None), (None, "f"), (2, "h")], "path int, symbol string")
    known = spark.createDataFrame([(1, "f"), (1, None), (None, "f"), (3, "h")], "path int, name string")
    assert rows_of(inspection.known_symbols(claims, known)) == [(1, 1, 2), (2, 0, 1), (None, 0, 1)]
    assert inspection.known_symbols(claims.limit(0), known).isEmpty()


def test_walks_of_paths_double_in_each_join(spark, monkeypatch):
    calls, write = [], lineage.written
    monkeypatch.setattr(lineage, "written", lambda f, label: calls.append(label) or write(f, label))
    draw = random.Random(9)
    rows = [(f"p{draw.randrange(90)}", f"p{draw.randrange(90)}", draw.choice("RRRRRC"), draw.choice([None, 90, 60, 49])) for _ in range(80)]
    rows += [(f"q{i + 1}", f"q{i}", "R", None) for i in range(20)] + [(f"c{(i + 1) % 6}", f"c{i}", "R", 70) for i in range(6)] + [("c2", "into", "R", 99), ("in place", None, "R", None)]
    current = ["q14", *[f"p{i}" for i in range(0, 90, 5)]]
    moves, past = {}, set()
    for path, source, kind, score in rows:
        past |= {path, source} - {None}
        if source:
            moves.setdefault(source, []).append((path, kind, 100 if score is None else score))

    def walked(path, hops):
        seen = [path]
        for _ in range(hops):
            step = moves.get(seen[-1])
            if not step:
                return None, "unresolved"
            target = step[0][0]
            if any(p != target or k == "C" or s < 50 for p, k, s in step) or target in seen:
                return None, "ambiguous"
            if target in current:
                return target, "supported_rename"
            seen.append(target)
        return None, "unresolved"

    frames = spark.createDataFrame(rows, "path string, source string, kind string, score int"), spark.createDataFrame([(c,) for c in current], "path string")
    for hops in (1, 3, 5, 6, 7, 8, 11):
        calls.clear()
        got = rows_of(lineage.lineage(*frames, hops))
        assert got == sorted(((p, *walked(p, hops)) for p in past - set(current)), key=repr)
        assert len(calls) <= 2 + 2 * hops.bit_length()
