"""Operators against loops on made-up rows, and on empty tables, nulls, ties and repeats."""

import math
import random

import pytest

from millrace.operators import budgets, evidence, graph, metrics, packets, resolve, state, statistics


def test_packet_choice_against_a_loop(spark):
    rng, rows = random.Random(5), []
    for q in range(30):
        rows += [(q, 1000 * q + r, r, rng.random() < 0.5, rng.choice([None, "a", "b", "c", "d", "e"])) for r in range(1, rng.randint(2, 20))]
    got = packets.chosen_files(spark.createDataFrame(rows, "query_id int, doc_id bigint, rank int, limited boolean, content string"), "doc_id", 6, 2)
    want = {}
    for q in range(30):
        chosen, held, seen, limited = 0, [], set(), 0
        for _, doc, _, lim, content in sorted((r for r in rows if r[0] == q), key=lambda r: r[2]):
            if chosen >= 6:
                want[doc] = "file limit"
            elif content is not None and content in seen:
                held.append((doc, "held: same content"))
            elif lim and limited >= 2:
                held.append((doc, "held: share"))
            else:
                chosen, limited, want[doc] = chosen + 1, limited + lim, "chosen"
                seen |= {content} - {None}
        for i, (doc, why) in enumerate(held):
            want[doc] = "refilled" if i < 6 - chosen else why
    assert {r.doc_id: r.state for r in got.collect()} == want


def test_running_sums_and_medians_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.choice([1, 2, 2, 5, 9])) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, i int, v int")
    used, want = {}, {}
    for g, i, v in rows:
        used[g] = used.get(g, 0) + v
        want[i] = used[g]
    assert {r.i: r.used for r in packets.prefix_sums(frame, "g", "i", "v").collect()} == want
    values = {g: sorted(v for h, _, v in rows if h == g) for g in {r[0] for r in rows}}
    middle = {g: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 for g, x in values.items()}
    assert {r.g: r["median"] for r in statistics.median(frame, "g", "v").collect()} == middle
    assert {r.g: r.upper_median for r in statistics.upper_median(frame, "g", "v").collect()} == {g: x[len(x) // 2] for g, x in values.items()}
    assert {r.g: r.at for r in statistics.nearest_rank(frame, "g", "v", 0.9).collect()} == {g: x[math.ceil(0.9 * len(x)) - 1] for g, x in values.items()}
    places = {r.i: r.place for r in statistics.numbered(frame.drop("g").withColumnRenamed("i", "k"), "k").selectExpr("k as i", "i as place").collect()}
    assert places == {i: i for i in range(500)}


def test_tie_bands_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(g, k, rng.choice([100.0, 97.0, 95.0, 94.0, 90.0, 50.0, 0.0])) for g in range(20) for k in range(rng.randint(1, 15))]
    got = budgets.tie_bands(spark.createDataFrame(rows, "g int, k int, s double"), "g", "k", "s", 0.05)
    want = {}
    for g in range(20):
        leader, band = None, 0
        for _, k, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if leader is None or s < leader * 0.95:
                leader, band = s, band + 1
            want[g, k] = band
    assert {(r.g, r.k): r.band for r in got.collect()} == want


def test_spans_against_pairs(spark):
    rng = random.Random(3)
    spans = [(rng.randint(0, 9), lo := rng.randint(0, 20), lo + rng.randint(0, 8)) for _ in range(200)]
    got = resolve.contained(spark.createDataFrame(spans, "f int, lo int, hi int"), "f").collect()
    every = set(spans)
    want = {s for s in every if not any(o != s and o[0] == s[0] and o[1] <= s[1] and o[2] >= s[2] for o in every)}
    assert sorted(map(tuple, got)) == sorted(want)


def test_sign_test_is_exact(spark):
    for wins, losses in ((0, 0), (3, 0), (7, 2), (40, 60)):
        pairs = spark.createDataFrame([(1.0, 0.0)] * wins + [(0.0, 1.0)] * losses + [(1.0, 1.0)], "a double, b double")
        got, m = metrics.sign_test(pairs).first(), wins + losses
        if not m:
            assert got.sign_p is None and got.low is None
        else:
            assert got.sign_p == pytest.approx(min(1, 2 * sum(math.comb(m, k) for k in range(min(wins, losses) + 1)) / 2**m))


def test_metrics_of_a_known_list(spark):
    ranked = spark.createDataFrame([("s", 1, k, r) for r, k in enumerate(["a", "t1", "b", "c", "t2"], 1)], "source string, query_id int, k string, rank int")
    targets = spark.createDataFrame([(1, "t1"), (1, "t2"), (1, "missing"), (2, "t1"), (1, "t1")], "query_id int, k string")
    got = {r.query_id: r for r in metrics.per_query(ranked, targets, "k", ["s"], [1, 3, 5]).collect()}
    assert [got[1].recall_1, got[1].recall_3, got[1].recall_5] == pytest.approx([0, 1 / 3, 2 / 3])
    assert (got[1].mrr, got[1].map, got[1].hit_1, got[1].all_5) == pytest.approx((0.5, (1 / 2 + 2 / 5) / 3, 0, 0))
    assert (got[2].mrr, got[2].recall_5) == (0, 0)


def test_last_correction_counts(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "event_id int, path string")
    fixes = spark.createDataFrame([(1, "a", "irrelevant", 1), (1, "b", "irrelevant", 1), (1, "b", "relevant", 2), (3, "z", "relevant", 1)], "event_id int, path string, verdict string, id int")
    assert sorted((r.event_id, r.path or "") for r in state.corrected(rows, fixes).collect()) == [(1, "b"), (2, ""), (3, "z")]


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    queries, texts = none("query_id int, term string, w double"), none("k int, field string, weight double, bulk boolean, text string")
    frames = [
        evidence.path_evidence(queries, none("k int, stem string, stem_tokens array<string>, directory_tokens array<string>"), "k"),
        evidence.multi_field(queries, texts, "k"),
        evidence.similar_tasks(queries, none("event_id int, term string, tf int"), 0.1),
        packets.prefix_sums(none("g string, i int, v int"), "g", "i", "v"),
        statistics.median(none("g string, v int"), "g", "v"),
        resolve.modules(none("spec string"), none("path int, module string")),
        metrics.block_bootstrap(none("block int, a double, b double"), 5),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_paths_without_host_or_tokens(spark):
    paths = spark.createDataFrame([(1, None, None, None), (2, "enginecore", ["enginecore"], ["src"]), (3, "eng", [], ["engine"])], "k int, stem string, stem_tokens array<string>, directory_tokens array<string>")
    asked = spark.createDataFrame([(9, "engine", 1.0)], "query_id int, term string, w double")
    got = {r.k: r.score for r in evidence.path_evidence(asked, paths, "k").collect()}
    rarity = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got == pytest.approx({2: 0.5 * rarity, 3: 1.0 * rarity})


def test_closure_reaches_all_steps(spark):
    rows = [("chain", k, k - 1 if k else None, k == 0) for k in range(30)] + [("ring", k, (k + 1) % 20, k == 7) for k in range(20)] + [("gap", 1, 99, None)]
    got = {(r.g, r.name): (r.dependencies, r.broken) for r in graph.closure(spark.createDataFrame(rows, "g string, name long, needs long, bad boolean"), "g", "name", "needs", "bad").collect()}
    assert got == {("chain", k): (k, True) for k in range(30)} | {("ring", k): (19, True) for k in range(20)} | {("gap", 1): (0, False)}
