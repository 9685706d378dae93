"""Rounds of requests against a loop over rankings, and answers whose join stays linear."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import inspection
from millrace.plans import exploration as plans

FOLDER = "/root/testdata/sf0.001"
SIZES = {"protected": 5, "shown": 8, "most_requests": 12, "most": 6, "enough": 0.9}


def loop(t, rounds, protected, shown, most_requests, most, enough):
    by = {}
    for q, p, r in t["ranked"]:
        by.setdefault(q, []).append((r, p))
    wanted, symbol, callers, near = {}, {}, {}, {}
    for q, n in t["wanted"]:
        wanted.setdefault(q, set()).add(n)
    for n, p in t["defined"]:
        symbol.setdefault(n, set()).add(p)
    for n, p, k in t["uses"]:
        callers.setdefault(n, set()).add((-k, p))
    for p, o in t["near"]:
        near.setdefault(p, set()).add(o)
    tests, out = {p for (p,) in t["tests"]}, []
    find = {"symbol": lambda v: sorted(symbol.get(v, ())), "callers": lambda v: [p for _, p in sorted(callers.get(v, ()))], "neighbors": lambda v: sorted(near.get(v, ()))}
    for q, ranks in by.items():
        ranked, said, below = [p for _, p in sorted(ranks)], {}, protected
        for number in range(1, rounds + 1):
            view, names = ranked[:shown], wanted.get(q, set())
            has = {n for n in names if symbol.get(n, set()) & set(view)}
            used = not names or any(p in view for n in names for _, p in callers.get(n, ()))
            sure = round(0.5 * (len(has) / len(names) if names else 1) + 0.5 * used, 2)
            if sure >= enough:
                break
            asked = [("symbol", n) for n in sorted(names - has, key=str)] + [("callers", n) for n in sorted(has, key=str) if not used]
            asked += [] if tests & set(view) else [("neighbors", view[0])]
            score = {}
            for place, (kind, value) in enumerate(asked[:most_requests], 1):
                for p in find[kind](value)[:most]:
                    score[p] = score.get(p, 0) + 1 / place
            best = sorted(score, key=lambda p: (-round(score[p], 9), p))[:most]
            fresh = [p for p in best if p not in view]
            if not fresh:
                break
            kept = [p for p in ranked if p not in fresh]
            ranked = kept[:below] + fresh + kept[below:]
            said |= dict.fromkeys(fresh, number)
            below += len(fresh)
        out += [(q, p, r, said.get(p)) for r, p in enumerate(ranked, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_rounds_against_a_loop(spark, rounds):
    tables = plans.given(spark, FOLDER)
    rows = {n: [tuple(r) for r in f.collect()] for n, f in tables.items()}
    rows["wanted"] = [r for r in rows["wanted"] if r[0] % 5]  # some want nothing
    tables["wanted"] = tables["wanted"].filter("query_id % 5 <> 0")
    got = inspection.explored(**tables, rounds=rounds, **SIZES)
    assert sorted((tuple(r) for r in got.select("query_id", "path", "rank", "round").collect()), key=repr) == loop(rows, rounds, **SIZES)
    assert inspection.explored(**{n: f.limit(0) for n, f in tables.items()}).collect() == []


def test_a_request_meets_no_more_than_it_keeps(spark):
    requests = spark.range(3000).selectExpr("id as query_id", "1L as position", "'symbol' as type", "'hot' as value")
    sources = spark.range(4000).selectExpr("'symbol' as type", "'hot' as value", "id as path")
    found = inspection.answers(requests, sources, 6)
    found.write.format("noop").mode("overwrite").save()
    assert found.count() == 18_000 and {r.path for r in found.collect()} == set(range(6))


def test_rounds_read_what_is_given_once(spark):
    met, tables = spark.sparkContext.accumulator(0), plans.given(spark, FOLDER)

    @F.udf("long")
    def counted(x):
        met.add(1)
        return x

    held = {"wanted": ("query_id", "name"), "uses": ("name", "path", "n"), "near": ("path", "other")}
    rows = sum(tables[n].count() for n in held)
    for n, (first, *others) in held.items():
        tables[n] = tables[n].select(counted.asNondeterministic()(first).alias(first), *others)
    assert inspection.explored(**tables, rounds=2, **SIZES).count() > 0 and met.value == rows
