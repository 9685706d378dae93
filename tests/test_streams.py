"""Keyed streams give the rows of their batch queries for any split into files, over restarts, and with late and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import packets
from millrace.streaming import events, keyed

SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"


def rows_of(n=600, seed=1):
    draw = random.Random(seed)
    return [(i, None if i % 41 == 0 else 1 if i % 3 == 0 else draw.randrange(2, 12), None if i % 29 == 0 else draw.choice("abc"), None if i % 5 == 0 or i < 30 else float(draw.randrange(100)), None) for i in range(n)]


def put(spark, folder, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{number:03}/events.parquet")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*/events.parquet")


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def parts_of(rows, cuts):
    edges = [0, *cuts, len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("cuts, stop", [([300], 1), ([5, 17, 450, 599], 2)])
def test_working_memory_for_any_split(spark, tmp_path, cuts, stop):
    """Files in any order, a stop after some of them, and a new start from the checkpoint."""
    rows = rows_of()
    mixed = random.Random(3).sample(rows, len(rows))
    base = keyed.new_base(spark)
    for number, part in enumerate(parts_of(mixed, cuts)):
        put(spark, tmp_path, part, number)
        if number + 1 in (stop, len(cuts) + 1):
            made = keyed.working_memory(stream(spark, tmp_path), "user_id", "event_id", "event_type", 12)
            keyed.run_into(made, base, "update")
    got = keyed.latest(keyed.gathered(spark, base, made.schema), ["user_id", "event_type"])
    groups = {}
    for i, user, kind, _, _ in rows:
        groups.setdefault(user, []).append((i, kind))
    want = {}
    for user, own in groups.items():
        for place, (_, kind) in enumerate(sorted(own, reverse=True)):
            row = want.setdefault((user, kind), [0, 0])
            row[place >= 12] += 1
    assert sorted_rows(got) == sorted(((*k, *v) for k, v in want.items()), key=repr)


@pytest.mark.parametrize("cuts, stop", [([200, 201], 2), ([30, 100, 350], 1)])
def test_replay_over_a_restart(spark, tmp_path, cuts, stop):
    rows, draw = rows_of(), random.Random(5)
    base = keyed.new_base(spark)
    for number, part in enumerate(parts_of(rows, cuts)):
        put(spark, tmp_path, draw.sample(part, len(part)), number)
        if number + 1 in (stop, len(cuts) + 1):
            made = keyed.replay(stream(spark, tmp_path), "user_id", "event_id", "value")
            keyed.run_into(made, base, "append")
    got = keyed.gathered(spark, base, made.schema)
    batch = packets.known_before(spark.createDataFrame(rows, SCHEMA).select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    assert sorted_rows(got.select("event_id", "earlier", "best_before")) == sorted_rows(batch.select("event_id", "earlier", "best_before"))
    assert got.filter("late").count() == 0


def test_late_events_of_a_replay(spark, tmp_path):
    rows = rows_of(100)
    base = keyed.new_base(spark)
    put(spark, tmp_path, rows[50:], 0)
    put(spark, tmp_path, rows[:50], 1)
    put(spark, tmp_path, [(1000, 1, "a", 3.0, None)], 2)
    made = keyed.replay(stream(spark, tmp_path), "user_id", "event_id", "value")
    keyed.run_into(made, base, "append")
    got = {r.event_id: (r.earlier, r.late) for r in keyed.gathered(spark, base, made.schema).collect()}
    after = {r[1] for r in rows[50:]}
    assert all(got[r[0]] == ((None, True) if r[1] in after else got[r[0]]) for r in rows[:50]) and any(got[r[0]][1] for r in rows[:50])
    assert got[1000] == (sum(r[1] == 1 for r in rows[50:]), False)


def test_reviews_keep_their_place(spark, tmp_path):
    """Later files send some events again; a restart lies between; the mark starts past the first hundred."""
    rows = rows_of()
    base = keyed.new_base(spark)
    for number, (a, b) in enumerate([(0, 200), (150, 320), (300, 600)]):
        put(spark, tmp_path, rows[a:b], number)
        if number != 1:
            keyed.review_into(stream(spark, tmp_path), base, "event_id", "event_type", 99)
    want = {}
    for r in rows[100:]:
        want[r[2]] = want.get(r[2], 0) + 1
    assert {r.kind: r.unread for r in keyed.reviewed(spark, base).collect()} == want
    late = events.reviewed(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(99,)], "at long"), "event_id")
    assert late.count() == sum(want.values()) and late.agg(F.min("event_id")).first()[0] == 100
