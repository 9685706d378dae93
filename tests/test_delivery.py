"""Packets with reserves and least deliveries against a loop that takes part after part."""

import random

import pytest

from millrace.operators import packets


def loop(rows, budget, classes):
    out = {}
    for packet in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == packet]
        room = budget - sum(r[3] or 0 for r in own if r[4])
        out |= {(packet, r[2]): "minimum" if room < 0 else "protected" for r in own if r[4]}
        out |= {(packet, r[2]): "omitted" for r in own if not r[4]}
        reserved = spent = 0
        for kind, share, least in classes if room >= 0 else ():
            reserved += int(share * room)
            free, left, used = reserved - spent, room - spent, 0
            for place, r in enumerate(sorted((r for r in own if r[1] == kind and not r[4]), key=lambda r: r[2]), 1):
                used += r[3] or 0
                if not (used <= free or (place <= least and used <= left)):
                    used -= r[3] or 0
                    break
                out[packet, r[2]] = "delivered"
            spent += used
    return out


@pytest.mark.parametrize("seed, budget", [(1, 60), (2, 200), (3, 25)])
def test_against_a_loop(spark, seed, budget):
    draw = random.Random(seed)
    rows = [(None if i % 31 == 0 else 1 if i % 3 == 0 else draw.randrange(2, 9), draw.choice(["a", "b", "c", "none", None]), i, None if i % 17 == 0 else draw.randrange(0, 20), None if i % 5 == 0 else draw.random() < 0.06) for i in range(500)]
    classes = [("a", draw.choice([0.2, 0.5]), draw.randrange(4)), ("b", 0.3, draw.randrange(3)), ("c", 0.2, 1)]
    frame = spark.createDataFrame(rows, "packet int, kind string, part int, size int, kept boolean").repartition(6)
    got = {(r.packet, r.part): r.state for r in packets.delivered(frame, "packet", "kind", "part", "size", "kept", budget, classes).collect()}
    assert got == loop(rows, budget, classes)
    assert packets.delivered(frame.limit(0), "packet", "kind", "part", "size", "kept", budget, classes).collect() == []
