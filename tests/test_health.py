"""Health against a loop over random receipts; messages by parts; metrics by arm and label against a loop."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions import texts
from millrace.operators import health, metrics

DECLARED = {
    "presence": ("installed", "absent", "unknown", None), "configuration": ("valid", "invalid", "unknown", "not_applicable"), "exposure": ("callable", "deferred", "not_exposed", None),
    "connectivity": ("untested", "untested", "not_applicable"), "authentication": ("unknown", "required", "not_applicable"), "authorization": ("unknown", None), "compatibility": ("unknown", None), "policy": ("enabled", "enabled", "disabled", None),
}
KINDS = ("skill", "role", "native_tool", "cli", "plugin", "api", "mcp_tool", "mcp_server", "mcp_server", None)
TYPES = ("static_validation", "host_exposure", "transport_negotiation", "tool_enumeration", "approved_read_probe", "observed_task_call", "user_report")
REASONS = ("TRANSPORT_TIMEOUT", "SERVICE_UNAVAILABLE", "PERMISSION_DENIED", "AUTHENTICATION_REQUIRED", "SCHEMA_CHANGED", "OTHER", None, "")


def drawn(seed):
    rng, instances, receipts = random.Random(seed), [], []
    for i in range(700):
        instances.append({"id": i, "kind": rng.choice(KINDS), "origin": rng.choice(("plugin", "user", None)), "discovery": rng.choice(("complete", "partial", None)), "shadowed": rng.choice((True, False, False, None)), **{n: rng.choice(v) for n, v in DECLARED.items()}})
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
            good = rng.random() < 0.5
            receipts.append({"id": i, "receipt": len(receipts), "operation": rng.choice("ab"), "type": rng.choice(TYPES), "outcome": "success" if good else "failure", "reason": "OK" if good else rng.choice(REASONS), "state": rng.choice(("current", "current", "historical", "expired")), "observed": rng.randrange(4)})
    receipts.append({**receipts[0], "id": 9999, "receipt": -1})
    return instances, receipts


def judged(i, receipts):
    d = {n: i[n] or ("enabled" if n == "policy" else "unknown") for n in DECLARED}
    live = sorted((r for r in receipts if r["state"] == "current" and r["type"] != "static_validation"), key=lambda r: (r["observed"], r["receipt"]))
    last = {r["operation"]: r for r in live}.values()
    good = lambda rows, types: any(r["outcome"] == "success" and r["type"] in types for r in rows)
    told = lambda *reasons: any(r["reason"] in reasons for r in last)
    worked, failed = any(r["outcome"] == "success" for r in last), [r["reason"] for r in last if r["outcome"] == "failure"]
    if i["kind"] in health.CONNECTED and d["connectivity"] != "not_applicable":
        broken = any(r["outcome"] == "failure" and r["reason"] in health.BROKEN for r in live)
        d["connectivity"] = "verified" if good(live, health.HANDSHAKES + health.USES) else "failed" if broken else "untested"
        d["authentication"] = "required" if told("AUTHENTICATION_REQUIRED") else "authenticated" if good(live, health.USES) else d["authentication"]
        d["authorization"] = "allowed" if good(last, health.USES) else "denied" if told("PERMISSION_DENIED") else "unknown"
        d["compatibility"] = "incompatible" if told(*health.CHANGED) else "compatible" if good(live, health.HANDSHAKES) else d["compatibility"]
        if i["discovery"] == "complete" and any(r["type"] == "host_exposure" and r["reason"] == "SERVICE_UNAVAILABLE" for r in live):
            d["presence"] = "absent"
    states = {r["state"] for r in receipts}
    static = any(r["state"] == "current" and r["type"] == "static_validation" for r in receipts)
    d["freshness"] = "fresh" if live or (static and states == {"current"}) else "expired" if "expired" in states else "stale" if "historical" in states else "unknown"
    why = ["STALE_SESSION_EVIDENCE"] if d["freshness"] == "stale" else []
    ready = d["presence"] == "installed" and d["configuration"] == "valid"
    if d["configuration"] == "invalid" or d["compatibility"] == "incompatible":
        shown = "MISCONFIGURED"
    elif d["authentication"] == "required":
        shown, why = "DEGRADED" if worked else "AUTH_REQUIRED", why + ["AUTHENTICATION_REQUIRED"]
    elif d["presence"] == "absent" or (d["connectivity"] == "failed" and not worked):
        shown, why = "UNAVAILABLE", why + failed
    elif i["kind"] in health.GUIDES:
        shown = "HEALTHY" if (ready and d["freshness"] == "fresh") or (not ready and d["exposure"] == "callable" and d["configuration"] == "unknown") else "UNTESTED"
    elif i["kind"] == "native_tool":
        shown = "HEALTHY" if d["exposure"] == "callable" else "UNTESTED"
    elif i["kind"] == "cli":
        shown = {"installed": "UNTESTED"}.get(d["presence"], "MISCONFIGURED")
    elif failed and worked:
        shown, why = "DEGRADED", why + failed
    elif worked:
        shown = "HEALTHY"
    elif d["exposure"] in ("callable", "deferred"):
        shown, why = "UNTESTED", why + (["CALLABLE_NOT_CONNECTION_TESTED"] if d["exposure"] == "callable" else [])
    else:
        shown, why = ("DEGRADED", why + failed) if failed else ("UNTESTED", why)
    why += ["POLICY_DISABLED"] if d["policy"] != "enabled" else []
    badges = [b for b in (d["policy"].upper() if d["policy"] != "enabled" else None, d["freshness"].upper() if d["freshness"] in ("stale", "expired") else None, ("OLD COPY" if "plugin" in (i["kind"], i["origin"]) else "SHADOWED") if i["shadowed"] else None) if b]
    return {**d, "id": i["id"], "kind": i["kind"], "display": shown, "reasons": sorted({w for w in why if w and w != "OK"}), "badges": badges, "eligible": d["policy"] == "enabled" and shown not in ("MISCONFIGURED", "UNAVAILABLE") and not i["shadowed"]}


def test_health_is_that_of_a_loop(spark):
    kinds = "id long, kind string, origin string, discovery string, shadowed boolean, " + ", ".join(f"{n} string" for n in DECLARED)
    logged = "id long, receipt long, operation string, type string, outcome string, reason string, state string, observed long"
    instances, receipts = drawn(5)
    a, b = spark.createDataFrame(instances, kinds), spark.createDataFrame(receipts, logged)
    got = {r.id: r.asDict() for r in health.assessed(a, b, "id").collect()}
    mine = {i["id"]: judged(i, [r for r in receipts if r["id"] == i["id"]]) for i in instances}
    assert [(k, got[k], mine[k]) for k in mine if got[k] != mine[k]] == [] and len(got) == len(mine)
    assert {m["display"] for m in mine.values()} == {"HEALTHY", "DEGRADED", "AUTH_REQUIRED", "MISCONFIGURED", "UNAVAILABLE", "UNTESTED"}
    assert {m["freshness"] for m in mine.values()} == {"fresh", "stale", "expired", "unknown"}
    assert health.assessed(a.limit(0), b, "id").count() == 0 and health.assessed(a, b.limit(0), "id").count() == 700


def test_messages_have_a_subject_and_a_body(spark):
    key = "gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0"
    cases = {
        "Fix a@b.org\n\nline  \nSigned-off-by: A B <a@b.org>\nmail c@d.net\n": ("Fix <redacted>", "line\nmail <redacted>"),
        "Helped-by: C <c@d.org>\n  Title \t\nx": ("Title", "x"),
        "a\x07b\r\nc\x00": ("ab", "c"),
        "": ("", ""),
        "one\n\n\n": ("one", ""),
        "Note: no address\nSee: x": ("Note: no address", "See: x"),
        "s" * 300 + "\n" + "b" * 2000: ("s" * 200, "b" * 1500),
        "t\n" + "x" * 1490 + " " + key: ("t", ("x" * 1490 + " [REDACTED]")[:1500]),
        "t\n" + " " * 100_000 + "y" + "\t" * 100_000: ("t", "y"),
    }
    rows = spark.createDataFrame([(i, m) for i, m in enumerate([*cases, None])], "i int, m string").withColumn("p", texts.sanitized(F.col("m"))).orderBy("i").collect()
    assert [(r.p.subject, r.p.body) for r in rows] == [*cases.values(), (None, None)]
    assert not re.search(r"@|\x07", "".join(r.p.subject + r.p.body for r in rows[:-1]))


def test_metrics_by_arm_and_label(spark):
    rng = random.Random(3)
    lists = [(arm, q, k, rank) for arm in "xy" for q in range(30) if (arm, q % 7) != ("y", 0) for rank, k in enumerate(rng.sample(range(20), 12), 1)]
    lists += [("x", 1, lists[0][2], 99), ("z", 1, 1, 1)]
    labels = [(q, g, rng.randrange(25)) for q in range(30) for g in ("g", "h", "g")][:-3] + [(2, "g", None), (3, None, 4), (2, "h", 5), (2, "h", 5)]
    got = {(r.arm, r.grp): r.asDict() for r in metrics.arm_groups(spark.createDataFrame(lists, "arm string, q long, k long, rank long"), spark.createDataFrame(labels, "q long, grp string, k long"), ["x", "y"], "q", "k", (1, 5)).collect()}
    best = {}
    for arm, q, k, rank in lists:
        best[arm, q, k] = min(rank, best.get((arm, q, k), rank))
    for arm in "xy":
        for grp in ("g", "h", "all"):
            want = {}
            for q, g, k in labels:
                if k is not None and g is not None and grp in (g, "all"):
                    want.setdefault(q, set()).add(k)
            found = {q: sorted(best[arm, q, k] for k in ks if (arm, q, k) in best) for q, ks in want.items()}
            mean = lambda f: sum(map(f, want)) / len(want)
            row = got.pop((arm, grp))
            assert row["n_queries"] == len(want)
            assert abs(row["mrr"] - mean(lambda q: 1 / found[q][0] if found[q] else 0)) < 1e-9
            for k in (1, 5):
                assert abs(row[f"hit_{k}"] - mean(lambda q: bool(found[q]) and found[q][0] <= k)) < 1e-9
                assert abs(row[f"recall_{k}"] - mean(lambda q: sum(r <= k for r in found[q]) / len(want[q]))) < 1e-9
    assert got == {}
