"""Health of capabilities from receipts: nine dimensions, one display state, reasons and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kinds that are reached over a connection, kinds of receipts and reasons that tell about it.
CONNECTED = ("mcp_server", "mcp_tool", "api", "plugin")
GUIDES = ("skill", "role", "recipe")
HANDSHAKES = ("transport_negotiation", "tool_enumeration")
USES = ("approved_read_probe", "observed_task_call")
BROKEN = ("TRANSPORT_TIMEOUT", "SERVICE_UNAVAILABLE", "PROCESS_FAILED", "MALFORMED_RESPONSE")
CHANGED = ("VERSION_INCOMPATIBLE", "SCHEMA_CHANGED")
DIMENSIONS = ("presence", "configuration", "exposure", "connectivity", "authentication", "authorization", "compatibility", "policy", "freshness")


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _facts(receipts: DataFrame, key: str) -> DataFrame:
    """A row for each instance: what its receipts say, and what the latest live one of each operation says."""
    current = F.col("state") == "current"
    live = current & (F.col("type") != "static_validation")
    worked, failed = F.col("outcome") == "success", F.col("outcome") == "failure"
    newest = F.max(F.when(live, F.struct("observed", "receipt", "outcome", "type", "reason")))
    per = receipts.groupBy(key, "operation").agg(
        newest.alias("last"), _any(live).alias("live"), _any(current & ~live).alias("static"), _any(F.col("state") == "historical").alias("historical"), _any(F.col("state") == "expired").alias("expired"),
        _any(live & worked & F.col("type").isin(*HANDSHAKES, *USES)).alias("reached"), _any(live & worked & F.col("type").isin(*USES)).alias("used"), _any(live & worked & F.col("type").isin(*HANDSHAKES)).alias("met"),
        _any(live & failed & F.col("reason").isin(*BROKEN)).alias("broken"), _any(live & (F.col("type") == "host_exposure") & (F.col("reason") == "SERVICE_UNAVAILABLE")).alias("gone"),
    )
    reason, good, bad = F.col("last.reason"), F.col("last.outcome") == "success", F.col("last.outcome") == "failure"
    flags = [_any(F.col(n)).alias(n) for n in ("live", "static", "historical", "expired", "reached", "used", "met", "broken", "gone")]
    return per.groupBy(key).agg(
        *flags, _any(good).alias("worked"), _any(bad).alias("partial"), _any(reason == "AUTHENTICATION_REQUIRED").alias("asks"), _any(reason == "PERMISSION_DENIED").alias("denied"),
        _any(good & F.col("last.type").isin(*USES)).alias("allowed"), _any(reason.isin(*CHANGED)).alias("changed"), F.collect_set(F.when(bad, reason)).alias("failures"),
    )


def assessed(instances: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """The instances with their dimensions as receipts change them, and display, reasons, badges and eligible.

    instances: key, kind, origin, discovery, shadowed and the first eight of DIMENSIONS as they were declared; null reads
    as unknown, a null policy as enabled. receipts: key, receipt, operation, type, outcome, reason, state, observed; of two
    live ones of an operation the later counts, at one time the greater id. Instances without receipts keep what is
    declared; receipts of unknown instances count for none. `reasons` has each reason of a failed operation once, of
    which there are as many as the vocabulary of reasons has.
    """
    held = instances.join(_facts(receipts, key), key, "left")
    flags = [n for n, t in held.dtypes if t == "boolean" and n not in instances.columns]
    held = held.withColumns({n: F.coalesce(n, F.lit(False)) for n in flags})
    held = held.withColumns({n: F.coalesce(n, F.lit("enabled" if n == "policy" else "unknown")) for n in DIMENSIONS[:-1]} | {"failures": F.coalesce("failures", F.array().cast("array<string>")), "shadowed": F.coalesce("shadowed", F.lit(False))})
    c = F.col
    joined = F.coalesce(c("kind").isin(*CONNECTED), F.lit(False)) & (c("connectivity") != "not_applicable")
    seen = lambda name, *cases: _cases(F.when(~joined, c(name)), *cases)
    held = held.withColumns({
        "connectivity": seen("connectivity", (c("reached"), "verified"), (c("broken"), "failed")).otherwise("untested"),
        "authentication": seen("authentication", (c("asks"), "required"), (c("used"), "authenticated")).otherwise(c("authentication")),
        "authorization": seen("authorization", (c("allowed"), "allowed"), (c("denied"), "denied")).otherwise("unknown"),
        "compatibility": seen("compatibility", (c("changed"), "incompatible"), (c("met"), "compatible")).otherwise(c("compatibility")),
        "presence": F.when(joined & c("gone") & (c("discovery") == "complete"), "absent").otherwise(c("presence")),
        "freshness": F.when(c("live") | (c("static") & ~c("historical") & ~c("expired")), "fresh").when(c("expired"), "expired").when(c("historical"), "stale").otherwise("unknown"),
    })
    installed, valid = c("presence") == "installed", c("configuration") == "valid"
    guide = F.when(installed & valid, F.when(c("freshness") == "fresh", "HEALTHY").otherwise("UNTESTED")).when((c("exposure") == "callable") & (c("configuration") == "unknown"), "HEALTHY").otherwise("UNTESTED")
    binary = F.when(installed, "UNTESTED").when(c("presence") == "absent", "UNAVAILABLE").otherwise("MISCONFIGURED")
    # The rule that decides, in order; the state and the reasons follow from it.
    rule = _cases(
        F.when((c("configuration") == "invalid") | (c("compatibility") == "incompatible"), "misconfigured"), (c("authentication") == "required", "authentication"),
        ((c("presence") == "absent") | ((c("connectivity") == "failed") & ~c("worked")), "unavailable"), (c("kind").isin(*GUIDES), "guide"), (c("kind") == "native_tool", "native"), (c("kind") == "cli", "binary"),
        (c("partial") & c("worked"), "mixed"), (c("worked"), "worked"), (c("exposure") == "callable", "callable"), (c("exposure") == "deferred", "deferred"), (c("partial"), "failed"),
    ).otherwise("none")
    held = held.withColumn("rule", rule)
    display = _cases(
        F.when(c("rule") == "misconfigured", "MISCONFIGURED"), ((c("rule") == "authentication") & c("worked"), "DEGRADED"), (c("rule") == "authentication", "AUTH_REQUIRED"), (c("rule") == "unavailable", "UNAVAILABLE"),
        (c("rule") == "guide", guide), (c("rule") == "binary", binary), ((c("rule") == "native") & (c("exposure") == "callable"), "HEALTHY"), (c("rule").isin("mixed", "failed"), "DEGRADED"), (c("rule") == "worked", "HEALTHY"),
    ).otherwise("UNTESTED")
    own = F.array(
        F.when(c("freshness") == "stale", "STALE_SESSION_EVIDENCE"), F.when(c("rule") == "authentication", "AUTHENTICATION_REQUIRED"),
        F.when(c("rule") == "callable", "CALLABLE_NOT_CONNECTION_TESTED"), F.when(c("policy") != "enabled", "POLICY_DISABLED"),
    )
    failures = F.when(c("rule").isin("unavailable", "mixed", "failed"), c("failures")).otherwise(F.array().cast("array<string>"))
    reasons = F.array_sort(F.array_distinct(F.filter(F.concat(own, failures), lambda r: r.isNotNull() & ~r.isin("", "OK"))))
    old = F.when(c("shadowed"), F.when((c("kind") == "plugin") | F.coalesce(c("origin") == "plugin", F.lit(False)), "OLD COPY").otherwise("SHADOWED"))
    badges = F.array_compact(F.array(F.when(c("policy") != "enabled", F.upper("policy")), F.when(c("freshness").isin("stale", "expired"), F.upper("freshness")), old))
    held = held.withColumns({"display": display, "reasons": reasons, "badges": badges})
    fit = (c("policy") == "enabled") & ~c("display").isin("MISCONFIGURED", "UNAVAILABLE") & ~c("shadowed")
    return held.withColumn("eligible", fit).select(key, "kind", *DIMENSIONS, "display", "reasons", "badges", "eligible")


def _cases(first: Column, *more: tuple) -> Column:
    for condition, value in more:
        first = first.when(condition, value)
    return first
