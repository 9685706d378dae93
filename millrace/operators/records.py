"""Stored records: reading by key, joining what still holds, pairing arms, forgetting and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fetched(wanted: DataFrame, stored: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Stored rows of the wanted keys, each once, with `state` read, too large or missing; sizes are compared before the
    other columns are read, which are null unless the state is read."""
    asked = wanted.select(key).distinct()
    sizes = asked.join(stored.select(key, F.col(size).alias("__size")), key, "left")
    state = F.when(F.col("__size").isNull(), "missing").when(F.col("__size") > most, "too large").otherwise("read")
    judged = sizes.select(key, state.alias("state"))
    return judged.filter("state <> 'read'").unionByName(judged.filter("state = 'read'").join(stored, key), allowMissingColumns=True)


def universe(scanned: DataFrame, stored: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Scanned rows and, where a key wasn't scanned, the stored row whose signature is still the current one (key, signature)."""
    fresh = stored.join(now.select(key, "signature").distinct(), [key, "signature"], "left_semi").join(scanned.select(key), key, "left_anti")
    return scanned.withColumn("origin", F.lit("scan")).unionByName(fresh.withColumn("origin", F.lit("stored")))


def paired_trials(trials: DataFrame, order: str, candidate: str, incumbent: str) -> DataFrame:
    """(client, fixture, repetition, candidate, incumbent, candidate_cost, incumbent_cost): the last usable trial of both
    arms, where both have a known outcome. Trials that a wrong set-up or the machine broke are none."""
    usable = trials.filter(F.col("arm").isin(candidate, incumbent) & ~F.coalesce(F.col("status"), F.lit("")).isin("invalid_configuration", "authentication_failure", "infrastructure_error"))
    last = lambda arm: F.max_by(F.struct("success", "cost"), F.when(F.col("arm") == arm, F.col(order)))
    pairs = usable.groupBy("client", "fixture", "repetition").agg(last(candidate).alias("c"), last(incumbent).alias("i"))
    return pairs.filter("c.success is not null and i.success is not null").select("client", "fixture", "repetition", F.col("c.success").alias("candidate"), F.col("i.success").alias("incumbent"), F.col("c.cost").alias("candidate_cost"), F.col("i.cost").alias("incumbent_cost"))


def not_citing(derived: DataFrame, citations: DataFrame, key: str, forgotten: DataFrame, cited: str) -> DataFrame:
    """Derived rows none of whose citations (key, cited) is forgotten."""
    gone = citations.join(forgotten.select(cited).distinct(), cited, "left_semi").select(key).distinct()
    return derived.join(gone, key, "left_anti")


def maintained(current: DataFrame, computed: DataFrame, key: str, most: int) -> DataFrame:
    """The current generation with the first `most` of the records just computed put in, by key; nothing is removed. The
    bound is the operator's purpose: upkeep after a query stays small, the rest waits for the next full build."""
    few = computed.select(current.columns).orderBy(key).limit(most)
    return current.join(few.select(key), key, "left_anti").union(few)


# Exposure by old status, kinds by old list, and what an observation says of a state.
EXPOSURE = {"exposed": "callable", "verified": "callable", "missing": "not_exposed"}
KINDS = {"skills": "skill", "mcps": "mcp_server"}
SEEN = {"verified": ("observed_task_call", "success", "OK"), "auth_required": ("observed_task_call", "failure", "AUTHENTICATION_REQUIRED"), "missing": ("host_exposure", "failure", "SERVICE_UNAVAILABLE")}
CALLS = ("observed_task_call", "approved_read_probe", "tool_enumeration", "transport_negotiation")
OUTAGES = ("TRANSPORT_TIMEOUT", "SERVICE_UNAVAILABLE", "PROCESS_FAILED")


def upgraded(old: DataFrame) -> DataFrame:
    """Rows of the second layout from those of the first (list, id, server, status): id, kind, server, exposure, policy, and
    observation (type, outcome, reason), null where the old status says nothing of one."""
    kind = F.when(F.col("list") == "tools", F.when(F.col("server").isNotNull(), "mcp_tool").otherwise("native_tool"))
    exposure, observed = None, None
    for name, new in KINDS.items():
        kind = kind.when(F.col("list") == name, new)
    for status, new in EXPOSURE.items():
        exposure = (F if exposure is None else exposure).when(F.col("status") == status, new)
    for status, said in SEEN.items():
        observed = (F if observed is None else observed).when(F.col("status") == status, F.struct(*[F.lit(v).alias(n) for n, v in zip(("type", "outcome", "reason"), said)]))
    policy = F.when(F.col("status").isin("disabled", "blocked"), F.col("status"))
    return old.select("id", kind.alias("kind"), "server", exposure.otherwise("unknown").alias("exposure"), policy.alias("policy"), observed.alias("observation"))


def projected(capabilities: DataFrame, observations: DataFrame) -> DataFrame:
    """(list, id, status) of the first layout, from capabilities (id, kind, exposure, policy) and observations (id, type,
    outcome, reason). Kinds that it doesn't know are left out; what is exposed but untested stays so."""
    good = F.bool_or((F.col("outcome") == "success") & F.col("type").isin(*CALLS))
    gone = F.bool_or(((F.col("reason") == "SERVICE_UNAVAILABLE") & (F.col("type") == "host_exposure")) | ((F.col("outcome") == "failure") & F.col("reason").isin(*OUTAGES)))
    seen = observations.groupBy("id").agg(good.alias("good"), F.bool_or(F.col("reason") == "AUTHENTICATION_REQUIRED").alias("auth"), gone.alias("gone"))
    where = F.when(F.col("kind") == "skill", "skills").when(F.col("kind") == "mcp_server", "mcps").when(F.col("kind").isin("mcp_tool", "native_tool"), "tools")
    status = F.when(F.col("policy") == "disabled", "disabled").when(F.col("policy").isin("blocked", "quarantined"), "blocked").when(F.col("auth"), "auth_required").when(F.col("gone") & ~F.coalesce("good", F.lit(False)), "missing").when(F.col("good"), "verified").when(F.col("exposure") == "callable", "exposed").otherwise("unknown")
    return capabilities.join(seen, "id", "left").select(where.alias("list"), "id", status.alias("status")).filter("list is not null")
