"""Reports over trials, checks and health: each measure with its own denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

__all__ = ["activity", "checked_outcome", "matched_writes", "parent_health", "rate", "route_scores", "shares"]


def rate(yes: Column, known: Column) -> Column:
    """Share of the known rows that are so; null where none is known."""
    n = F.count(F.when(known, 1))
    return F.when(n > 0, F.round(F.count(F.when(known & yes, 1)) / n, 6))


def activity(trials: DataFrame, group: str, value: str, availability: str) -> DataFrame:
    """Complete measurements and partial lower bounds apart; missing is not zero."""
    full, part = F.col(availability) == "complete", F.col(availability) == "partial"
    known = F.col(value).isNotNull() & (F.col(value) >= 0)
    seen = F.count(F.when(full & known, 1))
    return trials.groupBy(group).agg(
        seen.alias("observed"),
        (F.count("*") - seen).alias("missing"),
        F.sum(F.when(full & known, F.col(value))).alias("total"),
        F.sum(F.when(part & known, F.col(value))).alias("partial_total"),
        F.count(F.when(part & known, 1)).alias("partial_attempts"),
    )


def parent_health(children: DataFrame, parent: str, display: str) -> DataFrame:
    """(parent, display): degraded where some children work and others fail or await a login, healthy where one works and
    none fails, untested otherwise."""
    healthy, login = F.col(display) == "HEALTHY", F.col(display) == "AUTH_REQUIRED"
    fails = F.col(display).isin("UNAVAILABLE", "MISCONFIGURED", "DEGRADED")
    some, bad = F.bool_or(healthy), F.bool_or(login | fails)
    return children.groupBy(parent).agg(F.when(some & bad, "DEGRADED").when(some, "HEALTHY").when(bad, "UNAVAILABLE").otherwise("UNTESTED").alias("display"))


def shares(rows: DataFrame, group: str, state: str) -> DataFrame:
    """Share of each state among the rows of its group. Groups are few and one row each after counting."""
    counts = rows.groupBy(group, state).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).select(group, state, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def matched_writes(rows: DataFrame, target: str, write: Column, cleanup: Column) -> DataFrame:
    """Writes and cleanups of each target, and the writes that no cleanup matches."""
    n_writes, n_cleanups = F.count(F.when(write, 1)), F.count(F.when(cleanup, 1))
    return rows.groupBy(target).agg(n_writes.alias("writes"), n_cleanups.alias("cleanups"), F.greatest(n_writes - n_cleanups, F.lit(0)).alias("left_behind"))


def route_scores(rows: DataFrame, group: str, chosen: str, best: str, acceptable: str, avoided: str) -> DataFrame:
    """Shares of choices that are the best one, acceptable, or to be avoided; acceptable and avoided are arrays."""
    share = lambda yes: F.round(F.avg(yes.cast("double")), 6)
    return rows.groupBy(group).agg(share(F.col(chosen) == F.col(best)).alias("top1"), share(F.array_contains(acceptable, F.col(chosen))).alias("acceptable"), share(F.array_contains(avoided, F.col(chosen))).alias("avoided"))


def checked_outcome(observations: DataFrame, task: str, place: str) -> DataFrame:
    """(task, outcome) by the last observed check (outcome, freshness)."""
    last = observations.groupBy(task).agg(F.max(F.struct(place, "outcome", "freshness")).alias("last"))
    o, fresh = F.col("last.outcome"), F.col("last.freshness") == "current"
    named = F.when(o == "tests_passed", F.when(fresh, "checked_success").otherwise("stale_checks")).when(o.isin("tests_failed", "command_failed"), "failed_checks")
    named = named.when(o == "zero_tests", "zero_tests").when(o.isin("command_succeeded", "executed_unknown"), "exit_code_only")
    named = named.when(o.isin("timeout", "denied", "launch_failed", "not_run"), "infrastructure_error").otherwise("insufficient_evidence")
    return last.select(task, named.alias("outcome"))
