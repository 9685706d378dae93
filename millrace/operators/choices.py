"""Additive scores, equivalence with reasons, recommendations and checks of stated workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Kinds of files that configure a project.
CONFIGURES = ("config", "manifest", "schema")


def additive(exact: Column, named: Column, found: Column, kind: Column, fits_role: Column, rule_file: Column) -> Column:
    """A flat score: 3 for an exact phrase, 2 for a named path, 2 for several terms or 1 for a single one that is all there
    is; a score gains 1 for configuring files and 1 for the role. Project rules alone give 1; nothing gives null. What is
    read from a text is bound once, however often the rules look at it."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    bases = F.transform(F.array(F.struct((yes(exact, 3) + yes(named, 2)).alias("sure"), found.alias("found"))), lambda f: f["sure"] + F.when(f["found"] >= 2, 2).when((f["found"] == 1) & (f["sure"] == 0), 1).otherwise(0))
    more = yes(kind.isin(*CONFIGURES), 1) + yes(fits_role, 1)
    return F.get(F.transform(bases, lambda base: F.when(base > 0, base + more).when(rule_file, 1)), F.lit(0))


def difference(candidate: str, preferred: str, required: str) -> Column:
    """Why a candidate may not stand in for what is preferred, null if it may. The three are structs of domain, access,
    environment, resource, identity and sensitivity; an environment or sensitivity that isn't known is `unknown`."""
    c, p, r = (lambda n, s=s: F.col(f"{s}.{n}") for s in (candidate, preferred, required))
    other = lambda a, b: ~a.eqNullSafe(b)
    wrong = other(c("domain"), r("domain")) | other(c("access"), r("access"))
    wrong = wrong | ((r("environment") != "unknown") & other(c("environment"), r("environment")))
    wrong = wrong | (r("resource").isNotNull() & other(c("resource"), r("resource")))
    return (
        F.when(wrong, "operation")
        .when(p("resource").isNotNull() & other(c("resource"), p("resource")), "resource")
        .when(p("identity").isNotNull() & other(c("identity"), p("identity")), "identity")
        .when((F.coalesce(p("sensitivity"), F.lit("unknown")) != "unknown") & other(c("sensitivity"), p("sensitivity")), "sensitivity")
        .when(c("environment").eqNullSafe(F.lit("unknown")), "environment not established")
    )


def recommended(rows: DataFrame, by: str, key: str, tiers: dict[str, int], most: int = 8) -> DataFrame:
    """The first `most` of each group's rows (status, tier, trust) by their tier's weight, then key. What is usable, blocked
    or refused, what the community made and what has no tier is left out."""
    weight = F.coalesce(*[F.when(F.col("tier") == name, value) for name, value in tiers.items()])
    open_ = rows.withColumn("weight", weight).filter("weight is not null and status not in ('usable', 'blocked', 'not_recommended') and trust <> 'community'")
    action = F.when(F.col("status") == "unknown", "check first").when(F.col("status") == "auth_required", "reconnect").otherwise("configure")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight"), key))
    return open_.withColumn("rank", place).filter(F.col("rank") <= most).select(by, key, "weight", action.alias("action"), "rank")


# Categories of reports, the stronger the higher.
STRENGTH = {"confirmed": 3, "promising": 2, "no_benefit": 1, "insufficient": 0}


def candidate_status(candidates: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """(key, status, matched, transfer) of each candidate (key, digest) by reports (key, digest, category, exact).

    Reports of another digest never count, and those that aren't exact never decide. A regression outweighs all.
    """
    own = reports.select(key, "digest", "category", "exact").groupBy(key, "digest")
    exact = F.col("exact")
    strength = F.coalesce(*[F.when(F.col("category") == name, value) for name, value in STRENGTH.items()], F.lit(-1))
    met = own.agg(
        F.count(F.when(exact, 1)).alias("matched"), F.count(F.when(~exact, 1)).alias("transfer"),
        F.max(F.when(exact, strength)).alias("best"), F.max(exact & (F.col("category") == "regression")).alias("worse"),
    )
    held = candidates.select(key, "digest").join(met, [key, "digest"], "left")
    status = F.when(F.col("worse"), "not_recommended").when(F.col("best") == 3, "recommended").when(F.col("best").isNotNull(), "evaluate_further").otherwise("unevaluated")
    none = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return held.select(key, status.alias("status"), none("matched"), none("transfer"))


def workflow_faults(steps: DataFrame, workflow: str) -> DataFrame:
    """(workflow, n_steps, fault) from steps (workflow, id, position, requires): the first fault, null if there is none.

    A step may only require known steps before it; so the order is free of cycles, and every step can be reached.
    """
    known = steps.select(workflow, F.col("id").alias("needed"), F.col("position").alias("at"))
    sizes = steps.groupBy(workflow).agg(F.count("*").alias("n_steps"), F.count_distinct("id").alias("n_ids"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    needs = steps.select(workflow, "position", F.explode("requires").alias("needed")).join(known, [workflow, "needed"], "left")
    bad = needs.groupBy(workflow).agg(F.max(F.col("at").isNull()).alias("unknown"), F.max(F.col("at") >= F.col("position")).alias("late"))
    fault = (
        F.when(F.col("n_ids") < F.col("n_steps"), "ids repeat")
        .when((F.col("lo") != 1) | (F.col("hi") != F.col("n_steps")), "positions have gaps")
        .when(F.col("unknown"), "requires an unknown step")
        .when(F.col("late"), "requires a later step")
    )
    return sizes.join(bad, workflow, "left").select(workflow, "n_steps", fault.alias("fault"))


def composed(steps: DataFrame, inserts: DataFrame, workflow: str) -> DataFrame:
    """(workflow, id, place, derived): stated steps (workflow, id, position) with optional ones (workflow, id, after, nth)
    behind the step they come after, in their own order. What comes after no step is left out; where an id repeats, its first place counts. Places count from 1."""
    anchors = steps.groupBy(workflow, F.col("id").alias("after")).agg(F.min("position").alias("position"))
    added = inserts.join(anchors, [workflow, "after"]).select(workflow, "id", "position", "nth", F.lit(True).alias("derived"))
    both = steps.select(workflow, "id", "position", F.lit(0).alias("nth"), F.lit(False).alias("derived")).unionByName(added)
    order = Window.partitionBy(workflow).orderBy("position", "derived", "nth", "id")  # a workflow has few steps
    return both.select(workflow, "id", F.row_number().over(order).alias("place"), "derived")


# Endings tried for an import without one, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def plain_path(path: Column) -> Column:
    """A path without `.` and empty steps and with each `..` taken back; null where it leads out."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    out = F.lit([".."]).cast("array<string>")

    def walk(held: Column, step: Column) -> Column:
        back = F.when(F.size(held) > 0, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(out)
        return F.when(F.get(held, F.lit(0)) == "..", held).when(step == "..", back).otherwise(F.concat(held, F.array(step)))

    left = F.aggregate(steps, F.array().cast("array<string>"), walk)
    return F.when(F.coalesce(F.get(left, F.lit(0)), F.lit("")) != "..", F.array_join(left, "/"))


def relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, wanted, target): the first existing file of each relative import (path, wanted), by the order of endings."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    asked = imports.select("path", "wanted", plain_path(F.concat(folder, F.col("wanted"))).alias("base")).filter("base is not null")
    tried = asked.select("path", "wanted", "base", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("nth", "ending"))
    tried = tried.select("path", "wanted", "nth", F.concat("base", "ending").alias("target")).filter("target <> path")
    met = tried.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return met.groupBy("path", "wanted").agg(F.min_by("target", "nth").alias("target"))
