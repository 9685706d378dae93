"""Which revisions count for a request, in which state the others are, and what their layers come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Kinds whose layers are texts; a request takes a bounded number of them.
TEXTUAL = ("skill_overlay", "role_method_overlay", "recipe_overlay")
PROFILE = "retrieval_profile"


def base_state(allowed: Column, policy: Column, package: Column) -> Column:
    """The first reason against a revision by itself and its request, in order; active if there is none. Nulls are reasons."""
    said = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~said(F.col("live")), "not_approved").when(~said(allowed), "capability_unavailable").when(~said(policy) | ~said(package), "stale_base")
        .when(~said(F.col("applies")), "not_applicable").when(~said(F.col("supported")), "insufficient_evidence").otherwise("active")
    )


def resolved(matches: DataFrame, revisions: DataFrame, bases: DataFrame, kinds: list[str], policy: str, package: str, most: int, shadow: bool = False) -> DataFrame:
    """(request_id, revision_id, state) for each match (request_id, revision_id, applies) of a revision.

    Revisions are (revision_id, kind, artifact_id, scope, slot, live, policy, package, base, supported, families, dependencies,
    parents), bases (kind, artifact_id, digest). In order: what speaks against a revision alone (base_state); a dependency that isn't
    active for the request; no base, or another than the revision was made for; two revisions of one scope on one slot; a repo
    revision whose global parents aren't those that are active on its slot; texts beyond the first `most`, those of the repo and
    of more families first; more than one profile. With `shadow`, what would be active is shadow. Each step looks at the states that
    the one before left, and only at rows of the same request. Repeated matches count once, and apply if one does.
    """
    asked = matches.groupBy("request_id", "revision_id").agg(F.max(F.coalesce("applies", F.lit(False))).alias("applies"))
    rows = asked.join(revisions.dropDuplicates(["revision_id"]), "revision_id").withColumn("state", base_state(F.col("kind").isin(kinds), F.col("policy") == policy, F.col("package") == package))
    active = F.col("state") == "active"
    own = rows.filter(active).groupBy("request_id").agg(F.collect_set("revision_id").alias("__live")).withColumn("__live", F.coalesce("__live", F.array()))
    needed = F.filter(F.coalesce("dependencies", F.array().cast(revisions.schema["dependencies"].dataType)), lambda d: d.isNotNull())
    rows = rows.join(own, "request_id", "left").join(bases.groupBy("kind", "artifact_id").agg(F.min("digest").alias("__digest")), ["kind", "artifact_id"], "left")
    missing = F.size(F.array_except(needed, F.coalesce("__live", F.array().cast(revisions.schema["dependencies"].dataType)))) > 0
    state = F.when(~active, F.col("state")).when(missing, "insufficient_evidence").when(F.col("__digest").isNull(), "capability_unavailable").when(~F.coalesce(F.col("base") == F.col("__digest"), F.lit(False)), "stale_base").otherwise("active")
    rows = rows.withColumn("state", state)
    slot = Window.partitionBy("request_id", "kind", "artifact_id", "slot")
    same = Window.partitionBy("request_id", "kind", "artifact_id", "slot", "scope")
    rows = rows.withColumn("state", F.when(active & (F.sum(active.cast("int")).over(same) > 1), "conflict").otherwise(F.col("state")))
    expected = F.collect_set(F.when(active & (F.col("scope") == "global"), F.col("revision_id"))).over(slot)
    every = F.collect_set(F.when(F.col("scope") == "global", F.col("revision_id"))).over(Window.partitionBy("request_id"))
    rows = rows.withColumn("__declared", F.array_intersect(F.coalesce("parents", F.array().cast(revisions.schema["parents"].dataType)), every)).withColumn("__expected", expected)
    other = (F.size("__declared") > 0) & (F.array_sort("__declared") != F.array_sort("__expected"))
    rows = rows.withColumn("state", F.when(active & (F.col("scope") == "repo") & other, "stale_base").otherwise(F.col("state")))
    turn = Window.partitionBy("request_id").orderBy((~(active & F.col("kind").isin(*TEXTUAL))).cast("int"), (F.col("scope") != "repo").cast("int"), F.desc_nulls_last("families"), "revision_id")
    rows = rows.withColumn("state", F.when(active & F.col("kind").isin(*TEXTUAL) & (F.row_number().over(turn) > most), "budget_omitted").otherwise(F.col("state")))
    profile = active & (F.col("kind") == PROFILE)
    rows = rows.withColumn("state", F.when(profile & (F.sum(profile.cast("int")).over(Window.partitionBy("request_id")) > 1), "conflict").otherwise(F.col("state")))
    final = F.when(active, "shadow").otherwise(F.col("state")) if shadow else F.col("state")
    return rows.select("request_id", "revision_id", final.alias("state"))


def merged_settings(layers: DataFrame, limits: list[str]) -> DataFrame:
    """(request_id, key, value, layer) of layers (request_id, layer, key, value): the highest layer that has a key decides,
    but a limit, whose values are numbers, only gets tighter; layer says whose value it is, of equal limits the lowest.

    Both are sums of a kind (the greatest by layer, the least by value), so that parts of the layers can be merged first, in
    any order and anywhere. Null values say nothing; of a key's values in one layer the least counts.
    """
    known = layers.filter("value is not null").withColumn("limit", F.col("key").isin(limits))
    of = known.groupBy("request_id", "key", "limit").agg(F.max(F.struct("layer")).alias("top"), F.min(F.struct(F.col("value").cast("double").alias("v"), "layer", "value")).alias("least"), F.min_by("value", F.struct(-F.col("layer"), F.col("value"))).alias("last"))
    return of.select("request_id", "key", F.when(F.col("limit"), F.col("least.value")).otherwise(F.col("last")).alias("value"), F.when(F.col("limit"), F.col("least.layer")).otherwise(F.col("top.layer")).alias("layer"))
