"""Tables that are kept up to date: refresh by fingerprint, sweeps, logs whose last entry counts, ledgers and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def changed(source: DataFrame, stored: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """Rows of the source whose fingerprint the stored table does not have: only these need work."""
    return source.join(stored.select(key, sha), [key, sha], "left_anti")


def refreshed(source: DataFrame, stored: DataFrame, key: str, compute, sha: str = "sha") -> DataFrame:
    """The derived table after a refresh: records that still match are kept, changed ones are computed, gone ones go.

    `compute` makes records (key, sha, ...) from source rows, in the columns of `stored`.
    """
    kept = stored.join(source.select(key, sha), [key, sha], "left_semi")
    return kept.unionByName(compute(changed(source, stored, key, sha)).select(stored.columns))


def swept(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the newest generation saw."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_semi")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key of an append-only log. Partial maxima are taken before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("x")).select("x.*")


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """(event_id, path) after corrections (event_id, path, verdict, id): the last for each pair counts; `irrelevant`
    takes a path away and `relevant` brings one in."""
    last = corrections.groupBy("event_id", "path").agg(F.max_by("verdict", "id").alias("verdict"))
    kept = rows.select("event_id", "path").join(last.filter("verdict = 'irrelevant'"), ["event_id", "path"], "left_anti")
    return kept.union(last.filter("verdict = 'relevant'").select("event_id", "path")).distinct()


def freshness(files: DataFrame, current: DataFrame) -> DataFrame:
    """(event_id, state): recorded fingerprints (event_id, path, sha) against current (path, now). Paths that are gone
    count as changed, rows without fingerprint tell nothing."""
    met = files.join(current, "path", "left")
    known, moved = F.count("sha"), F.count(F.when(F.col("sha").isNotNull() & ~F.col("sha").eqNullSafe(F.col("now")), 1))
    got = met.groupBy("event_id").agg(known.alias("known"), moved.alias("moved"))
    state = F.when(F.col("known") == 0, "unknown").when(F.col("moved") == 0, "compatible").when(F.col("moved") < F.col("known"), "partially_changed").otherwise("changed")
    return got.select("event_id", state.alias("state"))


def newest(rows: DataFrame, group: str, order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows of each group. Spark cuts each task's rows before the shuffle, so a hot group stays small."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= keep).drop("__n")


def undelivered(offered: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Offered rows with `delivered`: whether the ledger has their keys, so that only a reference needs to go out."""
    had = ledger.select(*keys).distinct().withColumn("delivered", F.lit(True))
    return offered.join(had, keys, "left").withColumn("delivered", F.coalesce("delivered", F.lit(False)))


def inserted_once(stored: DataFrame, arriving: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """The stored rows and those arriving whose key is neither stored nor buried; of repeated arrivals any one stays."""
    fresh = arriving.join(stored.select(key), key, "left_anti").join(tombstones.select(key), key, "left_anti").dropDuplicates([key])
    return stored.unionByName(fresh)


def receipt_state(observed: Column, expires: Column, session: Column, at: Column, skew: Column) -> Column:
    """rejected (from the future), historical (no session), expired, or current."""
    return F.when(observed > at + skew, "rejected").when(session.isNull(), "historical").when(expires.isNotNull() & (at > expires), "expired").otherwise("current")
