"""Streams with state for each key: working memory, replay before each event, and reviews that keep their place.

Each result is that of the batch query over all files read so far, however the input is split into files and wherever a
run stops: state and offsets come back from the checkpoint, and a trigger that runs again replaces its own rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.sources.tables import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WorkingMemory(StatefulProcessor):
    """The last `window` events of a key by order stay as they are; those that fall out become counts by kind.

    What falls out depends on the order alone and not on when an event comes, so late events count at once.
    """

    def __init__(self, group: str, order: str, kind: str, window: int) -> None:
        self.group, self.order, self.kind, self.window = group, order, kind, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long, kind string")
        self.older = handle.getMapState("older", "kind string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        fallen: dict[str, int] = {}
        for frame in rows:
            held += zip(map(int, frame[self.order]), frame[self.kind], strict=True)
            held.sort(key=lambda x: x[0])
            for _, kind in held[: -self.window]:
                fallen[kind] = fallen.get(kind, 0) + 1
            held = held[-self.window :]
        for kind, n in fallen.items():
            was = self.older.getValue((kind,))[0] if self.older.containsKey((kind,)) else 0
            self.older.updateValue((kind,), (was + n,))
        self.recent.put(held)
        older = {k[0]: v[0] for k, v in self.older.iterator()}
        kinds = sorted({*older, *(k for _, k in held)}, key=str)
        own = None if key[0] else key[1]
        yield pd.DataFrame({self.group: pd.Series([own] * len(kinds), dtype=object), self.kind: kinds, "recent": [sum(k == x for _, k in held) for x in kinds], "compacted": [older.get(x, 0) for x in kinds]})

    def close(self) -> None:
        pass


class Replay(StatefulProcessor):
    """For each event, how many of its key came strictly before, and the greatest known value among them.

    Rows of one trigger may come in any order; those of one key are sorted at once, so that a trigger's files should be few
    (maxFilesPerTrigger) where a key is hot. An event at or before the last one replayed in an earlier trigger is late: it
    is given with late set and nothing known, and doesn't change what was said or will be.
    """

    def __init__(self, group: str, order: str, value: str) -> None:
        self.group, self.order, self.value = group, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "at long, n long, best double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, n, best = self.known.get() if self.known.exists() else (None, 0, None)
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        late = frame[self.order] <= at if at is not None else pd.Series(False, frame.index)
        fresh = frame[~late]
        values = fresh[self.value].astype(float)
        seen = pd.concat([pd.Series([float("nan") if best is None else best]), values]).cummax().ffill()
        out = pd.DataFrame({self.order: fresh[self.order], "earlier": range(n, n + len(fresh)), "best_before": seen.to_numpy()[:-1], "late": False})
        gone = pd.DataFrame({self.order: frame.loc[late, self.order], "earlier": None, "best_before": None, "late": True})
        if len(fresh):
            last = seen.iloc[-1]
            self.known.update((int(fresh[self.order].iloc[-1]), n + len(fresh), None if pd.isna(last) else float(last)))
        every = pd.concat([x for x in (out, gone) if len(x)]) if len(frame) else out
        yield every.assign(earlier=every["earlier"].astype("Int64"), best_before=every["best_before"].astype("Float64").where(~every["best_before"].isna()), late=every["late"].astype(bool))

    def close(self) -> None:
        pass


def _by(events: DataFrame, group: str):
    """Grouped by whether the key is null and by the key without nulls: pandas takes each row with a null key for a group."""
    key = F.coalesce(F.col(group), F.lit(0).cast(events.schema[group].dataType))
    return events.withColumns({"__null": F.col(group).isNull(), "__key": key}).groupBy("__null", "__key")


def working_memory(events: DataFrame, group: str, order: str, kind: str, window: int) -> DataFrame:
    """A stream of (group, kind, recent, compacted): the latest rows of a key replace those before."""
    out = StructType([events.schema[group], events.schema[kind]]).add("recent", "long").add("compacted", "long")
    return _by(events.select(group, order, kind), group).transformWithStateInPandas(WorkingMemory(group, order, kind, window), out, "Update", "None")


def replay(events: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """A stream of (order, earlier, best_before, late), a row for each event."""
    out = StructType([events.schema[order]]).add("earlier", "long").add("best_before", "double").add("late", "boolean")
    return _by(events.select(group, order, value), group).transformWithStateInPandas(Replay(group, order, value), out, "Append", "None")


def run_into(stream: DataFrame, base: str, mode: str, make: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Reads what is there and was not read before into base/out, a folder for each trigger. The next call goes on from there."""
    spark = stream.sparkSession
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def put(batch: DataFrame, number: int) -> None:
        (make(batch, number) if make else batch).write.mode("overwrite").parquet(f"{base}/out/trigger={number}")

    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def gathered(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All rows that triggers have put below base, with the number of the trigger."""
    return spark.read.schema(schema.add("trigger", "long")).parquet(f"{base}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the last trigger that gave each key."""
    rest = [c for c in rows.columns if c not in {*keys, "trigger"}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("__r")).select(*keys, "__r.*")


def review_into(events: DataFrame, base: str, order: str, by: str, start: float | None = None) -> None:
    """Counts by kind of the events past the high-water mark, which the sink itself holds: each trigger reads the mark of those
    before it, leaves out what is at or below, and puts its counts and its own mark together. Events that are sent again aren't
    counted again, provided that files come in the order of their events. `start` is the mark before the first trigger."""
    spark = events.sparkSession
    schema = StructType().add("kind", "string").add("unread", "long").add("mark", "double").add("trigger", "long")

    def make(batch: DataFrame, number: int) -> DataFrame:
        spark_ = batch.sparkSession
        spark_.createDataFrame([], StructType(schema.fields[:-1])).write.mode("ignore").parquet(f"{base}/out/trigger=-1")
        mark = spark_.read.schema(schema).parquet(f"{base}/out").filter(F.col("trigger") < number).agg(F.max("mark")).first()[0]
        mark = start if mark is None else mark
        past = batch if mark is None else batch.filter(F.col(order) > mark)
        return past.groupBy(F.col(by).alias("kind")).agg(F.count("*").alias("unread"), F.max(order).cast("double").alias("mark"))

    run_into(events, base, "append", make)


def reviewed(spark: SparkSession, base: str) -> DataFrame:
    """(kind, unread) of all triggers so far."""
    rows = gathered(spark, base, StructType().add("kind", "string").add("unread", "long").add("mark", "double"))
    return rows.groupBy("kind").agg(F.sum("unread").alias("unread"))


def new_base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
