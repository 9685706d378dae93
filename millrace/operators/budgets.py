"""Sequential choices as folds over the sorted rows of a partition, which hold one group's state and never its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def _folded(rows: DataFrame, group: str, key: str, value: str, order: list, out: StructField, begin: Callable, step: Callable) -> DataFrame:
    """(group, key, out) of rows taken in order within each group: step(state, value) gives the new state and the row's
    output, None for no row. Rows are sorted on disk if need be; a group ends where the next one begins."""
    held = rows.select(group, key, F.col(value).cast("double").alias(value))
    schema = StructType([held.schema[group], held.schema[key], out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            kept, made = [], []
            for i, (g, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if g != current:
                    current, state = g, begin()
                state, got = step(state, v)
                if got is not None:
                    kept.append(i)
                    made.append(got)
            taken = batch.take(pa.array(kept, pa.int64()))
            made = pa.array(made, pa.float64() if isinstance(out.dataType, DoubleType) else pa.int32())
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), made], names=schema.names)

    return held.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def skip_if_too_big(rows: DataFrame, group: str, order: str, size: str, budget: float) -> DataFrame:
    """(group, order, used) of the items that a group takes: in order, smaller ones first in ties, each that still fits;
    others, and those of unknown size, are skipped. Null groups are one group."""

    def step(used: float, s: float | None) -> tuple:
        fits = s is not None and used + s <= budget
        return (used + s, used + s) if fits else (used, None)

    return _folded(rows, group, order, size, [order, size], StructField("used", DoubleType()), lambda: 0.0, step)


def tie_bands(rows: DataFrame, group: str, key: str, score: str, tolerance: float) -> DataFrame:
    """(group, key, band): by falling score, a band goes on while scores are within the tolerance of its first. Unknown
    scores come last, in a band of their own."""

    def step(state: tuple, v: float | None) -> tuple:
        leader, band = state
        if band == 0 or (v is None and leader is not None) or (v is not None and v < leader * (1 - tolerance)):
            leader, band = v, band + 1
        return (leader, band), band

    return _folded(rows, group, key, score, [F.desc_nulls_last(score), key], StructField("band", IntegerType()), lambda: (None, 0), step)
