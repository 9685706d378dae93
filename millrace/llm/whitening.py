"""Embedding whitening with the leading eigenvectors of the covariance by LOBPCG.

Vectors become whole numbers, so that sums are exact. The covariance is never formed: each step multiplies a block of
directions by it in one pass over the centred rows, and a Rayleigh-Ritz step on the iterate, its residuals and the
previous directions gives the next iterate. A last pass certifies the residuals before anything is whitened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DecimalType, DoubleType, IntegerType, StructField, StructType

from millrace.llm.texts import plain
from millrace.sources.tables import written

COMPONENTS = 16
#: Directions beyond the components asked for; they speed up the last of those.
GUARD = 8
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers of this size and more have no place in a long; their rows are dropped as if not finite.
_MOST = float(1 << 61)


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors with sums per dimension; unit vectors in columns by falling value, and what was certified.

    residual is the greatest norm of V x - e x by the greatest e. values, explained and vectors have no component whose
    value is nothing but rounding, so that there may be fewer than asked for, none if all fitted vectors are one.
    """

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    residual: float
    identity_error: float
    passes: int


def whole_vectors(rows: DataFrame, dimension: int, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and x, floor(64 c) + 1000000 of each entry c as 64-bit numbers in a row of bytes. Rows whose vector is null, of
    another dimension, or has null or non-finite entries are dropped."""
    kept = [c for c in (rows.columns if keep is None else keep) if c != "__x"]
    frame = rows.select(*map(plain, kept), plain(column).cast("array<double>").alias("__x"))
    out = StructType([*frame.schema.fields[:-1], StructField("__x", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, n = to_arrow_schema(out), len(kept)
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(n)), dimension))
            entries = np.ascontiguousarray(batch.column(n).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, dimension)  # null: nan
            whole = np.floor(SCALE * entries)
            good = (np.isfinite(entries) & (np.abs(whole) < _MOST)).all(axis=1)
            bytes_ = [v.tobytes() for v in whole[good].astype("<i8") + SHIFT]
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(good)) for c in batch.columns[:n]), pa.array(bytes_, schema.field(n).type)], schema=schema)

    return frame.mapInArrow(run, out)


def _numbers(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dimension)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where that holds all, in Python's whole numbers beyond."""
    most = max(map(int, (abs(x).max(initial=0), 1)))
    fits = n * most + max(map(abs, map(int, sums)), default=0) < 1 << 62
    return x * n - sums.astype(np.int64) if fits else x.astype(object) * n - sums


def _sums(fit: DataFrame, dimension: int) -> list[int]:
    out = StructType([StructField("i", IntegerType()), StructField("s", DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = _numbers(batch.column(0), dimension)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        whole = [Decimal((int(h) << 32) + int(v)) for h, v in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array(whole, pa.decimal128(38, 0))], schema=to_arrow_schema(out))

    got = {r.i: int(r.s) for r in fit.mapInArrow(run, out).groupBy("i").agg(F.sum("s").alias("s")).collect()}  # a row for each dimension
    return [got[i] for i in range(dimension)]


def _product(fit: DataFrame, block: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times a block of directions, and the covariance's trace, in one pass over the fitted vectors."""
    dimension, width = block.shape
    out = StructType([StructField("i", IntegerType()), *(StructField(f"v{j}", DoubleType()) for j in range(width + 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((dimension, width)), np.zeros(dimension)
        for batch in batches:
            c = _centred(_numbers(batch.column(0), dimension), n, sums).astype(np.float64) / n
            total += c.T @ (c @ block)
            squares += (c * c).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), *map(pa.array, total.T), pa.array(squares)], schema=to_arrow_schema(out))

    values = [F.sum(f"v{j}").alias(f"v{j}") for j in range(width + 1)]
    got = sorted(tuple(r) for r in fit.mapInArrow(run, out).groupBy("i").agg(*values).collect())  # a row for each dimension
    whole = np.array([r[1:] for r in got]) / n
    return whole[:, :-1], float(whole[:, -1].sum())


def _orthonormal(block: np.ndarray, image: np.ndarray | None, against: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray | None]:
    """A basis of what the block spans beyond the orthonormal blocks `against`; images under the covariance follow it."""
    size = np.linalg.norm(block, axis=0)
    if image is not None:
        image = image[:, size > 0] / size[size > 0]
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for other, its in against:
            part = other.T @ block
            block = block - other @ part
            image = None if image is None else image - its @ part
        if not block.shape[1]:
            break
        u, s, v = np.linalg.svd(block, full_matrices=False)
        held = s > 1e-10
        block = u[:, held]
        image = None if image is None else image @ v.T[:, held] / s[held]
    return block, image


def lobpcg(multiply, dimension: int, components: int, guard: int = GUARD, tolerance: float = 1e-13, most: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, images, passes) of the greatest eigenvalues of the symmetric operator multiply(block).

    It ends when the residuals of `components` vectors, from a product of their own, are below the tolerance by the
    greatest value, or stand still at the rounding of sums.
    """
    width = min(dimension, components + guard)
    x, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((dimension, width)))
    ax, passes = multiply(x), 1
    p = ap = np.zeros((dimension, 0))
    best, stood, fresh = np.inf, 0, True
    while True:
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        order = np.argsort(-values)
        values, x, ax = values[order], x @ turn[:, order], ax @ turn[:, order]
        r = ax - x * values
        worst = float(np.linalg.norm(r[:, :components], axis=0).max() / max(abs(values[0]), np.finfo(float).tiny))
        best, stood = (worst, 0) if worst < best / 2 else (best, stood + 1)
        if worst <= tolerance or passes >= most or (stood >= 8 and worst < 1e-9):
            if fresh or passes >= most:
                return values[:components], x[:, :components], ax[:, :components], passes
            x, _ = np.linalg.qr(x)
            ax, fresh, p, ap, stood, best = multiply(x), True, p[:, :0], ap[:, :0], 0, np.inf
            passes += 1
            continue
        p, ap = _orthonormal(p, ap, [(x, ax)])
        w, _ = _orthonormal(r, None, [(x, None), (p, None)])
        if not w.shape[1]:
            return values[:components], x[:, :components], ax[:, :components], passes
        aw, fresh = multiply(w), False
        passes += 1
        q, aq = np.hstack([x, w, p]), np.hstack([ax, aw, ap])
        inner = q.T @ aq
        _, c = np.linalg.eigh((inner + inner.T) / 2)
        c = c[:, ::-1][:, :width]
        own = x.shape[1]
        x, ax, p, ap = q @ c, aq @ c, q[:, own:] @ c[own:], aq[:, own:] @ c[own:]


def common_dimension(rows: DataFrame, column: str = "embedding") -> int:
    """The most frequent number of entries of vectors, the greater of equals; 0 if no vector has any."""
    n = F.size(plain(column))
    found = rows.filter(n > 0).groupBy(n.alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    return found.d if found else 0


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, guard: int = GUARD) -> Whitening:
    """Fits on each distinct whole-number vector once.

    Null vectors, those with null or non-finite entries (or such as no long holds) and those of another than the most
    frequent dimension take no part; no vectors give no components. Copies are folded before the shuffle.
    """
    dimension = common_dimension(rows, column)
    none = np.zeros(0)
    if not dimension:
        return Whitening(0, (), np.zeros((0, 0)), none, none, 0.0, 0.0, 0)
    distinct = written(whole_vectors(rows, dimension, column, []).distinct(), "vectors")
    n = distinct.count()
    whole = _sums(distinct, dimension) if n else [0] * dimension
    if n < 2:
        return Whitening(n, tuple(whole), np.zeros((dimension, 0)), none, none, 0.0, 0.0, 0)
    sums, trace = np.array(whole, object), 0.0

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal trace
        image, trace = _product(distinct, block, n, sums)
        return image

    values, vectors, images, passes = lobpcg(multiply, dimension, min(components, dimension), guard)
    held = values > 1e-13 * dimension * max(values[0], 0)
    values, vectors, images = values[held], vectors[:, held], images[:, held]
    residual = float(np.linalg.norm(images - vectors * values, axis=0).max(initial=0) / values[0]) if len(values) else 0.0
    scale = np.sqrt(values)
    error = float(np.abs((vectors.T @ images) / np.outer(scale, scale) - np.eye(len(values))).max(initial=0))
    return Whitening(n, tuple(whole), vectors, values, values / trace, residual, error, passes)


def whiten(rows: DataFrame, model: Whitening, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Adds deviation, the exact sum of (n x - S) ** 2 as a whole number of 38 digits, and whitened, an entry for each component.

    Rows that take no part in a fit are dropped, and repeated rows are each whitened. Without fitted vectors there are no
    rows. An input column named like an added one gives way.
    """
    kept = [c for c in (rows.columns if keep is None else keep) if c.lower() not in {"deviation", "whitened"}]
    dimension = len(model.sums) if model.n else 0
    frame = whole_vectors(rows, dimension, column, kept) if dimension else rows.limit(0).select(*map(plain, kept), F.lit(b"").alias("__x"))
    out = StructType([*frame.schema.fields[:-1], StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    n, sums, turn, scale = model.n, np.array(model.sums, object), model.vectors, np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last = to_arrow_schema(out), len(kept)
        for batch in batches:
            c = _centred(_numbers(batch.column(last), dimension), n, sums)
            if c.dtype == object or dimension * int(abs(c).max(initial=0)) ** 2 >= 1 << 62:
                c = c.astype(object)
            deviation = pa.array([Decimal(int(v)) for v in (c * c).sum(axis=1)], pa.decimal128(38, 0))
            white = (c.astype(np.float64) / n) @ turn / scale
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * turn.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], deviation, pa.ListArray.from_arrays(ends, pa.array(white.ravel())).cast(schema.field(last + 1).type)], schema=schema)

    return frame.mapInArrow(run, out)
