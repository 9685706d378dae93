"""Whitening against a dense decomposition, whole-number sums, close and missing values, odd rows and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, whitening
from tests.llm.test_operators import FOLDER


def dense(x):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    return n, sums, e[::-1], u[:, ::-1], v


def test_query_against_a_dense_decomposition(spark):
    own = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(own.embedding).astype(float)).astype(np.int64) + 1_000_000
    n, sums, e, u, v = dense(x)
    got = queries.op13_embedding_whitening(spark, FOLDER).toPandas().sort_values(["vec_id", "component"])
    assert got.component.tolist() == list(range(1, 17)) * len(own) and (got.n == n).all() and got.identity_error.max() < 1e-10
    white = got.whitened.to_numpy().reshape(-1, 16)
    want = ((n * x - sums) / n) @ u[:, :16] / np.sqrt(e[:16])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-8
    assert (got.deviation.to_numpy()[::16] == ((n * x - sums) ** 2).sum(axis=1)).all()
    assert np.allclose(got.explained.to_numpy()[:16], e[:16] / np.trace(v), rtol=1e-12)


@pytest.mark.parametrize("dimension, gap", [(200, 1e-2), (120, 1e-4), (5, 0.5), (1, 1.0)])
def test_iteration_on_spectra(dimension, gap):
    draw = np.random.default_rng(dimension)
    u, _ = np.linalg.qr(draw.standard_normal((dimension, dimension)))
    e = np.sort(np.exp(-gap * np.arange(dimension)))[::-1]
    v = (u * e) @ u.T
    values, vectors, images, passes = whitening.lobpcg(lambda b: v @ b, dimension, min(16, dimension))
    k = len(values)
    assert k == min(16, dimension) and np.abs(values - e[:k]).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_few_directions(spark):
    """Three directions in eight dimensions: three components; one vector only, none."""
    draw = np.random.default_rng(1)
    rows = [(i, [float(a), float(b), float(c), float(a), 0.0, 1.0, 2.0, float(b)]) for i, (a, b, c) in enumerate(draw.standard_normal((300, 3)).round(2))]
    frame = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    assert len(model.values) in (3, 4, 5) and model.identity_error < 1e-8  # a and c's roundings differ by no more than one
    white = np.array([r.whitened for r in whitening.whiten(frame, model).collect()])
    assert white.shape == (350, len(model.values))
    alone = whitening.fit(frame.filter("vec_id = 0"))
    assert alone.n == 1 and [r.whitened for r in whitening.whiten(frame.filter("vec_id = 0"), alone).collect()] == [[]] * 2


def test_odd_rows_and_large_numbers(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1e300, 1.0]), (6, [1.0]), (7, []), (8, [0.5, -0.5]), (8, [0.5, -0.5]), (None, [-1.25, 2.0]), (9, [3e15, -2e15])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("clash") for n in ("whitened", "Deviation", "extra")})
    model = whitening.fit(frame)
    got = whitening.whiten(frame, model)
    assert got.columns == ["vec_id", "embedding", "extra", "deviation", "whitened"]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in [rows[7], rows[9], rows[10]]]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in zip((8, None, 9), x)}
    assert model.n == 3 and model.sums == tuple(sums)
    assert sorted(((r.vec_id, int(r.deviation)) for r in got.collect()), key=repr) == sorted([(8, want[8]), *want.items()], key=repr)
    empty = frame.limit(0)
    assert whitening.whiten(empty, whitening.fit(empty)).collect() == [] and whitening.whiten(frame, whitening.fit(frame.filter("vec_id < 8 and vec_id <> 6"))).collect() == []
