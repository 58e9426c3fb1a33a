"""Whitening against numpy's eigenvectors of the whole covariance, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>"


def whole(vectors: np.ndarray, k: int):
    """x-vectors, variances, components and trace in one place."""
    x = np.floor(1024 * vectors).astype(np.int64) + 100_000
    y = (len(x) * x - x.sum(axis=0)) / len(x)
    e, v = np.linalg.eigh(y.T @ y / len(x))
    return x, y, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def data(shape: str) -> np.ndarray:
    rng = np.random.default_rng(12)
    if shape == "spread":
        return rng.standard_normal((700, 12)) * np.linspace(3, 0.5, 12)
    if shape == "steep":
        return rng.standard_normal((700, 12)) @ (np.diag(np.logspace(4, -2, 12)) @ np.linalg.qr(rng.standard_normal((12, 12)))[0])
    if shape == "flat":
        return rng.standard_normal((700, 3)) @ rng.standard_normal((3, 12)) * 0 + np.column_stack([rng.integers(-50, 50, (700, 3)), np.zeros((700, 9))])
    return rng.standard_normal((700, 12)) * 0.01 * np.linspace(3, 1, 12) + 900.0


@pytest.mark.parametrize("shape", ["spread", "steep", "flat", "far"])
def test_as_in_one_place(spark, shape):
    v = data(shape)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA).repartition(5)
    got = whitening.op12_query(df).collect()
    x, y, e, vec, trace = whole(v, 8)
    rank = 3 if shape == "flat" else 8
    assert len(got) == 700 * rank
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    table = np.full((700, rank), np.nan)
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 700 and r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None)
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-6) and r.identity_error <= 1e-8
    want = y @ vec[:, :rank] / np.sqrt(e[:rank])
    sign = np.sign((table * want).sum(axis=0))
    assert np.allclose(table, want * sign, atol=1e-5 if shape == "steep" else 1e-7)
    assert len({r.identity_error for r in got}) == 1


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, x.tolist()) for i, x in enumerate(data("spread"))]
    made = []
    for parts in (1, 7):
        out = whitening.op12_query(spark.createDataFrame(rows, SCHEMA).repartition(parts)).orderBy("vec_id", "component").collect()
        made.append(np.array([r.whitened for r in out]))
    assert np.allclose(*made, atol=1e-9)


def test_odd_vectors(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [3.0, 2.5]), (1, [-1.0, 0.25]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1e300, 1.0]), (9, [1e8, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("x", "v", "n", "component", "label")})
    got = whitening.op12_query(df).collect()
    used = np.array([v for i, v in rows if v and len(v) == 2 and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1 << 30])
    x, y, e, vec, _ = whole(used, 2)
    assert sorted(r.vec_id or 0 for r in got) == sorted(2 * [i or 0 for i, v in rows if v and len(v) == 2 and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1 << 30])
    big = [r.whitened for r in got if r.vec_id == 9 and r.component == 1]
    assert abs(big[0]) == pytest.approx(abs((y @ vec[:, 0] / np.sqrt(e[0]))[-1]))
    sums = [int(s) for s in x.sum(axis=0)]
    want = sorted(sum((len(x) * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)
    assert sorted(r.deviation or 0 for r in got if r.component == 1) == sorted(w if w < 1 << 63 else 0 for w in want)
    for part in (df.limit(0), df.where("vec_id IS NULL"), df.where("vec_id = 2")):
        assert whitening.op12_query(part).collect() == []


def test_large_numbers_stay_exact():
    c = whitening.Centre(1 << 40, [3, 5])
    x = np.array([[1 << 39, -(1 << 38)]])
    want = [(1 << 79) - 3, -(1 << 78) - 5]
    assert c.off(x).tolist() == [want] and c.deviation(x) == [None]
    assert c.centred(x)[0] == pytest.approx([w / (1 << 40) for w in want])
