"""Shallot k-means against plain Lloyd rounds, and odd vectors."""

from __future__ import annotations

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import clustering

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>"


def lloyd(rows: list[tuple], k: int, d: int, factor: int, rounds: int, seed: int):
    """(vec_id, cluster, distance) in the order of the usable rows, and the centroids, in Python's whole numbers."""
    kept = [(i, [int(np.floor(factor * c)) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) and abs(c) < 1 << 19 for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in order[:k]]
    for left in range(rounds, -1, -1):
        put = [min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c)) for _, x in kept]
        for j in range(len(c)) if left else []:
            if own := [x for (_, x), (_, p) in zip(kept, put, strict=True) if p == j]:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, j, dist) for (i, _), (dist, j) in zip(kept, put, strict=True)], c


def shapes() -> dict[str, list[tuple]]:
    rng = np.random.default_rng(4)
    spread = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 6)))]
    lumps = [(i, (rng.integers(0, 3, 6) + rng.standard_normal(6) * 0.02).tolist()) for i in range(400)]
    ties = [(i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(300)]
    return {"spread": spread, "lumps": lumps, "ties": ties, "equal": [(i, [1.0] * 6) for i in range(50)], "few": spread[:3], "one": spread[:1], "cone": [(i, (v * 0.01 + 5).tolist()) for i, v in enumerate(rng.standard_normal((300, 6)))]}


@pytest.mark.parametrize("shape", shapes())
@pytest.mark.parametrize("k", [1, 2, 9])
def test_as_plain_rounds(spark, shape, k):
    rows = shapes()[shape]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    state, c = clustering.clusters(df, k=k, dimension=6, factor=16, rounds=4, seed=7)
    want, centroids = lloyd(rows, k, 6, 16, 4, 7)
    assert c.tolist() == centroids
    assert sorted((r.vec_id, r.near, r.distance) for r in state.collect()) == sorted(want)


def test_bounds_save_comparisons():
    """After the first round most vectors of separate lumps are not searched again."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-1000, 1000, (12, 8))
    x = np.repeat(middle, 50, axis=0) + rng.integers(-5, 6, (600, 8))
    state = [np.zeros(600, np.int32), np.ones(600, np.int32), np.full(600, np.inf), np.zeros(600)]
    clustering.Search(middle, None).assign(x, *state)
    assert (state[0] == np.repeat(np.arange(12), 50)).all()
    again = clustering.Search(middle + 1, np.full(12, np.sqrt(8) * (1 + clustering.SLACK)))
    again.search = lambda *_: pytest.fail("searched")
    again.assign(x, *state)


def test_odd_vectors(spark):
    ok = [float(i % 5) for i in range(64)]
    rows = [(None, ok), (None, ok), (1, ok), (1, [x + 1 for x in ok]), (2, None), (3, []), (4, ok[:63]), (5, [*ok[:63], None]), (6, [*ok[:63], float("nan")]), (7, [*ok[:63], float("-inf")]), (8, [*ok[:63], 1e300]), (9, [-x for x in ok])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("x", "near", "second", "upper", "distance", "label", "own", "v")})
    want, centroids = lloyd(rows, 40, 64, 256, 5, 2)
    got = clustering.op13_query(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in got)
    assert clustering.op13_query(df.limit(0)).collect() == []
    assert clustering.op13_query(df.where("vec_id = 2")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_oracle(spark):
    got = clustering.op13_query(spark.read.parquet(f"{SF}/embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({clustering.OP13_SQL})").fetchall()
    assert len(want) > 400 and sorted(map(tuple, got.collect())) == sorted(want)
