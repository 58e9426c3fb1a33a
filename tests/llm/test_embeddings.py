"""Near-duplicate embeddings against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import embedding_dedup as ed


def all_pairs(rows: list[tuple], least: float = 0.98) -> list[tuple[int, int]]:
    """(n_links, component_id) of each row, by place; usable vectors of one length only."""
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([lab for *_, lab in rows])
    near = (x @ x.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in part:
                    part.add(j)
                    todo.append(j)
        seen |= part
        for j in part:
            out[j] = (int(near[j].sum()), min(rows[k][0] for k in part))
    return out


def test_repeated_ids_keep_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (3, [0.01, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.op3_query(df).collect())
    assert got == sorted((i, n, c, i == c) for (i, *_), (n, c) in zip(rows, all_pairs(rows), strict=True))


@pytest.mark.parametrize("partitions", [2, 7, 50])
def test_recall_does_not_depend_on_partitions(spark, partitions):
    """5,000 vectors, half of them in chains and clusters around the threshold."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((2600, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[rng.integers(0, 400, 2400)] + rng.standard_normal((2400, 16)) * 0.035
    x = np.concatenate((base, near))
    rows = [(int(i), [float(c) for c in v], 1 if i % 10 else 2) for i, v in zip(rng.permutation(5000), x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.vec_id: (r.n_links, r.component_id) for r in ed.op3_query(df).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {i: w for (i, *_), w in zip(rows, all_pairs(rows), strict=True)}
    assert len(got) == len(want)
    assert all(n <= want[i][0] for i, (n, _) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_windows_cross_borders(spark, partitions):
    """One pass: the links are those of the whole order, whatever its ranges."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 8))
    x = base[rng.integers(0, 30, 300)] + rng.standard_normal((300, 8)) * 0.02
    nodes = spark.createDataFrame([(i, "8:a", v.tobytes(), np.zeros(8).tobytes()) for i, v in enumerate(x)], "id bigint, label string, vector binary, mean binary")
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = [(r.a, r.b) for r in ed.window_links(nodes, 0.98, 1, 4).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    plane = np.random.default_rng((ed.SEED, 0)).standard_normal((8, ed.HASH_BITS))
    order = sorted(range(300), key=lambda i: (tuple((unit[i] @ plane > 0).tolist()), i))
    groups, want = ed.Groups(), ed.Groups()
    for i, a in enumerate(order):
        for b in order[max(0, i - 4) : i]:
            if unit[a] @ unit[b] >= 0.98:
                want.join(a, b)
    for a, b in links:
        groups.join(a, b)
    assert [groups.top(i) for i in range(300)] == [want.top(i) for i in range(300)]


def spread(mean_cosine: float, n: int, d: int = 64) -> np.ndarray:
    """Unit vectors whose pairs have that cosine on average, a tenth of them pairs at 0.981."""
    rng = np.random.default_rng(int(mean_cosine * 100))
    m = n - n // 20
    x = rng.standard_normal((m, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.zeros(d)
    axis[0] = 1
    x = np.sqrt(1 - mean_cosine) * x + np.sqrt(mean_cosine) * axis
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((n - m, d))
    u -= (u * x[: n - m]).sum(axis=1, keepdims=True) * x[: n - m]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.concatenate((x, 0.981 * x[: n - m] + np.sqrt(1 - 0.981**2) * u))


def test_passes_follow_from_agreement():
    made = {}
    for c in (0.0, 0.8, 0.94):
        x = spread(c, 2000)
        near, far = ed.agreement(x, x.mean(axis=0), 0.98)
        plans = [ed.passes_for(10**k, near, far) for k in range(1, 8)]
        made[c] = [p * (ed.SORTING + w) for p, w in plans]
        assert made[c] == sorted(made[c]) and plans[0] == (4, ed.WINDOWS[0])
        assert far[:6] == pytest.approx([0.5**k for k in range(6)], rel=0.15)
    assert all(a <= b <= c for a, b, c in zip(*made.values(), strict=True)) and made[0.94][4] > 3 * made[0.0][4]


@pytest.mark.parametrize("mean_cosine", [0.0, 0.8, 0.9, 0.94])
def test_recall_in_cones(spark, mean_cosine):
    """20,000 vectors of one label against all pairs."""
    x = spread(mean_cosine, 20_000)
    ends = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 2000):
        near = x[lo : lo + 2000] @ x.T >= 0.98
        ends[lo : lo + 2000] = near.sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in ed.op3_query(df).collect()}
    assert len(got) == len(x) and all(got[i] <= n for i, n in enumerate(ends.tolist()))
    assert ends.sum() >= 2000 and sum(got.values()) >= 0.99 * ends.sum()


def test_odd_vectors(spark):
    rows = [(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 2.0], None), (None, None, None), (8, [1.0, 2.0, 3.0], 1), (9, [1e300, 2e300], 1), (10, [1e-300, 2e-300], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "copies", "component", "first", "size")})
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.op3_query(df).collect()]
    want = [(i, 0, i, True) for i in range(2, 9)] + [(None, 0, None, True), (None, 3, None, False)] + [(1, 3, 1, True), (9, 3, 1, False), (10, 3, 1, False)]
    # a null id links as any other, and its component is null
    assert sorted((i or -1, n, c or -1) for i, n, c, _ in got) == sorted((i or -1, n, c or -1) for i, n, c, _ in want)


def test_every_label_plans_for_itself(spark, monkeypatch):
    """One label of 60 in a cone among 500 of 24 vectors that no window cuts: its own vectors, 1 of 200, tell which window it needs."""
    rng = np.random.default_rng(8)
    easy = [(i, v, i // 24) for i, v in enumerate(rng.standard_normal((12_000, 32)).tolist())]
    hard = [(12_000 + i, v, 500) for i, v in enumerate(spread(0.97, 60, 32).tolist())]
    made, links = [], ed.window_links
    monkeypatch.setattr(ed, "window_links", lambda nodes, least, passes, window: made.append((passes, window)) or links(nodes, least, passes, window))
    assert ed.op3_query(spark.createDataFrame(easy + hard, "vec_id bigint, embedding array<double>, label int")).count() == 12_060
    x = spread(0.97, 60, 32)
    own = ed.passes_for(60, *ed.agreement(x, x.mean(axis=0), 0.98))
    assert made == [own] and own[1] > ed.WINDOWS[0]
