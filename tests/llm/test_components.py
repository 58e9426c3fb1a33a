"""Connected components against union-find, in one task and in rounds."""

from __future__ import annotations

import random

import pytest

from palimpsest.llm import components


def expected(edges: list[tuple[int, int]]) -> dict[int, int]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return {x: top(x) for x in list(root)}


def graph(kind: str) -> list[tuple[int, int]]:
    rng = random.Random(kind)
    if kind == "chain":
        ids = rng.sample(range(10_000), 300)
        return list(zip(ids, ids[1:]))
    if kind == "star":
        return [(5_000, x) for x in range(6_000, 9_000)] + [(5_000, 3)]
    if kind == "random":
        return [(rng.randrange(2_000), rng.randrange(2_000)) for _ in range(1_500)]
    return {"loops": [(1, 1), (2, 3), (3, 2), (3, 2)], "none": []}[kind]


@pytest.mark.parametrize("local", [10**6, 40])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "none"])
def test_components(spark, monkeypatch, kind, local):
    monkeypatch.setattr(components, "LOCAL", local)
    edges = graph(kind)
    df = spark.createDataFrame([*edges, (None, 4), (5, None)], "a bigint, b bigint").repartition(7)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == expected([(a, b) for a, b in edges if a != b])
