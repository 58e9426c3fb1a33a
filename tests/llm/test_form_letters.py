"""Form letters: many different sets that share most of their tokens."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import jaccard_join


def letters(n: int, names: int, seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    body = [f"word{rng.randrange(5000)}" for _ in range(90)]
    rows = []
    for i in range(n):
        w = list(body)
        for field, at in enumerate((15, 45, 75)):
            w[at] = f"name{field}x{rng.randrange(names)}"
        rows.append((i, " ".join(w[: len(w) - rng.randrange(3)])))
    return rows


@pytest.mark.parametrize(("names", "linked"), [(6, 1.0), (30, 1.0), (6, 0.5), (12, 0.0)])
def test_blocks_beside_the_largest_component(spark, monkeypatch, names, linked):
    """Whatever part of the links the first pass finds, the blocks find what joins the rest."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    by_head = jaccard_join.links_by_head
    monkeypatch.setattr(jaccard_join, "links_by_head", lambda nodes, percent: by_head(nodes, percent).where(F.pmod(F.xxhash64("a", "b"), F.lit(100)) < 100 * linked))
    rows = letters(120, names, names)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == jaccard_join.brute_force(rows, 3, 90)


def test_neighbours_join_most_letters(spark):
    """Few sets are left for blocks, so their work does not grow with the square of the letters."""
    rows = letters(3000, 20, 1)
    nodes = jaccard_join.document_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, "doc_id", "text").where("tokens IS NOT NULL")
    found = jaccard_join.components(jaccard_join.links_by_head(nodes.select("id", "n", "tokens"), 90))
    largest = found.groupBy("component").count().agg(F.max("count")).first()[0]
    assert largest >= 0.98 * nodes.count() > 2000
