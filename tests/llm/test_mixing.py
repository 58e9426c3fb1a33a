"""Mixing sources: targets by exact fractions, sums by brute force, and odd rows."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def size(text: str | None) -> int:
    return len(WORD.findall(text or ""))


def exact_targets(rows: list[tuple], weights=(3, 1, 2), share=Fraction(3, 2), most=2) -> dict:
    """Cut what is above its limit and share the rest again, until nothing is."""
    own = Counter()
    for _, text, source in rows:
        own[source] += size(text)
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = {s for s in names if not own[s]}, share * sum(own.values())
    while True:
        rest = budget - sum(most * own[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        given = {s: most * own[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and given[s] >= most * own[s]}
        if not over:
            return {s: (own[s], given[s]) for s in names}
        full |= over


def corpus() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for i in range(700):
        source = rng.choice(["a", "b", "c", "é", "😀", None, "", "tiny"] if i % 3 else ["a"])
        rows.append((i, " ".join("w" * rng.randint(1, 5) for _ in range(int(rng.expovariate(1 / 40)) + 1)), source if source != "tiny" or i % 40 == 0 else "b"))
    rows += [(i, "one two three", "hot") for i in range(1000, 1600)]
    rows += [(None, "one two three", "hot")] * 300 + [(7, "again and again", "b")] * 40
    rows += [(2000, None, "a"), (2001, "", "blank"), (2002, " \t\n", "blank"), (2003, "x " * 30_000, "long"), (2004, "\xa0 \x0b\x1c", "a")]
    return rows


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit(1) for c in ("src", "size", "salt", "n", "rows", "target", "range", "u", "nth")})
    return [sorted(mixing.op11_query(df.repartition(parts)).collect(), key=lambda r: (r.doc_id is not None, r)) for parts in (3, 11)]


def test_reruns_agree(result):
    assert result[0] == result[1]


def test_targets(result):
    rows = corpus()
    want = exact_targets(rows)
    of = {(s[0]): s for s in want.values()}
    assert len(result[0]) == len(rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in result[0]) == sorted((-1 if i is None else i, size(t)) for i, t, _ in rows)
    taken = Counter()
    for r in result[0]:
        assert r.target == pytest.approx(float(of[r.source_size][1])), r
        assert r.size == 0 and r.taken == 0 or r.taken // r.size in (0, 1, 2) and r.taken % r.size == 0
        taken[r.source_size] += r.taken
    for source, (own, goal) in want.items():
        # multiples of three only; one document only; few documents
        apart = {"hot": 1.5, "long": own, "tiny": 40}.get(source, 0.5)
        assert abs(taken[own] - goal) <= apart, (source, own, goal, taken[own])


def test_lengths_keep_their_shares():
    sizes, counts = list(range(1, 200)), [50] * 199
    taken = mixing.chosen_counts(sizes, counts, 400_000)
    assert sum(s * t for s, t in zip(sizes, taken, strict=True)) == 400_000
    assert all(abs(t / 50 - 400_000 / sum(s * 50 for s in sizes)) < 0.1 for s, t in zip(sizes, taken, strict=True) if s > 60)


def test_nearest_sum_against_all_choices():
    rng = random.Random(5)
    for _ in range(300):
        sizes = sorted(rng.sample(range(0, 30), rng.randint(1, 4)))
        counts = [rng.randint(1, 3) for _ in sizes]
        budget = rng.randint(0, sum(s * n for s, n in zip(sizes, counts, strict=True)))
        sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*(range(n + 1) for n in counts))}
        found = mixing.fitted(sizes, counts, budget)
        assert all(found[s] <= counts[sizes.index(s)] for s in found)
        assert sum(s * n for s, n in found.items()) == min(sums, key=lambda s: (abs(s - budget), s))
        whole = mixing.chosen_counts(sizes, counts, budget)
        assert all(0 <= t <= n for t, n in zip(whole, counts, strict=True))


def test_mixed_rows(spark, result):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"src": F.lit(1), "nth": F.col("doc_id")}).repartition(4)
    got = mixing.mixed(df)
    assert got.columns == df.columns
    made = Counter()
    for r in got.collect():
        made[r.doc_id, size(r.text)] += size(r.text)
    want = Counter()
    for r in result[0]:
        want[r.doc_id, r.size] += r.taken
    assert made == +want


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.op11_query(df).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.op11_query(df.limit(0)).collect() == [] and mixing.mixed(df).collect() == []
