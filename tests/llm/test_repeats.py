"""Repeated byte strings against brute force, with frequent anchors, colliding hashes and awkward ids."""

from __future__ import annotations

import random

import numpy as np
import pytest

from palimpsest.llm import repeats


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    old = repeats.chunked
    monkeypatch.setattr(repeats, "chunked", lambda d, i, t: old(d, i, t, 6_000))


def check(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op10_query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == repeats.brute_force(rows)


def noise(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.mark.parametrize("hot", [0, 1, 3, 10**9])
def test_frequent_line_in_varying_text(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(1)
    line = "Licensed under the terms that every one of these documents repeats word by word."
    rows = [(i, noise(rng, rng.randint(0, 60)) + line[: rng.randint(55, len(line))] + noise(rng, rng.randint(0, 60))) for i in range(300)]
    check(spark, [*rows, *((1000 + i, line) for i in range(20)), (2000, line + line), (2001, None), (2002, line[:49]), (2003, line[:50])])


def test_ten_thousand_documents_with_one_line(spark, monkeypatch):
    old = repeats.chunked
    monkeypatch.setattr(repeats, "chunked", lambda d, i, t: old(d, i, t))
    rng = random.Random(2)
    line = "This line of a licence is in each and every document, whatever else that says. "
    rows = [(i, noise(rng, 20) + line + noise(rng, 20)) for i in range(10_000)]
    check(spark, rows)


def test_bytes_decide_and_not_hashes(spark, monkeypatch):
    """With a hash of very few values results stay the same."""
    real = repeats.Chunk.hashes
    monkeypatch.setattr(repeats.Chunk, "hashes", lambda self, at, length: real(self, at, length) % np.uint64(3))
    rng = random.Random(3)
    base = [noise(rng, 90) for _ in range(6)]
    check(spark, [(i, base[rng.randrange(6)][rng.randint(0, 20) :] + rng.choice(["", "é", noise(rng, 5)]) + base[rng.randrange(6)]) for i in range(60)])


def test_previous_factors_against_all_pairs():
    rng = np.random.default_rng(4)
    kind = repeats.entry_type(2, 3)
    e = np.zeros(400, kind)
    e["doc"], e["left"], e["right"] = rng.integers(0, 30, 400), rng.integers(0, 4, 400), rng.integers(0, 4, 400)
    e["text"] = rng.integers(0, 2, (400, 8))
    masks = repeats.previous_factors(e, 3)
    for i in range(400):
        for a in range(4):
            want = e["left"][i] >= a and e["right"][i] >= 3 - a and any(
                f["doc"] < e["doc"][i] and f["left"] >= a and f["right"] >= 3 - a and (f["text"][3 - a : 8 - a] == e["text"][i][3 - a : 8 - a]).all()
                for f in e
            )
            assert bool(masks[i] >> a & 1) == want
