"""Sampled segmentations against enumerated ones."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import piece_sampling as ps


@pytest.fixture(scope="module")
def lattice():
    return ps.Lattice(ps.model_path(), 1.0)


def ways_of(m: ps.Lattice, unit: str) -> dict[tuple[int, ...], float]:
    """Probability of each segmentation of a unit."""
    pieces = {t.decode(): i for i, t in enumerate(m.text) if t and i not in set(m.byte_ids.tolist())}
    found: dict[tuple[int, ...], float] = {}

    def split(at: int, so_far: tuple[int, ...], weight: float) -> None:
        if at == len(unit):
            found[so_far] = math.exp(weight)
        for n in range(1, len(unit) - at + 1):
            p = unit[at : at + n]
            if p in pieces:
                split(at + n, (*so_far, pieces[p]), weight + m.weight[pieces[p]])
            elif n == 1:
                raw = p.encode()
                split(at + 1, (*so_far, *m.byte_ids[list(raw)].tolist()), weight + ps.BYTE_WEIGHT * len(raw))

    split(0, (), 0.0)
    return {w: x / sum(found.values()) for w, x in found.items()}


@pytest.mark.parametrize("unit", [" the", "   ", "  stone", "anders", "über", "a😀b", "▁x", "日本語", "x" * 9])
def test_frequencies(lattice, unit):
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in lattice.sample([unit] * n, list(range(n))))
    ways = ways_of(lattice, unit)
    assert set(drawn) <= set(ways)
    for w, p in ways.items():
        assert abs(drawn[w] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_draws_depend_on_key_and_place_only(lattice, monkeypatch):
    """Not on what the table holds, when it is emptied, or how long texts are cut."""
    texts = ["the stone house " * 40 + f"w{i}x " * i for i in range(30)] + ["", " ", "a  b " * 500]
    keys = list(range(len(texts)))
    want = [x.tolist() for x in ps.Lattice(ps.model_path(), 1.0).sample(texts, keys)]
    monkeypatch.setattr(ps, "BLOCK", 64)
    monkeypatch.setattr(ps, "TABLE_NODES", 40)
    lattice.forget()
    assert [x.tolist() for x in lattice.sample(texts, keys)] == want
    assert [lattice.sample([t], [k])[0].tolist() for t, k in zip(texts, keys, strict=True)] == want
    assert [lattice.decode(x) for x in want] == texts


def test_long_texts(lattice):
    for text in ("y" * 100_000, "stone " * 300_000, " " * 100_000, "é日" * 20_000):
        (ids,) = lattice.sample([text], [1])
        assert lattice.decode(ids.tolist()) == text
        assert ids.dtype == np.int32


def test_units_are_filtered_in_portions(monkeypatch):
    """Portions hold all units in order, none much over the bound, and give the same segmentations."""
    units = [" a" * n for n in range(1, 60)] + ["x" * 500, " b"]
    parts = list(ps.portions(units, 100))
    assert [u for p in parts for u in p] == units and all(sum(map(len, p)) <= 100 or len(p) == 1 for p in parts) and list(ps.portions([], 5)) == []
    texts = [" the stone and the river " * 20, "über das Feld 日本語 " * 9, ""]
    want = [x.tolist() for x in ps.Lattice(ps.model_path(), 1.0).sample(texts, [1, 2, 3])]
    monkeypatch.setattr(ps, "LEARNED", 7)
    assert [x.tolist() for x in ps.Lattice(ps.model_path(), 1.0).sample(texts, [1, 2, 3])] == want


def test_one_worker_draws_and_tells(spark):
    """The query has one Python step; its digests are those of the operator's ids."""
    docs = spark.createDataFrame([(1, "the stone"), (2, None), (3, ""), (4, "a😀b river")], "doc_id bigint, text string")
    got = ps.op6_query(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    ids = {r.doc_id: r.ids or [] for r in ps.encode(docs, ps.model_path()).collect()}
    assert {r.doc_id: (r.n_pieces, r.ids_crc32) for r in got.collect()} == {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in ids.items()}
