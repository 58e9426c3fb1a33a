"""Packing against best-fit decreasing in one place, and the encoder against the tokenizer."""

from __future__ import annotations

import json
import random
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import packing


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            n, gap = n + 1, capacity
        if gap > length:
            insort(gaps, gap - length)
    return n


def lengths_of(kind: str) -> list[int]:
    rng = random.Random(kind)
    if kind == "mixed":
        return [rng.choice([rng.randint(1, 2048), rng.randint(1, 90), 700, 2048]) for _ in range(6000)]
    if kind == "prose":
        return [min(2048, max(1, int(rng.lognormvariate(5, 1.1)))) for _ in range(6000)]
    if kind == "one length":
        return [700] * 4000 + [600] * 3000
    return {"full": [2048] * 500, "tiny": [1] * 5000, "single": [5], "none": []}[kind]


@pytest.mark.parametrize("kind", ["mixed", "prose", "one length", "full", "tiny", "single", "none"])
@pytest.mark.parametrize("share", [10**6, 1000])
def test_number_of_sequences(spark, kind, share):
    lengths = lengths_of(kind)
    cut = spark.createDataFrame([(i % 7 or None, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(5)
    rows = packing.pack(cut, share=share).collect()
    assert Counter(r.length for r in rows) == Counter(lengths)
    inside: dict[int, list] = {}
    for r in rows:
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    best = best_fit_decreasing(lengths, 2048)
    assert len(inside) == best if share > len(lengths) else len(inside) <= best * 1.01 + len(lengths) // share


def test_encoder_follows_the_file(tmp_path):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = ["The river's stone, 12 a.m. -- don't", "naïve café x", "a\x1cb", "<|endoftext|> x", "日本 😀", "", " \n ", "İß"]
    with open(path, encoding="utf-8") as f:
        other = json.load(f)
    other["normalizer"] = None
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"
    changed = tmp_path / "other.json"
    changed.write_text(json.dumps(other), encoding="utf-8")
    for file, by_units in ((path, True), (str(changed), False)):
        encode, whole = packing.Encoder(file), Tokenizer.from_file(file)
        assert encode.by_units == by_units
        for t in texts:
            assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_odd_documents(spark):
    rows = [(None, None), (None, "the river"), (None, "the river"), (1, ""), (1, "stone " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("gap", "rank", "task", "length", "sequence_id", "offset")})
    got = sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in packing.op1_query(df).collect())
    assert got == [(0, 0, 0, 1), (0, 0, 0, 3), (0, 0, 0, 3), (1, 0, 0, 1), (1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 905)]
