"""Values over awkward rows: null and repeated ids, nulls, empty and long texts, repeated rows, columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, jaccard_join, pii, piece_sampling, repeats, secrets, suffix_tree_lm

NAMES = ("chunk", "bucket", "data", "kind", "norm", "salt", "sha", "length", "rank", "task", "gap", "id", "node", "component", "n", "tokens", "held_out", "score", "kept", "spans", "sequence_id", "digest", "c", "ids")


def rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("river stone house water light under morning garden wall".split()) + rng.choice("abcdefgh") for _ in range(n))
    one, two, long = words(40), words(60), words(30_000)
    return [
        (None, None), (None, one), (None, one), (None, two), (1, one), (1, one), (1, two), (2, one.upper()), (3, ""), (4, long), (5, long[:1000] + " and more " + long[-900:]), (6, two + " more"), (7, "a.b@example.org 4111 1111 1111 1111 token = abcdefghijklmnop"),
        (8, None), (9, " \n "), (-5, two), (10, "é" * 60 + "😀\x00"), (11, "é" * 60),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id bigint, text string").withColumns({c: F.lit(1) for c in NAMES}).repartition(3)


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def spans_of(found) -> tuple[str, str]:
    text = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in s)
    return hashlib.sha256(text([x for x in found if x[4]]).encode()).hexdigest(), text(found)


def test_pii(docs):
    want = [(i, *spans_of(pii.find_spans(t or "")), ",".join(f"{s[3]:.1f}" for s in pii.find_spans(t or ""))) for i, t in rows()]
    same([(r.doc_id, r.base_sha256, r.spans, r.scores) for r in pii.op4_query(docs).collect()], want)
    assert any(x[3] for x in want)


def test_pii_context_raises_the_score():
    bare, near = (pii.find_spans(t)[0] for t in ("xx 192.0.2.7 xx", "the server 192.0.2.7 xx"))
    assert near[3] - bare[3] == pytest.approx(pii.CONTEXT_BONUS)


def test_secrets(docs):
    same([(r.doc_id, r.base_sha256, r.spans) for r in secrets.op5_query(docs).collect()], [(i, *spans_of(secrets.find_secrets_in(t or ""))) for i, t in rows()])


def test_piece_sampling(docs):
    same([(r.doc_id, r.text_sha256) for r in piece_sampling.op6_query(docs).collect()], [(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows()])


def test_base_scores(docs):
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = c.total(), len(c)
    want = [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 3)) for i, ws in tokens]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in suffix_tree_lm.op7_query(docs).collect()], want)


def test_exact_dedup(docs):
    low = [(i, (t or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for i, t in rows()]
    want = []
    for i, t in low:
        ids = [j for j, u in low if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    same([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.op8_query(docs).collect()], want)


def test_jaccard(docs):
    named = [(i, t) for i, t in rows() if i is not None]
    numbered = jaccard_join.brute_force([(k, t) for k, (_, t) in enumerate(named)], 3, 90)
    # rows of one id are one node
    root = {k: numbered[k][1] for k in numbered}
    for k, (i, _) in enumerate(named):
        for m, (j, _) in enumerate(named):
            if i == j and root[k] != root[m]:
                old, new = root[m], root[k]
                root = {x: new if r == old else r for x, r in root.items()}
    least = {r: min(named[k][0] for k in root if root[k] == r) for r in root.values()}
    want = [(i, numbered[k][0], least[root[k]]) for k, (i, _) in enumerate(named)]
    want += [(None, jaccard_join.brute_force([(0, t)], 3, 90)[0][0], None) for i, t in rows() if i is None]
    same([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op9_query(docs).collect()], want)


def test_repeats(docs):
    raw = [(-(10**9) if i is None else i, (t or "").encode()) for i, t in rows()]
    first: dict[bytes, int] = {}
    for i, x in raw:
        for p in range(len(x) - 49):
            first[x[p : p + 50]] = min(i, first.get(x[p : p + 50], i))
    want = []
    for (i, x), (doc, _) in zip(raw, rows(), strict=True):
        gone = bytearray(len(x))
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        want.append((doc, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op10_query(docs).collect()], want)
