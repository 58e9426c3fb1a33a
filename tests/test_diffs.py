"""Diffs of byte vectors and large images, compositions of long deltas, and long chains."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import deltas, footprints

SHORT, A, B, C = b"\x01", bytes(range(1, 13)), bytes(range(1, 14)), bytes(range(13))
#: (reverse image, forward image, COMMON as (rev_off, fwd_off, len), REVERSE and FORWARD as (offset, bytes)).
VECTORS = [
    (b"", b"", [], [], []), (b"", A, [], [], [(0, A)]), (A, b"", [], [(0, A)], []), (SHORT, A, [], [(0, SHORT)], [(0, A)]), (SHORT, C, [], [(0, SHORT)], [(0, C)]),
    (B, A, [(0, 0, 12)], [(12, b"\x0d")], []), (C, A, [(1, 0, 12)], [(0, b"\x00")], []), (A, B, [(0, 0, 12)], [], [(12, b"\x0d")]), (A, C, [(0, 1, 12)], [], [(0, b"\x00")]),
]


def test_byte_vectors(spark):
    pairs = spark.createDataFrame([(i, bytearray(r), bytearray(f)) for i, (r, f, *_) in enumerate(VECTORS)], "id int, rev binary, fwd binary")
    found: dict = {i: ([], [], []) for i in range(len(VECTORS))}
    made = deltas.diff_images(pairs, ["id"])
    for x in made.orderBy("id", "fwd_off", "rev_off").collect():
        found[x.id][("COMMON", "REVERSE", "FORWARD").index(x.kind)].append((x.rev_off, x.fwd_off, x.len) if x.kind == "COMMON" else (x.rev_off if x.kind == "REVERSE" else x.fwd_off, bytes(x.data)))
    assert [found[i] for i in range(len(VECTORS))] == [tuple(v[2:]) for v in VECTORS]
    ahead = {r.id: bytes(r.content) for r in deltas.apply_delta(pairs.select("id", F.col("rev").alias("content")), made, ["id"]).collect()}
    assert ahead == {i: v[1] for i, v in enumerate(VECTORS)}


def edited(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        at = rng.randrange(len(text) or 1)
        cut, add = rng.randrange(200), "".join(rng.choice("abcé😀 ") for _ in range(rng.randrange(300)))
        text = text[:at] + add + text[at + cut :]
    return text


def images() -> list[tuple[int, str, str]]:
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    large = " ".join(word() for _ in range(170_000))[:1_000_000]
    block = " ".join(word() for _ in range(2000))
    same = "the same line\n" * 3000
    return [
        (0, large, edited(rng, large, 120)), (1, large, large), (2, block, block[5000:] + block[:5000]), (3, same, same + same), (4, same, same[:20_000] + "x" + same[20_000:]), (5, "a" * 5000, "a" * 4000),
        (6, block[:3000], block[6000:9000]), (7, "é😀" * 700 + block[:900], block[:900] + "é😀" * 700), (8, "x", "y"), (9, "", "abc"), (10, None, "only one"), (11, block, block[:4000] * 2),
    ]


def test_large_and_odd_images(spark):
    rows = images()
    pairs = spark.createDataFrame(rows, "id int, rev string, fwd string").repartition(3).cache()
    made = deltas.diff_images(pairs, ["id"]).cache()
    full = pairs.select("id", F.coalesce("rev", F.lit("")).alias("rev"), F.coalesce("fwd", F.lit("")).alias("fwd"))
    sizes = full.select("id", F.length("rev").cast("long").alias("rev_size"), F.length("fwd").cast("long").alias("fwd_size"))
    assert deltas.validate_delta(made, ["id"], sizes).collect() == []
    ahead = {r.id: r.content for r in deltas.apply_delta(full.select("id", F.col("rev").alias("content")), made, ["id"]).collect()}
    back = {r.id: r.content for r in deltas.apply_delta(full.select("id", F.col("fwd").alias("content")), made, ["id"], reverse=True).collect()}
    assert ahead == {i: f or "" for i, _, f in rows} and back == {i: r or "" for i, r, _ in rows}
    common = {r.id: (r.n, r.total) for r in made.where("kind = 'COMMON'").groupBy("id").agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.min("len").alias("least")).where("least >= 12").collect()}
    assert common[0][0] <= 121 and common[0][1] > 960_000  # 120 edits of up to 200 units
    assert common[1] == (1, 1_000_000) and common[2][1] >= len(rows[2][1]) - 5000 - 200
    assert common[4] == (2, len(rows[4][1])) and common[5] == (1, 4000)
    pairs.unpersist()
    made.unpersist()


def test_marks_are_few_and_shared():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 200, 100_000).astype(np.uint32)
    h = footprints.rolling(u, 12)
    at = footprints.least_of_neighbours(h, 32)
    inner = at[(at >= 32) & (at < len(h) - 32)]
    assert len(at) == len(inner) + 64 and 100_000 / 75 < len(inner) < 100_000 / 55 and np.diff(inner).min() > 32
    for i in [*rng.integers(32, len(h) - 32, 50), *inner[:50]]:
        assert (i in at) == bool((h[i - 32 : i] > h[i]).all() and (h[i + 1 : i + 33] >= h[i]).all())
    moved = np.concatenate((rng.integers(0, 200, 777).astype(np.uint32), u))
    there = set((footprints.least_of_neighbours(footprints.rolling(moved, 12), 32) - 777).tolist())
    assert len(set(inner.tolist()) - there) <= 1
    assert footprints.least_of_neighbours(h[:50], 32).tolist() == list(range(50))
    one = {u[i : i + 12].tobytes() for i in range(len(h))}
    assert len(one) == len(np.unique(h))


def test_chain_of_places_against_quadratic():
    rng = random.Random(4)
    for _ in range(60):
        places = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(25))]
        got = deltas.longest_chain(places)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
        order, best = sorted(set(places)), []
        for f, r in order:
            best.append(1 + max((n for (x, y), n in zip(order, best, strict=False) if x < f and y < r), default=0))
        assert len(got) == max(best, default=0)


def cut(rng: random.Random, n: int, pieces: int) -> list[tuple[int, int]]:
    at = sorted({0, *(rng.randrange(1, n) for _ in range(pieces))})
    return [(a, b - a) for a, b in zip(at, [*at[1:], n], strict=True)]


@pytest.mark.parametrize("bucket", [7, 64, 1 << 16])
def test_compositions_against_units(spark, bucket):
    """Both deltas as lists of where each unit comes from."""
    rng, low, top, want = random.Random(bucket), [], [], {}
    for i in range(6):
        n = rng.choice([1, 40, 900])
        middle, new = [], []
        for at, length in cut(rng, n, n // 5):
            common = rng.random() < 0.6
            source = rng.randrange(1000)
            low.append((i, "COMMON" if common else "FORWARD", source if common else None, at, length, None if common else "".join(rng.choice("abc") for _ in range(length))))
            middle += [("base", source + j) if common else ("text", low[-1][5][j]) for j in range(length)]
        at = 0
        for source, length in cut(rng, n, n // 7):
            if rng.random() < 0.2:
                top.append((i, "FORWARD", None, at, 3, "xyz"))
                new += [("text", u) for u in "xyz"]
                at += 3
            if rng.random() < 0.8:
                top.append((i, "COMMON", source, at, length, None))
                new += middle[source : source + length]
                at += length
        want[i] = new
    ddl = "id int, kind string, rev_off bigint, fwd_off bigint, len bigint, data string"
    made = deltas.compose_deltas(spark.createDataFrame(low, ddl), spark.createDataFrame(top, ddl), ["id"], bucket).collect()
    got: dict = {i: {} for i in want}
    for r in made:
        for j in range(r.len):
            assert r.fwd_off + j not in got[r.id]
            got[r.id][r.fwd_off + j] = ("base", r.rev_off + j) if r.kind == "COMMON" else ("text", r.data[j])
    assert {i: [u[j] for j in range(len(u))] for i, u in got.items()} == want


def test_hot_chain_is_several_tasks(spark):
    """300,000 one-unit fragments of one key: rows stay in proportion and are dealt by offsets."""
    n = 300_000
    i = F.col("id")
    low = spark.range(n).select(F.lit(1).alias("key"), F.lit("COMMON").alias("kind"), (i * 2).alias("rev_off"), i.alias("fwd_off"), F.lit(1).cast("long").alias("len"), F.lit(None).cast("string").alias("data"))
    top = spark.range(n).select(F.lit(1).alias("key"), F.lit("COMMON").alias("kind"), i.alias("rev_off"), (n - 1 - i).alias("fwd_off"), F.lit(1).cast("long").alias("len"), F.lit(None).cast("string").alias("data"))
    made = deltas.compose_deltas(low, top, ["key"], 1 << 12).where("rev_off = 2 * (299999 - fwd_off)").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in made) == n and len(made) > 1


@pytest.mark.parametrize("image", [1, 700])
def test_chain_of_a_thousand_versions(spark, monkeypatch, image):
    rng, text, contents, fragments = random.Random(9), "the first version of this text", [], []
    for v in range(1, 1001):
        if v > 1:
            n, at, add = len(text), rng.randrange(len(text) + 1), f"<{v}>"
            fragments += [(1, v, "COMMON", 0, 0, at, None)] if at else []
            fragments += [(1, v, "FORWARD", None, at, len(add), add)]
            # 3 units go from time to time
            cut_ = min(3, n - at) if v % 4 == 0 else 0
            fragments += [(1, v, "REVERSE", at, None, cut_, text[at : at + cut_])] if cut_ else []
            fragments += [(1, v, "COMMON", at + cut_, at + len(add), n - at - cut_, None)] if n > at + cut_ else []
            text = text[:at] + add + text[at + cut_ :]
        contents.append(text)
    versions = spark.createDataFrame([(1, v, len(contents[v - 1]), v - 1 if v > 1 else None, v == image) for v in range(1, 1001)], "file_id bigint, version_id int, size bigint, base_version_id int, has_image boolean")
    stored = spark.createDataFrame([(1, image, contents[image - 1])], "file_id bigint, version_id int, content string")
    rounds, compose = [], deltas.compose_deltas
    monkeypatch.setattr(deltas, "compose_deltas", lambda *a, **b: (rounds.append(1), compose(*a, **b))[1])
    got = {r.version_id: r.content for r in deltas.rebuild_images(versions, stored, spark.createDataFrame(fragments, "file_id bigint, version_id int, kind string, rev_off bigint, fwd_off bigint, len bigint, data string")).collect()}
    assert got == dict(enumerate(contents, 1))
    assert len(rounds) <= 12


def test_footprints_are_counted_where_the_images_are(spark):
    """Repeated and null keys, short and null images."""
    rng = random.Random(4)
    rows = [(i % 40 if i % 3 else None if i % 9 else 100 + i, None if i % 11 == 0 else "".join(rng.choice("ab") for _ in range(i))) for i in range(90)]
    want: dict = {}
    for key, text in rows:
        at = range(len(text or "") - 11)
        n, places, seen = want.setdefault(key, (0, 0, set()))
        want[key] = n + len(at), places + sum(at), seen | {text[i : i + 12] for i in at}
    got = footprints.footprint_counts(spark.createDataFrame(rows, "file_id bigint, content string").repartition(5), ["file_id"])
    found = got.collect()
    assert len(found) == len({r.file_id for r in found})
    assert {r.file_id: (r.n_windows, r.positions, r.n_distinct) for r in found} == {k: (n, p, len(s)) for k, (n, p, s) in want.items() if n}


def test_a_pair_is_compared_in_its_row(spark):
    """Diffs shuffle neither marks nor texts; rows of one key do not get each other's marks."""
    rng = random.Random(11)
    text = "".join(rng.choice("abcdef ") for _ in range(4000))
    pairs = spark.createDataFrame([(1, text, edited(rng, text, 5)), (1, text[::-1], edited(rng, text[::-1], 5)), (2, None, text)], "id int, rev string, fwd string")
    made = deltas.diff_images(pairs, ["id"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.where("id = 1 AND kind = 'COMMON'").agg(F.sum("len")).first()[0] > 0.8 * 2 * len(text)
    assert [(r.kind, r.data) for r in made.where("id = 2").collect()] == [("FORWARD", text)]
