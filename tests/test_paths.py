"""Golden globs and the fragments expected for short byte vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import paths
from palimpsest.operators import deltas

GOLDEN = [
    ("*.odt", ["a.odt", ".odt"], ["d/a.odt", "a.ODT"]), ("**/*.tmp", ["x.tmp", "a/x.tmp", "a/b/x.tmp"], ["x.tmp/y"]), ("doc/**", ["doc", "doc/a", "doc/a/b"], ["docs/a"]), ("doc/", ["doc"], ["doc/a"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/x", "ab"]), ("a/**/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/x", "ab"]), ("**", ["a", "a/b"], []), ("*", ["a"], ["a/b"]), ("?.c", ["x.c"], [".c", "xx.c"]),
    ("a.b[1]+", ["a.b[1]+"], ["axb1", "a.b1"]), ("/a/b", ["a/b"], ["x/a/b"]), ("a\\b", ["a/b"], ["ab"]), ("a*b*c", ["abc", "aXbYc"], ["acb"]),
]


@pytest.mark.parametrize(("pattern", "yes", "no"), GOLDEN)
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert {r.path for r in paths.glob_match(df, pattern).collect()} == set(yes)


def test_glob_case(spark):
    df = spark.createDataFrame([("A/x.ODT",), ("b/y.txt",)], "path string")
    assert [r.path for r in paths.glob_match(df, "a/*.odt", case_sensitive=False).collect()] == ["A/x.ODT"]


def test_empty_filter_passes_everything(spark):
    df = spark.createDataFrame([("a",), ("b/c",)], "path string")
    assert paths.apply_filter(df, []).count() == 2
    assert paths.apply_filter(df, [], invert=True).count() == 0


def test_split(spark):
    df = spark.createDataFrame([("/a/b/",), ("a\\b",), ("a//b",)], "path string")
    assert [r[0] for r in df.select(paths.split_path("path")).collect()] == [["a", "b"], ["a", "b"], ["a", "", "b"]]


A12, A13, Z12 = "abcdefghijkl", "abcdefghijklm", "0abcdefghijkl"
VECTORS = [
    ("", "", []), ("", A12, [("FORWARD", None, 0, A12)]), (A12, "", [("REVERSE", 0, None, A12)]), ("a", Z12, [("FORWARD", None, 0, Z12), ("REVERSE", 0, None, "a")]),
    (A13, A12, [("COMMON", 0, 0, 12), ("REVERSE", 12, None, "m")]), (Z12, A12, [("COMMON", 1, 0, 12), ("REVERSE", 0, None, "0")]), (A12, A13, [("COMMON", 0, 0, 12), ("FORWARD", None, 12, "m")]),
    (A12, Z12, [("COMMON", 0, 1, 12), ("FORWARD", None, 0, "0")]), (A13, Z12, [("COMMON", 0, 1, 12), ("FORWARD", None, 0, "0"), ("REVERSE", 12, None, "m")]), (Z12, A13, [("COMMON", 1, 0, 12), ("FORWARD", None, 12, "m"), ("REVERSE", 0, None, "0")]),
]


def test_diff_vectors(spark):
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(VECTORS)], "id int, rev string, fwd string")
    got = {}
    for r in deltas.diff_images(pairs, ["id"]).collect():
        got.setdefault(r.id, []).append((r.kind, r.rev_off, r.fwd_off, r.len if r.kind == "COMMON" else r.data))
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(v, key=str) for i, (_, _, v) in enumerate(VECTORS) if v}


def test_diff_of_swapped_blocks_is_lossless(spark):
    a, b = "the quick brown fox jumps", " over the lazy dog again and again"
    pairs = spark.createDataFrame([(1, a + b, b + a), (2, a * 3, a * 5), (3, a, a)], "id int, rev string, fwd string")
    f = deltas.diff_images(pairs, ["id"]).cache()
    ahead = deltas.apply_delta(pairs.select("id", F.col("rev").alias("content")), f, ["id"])
    assert {r.id: r.content for r in ahead.collect()} == {1: b + a, 2: a * 5, 3: a}
    sizes = pairs.select("id", F.length("rev").cast("long").alias("rev_size"), F.length("fwd").cast("long").alias("fwd_size"))
    assert deltas.validate_delta(f, ["id"], sizes).count() == 0
