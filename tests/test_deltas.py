"""Every problem that a delta can have, aborted diffs in the storage policy, and the trees by doubling on odd shapes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.paths import filter_rules, glob_regex
from palimpsest.operators import deltas, trees

FRAGMENT = "id int, kind string, rev_off bigint, fwd_off bigint, len bigint, data string"
GOOD = [("COMMON", 0, 0, 5, None), ("FORWARD", None, 5, 3, "abc"), ("REVERSE", 5, None, 2, "xy"), ("COMMON", 7, 8, 4, None)]  # 11 -> 12
BAD = {
    "none": (GOOD, set()),
    "gap at the start": (GOOD[1:], {("forward", "gap"), ("reverse", "gap")}),
    "gap inside": ([GOOD[0], GOOD[2], GOOD[3]], {("forward", "gap")}),
    "overlap": ([GOOD[0], ("FORWARD", None, 5, 4, "abcd"), *GOOD[2:]], {("forward", "overlap")}),
    "backwards": ([("COMMON", 7, 0, 4, None), ("COMMON", 0, 4, 7, None), ("FORWARD", None, 11, 1, "z")], {("forward", "backwards"), ("reverse", "backwards")}),
    "source too short": ([GOOD[0], GOOD[1], GOOD[2], ("COMMON", 9, 8, 4, None)], {("forward", "source too short"), ("reverse", "gap"), ("reverse", "wrong end")}),
    "wrong length": ([GOOD[0], ("FORWARD", None, 5, 3, "ab"), *GOOD[2:]], {("forward", "wrong length")}),
    "wrong end": ([*GOOD[:3], ("COMMON", 7, 8, 3, None)], {("forward", "wrong end"), ("reverse", "wrong end")}),
}


@pytest.fixture(scope="module")
def problems(spark):
    rows = [(i, *f) for i, (fragments, _) in enumerate(BAD.values()) for f in fragments]
    sizes = spark.createDataFrame([(i, 11, 12) for i in range(len(BAD))], "id int, rev_size bigint, fwd_size bigint")
    found: dict[int, set] = {}
    for r in deltas.validate_delta(spark.createDataFrame(rows, FRAGMENT), ["id"], sizes).collect():
        found.setdefault(r.id, set()).add((r.side, r.problem))
    return found


@pytest.mark.parametrize("case", BAD)
def test_problems_of_a_delta(problems, case):
    assert problems.get(list(BAD).index(case), set()) == BAD[case][1]


VERSION = "file_id bigint, version_id int, size bigint, base_version_id int, has_image boolean"


def reference_ways(versions: list[tuple]) -> dict[tuple[int, int], list[int]]:
    """The nearest image's way for each version without one, by breadth-first search from each."""
    out = {}
    for f in {v[0] for v in versions}:
        own = {v[1]: v for v in versions if v[0] == f and v[2] is not None}
        near = {v: ([b] if (b := own[v][3]) in own else []) + sorted(x for x in own if own[x][3] == v) for v in own}
        dist = {v: 0 for v in own if own[v][4]}
        todo = sorted(dist)
        for v in todo:
            for x in near[v]:
                if x not in dist:
                    dist[x] = dist[v] + 1
                    todo.append(x)
        for v in own:
            if dist.get(v):
                way, at = [], v
                while dist[at]:
                    at = next(x for x in near[at] if dist.get(x) == dist[at] - 1)
                    way.append(at)
                out[f, v] = way
    return out


def shapes() -> list[tuple]:
    rows = [(1, i, 5, i - 1 if i > 1 else None, i in (1, 40)) for i in range(1, 71)]  # a chain
    rows += [(2, 1, 5, None, False), *((2, i, 5, 1, i == 9) for i in range(2, 12))]  # children of one
    rows += [(3, i, 5, i // 2 if i > 1 else None, i in (13, 20)) for i in range(1, 41)]  # a tree
    rows += [(4, 1, 5, None, False), (4, 2, 5, 1, False)]  # no image
    rows += [(5, 1, 5, None, True), (5, 2, None, 1, False), (5, 3, 5, 2, False)]  # a mark between
    rows += [(6, 2, 5, 77, False), (6, 3, 5, 2, True)]  # a base that is not there
    return rows


def test_ways_by_doubling(spark):
    v = spark.createDataFrame(shapes(), VERSION)
    got: dict = {}
    for r in trees.nearest_image_path(v).orderBy("step").collect():
        got.setdefault((r.file_id, r.source), []).append(r.next)
    assert got == reference_ways(shapes())


def test_sums_by_doubling(spark):
    rows = shapes()
    v = spark.createDataFrame([(*r, r[1]) for r in rows], f"{VERSION}, amount bigint")
    got = {(r.file_id, r.version_id): r.amount for r in trees.subtree_sums(v).collect()}
    for f, i, *_ in rows:
        below = {i}
        for _ in rows:
            below |= {x[1] for x in rows if x[0] == f and x[3] in below}
        assert got[f, i] == sum(below)
    ways = reference_ways(rows)
    hops = trees.image_distances(v).where("next IS NOT NULL").select("file_id", "version_id", "next", F.col("far").alias("amount"))
    sums = {(r.file_id, r.version_id): r.amount for r in trees.way_sums(hops).collect()}
    assert sums == {k: sum(range(1, len(w) + 1)) for k, w in ways.items()}


@pytest.mark.parametrize("pattern", ["*.odt", "**/*.tmp", "doc/**", "doc/", "a/**/b", "a/**/**/b", "**", "*", "?.c", "a.b[1]+", "/a/b", "a\\b", "a*b*c", "x{1}|(y)^$", "é?/_-&~#", ""])
def test_patterns_are_translated_alike(spark, pattern):
    paths = ["a.odt", ".odt", "d/a.odt", "x.tmp", "a/x.tmp", "a/b/x.tmp", "doc", "doc/a", "docs/a", "a/b", "a/x/b", "a/x/y/b", "x.c", "xx.c", "a.b[1]+", "abc", "aXbYc", "acb", "x{1}|(y)^$", "éa/_-&~#", ""]
    (rule,) = filter_rules(spark.createDataFrame([(1, "INCLUDE", 1, pattern)], "filter_id int, type string, number int, pattern string")).collect()
    df = spark.createDataFrame([(p, rule.include) for p in paths], "path string, include string")
    got = {r.path for r in df.where("concat(path, '/') RLIKE include").collect()}
    assert got == {p for p in paths if re.search(glob_regex(pattern), p + "/")}
