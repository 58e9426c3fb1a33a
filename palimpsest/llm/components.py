"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Works on distinct edges only, never on a component as a whole; the number of rounds grows with the logarithm of the
longest path. Before each round, every task contracts the edges it reads, ``LOCAL`` at a time, to stars of their own
components, which leaves few rounds. Minima are combined map-side, and a centre with very many leaves meets its minimum by
broadcast (``join_split``), so no task gets all edges of a node. Where there are no more than ``LOCAL`` edges at all, one
task's contraction ends the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import join_split, materialize, release


#: Edges that a task contracts at once, some 30 MB.
LOCAL = 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, with the same components: in each lot of a task's edges, its nodes linked to their smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            path = []
            while (y := up.setdefault(x, x)) != x:
                path.append(x)
                x = y
            for p in path:
                up[p] = x
            return x

        def stars() -> pa.RecordBatch:
            made = [(x, top(x)) for x in list(up)]
            made = [(x, y) for x, y in made if x != y]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in made], pa.int64()) for i in (0, 1)], names=["a", "b"])

        n = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            n += batch.num_rows
            if n >= LOCAL:
                yield stars()
                n = 0
        yield stars()

    return edges.mapInArrow(run, "a bigint, b bigint")


def _are_stars(edges: DataFrame) -> bool:
    """Has every node one smaller neighbour only, which has none?"""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return twice.isEmpty() and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of (a, b) edges; the component is its smallest node.

    Loops, repeated and reversed edges do no harm; rows with a null end are left out; no edges give no rows."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    # each row: a > b
    first = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = first.count() <= LOCAL
    e = materialize(contracted(first.coalesce(1))) if few else materialize(contracted(first).distinct())
    release(first)
    while not few and not _are_stars(e):
        rows = e.count()
        # large star: each node's larger neighbours are linked to the smallest node of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = materialize(join_split(both, least, ["a"], "n", 2 * rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: each node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = materialize(join_split(large, low, ["a"], "n", rows).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        last, e = e, materialize(contracted(small).distinct())
        release(last, large, small)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
