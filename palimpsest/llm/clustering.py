"""Exact k-means with the Shallot search.

Each vector remembers its nearest and its second-nearest centroid, an upper bound of the distance to the one and a lower bound
of the distance to all others. When centroids move, the bounds move by as much; where they still do not meet, nothing is
compared. Otherwise both remembered centroids are measured and the search starts from the closer one, through its neighbours in
order of their distance from it. No centroid further from it than (distance to it + distance to the second-nearest found) can
matter, so the ball shrinks with every better second. What lies in the ball is compared in squared whole numbers, so results are exact;
bounds only decide what need not be compared, and are widened by ``SLACK`` against rounding.

A round is one pass over the vectors with the centroids in its closure (k vectors) and one over what it wrote for the sums, which are
combined in tasks first: k * d rows reach the driver. The vectors travel with their bounds, written to the shared folder each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, release
from palimpsest.llm.vectors import integers, scaled

#: Squared distances of longer entries would not fit a long.
LIMIT = float(1 << 27)
SLACK = 1e-9
STATE = "vec_id bigint, x array<bigint>, near int, second int, upper double, lower double, distance bigint"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff)


class Search:
    """The centroids, their neighbours by distance, and how far each has moved since the bounds were made."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None) -> None:
        self.c, k = centroids, len(centroids)
        gaps = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
        self.order = [[int(j) for j in np.argsort(gaps[i], kind="stable") if j != i] for i in range(k)]
        self.gaps = [gaps[i, self.order[i]] for i in range(k)]
        self.moved = moved
        if moved is not None:
            # the furthest move of any other centroid
            top = np.argsort(moved)[::-1]
            self.others = np.full(k, moved[top[0]])
            self.others[top[0]] = moved[top[1]] if k > 1 else 0.0

    def assign(self, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Brings all four up to date in place."""
        if len(self.c) == 1:
            near[:] = 0
            return
        if self.moved is not None:
            upper += self.moved[near]
            lower -= self.others[near]
        rows = np.flatnonzero(~apart(upper, lower))
        upper[rows] = np.sqrt(squared(x[rows], self.c[near[rows]]))
        rows = rows[~apart(upper[rows], lower[rows])]
        if len(rows):
            self.search(x[rows], near, second, upper, lower, rows)

    def search(self, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, rows: np.ndarray) -> None:
        """Nearest and second-nearest of the vectors x, which are those at ``rows``."""
        i, j = near[rows], second[rows]
        a, b = squared(x, self.c[i]), squared(x, self.c[j])
        turn = (b < a) | ((b == a) & (j < i))
        i, j, a, b = np.where(turn, j, i), np.where(turn, i, j), np.where(turn, b, a), np.where(turn, a, b)
        for start in np.unique(start_of := i.copy()).tolist():
            at = np.flatnonzero(start_of == start)
            i[at], j[at], a[at], b[at] = self.scan(start, x[at], j[at], a[at], b[at])
        near[rows], second[rows], upper[rows], lower[rows] = i, j, np.sqrt(a), np.sqrt(b)

    def scan(self, start: int, x: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """The neighbours of ``start``, nearest first, for vectors at squared distance a from it and b from centroid j."""
        i, reach, live = np.full(len(x), start, j.dtype), np.sqrt(a), np.arange(len(x))
        for c, gap in zip(self.order[start], self.gaps[start], strict=True):
            live = live[gap <= (reach[live] + np.sqrt(b[live])) * (1 + SLACK) + SLACK]
            if not len(live):
                break
            new = live[(i[live] != c) & (j[live] != c)]
            d = squared(x[new], self.c[c])
            first = (d < a[new]) | ((d == a[new]) & (c < i[new]))
            after = ~first & ((d < b[new]) | ((d == b[new]) & (c < j[new])))
            f, o = new[first], new[after]
            j[f], b[f], i[f], a[f] = i[f], a[f], c, d[first]
            j[o], b[o] = c, d[after]
        return i, j, a, b


def apart(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Is the nearest centroid certainly nearer than all others?"""
    return upper * (1 + SLACK) + SLACK < lower * (1 - SLACK)


def starts(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes; of equal ids the one with the smaller numbers first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r.x) for r in points.orderBy(key, "x").limit(k).select("x").collect()]


def clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, dimension: int = 64, factor: int = 256, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, near, second, distance) of each usable vector, and the final centroids.

    Vectors of ``dimension`` entries, none null, not finite or with factor * entry beyond 2**27, become floor(factor * entry); others have no
    rows. Ties go to the centroid with the smaller number; empty centroids stay; with fewer than k vectors there are fewer
    centroids. Repeated ids are vectors of their own, null ids too. No usable vector: no rows and no centroids."""
    points = materialize(scaled(rows, id_col, vector_col, factor, 0, LIMIT / factor).where(F.size("x") == dimension))
    c = np.array(starts(points, k, seed), dtype=np.int64).reshape(-1, dimension)
    no = lambda kind, name, value=None: F.lit(value).cast(kind).alias(name)
    state = points.select("vec_id", "x", no("int", "near", 0), no("int", "second", min(1, max(0, len(c) - 1))), no("double", "upper", float("inf")), no("double", "lower", 0.0), no("bigint", "distance"))
    if not len(c):
        return state, c
    moved = None
    for left in range(rounds, -1, -1):
        last, state = state, materialize(state.mapInArrow(_assign(Search(c, moved), dimension, not left), STATE))
        if left < rounds:
            release(last)
        if left:
            new = c.copy()
            for r in _sums(state, dimension).collect():
                new[r.near, r.i] = r.total // r.n
            moved, c = np.sqrt(squared(new, c).astype(np.float64)) * (1 + SLACK), new
    release(points)
    return state, c


def _assign(search: Search, d: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(1), d)
            near, second, upper, lower = (b.column(i).to_numpy(zero_copy_only=False).copy() for i in range(2, 6))
            search.assign(x, near, second, upper, lower)
            distance = pa.array(squared(x, search.c[near])) if last else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (near, second, upper, lower)), distance], names=["vec_id", "x", "near", "second", "upper", "lower", "distance"])

    return run


def _sums(state: DataFrame, d: int) -> DataFrame:
    """(near, i, total, n) of each centroid that has vectors; a task sends one row for each of its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            near, x = b.column(0).to_numpy(), integers(b.column(1), d)
            for c in np.unique(near).tolist():
                own = x[near == c]
                totals[c] = totals.get(c, 0) + np.append(own.sum(axis=0), len(own))
        ids = [c for c in totals for _ in range(d)]
        cell = [i for _ in totals for i in range(d)]
        sums = [int(v) for t in totals.values() for v in t[:d]]
        counts = [int(t[d]) for t in totals.values() for _ in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(cell, pa.int32()), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], names=["near", "i", "total", "n"])

    parts = state.select("near", "x").mapInArrow(run, "near int, i int, total bigint, n bigint")
    return parts.groupBy("near", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def op13_query(embeddings: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector, as in ``clusters``; the sums are null
    if they do not fit a long. Other columns, whatever their names, are ignored."""
    state, c = clusters(embeddings)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    spark = embeddings.sparkSession
    names = spark.createDataFrame(list(enumerate(digest)), "near int, centroid_sha256 string")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = state.groupBy("near").agg(total.alias("own")).collect()
    own = spark.createDataFrame([(r.near, r.own) for r in sums], "near int, own decimal(38,0)")
    everything = sum(r.own for r in sums) if sums else 0
    facts = own.join(names, "near").select("near", F.expr("try_cast(own AS bigint)").alias("cluster_inertia"), F.lit(int(everything) if everything < 1 << 63 else None).cast("bigint").alias("inertia"), "centroid_sha256")
    # k rows
    return state.join(F.broadcast(facts), "near").select("vec_id", F.col("near").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql(k: int = 40, dimension: int = 64, rounds: int = 5) -> str:
    """Lloyd's rounds over one row for each entry of each vector."""
    parts = [
        f"kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dimension})",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM kept ORDER BY k LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT s.k, v.i, v.x FROM s JOIN v USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT v.vec_id, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.k)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT a.k, v.i, CAST(sum(v.x) AS BIGINT) AS t, count(*) AS n FROM a{r} a JOIN v USING (vec_id) GROUP BY a.k, v.i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((m.t - ((m.t % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k, i))")
    parts.append(f"h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (k)"


OP13_SQL = _op13_sql()
