"""PCA whitening by shifted Cholesky QR.

The centred rows X are never multiplied out on one machine: a pass computes the Gram matrix of the rows in tasks, sums the entries by
a shuffle and factors it on the driver, G + shift * I = R'R. The next pass solves each row against the factors so far, which
orthogonalises the rows, and takes the Gram matrix again, until it is the identity; the product R of the factors has X = QR. The right
singular vectors of R are the components, its singular values squared over n their variances: nothing is squared that a pass has not
orthogonalised before, so small variances come out as exactly as large ones. All that the driver holds is d * d, d the dimension.

Entries are whole numbers. Sums of rows are exact, and a row is centred as n * x - sum before it is divided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize
from palimpsest.llm.vectors import integers, scaled

#: Entries from here on count as not finite: their sums would not be exact.
LIMIT = float(1 << 30)
PASSES = 5
#: Passes end when the Gram matrix is the identity to this.
ORTHOGONAL = 1e-13
#: First shift, in parts of the trace; a hundred times larger after each factorisation that fails.
SHIFT = 1e-15


class Centre:
    """n, and the sums of all rows by dimension."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums

    def off(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as longs where they fit, else as Python's numbers."""
        top = int(np.abs(x).max(initial=0))
        if self.n * top < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.off(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum)^2 of each row; null if it does not fit a long."""
        y = self.off(x)
        if y.dtype == object or y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 >= 1 << 62:
            y = y.astype(object)
        return [s if s < 1 << 63 else None for s in map(int, (y * y).sum(axis=1))]


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows q with q R = x, R upper triangular: forward substitution over the columns, all rows at once."""
    q = np.empty_like(x)
    for j in range(x.shape[1]):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _summed(rows: DataFrame, d: int, width: int, moments: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a width x width matrix that ``moments`` makes of a block of them; a task sends the entries of its sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            total += moments(integers(b.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["i", "s"])

    out = np.zeros(width * width)
    for r in rows.select("x").mapInArrow(run, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out.reshape(width, width)


def centre_of(rows: DataFrame, d: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            n += b.num_rows
            sums = [s + int(t) for s, t in zip(sums, integers(b.column(0), d).sum(axis=0), strict=True)]
        parts = [*sums, n]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(list(map(Decimal, parts)), pa.decimal128(38, 0))], names=["i", "s"])

    made = rows.select("x").mapInArrow(run, "i bigint, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r.i: int(r.s) for r in made}
    return Centre(found.get(d, 0), [found.get(i, 0) for i in range(d)])


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift * I; the shift grows until there is one."""
    step = SHIFT * np.trace(gram)
    for _ in range(8):  # the last shift is as large as the matrix
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(step, shift * 100)
    raise ValueError("the Gram matrix is not finite")


def triangular(rows: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """R of the centred rows X = QR, by as many Gram passes as make Q orthonormal; rows of less than full rank leave some of R at 0."""
    factors: list[np.ndarray] = []
    for _ in range(PASSES):

        def gram(x: np.ndarray, known: tuple[np.ndarray, ...] = tuple(factors)) -> np.ndarray:
            q = centre.centred(x)
            for r in known:
                q = solved(q, r)
            return q.T @ q

        g = _summed(rows, d, d, gram)
        if not g.any():
            return g  # all rows are equal
        if factors and np.abs(g - np.eye(d)).max() <= ORTHOGONAL * d:
            break
        factors.append(factor(g, SHIFT * np.trace(g) if not factors else 0.0))
    product = np.eye(d)
    for r in factors:
        product = r @ product
    return product


class Whitening:
    """Centre, components (one a column), their variances and the sum of all variances."""

    def __init__(self, centre: Centre, components: np.ndarray, variances: np.ndarray, trace: float) -> None:
        self.centre, self.components, self.variances, self.trace = centre, components, variances, trace

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.variances)


def fit(rows: DataFrame, d: int, most: int) -> Whitening:
    """The ``most`` components of largest variance of (vec_id, x); components without variance are left out.

    A component's sign makes its largest entry positive."""
    centre = centre_of(rows, d)
    if not centre.n or not d:
        return Whitening(centre, np.zeros((d, 0)), np.zeros(0), 0.0)
    r = triangular(rows, d, centre)
    _, sigma, right = np.linalg.svd(r)
    keep = np.flatnonzero(sigma > sigma[0] * max(d, 64) * 1e-13)[:most] if sigma[0] > 0 else []
    v = right[keep].T
    if len(keep):
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(keep))])
    return Whitening(centre, v, sigma[keep] ** 2 / centre.n, float((sigma**2).sum() / centre.n))


def identity_error(rows: DataFrame, d: int, w: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, by one more pass over all rows."""
    k = len(w.variances)

    def moments(x: np.ndarray) -> np.ndarray:
        y = np.column_stack((w.apply(x), np.ones(len(x))))
        return y.T @ y

    m = _summed(rows, d, k + 1, moments) / w.centre.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max(initial=0.0))


def usable(rows: DataFrame, id_col: str, vector_col: str, factor_: int, shift: int) -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that have no null, not finite or too large entry, written out, and their dimension.

    Vectors of another length than most have (of equally many, the longest) cannot be whitened with them and are left out."""
    x = scaled(rows, id_col, vector_col, factor_, shift, LIMIT)
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    return materialize(x.where(F.size("x") == d)), d


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor_: int = 1024, shift: int = 100_000, most: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Null vectors, null and not finite entries, and entries from 2**30 on, leave a row out; so does a length that most vectors do not
    have. Repeated ids are rows of their own, null ids too. Fewer components than ``most`` where the rows vary in fewer directions:
    no rows where all vectors are equal, or where there is none. ``deviation`` is null where it does not fit a long."""
    x, d = usable(rows, id_col, vector_col, factor_, shift)
    w = fit(x, d, most)
    k, error = len(w.variances), None
    error = identity_error(x, d, w) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, m = integers(b.column(1), d), b.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.centre.n)), pa.array(w.centre.deviation(data), pa.int64()).take(at),
                    pa.array(w.apply(data).ravel()), pa.array(np.tile(w.variances / w.trace if k else w.variances, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op12_query(embeddings: DataFrame) -> DataFrame:
    """All embeddings; nulls, repeats, odd lengths and empty tables as in ``whitened``; other columns, whatever their names, are ignored."""
    return whitened(embeddings)
