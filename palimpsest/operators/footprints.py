"""Hashes of the windows of images, and which of them mark places that two images share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from palimpsest.sources.tables import materialize

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E37_79B9_7F4A_7C15
#: Windows that are sent on at once.
ROWS = 1 << 16


def units(image: str | bytes) -> np.ndarray:
    """Code points of a text, bytes of binary data."""
    return np.frombuffer(image.encode("utf-32-le"), np.uint32) if isinstance(image, str) else np.frombuffer(image, np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(u: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k units: the polynomial of its units, as a difference of two prefix sums shifted back to power 0, then mixed."""
    n = len(u)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((u.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), dtype=np.uint64, out=sums[1:])
        h = (sums[k:] - sums[:-k]) * _powers(pow(BASE, -1, 1 << 64), n - k + 1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8_FEB8_6659_FD93)
        return h ^ (h >> np.uint64(32))


def least_of_neighbours(h: np.ndarray, spread: int) -> np.ndarray:
    """Places whose hash is below those of the ``spread`` windows before and not above those of the ``spread`` after, and the ``spread`` places
    at either end, which have fewer neighbours.

    So equal stretches of two images have the same such places, but for ``spread`` at their ends, on average one in 2 * spread + 1."""
    if not spread or not len(h):
        return np.arange(len(h))
    top = np.full(spread, np.iinfo(np.uint64).max, np.uint64)
    least, reach = np.concatenate((top, h, top)), 1
    # the least of each run of ``spread`` by doubling
    while reach < spread:
        step = min(reach, spread - reach)
        least, reach = np.minimum(least[: len(least) - step], least[step:]), reach + step
    marked = (h < least[: len(h)]) & (h <= least[spread + 1 : spread + 1 + len(h)])
    marked[:spread] = marked[-spread:] = True
    return np.flatnonzero(marked)


def footprints(images: DataFrame, key: list[str], content: str = "content", k: int = 12, spread: int = 0, sample_mod: int = 1) -> DataFrame:
    """(key, pos, hash) of windows of k units: of all, or with ``spread`` of those that ``least_of_neighbours`` marks, or with
    ``sample_mod`` m of those whose hash is divisible by m. No row is made for a window that is not kept; null images have none."""
    keys = StructType([images.schema[c] for c in key])
    schema = StructType([*keys.fields, StructField("pos", IntegerType()), StructField("hash", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                image = b.column(len(key))[i].as_py()
                if image is None:
                    continue
                h = rolling(units(image), k)
                at = least_of_neighbours(h, spread)
                at = at[h[at] % np.uint64(sample_mod) == 0] if sample_mod > 1 else at
                for start in range(0, len(at), ROWS):
                    part = at[start : start + ROWS]
                    same = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays([*(b.column(j).take(same) for j in range(len(key))), pa.array(part.astype(np.int32)), pa.array(h[part].view(np.int64))], schema=arrow)

    return images.select(*key, content).mapInArrow(run, schema)


def footprint_counts(images: DataFrame, key: list[str], content: str = "content", k: int = 12) -> DataFrame:
    """(key, n_windows, positions, n_distinct) of keys with windows of k units: their number, the sum of their places and how many hashes differ.

    An image's windows are counted where its text is, and a row for each image is summed by key. Only for keys of several images, whose hashes
    have to meet, are windows dealt as rows."""
    keys = StructType([images.schema[c] for c in key])
    names = ("n_windows", "positions", "n_distinct")
    schema = StructType([*keys.fields, *(StructField(c, LongType()) for c in names)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            image = b.column(len(key))
            hashes = (rolling(units(image[i].as_py() or ""), k) for i in range(b.num_rows))
            told = np.array([(len(h), len(h) * (len(h) - 1) // 2, len(np.unique(h))) for h in hashes], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(key))), *(pa.array(told[:, j]) for j in range(3))], schema=arrow)

    own = images.select(*key, content).mapInArrow(run, schema).where("n_windows > 0").groupBy(*key)
    sums = own.agg(F.sum("n_windows").alias("n_windows"), F.sum("positions").alias("positions"), F.max("n_distinct").alias("most"))
    several = materialize(images.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    rows = footprints(images.join(several, same(images, several), "left_semi"), key, content, k)
    met = rows.groupBy(*key).agg(F.count_distinct("hash").alias("met"))
    return sums.join(met, same(sums, met), "left").select(*(sums[c] for c in key), "n_windows", "positions", F.coalesce("met", "most").alias("n_distinct"))
