"""Times with a tolerance and the stored size of deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE_MS = 2999
#: Largest number that fits in 1, 2, ... 8 bytes; fixed values of the stored format. Larger ones take 9.
SIZE_LIMITS = (127, 16383, 1048575, 268435455, 17179869183, 4398046511103, 1125899906842623, 288230376151711743)
#: Header, end mark and count of a stored delta.
EMPTY_DELTA = 7


def millis(n: int) -> Column:
    return F.expr(f"INTERVAL '{n // 1000}' SECOND + INTERVAL '0.{n % 1000:03d}' SECOND")


def same_time(a: Column, b: Column, tolerance_ms: int = TOLERANCE_MS) -> Column:
    """a lies within b -/+ the tolerance; the upper end reaches to the end of its millisecond."""
    top = F.expr("INTERVAL '0.000999' SECOND")
    return a.between(b - millis(tolerance_ms), b + millis(tolerance_ms) + top)


def in_time_frame(c: Column, start: str | None = None, end: str | None = None) -> Column:
    """start <= c < end; an end that is not given is open and adds no predicate."""
    test = F.lit(True)
    if start is not None:
        test = c >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        below = c < F.lit(end).cast("timestamp_ntz")
        test = below if start is None else test & below
    return test


def encoded_size(n: Column) -> Column:
    """Bytes of a stored offset or length."""
    out = F.when(n <= SIZE_LIMITS[0], 1)
    for i, limit in enumerate(SIZE_LIMITS[1:], 2):
        out = out.when(n <= limit, i)
    return out.otherwise(9).cast("long")


def dummy_common_size(size: Column) -> Column:
    """Stored size of the common part of a "same content" delta: one fragment (0, 0, size), none for an empty file."""
    return F.when(size > 0, EMPTY_DELTA + 2 + encoded_size(size)).otherwise(F.lit(EMPTY_DELTA)).cast("long")
