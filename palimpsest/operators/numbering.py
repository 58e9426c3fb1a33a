"""Gapless numbers in a given order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import materialize, release

#: monotonically_increasing_id() keeps the place within a partition in the lower bits.
PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, start: Column | int = 0) -> DataFrame:
    """``rows`` with ``name`` (bigint): start, start + 1, ... in the given order, without gaps.

    Rows are dealt to ranges and sorted there; each range's first number is the count of the rows before it. The offsets are one
    row a range, so as many as the session has shuffle partitions. Rows that are equal in the whole order get any order, and
    all go to one range: end the order with a key. ``order`` takes no rows apart that are equal in it."""
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", PLACE_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    first = start if isinstance(start, Column) else F.lit(start)
    inside = F.col("__place") - F.shiftleft(part, PLACE_BITS)
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    out = materialize(joined.withColumn(name, (first + F.col("__before") + inside).cast("long")).select(*rows.columns, name))
    release(placed)
    return out
