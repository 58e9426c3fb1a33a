"""Helpers that the training-data operators share: joins that hot keys do not slow down, and Arrow batching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.derived import read as table
from palimpsest.sources.tables import materialize, release

__all__ = ["ASCII_LOWER", "ascii_lower", "join_split", "map_rows", "materialize", "partitions_for", "release", "slices", "table", "with_ids"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table for "lower-case A-Z only".
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def join_split(big: DataFrame, small: DataFrame, on: list[str], count: str, rows: int) -> DataFrame:
    """``big`` joined to ``small``, which has one row for each key of big and the number of its rows there in ``count``.

    ``rows``: of big. A key of more than a thousandth of them, so one of a thousand keys at most, is joined by broadcast
    wherever its rows are; all other keys are shuffled."""
    limit = max(1000, rows // 1000)
    hot, rest = small.where(F.col(count) > limit).drop(count), small.where(F.col(count) <= limit).drop(count)
    often = F.broadcast(hot)
    return big.join(often, on).unionByName(big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII rows take the fast path, where lower() means the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def partitions_for(df: DataFrame, text_col: str, bytes_each: int) -> int:
    """Number of chunks of about ``bytes_each`` of text; one pass over one column."""
    total = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-total // bytes_each))


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is among ``ids`` (one column, no nulls), all columns; rows of one id collapse into one.

    One shuffle of the documents: both steps use the same partitioning by id."""
    wanted = ids.select(F.col(ids.columns[0]).alias(id_col)).where(F.col(id_col).isNotNull())
    return docs.join(wanted, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)


def map_rows(df: DataFrame, schema: str, fn: Callable[[list], list], slice_chars: int = 4_000_000) -> DataFrame:
    """mapInArrow over slices of rows of bounded text size.

    ``df`` has the columns (id, text, ...); ``fn`` gets one list per column and returns one list or Arrow array
    per output column. A slice ends as soon as its texts exceed ``slice_chars`` characters, so one task holds one
    slice at a time whatever the row lengths are."""
    out_schema = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_chars):
                made = fn([part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(made, out_schema, strict=True)], schema=out_schema)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each of at most about ``limit`` bytes of text (one row at least)."""
    col = batch.column(text_at)
    sizes = [0 if x is None else x for x in pa.compute.binary_length(col).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
