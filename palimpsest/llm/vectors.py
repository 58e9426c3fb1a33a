"""Vector columns: which rows can be used, and their numbers as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(vector: Column, limit: float) -> Column:
    """Is the vector there, without null, NaN, infinity and entries beyond +-limit? Never null."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(limit)))
    return F.coalesce(vector.isNotNull() & F.coalesce(good, F.lit(False)), F.lit(False))


def scaled(rows: DataFrame, id_col: str, vector_col: str, factor: int, shift: int, limit: float) -> DataFrame:
    """(vec_id, x): floor(factor * c) + shift of each entry c as double, of the rows that are ``within`` the limit."""
    vector = F.col(vector_col).cast("array<double>")
    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(within(F.col("v"), limit))
    return chosen.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(factor))).cast("long") + F.lit(shift)).alias("x"))


def integers(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an Arrow list column of vectors of ``d`` whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)
