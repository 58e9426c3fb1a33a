"""Sets of replicas on the row of a file, where a row for each replica would be files times replicas.

A plan row says for whom it is in ``replica_id``, ``replica_set``, ``block`` and ``members``:

| replica_set | the replicas that it means |
|---|---|
| ``one`` | ``replica_id`` |
| ``block`` | those of ``block`` but for the ids in ``members`` |
| ``rest`` | those of all blocks but for the numbers in ``members`` |

Ids from a multiple of ``BLOCK`` to the next are a block. So a file has one row, and one more for each block of which some replica
is an exception: rows grow with files and exceptions, and no group collects more than a block's ids or the numbers of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
COLUMNS = ("replica_id", "replica_set", "block", "members")


def block_of(replica_id: Column) -> Column:
    return F.floor(replica_id / BLOCK).cast("int")


def one() -> list[Column]:
    """Set columns beside an own ``replica_id``."""
    return [F.col("replica_id"), F.lit("one").alias("replica_set"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("array<int>").alias("members")]


def all_replicas() -> list[Column]:
    return [F.lit(None).cast("int").alias("replica_id"), F.lit("rest").alias("replica_set"), F.lit(None).cast("int").alias("block"), F.array().cast("array<int>").alias("members")]


def all_but(rows: DataFrame, exceptions: DataFrame, key: str) -> DataFrame:
    """``rows``, one for each key, with the set of all replicas but those of (key, replica_id) ``exceptions``."""
    no_id = F.lit(None).cast("int").alias("replica_id")
    blocks = exceptions.groupBy(key, block_of(F.col("replica_id")).alias("block")).agg(F.array_sort(F.collect_set("replica_id")).alias("members"))
    inside = rows.hint("merge").join(blocks, key).select(*rows.columns, no_id, F.lit("block").alias("replica_set"), "block", "members")
    named = blocks.groupBy(key).agg(F.array_sort(F.collect_set("block")).alias("members"))
    rest = rows.hint("merge").join(named, key, "left").select(*rows.columns, no_id, F.lit("rest").alias("replica_set"), F.lit(None).cast("int").alias("block"), F.coalesce("members", F.array().cast("array<int>")).alias("members"))
    return rest.unionByName(inside)


def of_replica(plan: DataFrame, replica_id: int) -> DataFrame:
    """What the plan means for one replica: a filter, with that ``replica_id`` and without the set columns."""
    r, block = F.lit(replica_id), F.lit(replica_id // BLOCK)
    kind, members = F.col("replica_set"), F.col("members")
    meant = F.when(kind == "one", F.col("replica_id") == r).when(kind == "block", (F.col("block") == block) & ~F.array_contains(members, r)).otherwise(~F.array_contains(members, block))
    return plan.where(meant).withColumn("replica_id", r).drop("replica_set", "block", "members")
