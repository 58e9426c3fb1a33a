"""Integrity audits: rows of offenders, none for a clean catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import prefixes
from palimpsest.operators.trees import chain_edges, first_hops, way_sums
from palimpsest.schema import Catalog


def audit_duplicate_paths(c: Catalog) -> DataFrame:
    """Paths of more than one existing file."""
    return c.existing.groupBy("path").agg(F.count("*").alias("n_files")).where("n_files > 1")


def audit_references(c: Catalog) -> DataFrame:
    """(rule, key): references to rows that are not there, and filter names that are not lower-case or not unique."""
    versions = c.versions.select("file_id", "version_id").hint("merge")

    def offenders(rule: str, rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))

    def missing(rule: str, rows: DataFrame, target: DataFrame, on: list[str], key: Column) -> DataFrame:
        return offenders(rule, rows.join(target, on, "left_anti"), key)

    pair = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    return (
        missing("current", c.files.select("file_id", F.col("current_version_id").alias("version_id")), versions, ["file_id", "version_id"], F.col("file_id"))
        .unionByName(missing("version file", c.versions, c.files.select("file_id").hint("merge"), ["file_id"], pair("file_id", "version_id")))
        .unionByName(missing("base", c.versions.where("base_version_id IS NOT NULL").select("file_id", F.col("base_version_id").alias("version_id"), F.col("version_id").alias("child")), versions, ["file_id", "version_id"], pair("file_id", "child")))
        .unionByName(missing("sync version", c.last_sync.where("version_id IS NOT NULL"), versions, ["file_id", "version_id"], pair("file_id", "replica_id")))
        .unionByName(missing("sync replica", c.last_sync, c.replicas.select("replica_id"), ["replica_id"], pair("file_id", "replica_id")))
        .unionByName(missing("default filter", c.replicas.where("default_filter_id IS NOT NULL").withColumnRenamed("default_filter_id", "filter_id"), c.filters.select("filter_id"), ["filter_id"], F.col("replica_id")))
        .unionByName(offenders("filter name", c.filters.where("name <> lower(name)"), F.col("name")))
        .unionByName(offenders("filter twice", c.filters.groupBy("name").count().where("count > 1"), F.col("name")))
    )


def audit_version_order(c: Catalog) -> DataFrame:
    """(rule, file_id, version_id): older than its base, a mark for a base, or newer than its file's current version."""
    base = c.versions.select("file_id", F.col("version_id").alias("base_version_id"), F.col("modified").alias("base_time"), F.col("size").alias("base_size"))
    child = c.versions.where("base_version_id IS NOT NULL").hint("merge").join(base, ["file_id", "base_version_id"])
    newer = c.versions.hint("merge").join(c.current.select("file_id", F.col("modified").alias("current_time")), "file_id").where("modified > current_time")
    row = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), "file_id", "version_id")
    return row("older than base", child.where("modified < base_time")).unionByName(row("base is mark", child.where("base_size IS NULL"))).unionByName(row("newer than current", newer))


def audit_path_nesting(c: Catalog) -> DataFrame:
    """Distinct (ancestor_path, path) of file records that lie below another."""
    below = c.files.select("path").distinct().withColumn("ancestor_path", F.explode(prefixes("path", proper=True)))
    return below.hint("merge").join(c.files.select(F.col("path").alias("ancestor_path")).distinct(), "ancestor_path", "left_semi").select("ancestor_path", "path")


def audit_restorability(c: Catalog) -> DataFrame:
    """Versions, no marks, without a stored image and without a way over stored deltas to one."""
    hops = chain_edges(first_hops(c.versions), c.versions)
    d = c.versions.select("file_id", F.col("version_id").alias("edge_version_id"), "cdelta_len", "fdelta_len", "rdelta_len")
    lacking = F.col("cdelta_len").isNull() | F.when(F.col("direction") == "FORWARD", F.col("fdelta_len").isNull()).otherwise(F.col("rdelta_len").isNull())
    bad = F.coalesce(lacking, F.lit(True)) | (F.col("direction") == "BROKEN")
    ways = way_sums(hops.hint("merge").join(d, ["file_id", "edge_version_id"], "left").select("file_id", F.col("source").alias("version_id"), "next", bad.cast("long").alias("amount"))).withColumnRenamed("amount", "bad")
    need = c.versions.where("size IS NOT NULL AND NOT has_image").select("file_id", "version_id").hint("merge").join(ways, ["file_id", "version_id"], "left")
    return need.where("bad IS NULL OR bad > 0").select("file_id", "version_id", F.when(F.col("bad").isNull(), "no way").otherwise("missing delta").alias("reason"))
