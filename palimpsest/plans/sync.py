"""Three-way reconciliation of local listings with the catalog, all replicas in one job.

A plan is rows of decisions: (replica_id, path, file_id, decision, reason, version_id). UNKNOWN as default action means that
a case without a safe answer is a CONFLICT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import effective_filter, filter_rules, matches, passes_rules
from palimpsest.operators.lookups import ancestor_file_conflicts, best_match, descendant_file_conflicts, sync_records
from palimpsest.plans import replica_sets
from palimpsest.plans.replica_sets import all_but, of_replica, one
from palimpsest.schema import Catalog

COLUMNS = ("replica_id", "path", "file_id", "decision", "reason", "version_id")


def _otherwise(default_action: str) -> Column:
    return F.lit("CONFLICT" if default_action == "UNKNOWN" else default_action)


def _matched(c: Catalog, listing: DataFrame) -> DataFrame:
    m = best_match(c, listing)
    return m.select("replica_id", "path", F.col("file_id").alias("match_file"), F.col("version_id").alias("match_version"), F.col("alive").alias("match_alive"), F.col("synced").alias("match_synced"))


def _synced(c: Catalog) -> DataFrame:
    r = sync_records(c)
    return r.select("file_id", "replica_id", F.col("version_id").alias("synced_version"), F.col("deleted").alias("synced_deleted"), F.lit(True).alias("has_sync"))


def sync_present(c: Catalog, listing: DataFrame, default_action: str = "UNKNOWN") -> DataFrame:
    """Existing files that have a local file. ``version_id``: the one to record as synced where no row says so yet."""
    rows = listing.hint("merge").join(c.existing.select("path", "file_id", "current_version_id", "modified"), "path")
    rows = rows.hint("merge").join(_matched(c, listing), ["replica_id", "path"], "left").hint("merge").join(_synced(c), ["file_id", "replica_id"], "left")
    current = (F.col("match_file") == F.col("file_id")) & (F.col("match_version") == F.col("current_version_id"))
    newer = (F.col("synced_version") == F.col("current_version_id")) & (F.col("modified") < F.col("mtime"))
    decision = F.when(current, "NONE").when(F.col("match_file").isNotNull(), "DISCARD").when(newer, "UPDATE").otherwise(_otherwise(default_action))
    reason = F.when(current, "current").when(F.col("match_file").isNotNull(), "stale version").when(newer, "new content").otherwise("content")
    record = F.when((F.col("decision") == "NONE") & F.col("has_sync").isNull(), F.coalesce("match_version", "current_version_id"))
    return rows.withColumn("decision", decision).withColumn("reason", reason).select("replica_id", "path", "file_id", "decision", "reason", record.alias("version_id"))


def sync_absent(c: Catalog, listing: DataFrame, default_action: str = "UNKNOWN") -> DataFrame:
    """Existing files without a local file, for every replica that has a sync row of them; for those without one see ``never_synced``."""
    rows = c.existing.select("path", "file_id", "current_version_id").hint("merge").join(_synced(c), "file_id")
    rows = rows.hint("merge").join(listing.select("replica_id", "path"), ["replica_id", "path"], "left_anti")
    same = F.col("synced_version") == F.col("current_version_id")
    decision = F.when(F.col("synced_deleted"), "DISCARD").when(same, "UPDATE").otherwise(_otherwise(default_action))
    reason = F.when(F.col("synced_deleted"), "was deleted").when(same, "deleted locally").when(F.col("synced_version").isNull(), "deleted, purged version").otherwise("deleted, older version")
    return rows.select("replica_id", "path", "file_id", decision.alias("decision"), reason.alias("reason"), F.lit(None).cast("int").alias("version_id"))


def never_synced(c: Catalog, listing: DataFrame) -> DataFrame:
    """Existing files for the replicas that have neither a sync row of them nor a local file: these get the file.

    A row for each file with the set of those replicas (``replica_sets``): all but the ones that have a sync row or something at the path."""
    existing = c.existing.select("path", "file_id")
    known = c.last_sync.select("file_id", "replica_id").hint("merge").join(existing, "file_id", "left_semi").unionByName(listing.select("path", "replica_id").hint("merge").join(existing, "path").select("file_id", "replica_id"))
    rows = existing.select("path", "file_id", F.lit("DISCARD").alias("decision"), F.lit("never synced").alias("reason"), F.lit(None).cast("int").alias("version_id"))
    return all_but(rows, known, "file_id")


def sync_new_local(c: Catalog, listing: DataFrame) -> DataFrame:
    """Local files whose path no existing file has. ``version_id``: for DELETE_LOCAL the mark to record, if the file is deleted."""
    new = listing.hint("merge").join(c.existing.select("path"), "path", "left_anti")
    nested = ancestor_file_conflicts(c, new).select("path").unionByName(descendant_file_conflicts(c, new).select("path")).distinct().withColumn("nested", F.lit(True))
    rows = new.hint("merge").join(nested, "path", "left").hint("merge").join(_matched(c, new), ["replica_id", "path"], "left")
    other = c.current.select(F.col("file_id").alias("match_file"), F.col("path").alias("match_path"), F.col("size").alias("match_size"), F.col("current_version_id").alias("match_current"))
    rows = rows.hint("merge").join(other, "match_file", "left")
    here = F.col("match_alive") & (F.col("match_path") == F.col("path"))
    kind = F.when(F.col("nested"), "ERROR").when(F.col("match_file").isNull(), "ADD").when(here, "SKIP").when(F.col("match_synced"), "DELETE_LOCAL").otherwise("ADD")
    reason = F.when(F.col("nested"), "path conflict").when(F.col("match_file").isNull(), "new").when(here, "added meanwhile").when(F.col("match_synced"), "moved or deleted elsewhere").otherwise("time touched")
    mark = F.when((F.col("decision") == "DELETE_LOCAL") & F.col("match_size").isNull(), F.col("match_current"))
    return rows.withColumn("decision", kind).withColumn("reason", reason).select("replica_id", "path", F.col("match_file").alias("file_id"), "decision", "reason", mark.alias("version_id"))


def _passing(c: Catalog, plan: DataFrame) -> DataFrame:
    """Rows (replica_id, path) that pass their replica's effective filter."""
    rules = effective_filter(c.replicas, c.filters).join(filter_rules(c.filter_elements), "filter_id", "left").select("replica_id", "include", "exclude")
    return plan.join(rules, "replica_id", "left").where(passes_rules("path")).drop("include", "exclude")


def sync_plan(c: Catalog, listing: DataFrame, default_action: str = "UNKNOWN", pattern: str | None = None, filtered: bool = True, file_ids: DataFrame | None = None) -> DataFrame:
    """Decisions for all replicas after the pattern and each replica's effective filter; by ids the filter is skipped.

    Rows that are for one replica have passed its filter. A row for a set of replicas holds for those of them whose own filter passes the path:
    ``sync_plan_of`` applies it. The plan grows with local files, sync rows and files, not with files times replicas."""
    rows = sync_present(c, listing, default_action).unionByName(sync_absent(c, listing, default_action)).unionByName(sync_new_local(c, listing))
    never = never_synced(c, listing)
    if file_ids is not None:
        ids = file_ids.select("file_id").distinct()
        rows, never = rows.hint("merge").join(ids, "file_id", "left_semi"), never.hint("merge").join(ids, "file_id", "left_semi")
    elif pattern:
        rows, never = rows.where(matches("path", pattern)), never.where(matches("path", pattern))
    if filtered and file_ids is None:
        rows = _passing(c, rows)
    sets = list(replica_sets.COLUMNS)
    return rows.select(*COLUMNS[1:], *one()).unionByName(never.select(*COLUMNS[1:], *sets))


def sync_plan_of(c: Catalog, plan: DataFrame, replica_id: int, filtered: bool = True) -> DataFrame:
    """One replica's part of a ``sync_plan``, rows for sets of replicas filtered as well."""
    own = of_replica(plan, replica_id)
    return (_passing(c, own) if filtered else own).select(*COLUMNS)
