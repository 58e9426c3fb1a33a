"""Restore and undo plans: what to write, delete or revert, for all files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.paths import matches, passes
from palimpsest.operators.lookups import files_related_to, path_collision_winner, snapshot_as_of, snapshot_as_of_with_current, version_as_of
from palimpsest.plans.replica_sets import all_but, all_replicas, one
from palimpsest.schema import Catalog


def _chosen(path: str, pattern: str | None, elements: list[tuple[str, str]] | None) -> Column:
    test = matches(path, pattern) if pattern else F.lit(True)
    return test & passes(path, elements) if elements else test


def restore_target(c: Catalog, t: str, pattern: str | None = None, elements: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, file_id, version_id, size) of what each path held at t, marks included."""
    return path_collision_winner(snapshot_as_of(c, t).where(_chosen("path", pattern, elements))).select("path", "file_id", "version_id", "size")


def restore_plan(c: Catalog, listing: DataFrame, t: str, pattern: str | None = None, elements: list[tuple[str, str]] | None = None) -> DataFrame:
    """In place, all replicas in one job: (path, file_id, version_id, action) with the set of replicas (``replica_sets``).

    WRITE the version at t, where that is no mark: one row, for all replicas. Where it is a mark, DELETE for a replica that has a local file
    there, NONE for all others. DELETE_EXTRA for matching local files that the snapshot does not have (these are synced first). The plan grows with the snapshot and
    the local files; ``of_replica`` gives one replica's part."""
    target = restore_target(c, t, pattern, elements)
    local = listing.where(_chosen("path", pattern, elements)).select("replica_id", "path").distinct()
    write = target.where("size IS NOT NULL").select("path", "file_id", "version_id", F.lit("WRITE").alias("action"), *all_replicas())
    delete = target.where("size IS NULL").hint("merge").join(local, "path").select("path", "file_id", "version_id", F.lit("DELETE").alias("action"), *one())
    marks = target.where("size IS NULL").select("path", "file_id", "version_id", F.lit("NONE").alias("action"))
    none = all_but(marks, local.hint("merge").join(marks, "path", "left_semi"), "path")
    extra = local.hint("merge").join(target.select("path"), "path", "left_anti").select("path", F.lit(None).cast("bigint").alias("file_id"), F.lit(None).cast("int").alias("version_id"), F.lit("DELETE_EXTRA").alias("action"), *one())
    return write.unionByName(delete).unionByName(none).unionByName(extra)


def restore_snapshot_plan(c: Catalog, dest_listing: DataFrame, t: str, pattern: str | None = None, elements: list[tuple[str, str]] | None = None, dest: str | None = None, replica_id: int | None = None) -> DataFrame:
    """Into another place: every version at t that is no mark; ``blocked`` where something is at its path already.

    With ``dest``, the folder to restore to, and the replica that restores: ``refused`` where the target lies in that replica's own folder, since a
    snapshot must not change it. Both may be nested in either way; ``.`` and ``..`` are not resolved."""
    target = path_collision_winner(snapshot_as_of(c, t).where(_chosen("path", pattern, elements))).where("size IS NOT NULL")
    there = dest_listing.select("path").distinct().withColumn("__there", F.lit(True))
    rows = target.hint("merge").join(there, "path", "left").select("path", "file_id", "version_id", "size", F.col("__there").isNotNull().alias("blocked"))
    if dest is None or replica_id is None:
        return rows.withColumn("refused", F.lit(False))
    root = c.replicas.where(F.col("replica_id") == replica_id).agg(F.concat(F.max(F.regexp_replace("root", "/+$", "")), F.lit("/"))).scalar()
    place = F.concat(F.lit(dest.rstrip("/") + "/"), "path")
    return rows.withColumn("refused", F.coalesce(place.startswith(root), F.lit(False)))


#: Ids that an ambiguous request is told.
MOST_IDS = 10


def restore_one_plan(c: Catalog, requests: DataFrame, most_ids: int = MOST_IDS) -> DataFrame:
    """One row per request (request_id, path, version_id?, moment?): its version, or why there is none.

    A version and a moment exclude each other (INVALID); neither means the current version. A path that several files
    have or had is AMBIGUOUS, with ``candidates``: the ``most_ids`` smallest of their ids, and ``etc.`` if there are more. No file is UNKNOWN_PATH, a
    version that is not there MISSING, one that had another path OTHER_NAME, a mark DELETED. ``replaces``: another existing file at the path, which goes."""
    related = files_related_to(c, requests).select("path", "file_id").distinct()
    nth = F.row_number().over(Window.partitionBy("path").orderBy("file_id"))
    few = related.withColumn("__nth", nth).where(F.col("__nth") <= most_ids + 1)
    listed = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("file_id")), 1, most_ids), lambda i: i.cast("string")), ", ")
    n = few.groupBy("path").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id"), F.concat(listed, F.when(F.count("*") > most_ids, ", etc.").otherwise("")).alias("candidates"))
    r = requests.hint("merge").join(n, "path", "left")
    dated = r.where("moment IS NOT NULL AND n = 1").select("file_id", "moment")
    as_of = version_as_of(c, dated).select("file_id", "moment", F.col("version_id").alias("dated_version"))
    r = r.hint("merge").join(as_of, ["file_id", "moment"], "left").hint("merge").join(c.files.select("file_id", "current_version_id", F.col("path").alias("__now")), "file_id", "left")
    wanted = F.when(F.col("version_id").isNotNull(), F.col("version_id")).when(F.col("moment").isNotNull(), F.col("dated_version")).otherwise(F.col("current_version_id"))
    r = r.withColumn("wanted", F.when(F.col("n") == 1, wanted))
    v = c.versions.select("file_id", F.col("version_id").alias("wanted"), "size", F.col("path").alias("__old"), F.lit(True).alias("__found"))
    living = c.existing.select("path", F.col("file_id").alias("living"))
    r = r.hint("merge").join(v, ["file_id", "wanted"], "left").hint("merge").join(living, "path", "left")
    status = (
        F.when(F.col("version_id").isNotNull() & F.col("moment").isNotNull(), "INVALID").when(F.col("n").isNull(), "UNKNOWN_PATH").when(F.col("n") > 1, "AMBIGUOUS")
        .when(F.col("__found").isNull(), "MISSING").when(F.coalesce("__old", "__now") != F.col("path"), "OTHER_NAME").when(F.col("size").isNull(), "DELETED").otherwise("WRITE")
    )
    r = r.withColumn("status", status)
    ok = F.col("status") == "WRITE"
    return r.select(
        "request_id", "path", "status", F.when(ok, F.col("file_id")).alias("file_id"), F.when(ok, F.col("wanted")).alias("version_id"), F.when(ok & (F.col("living") != F.col("file_id")), F.col("living")).alias("replaces"),
        F.when(F.col("status") == "AMBIGUOUS", F.col("candidates")).alias("candidates"),
    )


def raised(now: Column, *after: str) -> Column:
    """now, or 1 ms after the latest of the given times if that is later."""
    ms = F.expr("INTERVAL '0.001' SECOND")
    return F.greatest(now, *[F.when(F.col(a) >= now, F.col(a) + ms) for a in after])


def _undone(c: Catalog, targets: DataFrame, now: str, key: list[str]) -> DataFrame:
    """What an undo does for rows (key, file_id, path, current_version_id, version_id?, size?, modified?, old_path?, refusal?) of target versions."""
    cur = c.current.select("file_id", F.col("size").alias("current_size"), F.col("modified").alias("current_time"))
    living = c.existing.select(F.col("path").alias("target_path"), F.col("file_id").alias("living"))
    r = targets.hint("merge").join(cur, "file_id", "left").withColumn("target_path", F.coalesce("old_path", "path")).hint("merge").join(living, "target_path", "left")
    gone = F.col("version_id").isNull() | F.col("size").isNull()
    action = F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("version_id") == F.col("current_version_id"), "SKIP").when(gone & F.col("current_size").isNull(), "SKIP").when(gone, "MARK_DELETED").otherwise("REVERT")
    r = r.withColumn("action", action)
    revert = F.col("action") == "REVERT"
    at = F.lit(now).cast("timestamp_ntz")
    when = F.when(revert, raised(at, "modified", "current_time")).when(F.col("action") == "MARK_DELETED", raised(at, "current_time"))
    return r.select(
        *key, "file_id", "action", F.when(revert, F.col("version_id")).alias("target_version_id"), when.alias("new_modified"),
        F.when(revert & (F.col("living") != F.col("file_id")), F.col("living")).alias("replaces"), F.when(revert & (F.col("target_path") != F.col("path")), F.col("target_path")).alias("rename_to"),
    )


def undo_plan(c: Catalog, t: str, now: str, pattern: str | None = None, elements: list[tuple[str, str]] | None = None) -> DataFrame:
    """Take every file back to its version at t: SKIP, MARK_DELETED or REVERT to ``target_version_id``.

    A revert adds a version on top of the target, at operation time or 1 ms after the target and the current
    version; ``replaces`` is another existing file at the target's path, ``rename_to`` that path if the file has another now."""
    snap = snapshot_as_of_with_current(c, t).where(_chosen("path", pattern, elements))
    old = c.versions.select("file_id", "version_id", F.col("path").alias("old_path"))
    return _undone(c, snap.hint("merge").join(old, ["file_id", "version_id"], "left").withColumn("refusal", F.lit(None).cast("string")), now, [])


def undo_versions_plan(c: Catalog, requests: DataFrame, now: str) -> DataFrame:
    """The same for requests (request_id, file_id, version_id): one row each, whatever time the version is of. No filter applies.

    A null version means the file is to be deleted. A file that is not there is refused as NO_FILE, a version that the file does not have as
    NO_VERSION. Requests are answered one by one against the catalog as it is; two of one file are alternatives."""
    f = c.files.select("file_id", "path", "current_version_id", F.lit(True).alias("__file"))
    v = c.versions.select("file_id", "version_id", "size", "modified", F.col("path").alias("old_path"), F.lit(True).alias("__version"))
    r = requests.select("request_id", "file_id", F.col("version_id").cast("int").alias("version_id")).hint("merge").join(f, "file_id", "left").hint("merge").join(v, ["file_id", "version_id"], "left")
    refusal = F.when(F.col("__file").isNull(), "NO_FILE").when(F.col("version_id").isNotNull() & F.col("__version").isNull(), "NO_VERSION")
    return _undone(c, r.withColumn("refusal", refusal), now, ["request_id"])
