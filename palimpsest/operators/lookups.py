"""Lookups, counts and listings over the catalog. Each call answers for all files; filter before it for a few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.paths import effective_filter, prefixes
from palimpsest.functions.sizes import TOLERANCE_MS, in_time_frame, same_time
from palimpsest.schema import Catalog
from palimpsest.sources.tables import materialize


def is_deletion_mark(size: Column | str = "size") -> Column:
    return (F.col(size) if isinstance(size, str) else size).isNull()


def versions_with_effective_path(c: Catalog) -> DataFrame:
    """Versions with ``effective_path``: their own old path, else their file's; and the file's own ``file_path``."""
    f = c.files.select("file_id", F.col("path").alias("file_path"), "current_version_id")
    return c.versions.hint("merge").join(f, "file_id").withColumn("effective_path", F.coalesce("path", "file_path"))


def existing_file_at(c: Catalog, paths: DataFrame) -> DataFrame:
    """The existing file of each requested (path)."""
    return c.existing.hint("merge").join(paths.select("path").distinct(), "path").select("path", "file_id", "current_version_id")


def files_at(c: Catalog, paths: DataFrame) -> DataFrame:
    """All records at each requested (path); ``deleted_at``: time of the current deletion mark."""
    at = c.current.hint("merge").join(paths.select("path").distinct(), "path")
    return at.select("path", "file_id", "current_version_id", F.when(is_deletion_mark(), F.col("modified")).alias("deleted_at"))


def renamed_files_with_versions_at(c: Catalog, paths: DataFrame) -> DataFrame:
    """Distinct files that had a version at a requested (path) and lie elsewhere now."""
    old = c.versions.where("path IS NOT NULL").select("file_id", "path").distinct().hint("merge").join(paths.select("path").distinct(), "path")
    return old.hint("merge").join(c.files.select("file_id", F.col("path").alias("path_now")), "file_id").where("path <> path_now").select("path", "file_id", "path_now")


def files_related_to(c: Catalog, paths: DataFrame) -> DataFrame:
    """Records at each path, then files renamed from it; ``relation``: existing, deleted or renamed."""
    there = files_at(c, paths).select("path", "file_id", F.when(F.col("deleted_at").isNull(), "existing").otherwise("deleted").alias("relation"))
    return there.unionByName(renamed_files_with_versions_at(c, paths).select("path", "file_id", F.lit("renamed").alias("relation")))


def file_versions(c: Catalog, path: str | None = None) -> DataFrame:
    v = versions_with_effective_path(c)
    return v if path is None else v.where(F.col("effective_path") == path)


def derived_versions(c: Catalog) -> DataFrame:
    """(file_id, version_id, child_id): children in the version tree."""
    child = c.versions.select("file_id", F.col("base_version_id").alias("version_id"), F.col("version_id").alias("child_id")).where("version_id IS NOT NULL")
    return c.versions.select("file_id", "version_id").hint("merge").join(child, ["file_id", "version_id"])


def match_versions(c: Catalog, listing: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """Versions that a local file may be: same effective path and size, time within the tolerance; deleted files' too."""
    v = versions_with_effective_path(c).where("size IS NOT NULL").select(F.col("effective_path").alias("path"), "size", "file_id", "version_id", "modified", "current_version_id")
    return listing.hint("merge").join(v, ["path", "size"]).where(same_time(F.col("modified"), F.col("mtime"), tolerance_ms))


def versions_at_within(c: Catalog, paths: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Versions in the time frame of files that are now named as requested."""
    files = c.files if paths is None else c.files.hint("merge").join(paths.select("path").distinct(), "path", "left_semi")
    v = c.versions.where(in_time_frame(F.col("modified"), start, end)).drop("path")
    return v.hint("merge").join(files.select("file_id", "path"), "file_id")


def ancestor_file_conflicts(c: Catalog, paths: DataFrame) -> DataFrame:
    """Nearest file record whose path is a proper prefix of a requested (path), deleted records included."""
    asked = paths.select("path").distinct().withColumn("ancestor_path", F.explode(prefixes("path", proper=True)))
    records = c.files.groupBy(F.col("path").alias("ancestor_path")).agg(F.min("file_id").alias("ancestor_file_id"))
    nearest = F.max_by(F.struct("ancestor_path", "ancestor_file_id"), F.length("ancestor_path")).alias("a")
    return asked.hint("merge").join(records, "ancestor_path").groupBy("path").agg(nearest).select("path", "a.*")


def descendant_file_conflicts(c: Catalog, paths: DataFrame) -> DataFrame:
    """File records strictly below a requested (path)."""
    below = c.files.select("file_id", F.col("path").alias("descendant_path"), F.explode(prefixes("path", proper=True)).alias("path"))
    return below.hint("merge").join(paths.select("path").distinct(), "path").select("path", "file_id", "descendant_path")


def sync_records(c: Catalog) -> DataFrame:
    """Last-sync rows; ``deleted``: the linked version is a mark, or it was unlinked with no size."""
    v = c.versions.select("file_id", "version_id", F.col("size").alias("version_size"), F.lit(True).alias("__linked"))
    joined = c.last_sync.hint("merge").join(v, ["file_id", "version_id"], "left")
    deleted = F.when(F.col("version_id").isNull(), is_deletion_mark()).otherwise(F.col("__linked").isNotNull() & F.col("version_size").isNull())
    return joined.select("file_id", "replica_id", "version_id", "size", "modified", "path", deleted.alias("deleted"))


def operation_log(c: Catalog, start: str | None = None, end: str | None = None) -> DataFrame:
    """Log entries in the frame with replica address, filter name, parameters as a map and status class."""
    log = c.op_log.where(in_time_frame(F.col("started"), start, end))
    params = c.op_log_params.hint("merge").join(log.select("entry"), "entry", "left_semi").groupBy("entry").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("params"))
    uri = F.concat(F.lit("file://"), "user", F.lit("@"), "host", "root")
    r = c.replicas.select("replica_id", uri.alias("replica_uri"))
    f = c.filters.select("filter_id", F.col("name").alias("filter_name"))
    outcome = F.when(F.col("status").isNull(), "NA").when(F.col("status") == "", "OK").otherwise("ER")
    joined = log.join(r, "replica_id", "left").join(f, "filter_id", "left").hint("merge").join(params, "entry", "left")
    return joined.select("entry", "started", "operation", "replica_uri", "filter_name", "filter_inverted", "params", outcome.alias("outcome"))


def replicas_of(c: Catalog) -> DataFrame:
    """Replicas with ``is_default``: the one designated for its user and host, else the one with the lowest id."""
    least = F.min("replica_id").over(Window.partitionBy("host", "user"))
    d = c.replica_defaults.select("host", "user", F.col("replica_id").alias("designated"))
    return c.replicas.join(d, ["host", "user"], "left").select("replica_id", "host", "user", "root", (F.col("replica_id") == F.coalesce("designated", least)).alias("is_default"))


def find_files(c: Catalog, ids: DataFrame) -> DataFrame:
    """Requested (file_id) with ``found``, path and current version."""
    f = c.files.select("file_id", "path", "current_version_id", F.lit(True).alias("__found"))
    return ids.select("file_id").distinct().hint("merge").join(f, "file_id", "left").select("file_id", "path", "current_version_id", F.col("__found").isNotNull().alias("found"))


def find_versions(c: Catalog, keys: DataFrame) -> DataFrame:
    """Requested (file_id, version_id) with ``found``, size and time."""
    v = c.versions.select("file_id", "version_id", "size", "modified", F.lit(True).alias("__found"))
    return keys.select("file_id", "version_id").distinct().hint("merge").join(v, ["file_id", "version_id"], "left").select("file_id", "version_id", "size", "modified", F.col("__found").isNotNull().alias("found"))


def count_versions(c: Catalog) -> DataFrame:
    return c.versions.groupBy("file_id").agg(F.count("*").alias("n_versions"))


def next_version_id(c: Catalog) -> DataFrame:
    """1 for a file without versions."""
    last = c.versions.groupBy("file_id").agg(F.max("version_id").alias("last"))
    return c.files.select("file_id").hint("merge").join(last, "file_id", "left").select("file_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_version_id"))


def filter_usage(c: Catalog) -> DataFrame:
    """Replicas per default filter; a null filter is the global default."""
    used = c.replicas.groupBy(F.col("default_filter_id").alias("filter_id")).agg(F.count("*").alias("n_replicas"))
    ids = c.filters.select("filter_id").unionByName(used.where("filter_id IS NULL").select("filter_id"))
    return ids.join(used.withColumnRenamed("filter_id", "used"), F.col("filter_id").eqNullSafe(F.col("used")), "left").select("filter_id", F.coalesce("n_replicas", F.lit(0)).alias("n_replicas"))


def obsolete_files(c: Catalog, epoch: str) -> DataFrame:
    """Files whose current version is a mark from before the epoch."""
    return c.current.where(is_deletion_mark() & ~F.col("is_broken") & (F.col("modified") < F.lit(epoch).cast("timestamp_ntz"))).select("file_id", "path")


def history_summary(c: Catalog, paths: DataFrame) -> DataFrame:
    return files_related_to(c, paths).groupBy("path").agg(*[F.count_if(F.col("relation") == r).alias(f"n_{r}") for r in ("existing", "renamed", "deleted")])


def image_census(c: Catalog) -> DataFrame:
    """Versions and stored images of each file."""
    return c.versions.groupBy("file_id").agg(F.count("*").alias("n_versions"), F.count_if(F.coalesce("has_image", F.lit(False))).alias("n_images"))


def needs_transfer(c: Catalog) -> DataFrame:
    """Versions that hold the only image of their file and are not its only version."""
    lone = image_census(c).where("n_images = 1 AND n_versions > 1").select("file_id")
    return c.versions.where("has_image").hint("merge").join(lone, "file_id", "left_semi").select("file_id", "version_id")


def list_paths(c: Catalog) -> DataFrame:
    """Distinct paths of all records in depth-first order, by a distributed range sort on the path's elements."""
    return c.files.select("path").distinct().orderBy(F.split("path", "/"))


def touched_paths(c: Catalog, start: str | None = None, end: str | None = None) -> DataFrame:
    return versions_at_within(c, None, start, end).select("path").distinct().orderBy(F.split("path", "/"))


def file_history(c: Catalog, paths: DataFrame) -> DataFrame:
    """Versions of all files related to a path, with the relation and whether the version is current."""
    related = files_related_to(c, paths)
    v = c.versions.hint("merge").join(c.files.select("file_id", "current_version_id"), "file_id")
    size = F.when(is_deletion_mark(), "deleted").otherwise(F.col("size").cast("string"))
    rows = related.hint("merge").join(v.drop("path"), "file_id").select("path", "relation", "file_id", "version_id", "base_version_id", size.alias("size"), "modified", (F.col("version_id") == F.col("current_version_id")).alias("is_current"))
    return rows.orderBy("path", "file_id", "version_id")


def list_filters(c: Catalog, replica_id: int) -> DataFrame:
    chosen = effective_filter(c.replicas.where(F.col("replica_id") == replica_id), c.filters).select("filter_id", F.lit(True).alias("__chosen"))
    return c.filters.join(chosen, "filter_id", "left").select("name", F.col("__chosen").isNotNull().alias("is_default")).orderBy("name")


def version_as_of(c: Catalog, moments: DataFrame) -> DataFrame:
    """Last version of each requested (file_id, moment) at or before the moment, marks included; null if none.

    A merge: versions and moments in one order of file and time, each moment taking the last version before it. The order is dealt to
    ranges, so a file with very many of either is dealt to several; what a range ends with is carried to the file's next ones."""
    asked = moments.select("file_id", "moment").distinct()
    own = F.struct("version_id", "size", "modified").alias("v")
    v = c.versions.where("modified IS NOT NULL").hint("merge").join(asked.select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.col("modified").alias("at"), F.lit(0).alias("kind"), "version_id", own)
    m = asked.select("file_id", F.col("moment").alias("at"), F.lit(1).alias("kind"))
    order = ["file_id", "at", "kind", "version_id"]
    rows = v.unionByName(m, allowMissingColumns=True).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = materialize(rows)
    inside = F.last("v", True).over(Window.partitionBy("file_id", "part").orderBy(*order[1:]))
    ends = rows.groupBy("file_id", "part").agg(F.max_by("v", F.when(F.col("kind") == 0, F.struct("at", "version_id"))).alias("v"))
    before = F.last("v", True).over(Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = ends.select("file_id", "part", before.alias("earlier"))
    found = rows.withColumn("inside", inside).where("kind = 1").hint("merge").join(earlier, ["file_id", "part"], "left")
    best = F.coalesce("inside", "earlier").alias("v")
    return found.select("file_id", F.col("at").alias("moment"), best).select("file_id", "moment", "v.*")


def snapshot_as_of(c: Catalog, t: str) -> DataFrame:
    """The last version of every file at or before t, marks included; of equal times the highest version."""
    v = c.versions.where(F.col("modified") <= F.lit(t).cast("timestamp_ntz"))
    latest = v.groupBy("file_id").agg(F.max_by(F.struct("version_id", "size", "modified"), F.struct("modified", "version_id")).alias("v")).select("file_id", "v.*")
    return latest.hint("merge").join(c.files, "file_id").select("file_id", "path", "current_version_id", "version_id", "size", "modified")


def snapshot_as_of_with_current(c: Catalog, t: str) -> DataFrame:
    """The snapshot, and existing files that have no version by then (version columns null)."""
    snap = snapshot_as_of(c, t)
    later = c.existing.select("file_id", "path", "current_version_id").hint("merge").join(snap.select("file_id"), "file_id", "left_anti")
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    return snap.unionByName(later.select("file_id", "path", "current_version_id", null("int", "version_id"), null("bigint", "size"), null("timestamp_ntz", "modified")))


def best_match(c: Catalog, listing: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """The version that each local file is most likely to be: an existing file's first, then the one that the replica
    synced last, then the latest; ties by higher file id, then version id."""
    found = match_versions(c, listing, tolerance_ms)
    alive = c.existing.select("file_id", F.lit(True).alias("__alive"))
    synced = c.last_sync.where("version_id IS NOT NULL").select("file_id", "replica_id", "version_id", F.lit(True).alias("__synced"))
    ranked = found.hint("merge").join(alive, "file_id", "left").hint("merge").join(synced, ["file_id", "replica_id", "version_id"], "left")
    order = [F.col("__alive").isNotNull().desc(), F.col("__synced").isNotNull().desc(), F.col("modified").desc(), F.col("file_id").desc(), F.col("version_id").desc()]
    first = F.row_number().over(Window.partitionBy("replica_id", "path").orderBy(*order))
    return ranked.withColumn("__rank", first).where("__rank = 1").select("replica_id", "path", "file_id", "version_id", "current_version_id", F.col("__alive").isNotNull().alias("alive"), F.col("__synced").isNotNull().alias("synced"))


def image_transfer_target(c: Catalog, epoch: str) -> DataFrame:
    """Of the versions that stay (from the epoch on, or current; no marks) the smallest, then the one with the highest id."""
    v = c.versions.hint("merge").join(c.files.select("file_id", "current_version_id"), "file_id")
    stay = v.where((F.col("modified") >= F.lit(epoch).cast("timestamp_ntz")) | (F.col("version_id") == F.col("current_version_id"))).where("size IS NOT NULL")
    return stay.groupBy("file_id").agg(F.min_by(F.struct("version_id", "size"), F.struct(F.col("size"), -F.col("version_id"))).alias("v")).select("file_id", "v.*")


def path_collision_winner(snapshot: DataFrame) -> DataFrame:
    """Of several files at one path: no mark before mark, then the later, then the higher file id."""
    order = [is_deletion_mark().asc(), F.col("modified").desc(), F.col("file_id").desc()]
    return snapshot.withColumn("__rank", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("__rank = 1").drop("__rank")
