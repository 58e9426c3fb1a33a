"""Catalog changes. Each returns new table states, the old rows without the changed keys plus the changed rows; nothing
is written. Callers save the result as a new snapshot folder."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.sizes import EMPTY_DELTA, dummy_common_size
from palimpsest.operators.lookups import next_version_id
from palimpsest.operators.numbering import numbered
from palimpsest.plans.purge import purge_files_plan, purge_image_plan, purge_reroot_plan, purge_sync_unlink_plan, purged
from palimpsest.plans.restore import raised
from palimpsest.schema import Catalog
from palimpsest.sources.tables import materialize

MS = "INTERVAL '0.001' SECOND"


def fill(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with all columns of ``like`` in its order and types; null where rows has none."""
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in like.dtypes])


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.hint("merge").join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(fill(rows, target))


def new_ids(rows: DataFrame, order: list[str], above: DataFrame, id_col: str) -> DataFrame:
    """Adds the ids that follow the largest in ``above``, gapless and in the given order, whatever the partitions of rows."""
    top = above.agg(F.max(id_col)).first()[0] or 0
    return numbered(rows, [F.col(c) for c in order], id_col, top + 1)


def record_sync(c: Catalog, rows: DataFrame) -> Catalog:
    """(file_id, replica_id, version_id): all other fields of these sync rows become null."""
    return replace(c, last_sync=upsert(c.last_sync, rows.select("file_id", "replica_id", "version_id"), ["file_id", "replica_id"]))


def delete_sync(c: Catalog, files: DataFrame, replica_id: int | None = None) -> Catalog:
    """The sync rows of the files, of one replica or all."""
    gone = c.last_sync.hint("merge").join(files.select("file_id"), "file_id", "left_semi")
    gone = gone if replica_id is None else gone.where(F.col("replica_id") == replica_id)
    return replace(c, last_sync=c.last_sync.hint("merge").join(gone.select("file_id", "replica_id"), ["file_id", "replica_id"], "left_anti").select(*c.last_sync.columns))


def repoint(c: Catalog, current: DataFrame) -> DataFrame:
    """Files with the current version of ``current`` (file_id, version_id) where it has one."""
    new = current.select("file_id", F.col("version_id").alias("__new"))
    return c.files.hint("merge").join(new, "file_id", "left").select("file_id", "path", F.coalesce("__new", "current_version_id").cast("int").alias("current_version_id"))


def deletion_marks(c: Catalog, files: DataFrame, when: str) -> DataFrame:
    """(file_id, version_id, base_version_id, modified, has_image): a deletion mark on the current version of each given existing file."""
    target = c.existing.hint("merge").join(files.select("file_id").distinct(), "file_id", "left_semi").hint("merge").join(next_version_id(c), "file_id")
    at = F.lit(when).cast("timestamp_ntz")
    return target.select("file_id", F.col("next_version_id").alias("version_id"), F.col("current_version_id").alias("base_version_id"), raised(at, "modified").alias("modified"), F.lit(False).alias("has_image"))


def put_on_top(c: Catalog, new: DataFrame) -> Catalog:
    """Append versions and make them current."""
    return replace(c, versions=c.versions.unionByName(fill(new, c.versions)), files=repoint(c, new))


def mark_deleted(c: Catalog, files: DataFrame, when: str, replica_id: int | None = None) -> Catalog:
    """Append a deletion mark on the current version of the given existing files and make it current; with a replica, record its sync."""
    marks = deletion_marks(c, files, when)
    out = put_on_top(c, marks)
    return out if replica_id is None else record_sync(out, marks.withColumn("replica_id", F.lit(replica_id)))


def new_versions(c: Catalog, rows: DataFrame, now: str) -> DataFrame:
    """(file_id, size, modified) as versions on top of the current ones, with ``refused`` where that is a mark.

    A time in the future becomes the operation time; one before the base's, 1 ms after it."""
    r = rows.select("file_id", F.col("size").alias("new_size"), F.col("modified").alias("new_time")).hint("merge").join(c.current.select("file_id", "current_version_id", "size", "modified"), "file_id").hint("merge").join(next_version_id(c), "file_id")
    at = F.least("new_time", F.lit(now).cast("timestamp_ntz"))
    time = F.when(at < F.col("modified"), F.col("modified") + F.expr(MS)).otherwise(at)
    return r.select("file_id", F.col("next_version_id").cast("int").alias("version_id"), F.col("new_size").alias("size"), time.alias("modified"), F.col("current_version_id").alias("base_version_id"), F.lit(True).alias("has_image"), F.col("size").isNull().alias("refused"))


def add_versions(c: Catalog, rows: DataFrame, now: str) -> Catalog:
    new = new_versions(c, rows, now).where("NOT refused")
    return replace(c, versions=c.versions.unionByName(fill(new, c.versions)), files=repoint(c, new))


def new_files(c: Catalog, rows: DataFrame) -> DataFrame:
    """(path, size, modified, refused, file_id) of rows (path, size, modified): ``refused`` where an existing file has the path, else with the
    id of the new file. Of several rows of one path the latest counts, then the larger; ids follow the order of the paths."""
    last = rows.groupBy("path").agg(F.max(F.struct("modified", "size")).alias("r")).select("path", "r.size", "r.modified")
    taken = c.existing.select("path")
    free = new_ids(last.hint("merge").join(taken, "path", "left_anti"), ["path"], c.files, "file_id").withColumn("refused", F.lit(False))
    return free.unionByName(last.hint("merge").join(taken, "path", "left_semi").withColumn("refused", F.lit(True)), allowMissingColumns=True)


def add_files(c: Catalog, rows: DataFrame, replica_id: int) -> Catalog:
    """(path, size, modified) as new files with a stored first version and a sync row; paths of existing files are refused (``new_files``)."""
    new = new_files(c, rows).where("NOT refused").withColumn("version_id", F.lit(1)).withColumn("current_version_id", F.lit(1)).withColumn("has_image", F.lit(True))
    sync = new.select("file_id", F.lit(replica_id).alias("replica_id"), "version_id")
    return replace(c, files=c.files.unionByName(fill(new, c.files)), versions=c.versions.unionByName(fill(new.drop("path"), c.versions)), last_sync=c.last_sync.unionByName(fill(sync, c.last_sync)))


def rename_files(c: Catalog, rows: DataFrame) -> Catalog:
    """(file_id, new_path). Versions and unlinked sync rows without a path of their own keep the old one."""
    old = c.files.hint("merge").join(rows.select("file_id", "new_path"), "file_id").where("path <> new_path").select("file_id", F.col("path").alias("__old"), "new_path")
    versions = c.versions.hint("merge").join(old.select("file_id", "__old"), "file_id", "left").withColumn("path", F.coalesce("path", "__old")).select(*c.versions.columns)
    unlinked = F.when(F.col("version_id").isNull(), F.coalesce("path", "__old")).otherwise(F.col("path"))
    sync = c.last_sync.hint("merge").join(old.select("file_id", "__old"), "file_id", "left").withColumn("path", unlinked).select(*c.last_sync.columns)
    files = c.files.hint("merge").join(old, "file_id", "left").select("file_id", F.coalesce("new_path", "path").alias("path"), "current_version_id")
    return replace(c, files=files, versions=versions, last_sync=sync)


def dummy_versions(c: Catalog, revert: DataFrame) -> DataFrame:
    """A child of each target with its content, for the REVERT rows of an undo plan."""
    target = c.versions.select("file_id", F.col("version_id").alias("target_version_id"), "size", "digest")
    return revert.hint("merge").join(target, ["file_id", "target_version_id"]).hint("merge").join(next_version_id(c), "file_id").select(
        "file_id", F.col("next_version_id").cast("int").alias("version_id"), "size", "digest", F.col("new_modified").alias("modified"), F.col("target_version_id").alias("base_version_id"), F.lit(False).alias("has_image"),
        dummy_common_size(F.col("size")).alias("cdelta_len"), F.lit(EMPTY_DELTA).alias("fdelta_len"), F.lit(EMPTY_DELTA).alias("rdelta_len"),
    )


def put_back(c: Catalog, revert: DataFrame, new: DataFrame) -> Catalog:
    """The dummy versions of REVERT rows made current; files renamed back."""
    return put_on_top(rename_files(c, revert.where("rename_to IS NOT NULL").select("file_id", F.col("rename_to").alias("new_path"))), new)


def add_dummy_versions(c: Catalog, plan: DataFrame) -> Catalog:
    """Apply the REVERT rows of an undo plan: a child of the target with its content, made current; files renamed back."""
    revert = plan.where("action = 'REVERT'")
    return put_back(c, revert, dummy_versions(c, revert))


def apply_undo(c: Catalog, plan: DataFrame, now: str) -> Catalog:
    """Carry out an undo plan of one row a file: files at a target's path give way, marks are appended, targets come back on top.

    Where several files are taken back to one path, the one with the highest id has it and the others stay as they are.

    Marks and dummy versions are written before they are appended: a plan of all steps would derive the versions with their marks again in
    each, and Spark 4.1 fails on it. A union whose inputs are all dealt by file counts as dealt by file itself, which Spark forgets for an
    input that turns out to be a shuffle used before, when steps after it are planned already."""
    back = plan.where("action = 'REVERT'").hint("merge").join(c.files.select("file_id", "path"), "file_id").withColumn("__to", F.coalesce("rename_to", "path"))
    winners = back.groupBy("__to").agg(F.max("file_id").alias("file_id")).select("file_id")
    reverted = materialize(plan.where("action = 'REVERT'").hint("merge").join(winners, "file_id", "left_semi"))
    gone = plan.where("action = 'MARK_DELETED'").select("file_id").unionByName(reverted.where("replaces IS NOT NULL").select(F.col("replaces").alias("file_id")))
    marked = put_on_top(c, materialize(deletion_marks(c, gone.hint("merge").join(reverted, "file_id", "left_anti"), now)))
    return put_back(marked, reverted, materialize(dummy_versions(marked, reverted)))


def register_replicas(c: Catalog, rows: DataFrame) -> Catalog:
    """(host, user, root) not there yet, with the next ids in that order."""
    key = ["host", "user", "root"]
    new = new_ids(rows.select(*key).distinct().join(c.replicas, key, "left_anti"), key, c.replicas, "replica_id")
    return replace(c, replicas=c.replicas.unionByName(fill(new, c.replicas)))


def designate_default(c: Catalog, host: str, user: str, replica_id: int) -> Catalog:
    row = c.replicas.where((F.col("replica_id") == replica_id) & (F.col("host") == host) & (F.col("user") == user)).select("host", "user", "replica_id")
    return replace(c, replica_defaults=upsert(c.replica_defaults, row, ["host", "user"]))


def set_default_filter(c: Catalog, replica_id: int, filter_id: int | None) -> Catalog:
    value = F.when(F.col("replica_id") == replica_id, F.lit(filter_id)).otherwise(F.col("default_filter_id")).cast("int")
    return replace(c, replicas=c.replicas.withColumn("default_filter_id", value))


def drop_replica(c: Catalog, replica_id: int) -> Catalog:
    """Its sync rows and its place as a default go too; log entries stay without it."""
    other = F.col("replica_id") != replica_id
    log = c.op_log.withColumn("replica_id", F.when(other, F.col("replica_id")))
    return replace(c, replicas=c.replicas.where(other), last_sync=c.last_sync.where(other), replica_defaults=c.replica_defaults.where(other), op_log=log)


def save_filter(c: Catalog, name: str, elements: list[tuple[str, str]]) -> Catalog:
    """Create or replace a filter: name in lower case, elements numbered per type. ``all`` cannot change."""
    name = name.lower()
    if name == "all":
        raise ValueError("the filter 'all' is immutable")
    spark = c.filters.sparkSession
    known = c.filters.where(F.col("name") == name).select("filter_id").first()
    filter_id = known[0] if known else (c.filters.agg(F.max("filter_id")).first()[0] or 0) + 1
    numbered, n = [], {}
    for kind, pattern in elements:
        n[kind] = n.get(kind, 0) + 1
        numbered.append((filter_id, kind, n[kind], pattern))
    rows = spark.createDataFrame(numbered, "filter_id int, type string, number int, pattern string")
    filters = upsert(c.filters, spark.createDataFrame([(filter_id, name)], "filter_id int, name string"), ["filter_id"])
    return replace(c, filters=filters, filter_elements=c.filter_elements.where(F.col("filter_id") != filter_id).unionByName(rows))


def drop_filter(c: Catalog, name: str, force: bool = False) -> Catalog:
    """Elements go too and replicas lose it as default; refused while in use unless forced, and for ``all``."""
    name = name.lower()
    if name == "all":
        raise ValueError("the filter 'all' is immutable")
    gone = c.filters.where(F.lower("name") == name).select("filter_id")
    used = c.replicas.join(gone, c.replicas["default_filter_id"] == gone["filter_id"], "left_semi")
    if not force and not used.isEmpty():
        raise ValueError(f"the filter '{name}' is some replica's default")
    ids = gone.withColumnRenamed("filter_id", "default_filter_id").withColumn("__gone", F.lit(True))
    replicas = c.replicas.join(ids, "default_filter_id", "left").withColumn("default_filter_id", F.when(F.col("__gone").isNull(), F.col("default_filter_id"))).select(*c.replicas.columns)
    log = c.op_log.join(gone.withColumn("__gone", F.lit(True)), "filter_id", "left").withColumn("filter_id", F.when(F.col("__gone").isNull(), F.col("filter_id"))).select(*c.op_log.columns)
    return replace(c, filters=c.filters.join(gone, "filter_id", "left_anti"), filter_elements=c.filter_elements.join(gone, "filter_id", "left_anti"), replicas=replicas, op_log=log)


def log_operations(c: Catalog, rows: DataFrame) -> Catalog:
    """Append log rows; a column ``params`` (map) becomes parameter rows."""
    params = rows.select("entry", F.explode("params").alias("name", "value")) if "params" in rows.columns else None
    return replace(c, op_log=c.op_log.unionByName(fill(rows, c.op_log)), op_log_params=c.op_log_params if params is None else c.op_log_params.unionByName(params))


def set_status(c: Catalog, rows: DataFrame) -> Catalog:
    """(entry, status): '' for success, a message for a failure."""
    new = rows.select("entry", F.col("status").alias("__status"), F.lit(True).alias("__set"))
    log = c.op_log.hint("merge").join(new, "entry", "left").withColumn("status", F.when(F.col("__set"), F.col("__status")).otherwise(F.col("status"))).select(*c.op_log.columns)
    return replace(c, op_log=log)


def migrate_soft_deletes(c: Catalog, deleted: DataFrame, sync_deleted: DataFrame) -> Catalog:
    """From a release that kept a ``deleted`` time on files (file_id, deleted) and a flag on sync rows (file_id, replica_id).

    Each such file gets a deletion mark as its last version; flagged sync rows point at their file's latest mark, or go if
    it has none."""
    marks = deleted.where("deleted IS NOT NULL").hint("merge").join(c.files, "file_id").hint("merge").join(next_version_id(c), "file_id").select("file_id", F.col("next_version_id").cast("int").alias("version_id"), F.col("current_version_id").alias("base_version_id"), F.col("deleted").alias("modified"), F.lit(False).alias("has_image"))
    versions = c.versions.unionByName(fill(marks, c.versions))
    latest = versions.where("size IS NULL").groupBy("file_id").agg(F.max("version_id").alias("__mark"))
    flagged = sync_deleted.select("file_id", "replica_id")
    kept = c.last_sync.hint("merge").join(flagged, ["file_id", "replica_id"], "left_anti").select(*c.last_sync.columns)
    moved = c.last_sync.hint("merge").join(flagged, ["file_id", "replica_id"], "left_semi").hint("merge").join(latest, "file_id").select("file_id", "replica_id", F.col("__mark").alias("version_id"))
    return replace(c, versions=versions, files=repoint(c, marks), last_sync=kept.unionByName(fill(moved, c.last_sync)))


def apply_purge(c: Catalog, plan: DataFrame, epoch: str) -> Catalog:
    """Carry out the purge of versions (``plan``) and of obsolete files in all tables.

    A file that would lose its last image with no version to move it to stays as it is."""
    blocked = purge_image_plan(c, plan, epoch).where("blocked").select("file_id", F.lit(True).alias("__blocked"))
    plan = plan.hint("merge").join(blocked, "file_id", "left").select("file_id", "version_id", (F.col("kept") | F.coalesce("__blocked", F.lit(False))).alias("kept"))
    files_gone = purge_files_plan(c, epoch).select("file_id")
    gone, reroot, images, unlink = purged(plan), purge_reroot_plan(c, plan), purge_image_plan(c, plan, epoch), purge_sync_unlink_plan(c, plan)
    roots = reroot.select("file_id", "version_id", F.lit(True).alias("__root"))
    stored = images.where("NOT blocked").select("file_id", F.col("target_version_id").alias("version_id"), F.lit(True).alias("__image"))
    v = c.versions.hint("merge").join(files_gone, "file_id", "left_anti").hint("merge").join(gone, ["file_id", "version_id"], "left_anti").hint("merge").join(roots, ["file_id", "version_id"], "left").hint("merge").join(stored, ["file_id", "version_id"], "left")
    clear: dict[str, Column] = {n: F.when(F.col("__root").isNull(), F.col(n)) for n in ("base_version_id", "cdelta_len", "fdelta_len", "rdelta_len")}
    v = v.withColumns({**clear, "has_image": F.col("has_image") | F.coalesce("__image", F.lit(False))}).select(*c.versions.columns)
    sync = upsert(c.last_sync.hint("merge").join(files_gone, "file_id", "left_anti").select(*c.last_sync.columns), unlink.drop("old_version_id"), ["file_id", "replica_id"])
    return replace(c, files=c.files.hint("merge").join(files_gone, "file_id", "left_anti"), versions=v, last_sync=sync)
