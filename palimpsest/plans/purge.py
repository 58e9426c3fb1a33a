"""Purge plans: which versions, files, sync links, images and log entries go."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import passes
from palimpsest.operators.lookups import image_transfer_target, obsolete_files
from palimpsest.operators.trees import subtree_sums
from palimpsest.schema import Catalog
from palimpsest.sources.tables import materialize


def purge_versions_plan(c: Catalog, epoch: str, elements: list[tuple[str, str]] | None = None) -> DataFrame:
    """(file_id, version_id, kept) of all versions of files that are not obsolete.

    One at a time, old versions that are leaves, or a root with one child, would go until none is left. In closed form,
    with K = versions from the epoch on, current, or with a mark for a child: a version stays if its subtree meets K,
    unless it is not in K itself, its subtree holds all of K, and one child's subtree alone meets K (then it is on the
    single stem above K, from which roots are cut off)."""
    live = c.files.hint("merge").join(obsolete_files(c, epoch), "file_id", "left_anti")
    live = live.where(passes("path", elements)) if elements else live
    v = c.versions.drop("path").hint("merge").join(live.select("file_id", "current_version_id"), "file_id")
    marks = v.where("size IS NULL AND base_version_id IS NOT NULL").select("file_id", F.col("base_version_id").alias("version_id")).distinct().withColumn("__over_mark", F.lit(True))
    fixed = (F.col("modified") >= F.lit(epoch).cast("timestamp_ntz")) | (F.col("version_id") == F.col("current_version_id")) | F.col("__over_mark").isNotNull()
    v = v.hint("merge").join(marks, ["file_id", "version_id"], "left").select("file_id", "version_id", "base_version_id", fixed.alias("fixed"))
    v = materialize(v)
    held = subtree_sums(v.select("file_id", "version_id", "base_version_id", F.col("fixed").cast("long").alias("amount"))).withColumnRenamed("amount", "held")
    total = v.groupBy("file_id").agg(F.count_if("fixed").alias("total"))
    rows = v.hint("merge").join(held, ["file_id", "version_id"], "left").hint("merge").join(total, "file_id")
    branches = rows.where("held > 0 AND base_version_id IS NOT NULL").groupBy("file_id", F.col("base_version_id").alias("version_id")).agg(F.count("*").alias("branches"))
    rows = rows.hint("merge").join(branches, ["file_id", "version_id"], "left")
    stem = ~F.col("fixed") & (F.col("held") == F.col("total")) & (F.coalesce("branches", F.lit(0)) == 1)
    return rows.select("file_id", "version_id", (F.coalesce("held", F.lit(0)).cast("long") > 0).alias("__meets"), stem.alias("__stem")).select("file_id", "version_id", (F.col("__meets") & ~F.coalesce("__stem", F.lit(False))).alias("kept"))


def purged(plan: DataFrame) -> DataFrame:
    return plan.where("NOT kept").select("file_id", "version_id")


def purge_files_plan(c: Catalog, epoch: str, elements: list[tuple[str, str]] | None = None) -> DataFrame:
    """Obsolete files that go as a whole, with what goes with them: (file_id, path, n_versions, n_sync_rows)."""
    gone = obsolete_files(c, epoch)
    gone = gone.where(passes("path", elements)) if elements else gone
    versions = c.versions.groupBy("file_id").agg(F.count("*").alias("n_versions"))
    sync = c.last_sync.groupBy("file_id").agg(F.count("*").alias("n_sync_rows"))
    return gone.hint("merge").join(versions, "file_id", "left").hint("merge").join(sync, "file_id", "left").select("file_id", "path", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.coalesce("n_sync_rows", F.lit(0)).alias("n_sync_rows"))


def purge_reroot_plan(c: Catalog, plan: DataFrame) -> DataFrame:
    """Versions that stay while their base goes: they become roots and lose their deltas."""
    gone = purged(plan).withColumnRenamed("version_id", "base_version_id")
    kept = plan.where("kept").select("file_id", "version_id")
    return c.versions.select("file_id", "version_id", "base_version_id").hint("merge").join(kept, ["file_id", "version_id"]).hint("merge").join(gone, ["file_id", "base_version_id"], "left_semi").select("file_id", "version_id", F.col("base_version_id").alias("old_base_version_id"))


def purge_image_plan(c: Catalog, plan: DataFrame, epoch: str) -> DataFrame:
    """Files that lose all images while versions stay: the version that gets one, or ``blocked`` if there is none."""
    v = c.versions.select("file_id", "version_id", "has_image", "size").hint("merge").join(plan, ["file_id", "version_id"])
    counts = v.groupBy("file_id").agg(F.count_if(F.col("has_image") & F.col("kept")).alias("images"), F.count_if(F.col("kept") & F.col("size").isNotNull()).alias("stay"))
    lost = counts.where("images = 0 AND stay > 0").select("file_id")
    target = image_transfer_target(c, epoch)
    return lost.hint("merge").join(target, "file_id", "left").select("file_id", F.col("version_id").alias("target_version_id"), F.col("version_id").isNull().alias("blocked"))


def purge_sync_unlink_plan(c: Catalog, plan: DataFrame) -> DataFrame:
    """Sync rows that point at a purged version: unlinked, with the version's attributes copied."""
    v = c.versions.select("file_id", "version_id", F.col("size").alias("v_size"), F.col("modified").alias("v_modified"), F.col("path").alias("v_path"))
    f = c.files.select("file_id", F.col("path").alias("f_path"))
    rows = c.last_sync.select("file_id", "replica_id", "version_id").hint("merge").join(purged(plan), ["file_id", "version_id"], "left_semi").hint("merge").join(v, ["file_id", "version_id"]).hint("merge").join(f, "file_id")
    return rows.select("file_id", "replica_id", F.col("version_id").alias("old_version_id"), F.col("v_size").alias("size"), F.col("v_modified").alias("modified"), F.coalesce("v_path", "f_path").alias("path"))


def purge_log(c: Catalog, epoch: str, now: str, filter_name: str = "all", inverted: bool = False) -> Catalog:
    """The log without old entries and their parameters. Only a purge of everything (filter ``all``, not inverted) cleans it, up to 1100 ms ago."""
    if filter_name != "all" or inverted:
        return c
    limit = F.least(F.lit(epoch).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL '1.1' SECOND"))
    old = c.op_log.where(F.col("started") < limit).select("entry")
    return replace(c, op_log=c.op_log.where(F.coalesce(F.col("started") >= limit, F.lit(True))), op_log_params=c.op_log_params.hint("merge").join(old, "entry", "left_anti").select(*c.op_log_params.columns))


def purge_counts(c: Catalog, plan: DataFrame, epoch: str) -> DataFrame:
    """One row (n_versions, n_files, n_unlinked) of what a purge removes: versions, those of whole files among them, files, and sync links."""
    files = purge_files_plan(c, epoch).agg(F.coalesce(F.sum("n_versions"), F.lit(0)).alias("whole"), F.count("*").alias("n_files"))
    single = plan.agg(F.count_if(~F.col("kept")).alias("single"))
    links = purge_sync_unlink_plan(c, plan).agg(F.count("*").alias("n_unlinked"))
    return files.select((F.col("whole") + single.scalar()).alias("n_versions"), "n_files", links.scalar().alias("n_unlinked"))
