"""Plans carried out: a purged catalog is clean, and changes end where they should."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audits, mutators, trees
from palimpsest.plans import purge
from palimpsest.sources import derived, tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
EPOCH = "2024-01-20"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("catalog") / "c")
    tables.save_catalog(derived.catalog(spark, SF), folder)
    return tables.load_catalog(spark, folder)


def test_purged_catalog_is_clean(catalog):
    plan = tables.materialize(purge.purge_versions_plan(catalog, EPOCH))
    after = mutators.apply_purge(catalog, plan, EPOCH)
    assert audits.audit_references(after).count() == 0
    assert audits.audit_version_order(after).where("rule <> 'newer than current'").count() == 0
    assert audits.audit_restorability(after).count() == 0
    recent = catalog.versions.where(F.col("modified") >= F.lit(EPOCH).cast("timestamp_ntz"))
    assert recent.join(after.versions, ["file_id", "version_id"], "left_anti").join(after.files, "file_id", "left_semi").count() == 0


def test_purge_again_changes_nothing(catalog):
    plan = tables.materialize(purge.purge_versions_plan(catalog, EPOCH))
    after = mutators.apply_purge(catalog, plan, EPOCH)
    again = mutators.apply_purge(after, tables.materialize(purge.purge_versions_plan(after, EPOCH)), EPOCH)
    assert again.versions.count() == after.versions.count()


def test_closure_matches_depth(catalog):
    c = trees.version_closure(catalog.versions)
    assert c.where("depth = 0").count() == catalog.versions.count()
    assert c.where("depth = 1").count() == catalog.versions.where("base_version_id IS NOT NULL").count()


def test_filters_and_replicas(catalog):
    with pytest.raises(ValueError, match="immutable"):
        mutators.save_filter(catalog, "ALL", [])
    with pytest.raises(ValueError, match="default"):
        mutators.drop_filter(catalog, "office")
    assert mutators.drop_filter(catalog, "office", force=True).replicas.where("default_filter_id = 2").count() == 0
    assert mutators.drop_replica(catalog, 2).last_sync.where("replica_id = 2").count() == 0


def test_restored_images_are_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x")], "path string, content string").withColumn("modified", F.lit("2024-01-01").cast("timestamp_ntz"))
    dest = str(tmp_path / "out")
    assert tables.write_restored(rows, dest).count() == 1
    with pytest.raises(Exception, match="already exists"):
        tables.write_restored(rows, dest)
