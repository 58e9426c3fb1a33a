"""An undo carried out, against plain Python."""

from __future__ import annotations

import datetime
import random

import pytest

from palimpsest import schema
from palimpsest.operators import lookups, mutators
from palimpsest.plans import restore
from palimpsest.schema import Catalog
from palimpsest.sources import derived, tables

THEN, NOW = "2024-01-10", "2024-03-01"
TABLES = ("files", "versions", "last_sync")


def catalog() -> tuple[list[tuple], list[tuple]]:
    """Files and versions: 40 paths of five files, four of them deleted by now, with times that overlap."""
    rng, files, versions = random.Random(4), [], []
    for f in range(1, 201):
        dead, n = f > 40, rng.randrange(2, 6)
        for i, day in enumerate(sorted(rng.sample(range(40), n)), 1):
            versions.append((f, i, None, None if dead and i == n else rng.randrange(100), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), i - 1 or None))
        files.append((f, f"p{f % 40}", n))
    return files, versions


@pytest.mark.parametrize("n", ["4", "13"])
@pytest.mark.parametrize("kept", [True, False], ids=["saved", "derived"])
def test_an_undo_is_carried_out_whole(spark, tmp_path, n, kept):
    files, versions = catalog()
    columns = "file_id bigint, version_id int, path string, size bigint, modified timestamp_ntz, base_version_id int"
    v = mutators.fill(spark.createDataFrame(versions, columns), spark.createDataFrame([], schema.VERSIONS))
    sync = spark.createDataFrame([(f, 1, 1, None, None, None, None) for f, _, _ in files], schema.LAST_SYNC)
    tables.save_catalog(Catalog(spark.createDataFrame(files, schema.FILES), v, sync), str(tmp_path / "c"), TABLES)
    saved = derived.renamed(Catalog(**tables.load_tables(spark, str(tmp_path / "c"), TABLES)))
    if kept:
        tables.save_catalog(saved, str(tmp_path / "r"), TABLES)
        saved = Catalog(**tables.load_tables(spark, str(tmp_path / "r"), TABLES))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        plan = tables.materialize(restore.undo_plan(saved, THEN, NOW))
        out = mutators.apply_undo(saved, plan, NOW)
        got = {r.file_id: (r.path, r.current_version_id, r.size) for r in out.current.collect()}
        counted = {r.file_id: r.n_versions for r in lookups.count_versions(out).collect()}
        told = lookups.next_version_id(out).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    asked = plan.collect()
    now = {f: ("moved/" + p if f % 7 == 0 and n > 1 else p, n) for f, p, n in files}
    size = {(f, i): s for f, i, _, s, _, _ in versions}
    to = {r.file_id: r.rename_to or now[r.file_id][0] for r in asked if r.action == "REVERT"}
    winner = {p: max(f for f in to if to[f] == p) for p in to.values()}
    back = {r.file_id: r for r in asked if r.file_id in winner.values() and r.action == "REVERT"}
    gone = {r.file_id for r in asked if r.action == "MARK_DELETED"} | {r.replaces for r in back.values() if r.replaces is not None and r.replaces not in back}
    want = {}
    for f, (path, last) in now.items():
        want[f] = (to[f], last + 1, size[f, back[f].target_version_id]) if f in back else (path, last + 1, None) if f in gone else (path, last, size[f, last])
    assert len(back) > 20 and len(gone) > 20 and len(to) > len(back) and any(f % 7 == 0 for f in back)
    assert got == want
    assert counted == {f: want[f][1] for f in want}
    assert sorted((r.file_id, r.next_version_id) for r in told) == sorted((f, want[f][1] + 1) for f in want)
