"""Hot files, many replicas, gapless numbers and tree labels against plain Python."""

from __future__ import annotations

import datetime
import os
import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import catalog_queries, schema
from palimpsest.operators import lookups, trees
from palimpsest.operators.numbering import numbered
from palimpsest.plans import replica_sets
from palimpsest.schema import Catalog
from palimpsest.sources import derived, tables

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions, which AQE leaves alone."""
    conf = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}

    def use(n: int) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [1, 13])
def test_versions_of_a_hot_file(spark, partitions, n):
    """20,000 versions and 3,000 moments of one file, ties, a file without versions, and null times."""
    partitions(n)
    rng = np.random.default_rng(n)
    times = np.sort(rng.integers(0, 40_000, 20_000))
    second = lambda t: START + datetime.timedelta(seconds=int(t))
    v = [(1, i + 1, i, second(t)) for i, t in enumerate(times)] + [(2, 1, 5, second(10)), (2, 2, None, second(20)), (2, 3, 6, None)]
    moments = [(1, second(t)) for t in rng.integers(-5, 45_000, 3000)] + [(2, second(t)) for t in (9, 10, 15, 25)] + [(3, second(1)), (1, None), (None, second(3))] * 2
    c = Catalog(None, spark.createDataFrame(v, "file_id bigint, version_id int, size bigint, modified timestamp_ntz").repartition(3))
    got = {(r.file_id, r.moment): (r.version_id, r.size, r.modified) for r in lookups.version_as_of(c, spark.createDataFrame(moments, "file_id bigint, moment timestamp_ntz")).collect()}
    want = {}
    for f, m in moments:
        own = [x for x in (v[20_000:] if f == 2 else []) if x[3] and x[3] <= m]
        if f == 1 and m is not None:
            at = int(np.searchsorted(times, (m - START).total_seconds(), "right"))
            own = v[at - 1 : at] if at else []
        want[f, m] = own[-1][1:] if own else (None, None, None)
    assert got == want


@pytest.mark.parametrize("n", [1, 7, 40])
def test_numbers_are_gapless_and_in_order(spark, partitions, n):
    partitions(n)
    rows = spark.range(5000).select(F.concat(F.lit("p"), (F.col("id") * 7919 % 5000).cast("string")).alias("path"), F.col("id").alias("size"))
    got = [(r.path, r.number) for r in numbered(rows.repartition(5), [F.col("path")], "number", 100).orderBy("number").collect()]
    assert got == [(p, i) for i, p in enumerate(sorted(f"p{k}" for k in range(5000)), 100)]
    assert numbered(rows.limit(0), [F.col("path")], "number").collect() == []


def trees_of() -> list[tuple]:
    rng = random.Random(8)
    rows = [(1, i, i - 1 if i > 1 else None) for i in range(1, 700)]
    rows += [(2, 1, None), *((2, i, 1) for i in range(2, 900))]
    rows += [(3, i, rng.randrange(1, i) if i > 1 else None) for i in range(1, 800)]
    rows += [(4, 5, None), (4, 2, None), (4, 9, 2), (4, 3, 77), (5, 1, None)]
    return rows


def test_labels_of_trees(spark):
    rows = trees_of()
    v = spark.createDataFrame(rows, "file_id bigint, version_id int, base_version_id int").repartition(4)
    labels = trees.version_labels(v)
    got = {(r.file_id, r.version_id): (r.first, r.last, r.depth) for r in labels.collect()}
    assert len(got) == len(rows)
    children: dict = {}
    known = {(f, i) for f, i, _ in rows}
    for f, i, b in rows:
        children.setdefault((f, b if (f, b) in known else None), []).append(i)
    want, pairs = {}, {}
    for f in {r[0] for r in rows}:
        order, todo = [], [(i, 0) for i in sorted(children[f, None], reverse=True)]
        while todo:
            i, depth = todo.pop()
            order.append((i, depth))
            todo += [(j, depth + 1) for j in sorted(children.get((f, i), []), reverse=True)]
        for at, (i, depth) in enumerate(order):
            end = at
            while end + 1 < len(order) and order[end + 1][1] > depth:
                end += 1
            want[f, i] = (at, end, depth)
            pairs[f, i] = {(j, d - depth) for j, d in order[at : end + 1]}
    assert got == want
    asked = spark.createDataFrame([(1, 650), (2, 1), (3, 2), (3, 700), (4, 2), (4, 3), (9, 9)], "file_id bigint, version_id int")
    found: dict = {}
    for r in trees.descendants(labels, asked).collect():
        found.setdefault((r.file_id, r.ancestor), set()).add((r.descendant, r.depth))
    assert found == {(r.file_id, r.version_id): pairs[r.file_id, r.version_id] for r in asked.where("file_id < 9").collect()}
    asks = spark.createDataFrame([(3, a, d) for a in (1, 2, 5, 600) for d in (2, 5, 700, 9999)] + [(2, 1, 800), (2, 800, 1)], "file_id bigint, ancestor int, descendant int")
    assert all(r.related == (r.descendant in {j for j, _ in pairs[r.file_id, r.ancestor]}) for r in trees.is_ancestor(labels, asks).collect())


def test_trees_of_several_blocks(spark, partitions, monkeypatch):
    """Sums and nearest images in trees of more than one block of versions, against plain Python; the states written do not grow with the depth."""
    partitions(3)
    rng, n = random.Random(5), 9500
    up = {1: [i - 1 for i in range(1, n)], 2: [0] + [1] * (n - 2), 3: [rng.randrange(max(0, i - 5000), i) for i in range(1, n)], 4: [i + 1 for i in range(1, n - 1)] + [0], 5: [0, 1, 77, 2]}
    rows = [(f, i, b or None, rng.randrange(-5, 10**15), rng.random() < 0.0005, None if rng.random() < 0.001 else 5) for f, bases in up.items() for i, b in enumerate(bases, 1)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "file_id bigint, version_id int, base_version_id int, amount bigint, has_image boolean, size bigint")
    own = {(f, i): (b, a, image, size) for f, i, b, a, image, size in rows}
    sums, ways = {k: x[1] for k, x in own.items()}, {}
    order = sorted(own, key=lambda k: (k[0], -k[1] if k[0] == 4 else k[1]))
    for f, i in reversed(order):
        if (f, own[f, i][0]) in own:
            sums[f, own[f, i][0]] += sums[f, i]
    for f, i in order:
        ways[f, i] = own[f, i][1] + ways.get((f, own[f, i][0]), 0)
    states = []
    monkeypatch.setattr(trees, "materialize", lambda df: states.append(1) or tables.materialize(df))
    got = trees.subtree_sums(d).collect()
    assert {(r.file_id, r.version_id): r.amount for r in got} == sums and len(got) == len(rows)
    got = trees.way_sums(d.withColumnRenamed("base_version_id", "next")).collect()
    assert {(r.file_id, r.version_id): r.amount for r in got} == ways and len(got) == len(rows)
    assert len(states) < 16

    live = {k: x for k, x in own.items() if x[3] is not None}
    edges: dict = {}
    for (f, i), x in live.items():
        if (f, x[0]) in live:
            edges.setdefault((f, i), []).append((f, x[0]))
            edges.setdefault((f, x[0]), []).append((f, i))
    far = {k: 0 for k, x in live.items() if x[2]}
    ring = list(far)
    while ring:
        ring = [m for k in ring for m in edges.get(k, []) if m not in far and not far.update({m: far[k] + 1})]
    got = trees.image_distances(d).collect()
    assert {(r.file_id, r.version_id): r.far for r in got} == far and len(got) == len(far)
    for r in got:
        assert (r.next is None) == (r.far == 0) and (r.next is None or far[r.file_id, r.next] == r.far - 1)


def test_sets_of_replicas(spark):
    """Each replica's part is the product less the exceptions; rows grow with files and exceptions."""
    rng = random.Random(2)
    exceptions = {(f, rng.choice([0, 1, 5, 1023, 1024, 2500, 70_000])) for f in range(40) for _ in range(rng.randrange(5))}
    rows = spark.range(40).select(F.col("id").alias("file_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"))
    plan = replica_sets.all_but(rows, spark.createDataFrame(sorted(exceptions), "file_id bigint, replica_id int"), "file_id").cache()
    assert plan.count() == 40 + len({(f, r // replica_sets.BLOCK) for f, r in exceptions})
    one = spark.createDataFrame([(5, 99), (6, 99)], "replica_id int, file_id bigint").withColumn("path", F.lit("x"))
    plan = plan.unionByName(one.select("file_id", "path", *replica_sets.one()))
    for r in (0, 1, 4, 5, 1023, 1024, 1025, 2500, 70_000, 10**6):
        got = sorted(x.file_id for x in replica_sets.of_replica(plan, r).collect())
        assert got == sorted([f for f in range(40) if (f, r) not in exceptions] + [99] * (r in (5, 6)))
    assert {x.replica_id for x in replica_sets.of_replica(plan, 4).collect()} == {4}
    plan.unpersist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_a_changed_table_is_derived_again(spark, tmp_path):
    for name in derived.SOURCES:
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    before = derived.saved_catalog(spark, str(tmp_path)).versions.count()
    assert derived.saved_catalog(spark, str(tmp_path)).versions.count() == before
    path = tmp_path / "events.parquet"
    half = spark.read.parquet(str(path)).where("event_id % 2 = 0").toPandas()
    path.unlink()
    spark.createDataFrame(half).coalesce(1).write.parquet(str(path))
    c = derived.saved_catalog(spark, str(tmp_path))
    assert 0 < c.versions.count() < before
    assert c.versions.count() == derived.catalog(spark, str(tmp_path)).versions.count()
    assert tables.file_states(spark, str(path)) == tables.file_states(spark, str(path))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["I3_sync_new_local", "I4_sync_plan_sets", "K1_record_sync", "I14_purge_log", "M2_audit_references", "K3_mark_deleted", "F3_changed_paths"])
def test_no_table_of_the_catalog_is_broadcast(spark, name):
    """Files, versions, sync rows, local files and log entries meet by shuffles, however few they are; only replicas' filters may go through the driver."""
    plan = catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search("SortMergeJoin", plan)
    assert not re.findall(r"BroadcastHashJoin \[(?:knownfloatingpointnormalized\()?(?:file_id|path|entry|match_file)#", plan)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_a_loaded_catalog_is_derived_once(spark, monkeypatch):
    """What several tables are derived from is stored: local files are not derived from the events again."""
    saved, save = [], tables.save_catalog
    monkeypatch.setattr(tables, "save_catalog", lambda c, folder: saved.append(c) or save(c, folder))
    assert catalog_queries.QUERIES["A2_load_catalog"](spark, "/root/testdata/sf0.001").count() > 0
    assert not any("events.parquet" in f for f in saved[0].listing.inputFiles())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_log_tables_are_written_only_for_queries_that_use_them(spark, tmp_path, monkeypatch):
    for name in derived.SOURCES:
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    written, save = [], derived.save_catalog
    monkeypatch.setattr(derived, "save_catalog", lambda c, folder, *names: written.append(*names or [tuple(schema.TABLES)]) or save(c, folder, *names))
    for name in ("F3_changed_paths", "I2_sync_absent", "E3_snapshot_as_of_with_current", "K3_mark_deleted", "C3_existing_file_at"):
        catalog_queries.QUERIES[name](spark, str(tmp_path))
    assert len(written) == 1 and not {"op_log", "op_log_params"} & {*written[0]}
    lazy = derived.saved_catalog(spark, str(tmp_path))
    for name in ("C14_operation_log", "I14_purge_log", "K9_update_filters", "K10_log_operations"):
        catalog_queries.QUERIES[name](spark, str(tmp_path))
    assert written[1:] == [("op_log", "op_log_params")]
    kept = derived.saved_catalog(spark, str(tmp_path), logs=True)
    for name in ("op_log", "op_log_params"):
        a, b = (sorted(map(str, getattr(c, name).collect())) for c in (lazy, kept))
        assert a == b and a


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_events_are_dealt_to_partitions_in_number_with_the_table(spark, monkeypatch):
    """A task that puts versions in order holds a bounded part of the events, whatever the session's number of partitions."""
    sf = "/root/testdata/sf0.001"
    before = sorted(map(str, derived.catalog(spark, sf).versions.collect()))
    monkeypatch.setattr(derived, "PARTITION_BYTES", 1 << 10)
    n = -(-os.path.getsize(f"{sf}/events.parquet") // (1 << 10))
    versions = derived.catalog(spark, sf).versions
    assert n > spark.sparkContext.defaultParallelism
    assert re.search(rf"hashpartitioning\(path#\d+, {n}\), REPARTITION_BY_NUM", versions._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(str, versions.collect())) == before
