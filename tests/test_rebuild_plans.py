"""J11: no step of rebuilding images sends a table through the driver."""

from __future__ import annotations

from palimpsest.operators import deltas
from palimpsest.sources import derived


def test_rebuilding_broadcasts_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(20)], "doc_id bigint, text string")
    versions, images, fragments = derived.edit_chain(docs)
    plans, materialize = [], deltas.materialize
    monkeypatch.setattr(deltas, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialize(df))
    out = deltas.rebuild_images(versions, images.where("version_id = 1"), fragments)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 60 and len(plans) > 5
    assert not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
