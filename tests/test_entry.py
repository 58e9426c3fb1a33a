from __future__ import annotations

import os

import pytest

import __spark_entry__


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert "E2_snapshot_as_of" in queries


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
