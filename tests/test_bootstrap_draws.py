"""Draws of the bootstrap are added up where they are made; the join beyond the limit gives the same."""

import pytest

from tracewright.operators import statistics


@pytest.mark.parametrize("missing", [(), (1, 4), range(7)])
def test_arrays_and_join_agree(spark, missing):
    rows = [(i, i * 0.25, None if i in missing else i * i * 0.5) for i in range(7)]
    pairs = spark.createDataFrame(rows, "pos long, a double, b double")
    arrays = statistics.bootstrap_deltas(pairs, 40, piece=3)
    assert "Join" not in arrays._jdf.queryExecution().executedPlan().toString()  # no row for each draw
    joined = {r["iteration"]: r["delta"] for r in statistics.bootstrap_deltas(pairs, 40, most=0).collect()}
    got = {r["iteration"]: r["delta"] for r in arrays.collect()}
    assert sorted(got) == list(range(40)) and got == pytest.approx(joined)


def test_no_families(spark):
    assert statistics.bootstrap_deltas(spark.createDataFrame([], "pos long, a double, b double"), 5).count() == 0
