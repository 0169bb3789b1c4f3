"""Excerpts at the cut: the separator there belongs to them, null contents do not."""

from tracewright.operators import upkeep


def test_excerpt_that_ends_at_a_separator(spark):
    rows = [(1, 0, "abc"), (1, 1, "def"), (2, 0, None), (2, 1, "x"), (3, 0, None)] + [(4, i, "") for i in range(9)]
    got = upkeep.excerpts(spark.createDataFrame(rows, "document_id int, ord int, content string"), 4)
    assert {r["document_id"]: r["excerpt"] for r in got.collect()} == {1: "abc\n", 2: "x", 3: None, 4: "\n\n\n\n"}
