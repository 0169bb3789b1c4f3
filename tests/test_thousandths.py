"""Thousandths of unit vectors are rounded from doubles, not from vectors stored as float."""

import math

from pyspark.sql import functions as F

from tracewright.functions.vectors import character_sums, normalized, unit
from tracewright.plans.retrieval import _thousandths


def test_thousandths_close_to_a_half(spark):
    # 1000 x / n lies by some 1e-6 above or below a half; stored as float it crosses.
    rows = [[float(a), float(b)] for a in range(1, 700) for b in range(1, 700, 7)]
    exact = [",".join(str(math.floor(1000 * x / math.sqrt(a * a + b * b) + 0.5)) for x in (a, b)) for a, b in rows]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<float>")
    out = frame.select("i", _thousandths(F.col("v")).alias("t"), F.array_join(F.transform(normalized(F.col("v")), lambda x: F.round(1000 * x.cast("double")).cast("long").cast("string")), ",").alias("f")).orderBy("i").collect()
    assert [r["t"] for r in out] == exact
    assert [r["f"] for r in out] != exact  # so the test tells the two apart


def test_large_sums_and_zero_vectors_are_exact(spark):
    total = spark.range(1).select(character_sums(F.repeat(F.lit("\U0001f600"), 201), 1)).first()[0]
    assert total == [201 * 0x1F600]  # beyond 2**24, odd multiples are lost in float
    assert spark.range(1).select(unit(F.array(F.lit(0.0), F.lit(0.0)), 1000.0)).first()[0] == [0.0, 0.0]
