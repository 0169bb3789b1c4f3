"""The cap on edges and the labels of clusters do a bounded work a row."""

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import edges


def test_first_rows_of_skewed_places(spark):
    at = [0, 1, 1, 1, 2, 10**12, 10**12 + 1] + [5] * 6
    frame = spark.createDataFrame([(a, i) for i, a in enumerate(at)], "ord long, i int").select("i", F.struct("ord", "i").alias("seq"))
    order = [i for _, i in sorted((a, i) for i, a in enumerate(at))]
    for most in (0, 1, 3, 7, 11, 12, 13, 20):
        got = edges.first_rows(frame, most, ranges=3, size=2)
        assert sorted(r["i"] for r in got.select("i").collect()) == sorted(order[:most])


def test_first_rows_without_a_number_come_last(spark):
    frame = spark.createDataFrame([(None, 0), (4, 1), (None, 2), (3, 3)], "ord long, i int").select("i", F.struct("ord", "i").alias("seq"))
    assert sorted(r["i"] for r in edges.first_rows(frame, 3).select("i").collect()) == [0, 1, 3]


def test_first_rows_of_one_place_do_not_follow_the_order_of_rows(spark):
    for rows in ([(7, i) for i in range(20)], [(None, i) for i in range(20)]):
        for given in (rows, rows[::-1]):
            frame = spark.createDataFrame(given, "ord long, i int").select("i", F.struct("ord").alias("seq"))
            assert sorted(r["i"] for r in edges.first_rows(frame, 3).select("i").collect()) == [0, 1, 2]


def test_first_rows_of_far_places(spark):
    step = 2**60 // 3 + 1
    at = [0, step - 2, step - 1, step, step + 1, 2 * step - 1, 2 * step, 2**60]
    frame = spark.createDataFrame([(a,) for a in at], "ord long").select("ord", F.struct("ord").alias("seq"))
    for most in range(9):
        assert sorted(r["ord"] for r in edges.first_rows(frame, most, ranges=3, size=1).select("ord").collect()) == at[:most]


def test_last_of_equal_places_does_not_follow_the_order_of_rows(spark):
    rows = [("t", "a", "p", "b", 5, "N"), ("t", "a", "p", "b", 5, "A"), ("t", "a", "p", "b", 3, "R"), ("t", "a", "p", "b", 5, "B")]
    for given in (rows, rows[::-1]):
        frame = spark.createDataFrame(given, "type string, source_id string, target_type string, target_id string, seq long, evidence string").coalesce(1)
        assert [(r["evidence"], r["place"]) for r in edges.last_wins(frame).collect()] == [("N", 3)]


def test_first_rows_compares_no_row_with_each_cut(spark):
    frame = spark.range(1000).select("id", F.struct(F.col("id").alias("ord")).alias("seq"))
    plan = edges.first_rows(frame, 500)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_label_of_words_behind_many_stop_words(spark):
    late = " ".join(["the"] * 200 + ["one", "two", "three", "four", "five", "six", "seven", "eight"])
    few = " ".join(["the", "a"] * 100 + ["one"])
    rows = [(0, late), (1, few), (2, ""), (3, "\n\tred `x y` <b>green</b> &amp; blue (dark) https://a.b/c yellow  black"), (4, None)]
    out = {r["i"]: r["l"] for r in spark.createDataFrame(rows, "i int, t string").select("i", text.label(F.col("t")).alias("l")).collect()}
    assert out == {0: "one two three four five six seven", 1: "the a the a the a the", 2: "unlabelled cluster", 3: "red green blue dark yellow black", 4: None}


def test_label_is_split_for_its_first_words_only(spark):
    """Seven million characters: words are looked at once, from the start on."""
    import time

    frame = lambda n: spark.range(40, numPartitions=1).select(F.repeat(F.lit("word other thing some more longer texts here "), n).alias("t"))

    def seconds(n):
        start = time.time()
        frame(n).select(F.max(text.label(F.col("t")))).collect()
        return time.time() - start

    seconds(10)
    assert seconds(4_000) < 8
