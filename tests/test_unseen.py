"""What is known drops out without the chunks being shuffled."""

from tracewright.operators import ingest


def test_chunks_meet_what_is_known_of_them_only(spark):
    """Before, all chunks went with their contents through two shuffles where what is known is large."""
    rows = [("a", "f1", "x"), ("a", "f1", "x"), ("b", "f2", "y"), ("c", None, "z"), ("d", None, "z"), (None, "f4", "u"), (None, "f5", "v"), ("e", "f6", "w"), (None, None, "n")]
    chunks = spark.createDataFrame(rows, "id string, fingerprint string, content string")
    ids, marks = spark.createDataFrame([("b",), ("b",), ("q",), (None,)], "id string"), spark.createDataFrame([("f4",), ("d",), (None,), ("f6",)], "fingerprint string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = ingest.unseen(chunks, ids, marks)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, (tuple(r[c] for c in chunks.columns) for r in out.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning" not in plan
    assert got == sorted(map(str, [rows[0], rows[1], rows[3], rows[6], rows[8]]))
