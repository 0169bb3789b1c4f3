"""Shingles that many documents of a source share, against counts of all of them."""

import collections
import math

from tracewright.functions import text as X
from tracewright.operators import ingest


def test_only_what_is_common_in_some_batch_is_counted(spark):
    """Batches of seven documents; before, every shingle of every document went through the shuffle that counts them."""
    texts = {i: (f"s{i % 3}" if i % 20 else None, " ".join([f"own{i} word{i}"] * (i % 4) + ["the same five words here"] * (i % 5 > 1) + [f"one of {i % 6} in the lot"])) for i in range(120)}
    texts[120] = ("s0", None)
    runs = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)}
    counts = collections.Counter((s, r) for s, t in texts.values() for r in runs(t))
    total = collections.Counter(s for s, _ in texts.values())
    want = {i: (len(runs(t)), sum(s is not None and counts[s, r] >= max(2, math.ceil(0.2 * total[s])) for r in runs(t))) for i, (s, t) in texts.items()}
    frame = spark.createDataFrame([(i, s, t) for i, (s, t) in texts.items()], "doc_id long, source string, text string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = ingest.shingled(frame.select("doc_id", "source", X.word_hashes(frame.text).alias("words")))
        got = {r.doc_id: (r.shingles, r.common) for r in ingest.common_shingles(docs, 0.2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == want
