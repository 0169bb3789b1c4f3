"""Fixed windows, exact percentiles, fronts and the slot for models against plain walks."""

import json
import math
import random

import numpy as np
import pytest

from tracewright.operators import extract, statistics, temporal


@pytest.mark.parametrize(("seed", "width", "parts"), [(1, 10.0, 16), (2, 3.0, 1), (3, 500.0, 5)])
def test_fixed_windows_equal_a_walk(spark, seed, width, parts):
    rng = random.Random(seed)
    events = [(rng.choice(["a", "b", None]), rng.choice([rng.uniform(0, 300), float(rng.randint(0, 40)), rng.uniform(5000, 5100)])) for _ in range(400)] + [("c", 7.0), ("a", None)]
    want = {}
    for key in ("a", "b", "c", None):
        start = None
        for t in sorted(t for k, t in events if k == key and t is not None):
            if key is None:
                continue
            if start is None or t >= start + width:
                start = t
            want[key, start] = want.get((key, start), 0) + 1
    got = temporal.fixed_windows(spark.createDataFrame([e for e in events if e[0]], "key string, ts double"), width, 3, parts).collect()
    assert {(r.key, r.start): (r.n, r.allowed) for r in got} == {k: (n, min(n, 3)) for k, n in want.items()}
    assert temporal.fixed_windows(spark.createDataFrame([], "key string, ts double"), width).collect() == []


def test_percentiles_and_front(spark):
    rng = random.Random(5)
    rows = [(i % 3, float(rng.randint(0, 50)) if i % 7 else None, float(rng.randint(0, 30)) if i % 5 else None) for i in range(400)] + [(9, 4.0, 1.0)]
    frame = spark.createDataFrame(rows, "k int, v double, c double")
    got = {r.k: (r.p50, r.p95) for r in statistics.percentiles(frame, "v", {"p50": 0.5, "p95": 0.95}, "k").collect()}
    for k in (0, 1, 2, 9):
        values = [v for i, v, _ in rows if i == k and v is not None]
        assert np.allclose(got[k], np.percentile(values, [50, 95]))
    cost = lambda c: math.inf if c is None else c
    want = sorted(((k, v, c) for k, v, c in rows if v is not None and not any(w is not None and w >= v and cost(d) <= cost(c) and (w > v or cost(d) < cost(c)) for _, w, d in rows)), key=str)
    assert sorted([tuple(r) for r in statistics.frontier(frame.repartition(5), "v", "c").collect()], key=str) == want


def test_a_batch_fails_alone(spark):
    chunks = [("s", i, i, "code", None, "x" * (40 * i)) for i in range(12)] + [(None, 50, 1, None, "src", None), ("t", 60, 1, "code", "src", "y" * 9000)]

    def call(message):
        told = json.loads(message)
        if told[0]["chunk_id"] == "60":
            raise ValueError("too long")
        if any(c["chunk_id"] == "5" for c in told):
            return "none"
        good = {"type": "depends-on", "sourceId": told[0]["chunk_id"], "targetType": "package", "targetId": "lib/a1", "evidence": "it needs the library a1", "confidence": 2}
        bad = [{**good, "sourceId": "99"}, {**good, "evidence": " "}, {**good, "targetId": ""}, {"type": "x"}]
        return json.dumps([good, *bad])

    edges, batches = extract.model_edges(spark.createDataFrame(chunks, "context string, id long, ord long, source_type string, source string, content string"), call, 150)
    rows = batches.collect()
    assert sorted(int(i) for r in rows for i in r.ids) == sorted(c[1] for c in chunks)
    failed = {r.error for r in rows if "60" in r.ids}
    assert failed == {"ValueError: too long"} and {r.error for r in rows if "5" in r.ids} == {"no JSON"}
    good = [r for r in rows if r.error is None]
    found = edges.collect()
    assert len(found) == len(good) > 2 and {(r.type, r.confidence, r.reason) for r in found} == {("depends-on", 0.8, None)}
    assert {r.source_id for r in found} == {r.ids[0] for r in good} and {r.found for r in good} == {5}
