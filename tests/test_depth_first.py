"""Depth-first hops against a walk over the whole graph, and what one task of the expansion holds."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import trace

EACH = 400


def graph(rng):
    """300 nodes with some parallel edges, and a hub that many reach and that reaches many; ``seq`` has no ties."""
    pairs = [(f"n{i}", f"n{rng.randrange(300)}") for i in range(300) for _ in range(8)]
    pairs += [("hub", f"n{i % 300}") for i in range(600)] + [(f"n{i}", "hub") for i in range(0, 300, 2)]
    return [(a, b, f"t{rng.randrange(3)}", "forward", s) for (a, b), s in zip(pairs, rng.sample(range(10**6), len(pairs)), strict=True)]


def walks(seeds, edges):
    out, got = {}, {}
    for node, other, kind, direction, _ in sorted(edges, key=lambda e: e[4]):
        out.setdefault(node, {}).setdefault(other, (kind, direction))
    for q in sorted({s[0] for s in seeds}):
        starts = [(s[1], None) for s in sorted(seeds, key=lambda s: s[2]) if s[0] == q]
        hops, _ = trace._walk(starts, {n: list(t.items()) for n, t in out.items()}, trace.MAX_HOPS, trace.MAX_TOTAL)
        got[q] = [(n, p, e) for n, p, e, _ in hops]
    return got


@pytest.mark.parametrize("large", [False, True])
def test_depth_first_equals_a_walk_in_bounded_tasks(spark, monkeypatch, large):
    """Before, partitions were merged by their bytes and a large front was met by sorting all edges."""
    rng = random.Random(7)
    edges = graph(rng)
    seeds = [(q, f"n{rng.randrange(300)}", 4 * q + i) for q in range(30) for i in range(4)]
    plans, held = [], []
    kept = trace.checkpointed

    def seen(df):
        out = kept(df)
        if "other" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            held.append(max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) / out.count())
        return out

    monkeypatch.setattr(trace, "checkpointed", seen)
    monkeypatch.setattr(trace, "tasks", lambda rows, each=0: max(1, -(-rows // EACH)), raising=False)
    if large:
        monkeypatch.setattr(trace, "sized", lambda df, *_: df)
        monkeypatch.setattr(trace, "BROADCAST_ROWS", 0, raising=False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = spark.createDataFrame(seeds, "query_id long, node string, ord long"), spark.createDataFrame(edges, "node string, other string, type string, direction string, seq long")
        got = {}
        for r in trace.depth_first(*frames).orderBy("query_id", "hop_index").collect():
            got.setdefault(r.query_id, []).append((r.node, r.parent_hop_index, (r.edge_type, r.direction) if r.edge_type else None))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == walks(seeds, edges)
    assert len(held) == trace.MAX_HOPS and max(held) < 0.25
    assert not any("SortMergeJoin" in line and "LeftSemi" in line for p in plans for line in p.splitlines())


def test_few_rows_take_few_tasks(spark, monkeypatch):
    """A single partition would be dealt anew to as many as shuffles have."""
    one = spark.createDataFrame([("a", "b", "t", "forward", 1), ("b", "c", "t", "forward", 2)], "node string, other string, type string, direction string, seq long")
    seeds = spark.createDataFrame([(0, "a")], "query_id long, node string")
    kept, frames = trace.checkpointed, []
    monkeypatch.setattr(trace, "checkpointed", lambda df: (frames.append(kept(df)), frames[-1])[1])
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        within, met = trace._within(seeds, one.unionByName(one), 3, 30)
        assert met == 3 and within.count() == 2
        assert max(f.rdd.getNumPartitions() for f in frames) <= 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
