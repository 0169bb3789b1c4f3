"""The kept vector index against a full scan."""

import numpy as np
import pytest

from tracewright.operators import cluster, retrieval
from tracewright.operators.index import DimensionMismatch, VectorIndex

SCHEMA = "id long, embedding array<float>, kind string, n int"


def rows_of(seed, n=600, dim=8, groups=12, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    m = middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    m[:3] = 0
    m[5] = m[4]
    return [(i, v.astype(np.float32).tolist(), f"k{i % 3}", 0) for i, v in enumerate(m)]


def scan(rows, queries, k):
    m = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    ids = np.array([r[0] for r in rows])
    out = {}
    for q, v in queries:
        v = np.array(v, np.float64)
        both = np.linalg.norm(m, axis=1) * np.linalg.norm(v)
        s = np.divide(m @ v, both, out=np.zeros(len(m)), where=both > 0)
        at = np.lexsort((ids, -s.round(12)))[:k]
        out[q] = [(int(ids[i]), round(float(s[i]), 9)) for i in at]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    return out


@pytest.mark.parametrize(("seed", "cells", "block"), [(1, 24, 10_000), (2, None, 37), (3, 1, 10_000)])
def test_search_equals_a_full_scan(spark, tmp_path, monkeypatch, seed, cells, block):
    monkeypatch.setattr("tracewright.operators.index.BLOCK", block)
    rows = rows_of(seed)
    queries = [(int(r[0]), [float(x) for x in r[1]]) for r in rows[::40]] + [(9001, [0.0] * 8)]
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    index = VectorIndex.create(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/i", cells)
    for k in (1, 7, 700):
        got, want = found(index.search(asked, k)), scan(rows, queries, k)
        assert {q: [s for _, s in x] for q, x in got.items()} == {q: [s for _, s in x] for q, x in want.items()}
        assert {q: x for q, x in got.items() if len({s for _, s in x}) == len(x)} == {q: x for q, x in want.items() if len({s for _, s in x}) == len(x)}
    assert index.search(asked, 0).count() == 0
    if cells == 24:  # separate groups: most of the index is not compared
        shares = [r.share for r in index.visits(asked, 5).where("query_id between 4 and 9000").collect()]
        assert np.mean(shares) < 0.4


def test_upserts_deletes_and_exchange(spark, tmp_path):
    rows = rows_of(4, n=200)
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    index = VectorIndex.create(frame(rows[:150]), f"{tmp_path}/i", 9)
    new = [(i, [-x for x in v], "turned", n) for i, v, _, n in rows[100:160] for n in (1, 2)]
    new[1] = (100, [float(x) for x in range(8)], "last", 2)
    index.upsert(frame(new), order="n")
    index.delete(frame(rows[:20]).select("id"))
    now = {r[0]: r for r in rows[:150]} | {r[0]: r for r in new if r[3] == 2}
    now = [r for i, r in now.items() if i >= 20]
    asked = [(int(r[0]), [float(x) for x in r[1]]) for r in rows[30:180:30]]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")

    def same(i):
        got = {r.id: (r.kind, [round(x, 5) for x in r.embedding]) for r in i.live().collect()}
        assert got == {r[0]: (r[2], [round(float(np.float32(x)), 5) for x in r[1]]) for r in now} and i.size() == len(now)
        assert {q: [s for _, s in x] for q, x in found(i.search(queries, 12)).items()} == {q: [s for _, s in x] for q, x in scan(now, asked, 12).items()}

    same(index)
    assert index.segments() == [1, 2, 3]
    index.compact()
    assert index.segments() == [4]
    same(index)
    same(VectorIndex(spark, f"{tmp_path}/i"))
    index.write_json(f"{tmp_path}/json")
    same(VectorIndex.read_json(spark, f"{tmp_path}/json", SCHEMA, f"{tmp_path}/j"))
    with pytest.raises(DimensionMismatch):
        index.upsert(frame([(1, [1.0, 2.0], "x", 0)]))
    with pytest.raises(DimensionMismatch):
        index.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3)
    with pytest.raises(DimensionMismatch):
        VectorIndex.create(frame([(1, [1.0, 2.0], "x", 0), (2, [1.0], "x", 0)]), f"{tmp_path}/k")
    assert index.segments() == [4]


def test_top_k_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    rows = rows_of(6, n=300)
    queries = [(int(r[0]), [float(x) for x in r[1]]) for r in rows[7:300:3]]
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = found(retrieval.top_k(asked, spark.createDataFrame(rows, SCHEMA), 9).select("query_id", "id", "score", "rank"))
    assert {q: [s for _, s in x] for q, x in got.items()} == {q: [s for _, s in x] for q, x in scan(rows, queries, 9).items()}
    of_kind = retrieval.top_k(asked, spark.createDataFrame(rows, SCHEMA), 2, by="kind").groupBy("query_id", "kind").count().collect()
    assert len(of_kind) == 3 * len(queries) and {r["count"] for r in of_kind} == {2}


@pytest.mark.parametrize(("threshold", "cells", "block"), [(0.9, 12, 4096), (0.72, None, 41), (-0.5, 3, 60), (0.99, 1, 4096)])
def test_similar_pairs_equal_all_pairs(spark, threshold, cells, block):
    rows = rows_of(9, n=250)
    m = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = m @ m.T
    want = {(i, j): round(float(scores[i, j]), 9) for i in range(250) for j in range(i + 1, 250) if scores[i, j] >= threshold}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = cluster.similar_pairs(frame, threshold, block, cells).collect()
    assert {(r.a, r.b): round(r.score, 9) for r in got} == want and len(got) == len(want)
    if cells == 12:
        assert cluster.compared(frame, threshold, cells) < 0.5
    assert cluster.similar_pairs(frame.limit(0), threshold).collect() == []


def test_pairs_leave_their_task_unshuffled(spark):
    """As in SQL, an id that stands twice has its pairs twice; before, all pairs went through one more shuffle, which dropped them."""
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    out = cluster.similar_pairs(frame, 0.9)
    assert "Deduplicate" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted((r.a, r.b) for r in out.collect()) == [(1, 2), (1, 2)]


def test_greedy_takes_before_it_pairs(spark, monkeypatch):
    """Vectors with many similar ones: before, all their pairs were written and followed."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(400, 3)).astype(np.float32)
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    want, heads = {}, 0
    for i in range(400):
        near = [j for j in range(i + 1, 400) if j not in want and unit[i] @ unit[j] >= 0.6] if i not in want else []
        if near:
            want |= dict.fromkeys([i, *near], heads)
            heads += 1
    paired = []
    pairs = cluster.similar_pairs
    monkeypatch.setattr(cluster, "similar_pairs", lambda v, t: (paired.append(v.count()), pairs(v, t))[1])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")
    got = {r.id: r.cluster for r in cluster.greedy(frame, 0.6, first=40).collect()}
    assert got == {i: want.get(i) for i in range(400)}
    assert max(paired) <= 80
