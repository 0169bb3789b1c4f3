"""Single operators against hand-made values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.functions.vectors import cosine, hash_embedding
from tracewright.operators import chunking, cluster, edges, ingest, jobs, retrieval, store, temporal, trace
from tracewright.operators import edges as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def chunks(spark, *rows):
    return spark.createDataFrame(rows, "id string, content string, source_type string, source string")


@pytest.mark.parametrize(("word", "root"), [("deployment", "deploy"), ("running", "run"), ("stopped", "stop"), ("collision", "colli"), ("bed", "bed"), ("organization", "organ"), ("Quickly", "quick")])
def test_stem(spark, word, root):
    assert one(spark, edges.stem(F.lit(word))) == root


def test_cosine_of_zero_vector(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, cosine(v(3, 4), v(3, 4))) == pytest.approx(1.0)
    with pytest.raises(Exception, match="dimension mismatch"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()


def test_hash_embedding_has_unit_length(spark):
    e = one(spark, hash_embedding(F.lit("abc"), 2))  # sums 97 + 99 and 98
    assert e == pytest.approx([196 / (196**2 + 98**2) ** 0.5, 98 / (196**2 + 98**2) ** 0.5], rel=1e-6)


def test_closing_beats_reference(spark):
    rows = edges.regex_edges(chunks(spark, ("1", "Fixes #3 and #3, see acme/x#4", "github-pr", "acme/y#9"))).collect()
    assert {(r.type, r.target_id, r.confidence) for r in rows} == {("closes", "acme/y#3", 1.0), ("references", "acme/x#4", 1.0)}


def test_bare_references_take_the_batch_repository(spark):
    rows = edges.regex_edges(chunks(spark, ("1", "see acme/x#4", "slack-message", "#a"), ("2", "closes #5", "slack-message", "#a"))).collect()
    assert ("closes", "acme/x#5", 0.5) in {(r.type, r.target_id, r.confidence) for r in rows}


def test_bare_reference_without_any_repository(spark):
    (row,) = edges.regex_edges(chunks(spark, ("1", "see #7", "slack-message", "#a"))).collect()
    assert (row.target_id, row.confidence) == ("#7", 1.0)


def test_heuristic_edges(spark):
    text = "PROJ-1 PROJ-1 UTF-8 [a](https://x.org/1) [b](https://x.org/1) [c](https://github.com/a/b) https://t.slack.com/archives/C1/p12"
    rows = edges.heuristic_edges(chunks(spark, ("1", text, "x", "y"))).collect()
    assert sorted(r.target_id for r in rows) == ["PROJ-1", "https://x.org/1", "t/C1/p12"]


def test_imports_and_dependencies(spark):
    files = spark.createDataFrame([("1", "a.ts", "import x from './b'\nconst y = require('lodash')"), ("2", "a.py", "from os.path import join\nimport sys")], "id string, path string, content string")
    assert sorted((r.source_id, r.target_type, r.target_id) for r in edges.import_edges(files).collect()) == [("1", "file", "./b"), ("1", "package", "lodash"), ("2", "package", "os.path"), ("2", "package", "sys")]
    manifests = spark.createDataFrame([("1", "package.json", json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}})), ("2", "requirements.txt", "numpy>=1\n# no\npandas"), ("3", "go.mod", "require github.com/x/y v1.2.3")], "id string, path string, content string")
    assert sorted(r.target_id for r in edges.dependency_edges(manifests).collect()) == ["a", "b", "github.com/x/y", "numpy", "pandas"]


def test_merge_adds_for_each_further_extractor(spark):
    rows = spark.createDataFrame([(1, "t", "a", "x", "b", "one", 0.98, "e1"), (2, "t", "a", "x", "b", "two", 0.5, "e2"), (3, "t", "a", "x", "b", "one", 0.5, "e2")], "seq long, type string, source_id string, target_type string, target_id string, evidence string, confidence double, extractor string")
    (row,) = edges.merged(rows).collect()
    assert (row.confidence, row.evidence, row.provenance) == (1.0, "one | two", ["e1", "e2"])


def test_markdown_pieces_cut_at_headers_and_move_forward():
    text = "intro text\n# One\n" + "a" * 30 + "\n# Two\n" + "b" * 200
    pieces = chunking.markdown_pieces(text, 60)
    assert text[: pieces[0][1]].endswith("a\n")
    assert "".join(text[a:b] for a, b in pieces) == text
    assert all(b > a for a, b in chunking.markdown_pieces("x" * 100, 10, 9))


def test_code_pieces_name_their_symbols():
    pieces = chunking.code_pieces("import os\n\ndef f():\n    pass\n\nclass C:\n    pass\n", "python")
    assert [p[2] for p in pieces] == [None, "f", "C"]


def test_depth_first_shares_visited_nodes(spark):
    graph = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 2), ("c", "a", 1), ("c", "d", 2), ("d", "e", 1)], "node string, other string, seq long").withColumn("type", F.lit("t")).withColumn("direction", F.lit("forward"))
    seeds = spark.createDataFrame([(0, "a", 0), (0, "e", 1)], "query_id long, node string, ord long")
    hops = sorted(trace.depth_first(seeds, graph).collect(), key=lambda r: r.hop_index)
    assert [(h.node, h.parent_hop_index) for h in hops] == [("a", -1), ("b", 0), ("c", 1), ("d", 2), ("e", -1)]


def test_depth_first_stops_at_the_cap(spark):
    graph = spark.createDataFrame([("a", f"n{i:02}", i) for i in range(40)], "node string, other string, seq long").withColumn("type", F.lit("t")).withColumn("direction", F.lit("forward"))
    seeds = spark.createDataFrame([(0, "a", 0)], "query_id long, node string, ord long")
    assert trace.depth_first(seeds, graph).count() == 15


def test_sessions_break_on_other_authors(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (2, 100, "x"), (3, 150, "y"), (4, 160, "x"), (5, 1000, "x")], "id long, s long, who string").withColumn("ts", F.timestamp_seconds("s")).withColumn("ch", F.lit(1))
    got = {r.id: r.session for r in temporal.sessions(rows, "ch", "who").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4}


def test_retrieval_filters(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    c = spark.createDataFrame([(i, [1.0, i / 10], "a" if i % 2 else "b") for i in range(10)], "id long, embedding array<float>, source_type string")
    assert [r.id for r in retrieval.search(q, c, 3, include=["a"]).orderBy("rank").collect()] == [1, 3, 5]
    assert retrieval.top_k(q, c, 0).count() == 0
    assert one(spark, retrieval.trace_allowed(F.lit("a"), [], ["a"])) is False
    assert one(spark, retrieval.allowed(F.lit("a"), [], [])) is True


def test_greedy_clusters(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id long, embedding array<float>")
    assert {r.id: r.cluster for r in cluster.greedy(v).collect()} == {0: 0, 1: 0, 2: None, 3: None}


def test_head_is_compare_and_swap(spark, tmp_path):
    path = f"file://{tmp_path}/head"
    assert store.read_head(spark, path) is None
    first = store.write_head(spark, path, 1, {"name": "c"}, None)
    store.write_head(spark, path, 2, {"name": "c"}, first)
    with pytest.raises(store.Conflict):
        store.write_head(spark, path, 3, {"name": "c"}, first)


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/head"
    store.write_head(spark, path, 1, {"writer": "a"}, None)
    first = store.read_head(spark, path)
    monkeypatch.setattr(store, "read_head", lambda *_: first)  # both have read the same head
    store.write_head(spark, path, 2, {"writer": "a"}, first)
    with pytest.raises(store.Conflict):
        store.write_head(spark, path, 2, {"writer": "b"}, first)


def test_blobs_are_verified(spark, tmp_path):
    path = f"file://{tmp_path}/blobs"
    rows = spark.createDataFrame([(b"one",), (b"two",), (b"one",)], "content binary")
    ids = store.write_blobs(rows, path)
    assert ids.count() == 2
    wanted = ids.unionByName(spark.createDataFrame([("../secret",), ("0" * 64,)], "id string"))
    got = {r.id: (r.content, r.verified) for r in store.read_blobs(spark, path, wanted).collect()}
    assert sorted(bytes(c) for c, ok in got.values() if ok) == [b"one", b"two"]
    assert got["../secret"] == (None, False) and got["0" * 64] == (None, False)
    (tmp_path / "p").mkdir()
    for name in ("a-1.json", "b.txt", "c d.json", "e_2.json"):
        (tmp_path / "p" / name).write_text("{}")
    assert store.projects(spark, f"file://{tmp_path}/p") == ["a-1", "e_2"]
    assert store.projects(spark, f"file://{tmp_path}/none") == []


def test_file_summaries(spark):
    code = '"""What it does.\n\nMore."""\n# note\nimport os\nfrom a import b\n\ndef run():\n    pass\n\nclass C:\n    pass\n'
    docs = spark.createDataFrame([("f1", "v", "a/b.py", code), ("f2", "v", "c.js", "// top\nconst x = require('y');\nfunction go() {}\n"), ("f3", "v", "d.md", "# T"), ("f4", "v", "e.go", "x"), ("f5", "v", "f.py", None)], "id string, version string, path string, content string")
    got = {r.document_id: r.content for r in chunking.summaries(docs).collect()}
    assert got == {
        "f1": 'File: a/b.py\n\n"""What it does.\n\nMore."""\n# note\n\nImports:\nimport os\nfrom a import b\n\nSymbols:\n- run\n- C',
        "f2": "File: c.js\n\n// top\n\nImports:\nconst x = require('y');\n\nSymbols:\n- x\n- go",
    }


def plain_trace(q, chunks, out, max_per_source, max_total, max_hops, min_score):
    """One query by lists and recursion, without boosts."""
    import math

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    near = sorted(((cosine(q, c["embedding"]), -c["id"]) for c in chunks.values()), reverse=True)
    near = [(s, -i) for s, i in near]
    hops, visited = [], set()

    def follow(node, depth, at):
        if depth >= max_hops:
            return
        for other, kind in out.get(node, ()):
            if len(hops) >= max_total:
                return
            if other not in visited:
                visited.add(other)
                hops.append((other, at, kind))
                follow(other, depth + 1, len(hops) - 1)

    for score, i in near[:max_total]:
        if score < min_score or i in visited:
            continue
        visited.add(i)
        hops.append((i, -1, None))
        follow(i, 0, len(hops) - 1)
        if len(hops) >= max_total:
            break
    for kind in dict.fromkeys(chunks[i]["source_type"] for i in sorted(chunks)):
        have = sum(chunks[h[0]]["source_type"] == kind for h in hops)
        if len(hops) >= max_total or have >= max_per_source:
            continue
        for score, i in near[: max_per_source - have + len(visited)]:
            if len(hops) >= max_total or have >= max_per_source:
                break
            if score >= min_score and i not in visited and chunks[i]["source_type"] == kind:
                visited.add(i)
                hops.append((i, -1, None))
                have += 1
    return hops


@pytest.mark.parametrize(("max_total", "min_score"), [(15, 0.05), (15, 0.2), (6, -1.0), (60, 0.1)])
def test_trace_equals_a_plain_walk(spark, max_total, min_score):
    from tests.conftest import SF
    from tracewright import registry  # noqa: F401  (it loads the plans in order)
    from tracewright.plans.trace import trace_tables

    queries, chunks, edges = trace_tables(spark, SF)
    known = {r.id: r.asDict() for r in chunks.collect()}
    out = {}
    for r in edges.orderBy("seq", "type", "direction").collect():
        out.setdefault(r.node, []).append((r.other, r.type))
    got = {}
    for r in trace.trace(queries, chunks, edges, max_total=max_total, min_score=min_score).orderBy("query_id", "hop_index").collect():
        got.setdefault(r.query_id, []).append((r.node, r.parent_hop_index, r.edge_type))
    for r in queries.collect():
        assert got.get(r.query_id, []) == plain_trace(r.vector, known, out, 3, max_total, 3, min_score)


def test_trace_filters_and_groups(spark):
    vec = lambda x: [1.0, x]
    chunks = spark.createDataFrame([(i, i, vec(i / 10), "ab"[i % 2], f"s{i}", None) for i in range(8)], "id long, ord long, embedding array<float>, source_type string, source string, ts timestamp")
    edges = spark.createDataFrame([(0, 1, "t", "forward", 1, "e", 0.5), (0, 2, "t", "forward", 2, "e", 0.5)], "node long, other long, type string, direction string, seq long, evidence string, confidence double")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    hops = trace.trace(queries, chunks, edges, max_per_source=2, max_total=5, exclude=["b"]).orderBy("hop_index").collect()
    # Edges never reach an excluded type; the types that are filled up at the end are not filtered.
    assert [(h.node, h.method, h.grouped) for h in hops] == [(0, "semantic", True), (2, "edge", True), (4, "semantic", False), (1, "semantic", True), (3, "semantic", True)]
    assert trace.trace(queries, chunks, edges, include=[], max_total=4).where("method = 'edge'").count() == 0
    assert trace.trace(queries.limit(0), chunks, edges).count() == 0
    strongest = trace.insights(trace.trace(queries, chunks, edges), F.lit("2024-01-01").cast("timestamp"))
    assert strongest.count() == 0  # two types converge on nothing


def test_dotted_paths_of_any_depth(spark):
    rows = [(1, i, i - 1, f"n{i}") for i in range(1, 41)] + [(2, 1, 0, "a"), (2, 2, 9, "lost"), (2, 3, 4, "x"), (2, 4, 3, "y")]
    got = {(r.doc, r.i): r.path for r in trace.dotted(spark.createDataFrame(rows, "doc long, i int, parent int, name string")).collect()}
    assert got == {(1, i): ".".join(f"n{k}" for k in range(1, i + 1)) for i in range(1, 41)} | {(2, 1): "a"}


def test_first_rows(spark):
    edges = spark.range(500).select(F.struct((F.col("id") % 37).alias("ord"), F.col("id").alias("place")).alias("seq"), F.col("id").alias("x"))
    for most in (0, 1, 77, 499, 500, 900):
        want = sorted(range(500), key=lambda i: (i % 37, i))[:most]
        assert sorted(r.x for r in E.first_rows(edges, most, 10).collect()) == sorted(want)


def test_sources_that_hold_a_probe(spark):
    sources = ["acme/repo", "acme/repo-two", "x/y/z", "ab", "é/ü", ""]
    probes = ["acme", "repo", "/", "y/", "é", "zz", "acme/repo-", "", "ab"]
    rows = spark.createDataFrame([(s,) for s in sources], "norm string"), spark.createDataFrame([(p,) for p in probes], "probe string")
    assert sorted(map(tuple, E.holders(*rows).collect())) == sorted((p, s) for p in probes for s in sources if p in s)


def test_rejoined_pieces(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    rows = [(1, k, text[a : a + 300]) for k, a in enumerate(range(0, 1000, 250))] + [(2, 1, "b c"), (2, 0, "a b "), (3, 0, "")]
    got = {r.id: r.content for r in E.rejoined(spark.createDataFrame(rows, "id long, chunk_index int, content string")).collect()}
    assert got == {1: text, 2: "a b c", 3: ""}


def test_json_pages(spark):
    pages = '[{"a":"see [docs][1]"},{"a":"q\\"][\\""}]\n[{"a":"x"}][]'
    found = one(spark, F.from_json(X.json_pages(F.lit(pages)), "array<struct<a:string>>"))
    assert [r.a for r in found][:3] == ["see [docs][1]", 'q"]["', "x"]
    long = '[{"a":"' + "\\n" * 20_000 + '"}][{"a":"y"}]'
    assert [len(r.a) for r in one(spark, F.from_json(X.json_pages(F.lit(long)), "array<struct<a:string>>"))] == [20_000, 1]


def test_catalog_upsert_is_idempotent(spark):
    new = spark.createDataFrame([("d", "v1", ["c1"], "mutable-state", False)], "document_id string, version string, chunk_ids array<string>, mutability string, tombstone boolean")
    empty = spark.createDataFrame([], "document_id string, version string, chunk_ids array<string>, previous array<string>, superseded array<string>, state string, mutability string")
    once = ingest.catalog_upsert(empty, new)
    assert once.collect() == ingest.catalog_upsert(once, new).collect()


def test_text_functions(spark):
    assert one(spark, X.html_stripped(F.lit('<p>a<br/>b <a href="u" x>t</a> &amp;lt;'))) == "a\nb u <"
    assert one(spark, X.redacted(F.lit("--db-password=hunter2 sk-abcdefghijklmnopqrstuv"))) == "--db-password=<redacted> <redacted>"
    assert one(spark, X.duration_seconds(F.lit("48h"))) == 172800
    assert one(spark, X.is_placeholder_repo(F.lit("Owner/Repo"))) is True
    assert one(spark, X.is_placeholder_repo(F.lit("docs/user.md"))) is True
    assert one(spark, X.url_source(F.lit("HTTP://Ex.org"))) == "ex.org/"


def test_lineage_reaches_the_root_of_a_long_trace(spark):
    hops = spark.createDataFrame([(1, i, i - 1, "ab"[i % 2]) for i in range(40)], "query_id long, hop_index int, parent_hop_index int, source_type string")
    row = trace.lineage(hops).first()
    assert row.path == list(range(40)) and row.length == 40


def test_evidence_chains_read_every_event(spark):
    from tests.conftest import SF
    from tracewright import registry
    from tracewright.plans.trace import _hops

    hops = _hops(spark, SF)
    assert hops.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert hops.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 15
    later = registry.QUERIES["evidence_chains"](spark, SF).where("query_id not like '%-0'")
    assert later.count() > 0


def test_published_stops_at_a_wrong_checksum(spark):
    rows = spark.createDataFrame([("segment", "a", b"x", None), ("raw-source-blob", "b", b"y", "0" * 64)], "kind string, id string, content binary, recorded string")
    addresses = spark.createDataFrame([("a", "c1"), ("b", "c2")], "id string, address string")
    assert jobs.published(rows.where("id = 'a'"), addresses).first().address == "c1"
    for wrong in (jobs.published(rows, addresses), jobs.published(rows.where("id = 'a'"), addresses.where("id = 'b'"))):
        with pytest.raises(Exception, match="checksum of b|no address for a"):
            wrong.collect()


def test_phases_are_guarded(spark, tmp_path):
    path = f"file://{tmp_path}/phase.json"
    assert jobs.read_phase(spark, path, "search", "f1") is None
    (tmp_path / "phase.json").write_text(json.dumps({"schemaVersion": 1, "phase": "search", "runConfigFingerprint": "f1", "x": 3}, indent=1))
    assert jobs.read_phase(spark, path, "search", "f1")["x"] == 3
    for phase, print_ in (("themes", "f1"), ("search", "f2")):
        with pytest.raises(jobs.Mismatch):
            jobs.read_phase(spark, path, phase, print_)


def test_stages(spark):
    row = lambda v: lambda: spark.createDataFrame([(v,)], "verdict string")
    stages = [("ingest", row("pass")), ("storage", row("warn")), ("search", row("fail"))]
    assert jobs.staged(stages) == ([("ingest", "pass"), ("storage", "warn"), ("search", "fail")], "fail")
    assert jobs.staged(stages, frozenset(["search"])) == ([("ingest", "pass"), ("storage", "warn"), ("search", "skipped")], "warn")


def test_a_flushed_batch(spark):
    batch = spark.createDataFrame([(1, "fixes acme/x#7 broken", "github-issue", "acme/r#1", "2024-01-01", None, "s1"), (2, "see #3", "slack-message", "#dev", "2024-01-02", None, "s1")], "id long, content string, source_type string, source string, ts_raw string, repo string, segment_id string")
    parts = [p.withColumns({"extractor": F.lit(n), "seq": F.struct(F.col("source_id").alias("ord"), F.lit(i).alias("e"), F.col("seq").alias("place"))}) for i, (n, p) in enumerate((("regex", E.regex_edges(batch)), ("heuristic", E.heuristic_edges(batch))))]
    stored, merged, summary = jobs.flushed(batch, parts, lambda c: hash_embedding(c, 3))
    assert {r.id: dict(r.signal_scores) for r in stored.collect()} == {1: {"pain": 20}, 2: {}}
    assert {(r.type, r.target_id) for r in merged.collect()} == {("closes", "acme/x#7"), ("references", "acme/r#3")}
    assert summary.first().chunks == 2
