"""The ingest job against a plain walk over the same chunks, however its stream is cut, killed or repeated."""

import hashlib

import pytest

from tracewright.operators import chunking
from tracewright.operators.store import Conflict
from tracewright.streaming import job as J
from tracewright.streaming.ingest import stream

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
LONG = "# One\n" + "word " * 30 + "\n\n# Two\n" + "other " * 30


def chunk(ord_, doc, version, content, kind="doc-page", fp=True, raw=None, ts=None, path=None, ident=None):
    return (ident or sha(f"{doc}:{version}:{content}"), doc, version, kind, "src", path, content, raw, sha(content) if fp else None, ts, None, None, {"filePath": "x", "state": "open"} if raw else None, ord_)


FIRST = [
    chunk(1, "d1", "v1", "alpha", raw="alpha beta", ts="2024-01-03"), chunk(2, "d1", "v1", "beta", raw="alpha beta"), chunk(3, "d2", "v1", "alpha", ts="2024-01-09"), chunk(3, "d2", "v1", "alpha"),
    chunk(4, "d3", "v1", LONG, raw=LONG), chunk(5, None, None, "no document", fp=False), chunk(6, "h1", "v1", "story", kind="hn-story"), chunk(7, "d4", "v1", "old", raw=""), chunk(8, "d5", "v1", "stays", raw="stays", path="docs/a.md"),
]
SECOND = [
    chunk(1, "d1", "v2", "alpha", raw="alpha gamma"), chunk(2, "d1", "v2", "gamma"), chunk(3, "h1", "v2", "comment", kind="hn-story"), chunk(4, "d4", "v2", "", kind="tombstone"), chunk(5, "new", "v1", "", kind="tombstone"),
    chunk(6, "d3", "v1", LONG, raw=LONG), chunk(7, None, None, "no document", fp=False), chunk(8, "d6", "v1", "gamma", ts="2024-01-05"), chunk(9, "d7", "v1", "donated", raw="donated"),
]


def walk(runs, most, append_only):
    """What one pass over each run gives: chunks by run, archive, catalog."""
    archive, stored, catalog, ids, marks = {}, [], {}, set(), set()
    for number, rows in enumerate(runs):
        seen = []
        for i, doc, version, kind, _, _, content, raw, fp, _, _, _, _, ord_ in sorted(rows, key=lambda r: r[-1]):
            if raw and doc and version:
                archive.setdefault((doc, version), raw)
            pieces = [(i, content, fp)] if len(content) <= most else [(sha(f"{doc}:{version}:{k}:{content[a:b]}"), content[a:b], sha(content[a:b])) for k, (a, b) in enumerate(chunking.markdown_pieces(content, most, 0))]
            for k, (pi, text, pf) in enumerate(pieces):
                if doc and version:
                    seen.append((doc, version, kind, ord_, k, pi, pf))
                if (pf or pi) not in marks and pi not in ids:
                    stored.append((number + 1, doc, text))
        for d in dict.fromkeys(s[0] for s in seen):
            own = [s for s in seen if s[0] == d]
            version, kind, new = own[0][1], own[0][2], [s[5] for s in own]
            if kind == "tombstone":
                if d in catalog:
                    catalog[d]["state"] = "archived"
            elif d not in catalog:
                catalog[d] = {"version": version, "chunks": new, "superseded": [], "state": "active"}
            elif kind in append_only:
                catalog[d] |= {"version": version, "chunks": list(dict.fromkeys(catalog[d]["chunks"] + new)), "state": "active"}
            elif catalog[d]["version"] != version:
                gone = [x for x in catalog[d]["chunks"] if x not in new]
                catalog[d] |= {"version": version, "chunks": new, "superseded": catalog[d]["superseded"] + gone, "state": "active"}
        ids |= {s[5] for s in seen} | {r[0] for r in rows}
        marks |= {s[6] for s in seen if s[6]} | {r[8] for r in rows if r[8]}
    return sorted(stored, key=str), archive, catalog


def run_job(spark, folder, name, rows, files, kill=None, **options):
    landing = f"{folder}/landing-{name}"
    frame = spark.createDataFrame(rows, J.CHUNK)
    frame.repartition(files, "ord", "id").write.parquet(landing)

    class Killed(J.IngestJob):
        def commit(self, name, body):
            if kill is not None and name.endswith(f"-{kill:09d}"):
                raise RuntimeError("killed")
            super().commit(name, body)

    if kill is not None:
        with pytest.raises(Exception, match="killed"):
            Killed(spark, f"{folder}/c", name, "s", **options).stream(stream(spark, landing, J.CHUNK)).awaitTermination()
    job = J.IngestJob(spark, f"{folder}/c", name, "s", **options)
    job.stream(stream(spark, landing, J.CHUNK)).awaitTermination()
    return job


@pytest.mark.parametrize(("files", "kill"), [(1, None), (3, 1)])
def test_runs_equal_a_plain_walk(spark, tmp_path, files, kill):
    options = {"most": 100, "append_only": ("hn-story",)}
    job = run_job(spark, tmp_path, "one", FIRST, files, kill, **options)
    with pytest.raises(Conflict):
        J.IngestJob(spark, f"{tmp_path}/c", "two", "s")
    assert job.finish()["cursor"] == "2024-01-09" and job.finish()["cursor"] == "2024-01-09"
    job = run_job(spark, tmp_path, "two", SECOND, files, kill, **options)
    job.step(spark.createDataFrame(FIRST, J.CHUNK), 0)  # a number that was committed
    assert job.finish(spark.createDataFrame([("d5",), ("none",)], "document_id string"))["cursor"] == "2024-01-09"  # no regression
    stored, archive, catalog = walk([FIRST, SECOND], 100, ("hn-story",))
    own, others = (job.table("chunks", own=o).collect() for o in (True, False))
    assert sorted([(n, r.document_id, r.content) for n, rows in ((1, others), (2, own)) for r in rows], key=str) == stored
    kept = {(r.document_id, r.version): r for r in job.table("archive").collect()}
    assert {k: r.content for k, r in kept.items()} == archive and len(kept) == job.table("archive").count()
    assert all(r.checksum == sha(r.content) and r.bytes == len(r.content) and r.metadata == {"state": "open"} for r in kept.values())
    catalog["d5"]["state"] = "archived"
    rows = {r.document_id: r for r in job.table("catalog").collect()}
    assert {d: (r.version, r.chunk_ids, sorted(r.superseded), r.state) for d, r in rows.items()} == {d: (c["version"], c["chunks"], sorted(c["superseded"]), c["state"]) for d, c in catalog.items()}
    found = {r.content for r in J.searchable(job).collect()}
    assert "gamma" in found and not found & {"beta", "old", "stays"}


def test_donors_filters_and_cursor(spark, tmp_path):
    archives = spark.createDataFrame([("other", "b1", "s", "d7", "v1", "doc-page", {"filePath": "x", "author": "a"}, "donated"), ("other", "", "s", "d8", "v1", "doc-page", None, "lost"), ("far", "b2", "t", "d9", "v1", "doc-page", None, "y")], "collection string, storage_id string, source_key string, document_id string, version string, source_type string, metadata map<string,string>, content string")
    catalogs = spark.createDataFrame([("other", "d7", ["c7"], [sha("donated")]), ("other", "d6", ["c6"], [sha("gamma")])], "collection string, document_id string, chunk_ids array<string>, fingerprints array<string>")
    folder = f"{tmp_path}/c"
    job = J.IngestJob(spark, folder, "one", "s")
    assert job.reuse_donors(archives, catalogs) == ["other"] and job.reuse_donors(archives, catalogs) == []
    job.step(spark.createDataFrame(SECOND, J.CHUNK), 0)
    assert [(r.document_id, r.content, r.metadata) for r in job.table("archive").collect() if r.document_id == "d7"] == [("d7", "donated", {"author": "a"})]
    stored = [r.content for r in job.table("chunks").collect()]
    assert "donated" not in stored and stored.count("gamma") == 2  # only documents that were replayed make chunks known
    assert job.finish(commit_sha="abc")["cursor"] == "abc"
    part = J.IngestJob(spark, folder, "two", "s", paths=["docs"], since="2024-01-01")
    assert part.reuse_donors(archives, catalogs) == []
    part.step(spark.createDataFrame([chunk(1, "p", "v1", "in", path="docs/a.md", ts="2024-02-01"), chunk(2, "p", "v1", "out", path="docsy/b", ts="2024-02-01"), chunk(3, "p", "v1", "early", path="docs", ts="2023-02-01")], J.CHUNK), 0)
    assert [r.content for r in part.table("chunks", own=True).collect()] == ["in"]
    assert part.finish(spark.createDataFrame([("p",)], "document_id string"))["cursor"] is None
    assert {r.document_id: r.state for r in part.table("catalog").collect()}["p"] == "active"
    empty = J.IngestJob(spark, folder, "three", "s")
    empty.step(spark.createDataFrame([], J.CHUNK), 0)
    assert empty.finish()["next"] == "abc" and empty.table("chunks", own=True).count() == 0
