"""Readers and streaming over small files."""

import json

from pyspark.sql import functions as F

from tracewright.sources import readers
from tracewright.streaming import ingest


def test_issues_drop_pull_requests(spark, tmp_path):
    rows = [{"number": 1, "title": "T", "body": "B", "updated_at": "2024-01-02"}, {"number": 2, "title": "P", "pull_request": {"url": "u"}}]
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, rows)))
    (row,) = readers.issues(spark, str(tmp_path / "i.json"), "a/b").collect()
    assert (row.content, row.source, row.ts_raw) == ("# T\n\nB", "a/b#1", "2024-01-02")


def test_pulls_comments_discussions(spark, tmp_path):
    put = lambda name, rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    put("p.json", [{"number": 2, "title": "P", "body": None, "updated_at": "2024-02-01T00:00:00Z"}, {"number": 3, "title": "old", "created_at": "2023-01-01T00:00:00Z"}, {"number": 4, "title": "", "body": ""}])
    put("c.json", [{"id": 7, "body": "nit", "created_at": "2024-01-03T00:00:00Z", "pull_request_url": "https://x/pulls/2"}, {"id": 8, "body": "", "pull_request_url": "https://x/pulls/2"}])
    put("d.json", [{"number": 5, "title": "D", "body": "why", "createdAt": "2024-01-04"}])
    (pull,) = readers.pulls(spark, str(tmp_path / "p.json"), "a/b", "2024-01-01").collect()
    assert (pull.content, pull.source, pull.source_type) == ("# P\n\n", "a/b#2", "github-pr")
    (comment,) = readers.review_comments(spark, str(tmp_path / "c.json"), "a/b").collect()
    assert (comment.content, comment.source, comment.ts_raw) == ("nit", "a/b#2/comment/7", "2024-01-03T00:00:00Z")
    (talk,) = readers.discussions(spark, str(tmp_path / "d.json"), "a/b").collect()
    assert (talk.content, talk.source, talk.ts_raw) == ("# D\n\nwhy", "a/b/discussions/5", "2024-01-04")


def test_slack_groups_messages(spark, tmp_path):
    rows = [{"type": "message", "ts": str(t), "user": u, "text": x} for t, u, x in ((1, "a", "one"), (2, "a", "two"), (3, "b", "three"), (4, "b", " "))]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(r.content for r in readers.slack(spark, str(tmp_path / "s.json"), "c").collect()) == ["one\ntwo", "three"]


def test_discord_export(spark, tmp_path):
    body = {"channel": {"id": "1", "name": "dev"}, "messages": [{"id": "1", "timestamp": "2024-01-01T00:00:00Z", "content": "hi", "author": {"id": "x", "name": "X"}}]}
    (tmp_path / "d.json").write_text(json.dumps(body))
    (row,) = readers.discord(spark, str(tmp_path / "d.json")).collect()
    assert (row.content, row.source) == ("hi", "#dev")


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "README.md").write_text("# Hi")
    (tmp_path / "blank.py").write_text("  \n")
    got = {r.source: r.source_type for r in readers.files(spark, str(tmp_path), "r").collect()}
    assert got == {"r/src/a.py": "code", "r/README.md": "markdown"}


def test_stream_deduplicates(spark, tmp_path):
    for i in (1, 2):
        spark.createDataFrame([(1, 10), (i + 1, 20)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = ingest.stream(spark, str(tmp_path / "in"), "id long, ts timestamp")
    ingest.run_to_end(ingest.deduplicated(rows, "id", "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_stream_upserts(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(str(tmp_path / "in"))
    target = str(tmp_path / "t")
    spark.createDataFrame([(1, "old")], "id long, v string").write.parquet(f"{target}/0")
    state = {"at": f"{target}/0"}

    def write(df, n):
        df.write.mode("overwrite").parquet(f"{target}/{n + 1}")
        state["at"] = f"{target}/{n + 1}"

    merge = lambda old, new: old.join(new, "id", "left_anti").unionByName(new)
    rows = ingest.stream(spark, str(tmp_path / "in"), "id long, v string", 100)
    ingest.upserting(rows, merge, lambda: spark.read.parquet(state["at"]), write, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(state["at"]).collect())) == [(1, "a"), (2, "b")]
