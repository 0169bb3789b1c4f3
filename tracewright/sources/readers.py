"""Readers that turn source material into chunk rows (id, content, source_type, source, ts_raw, document_id)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import html_stripped, low_quality, url_source, without_boilerplate
from ..operators.temporal import sessions

_ISSUE = "number long, title string, body string, state string, created_at string, updated_at string, html_url string, pull_request struct<url:string>, user struct<login:string>"
_SLACK = "type string, ts string, user string, text string, thread_ts string, reply_count long"
_DISCORD = "channel struct<id:string,name:string>, messages array<struct<id:string,timestamp:string,content:string,author:struct<id:string,name:string>>>"
_STORY = "objectID string, title string, url string, story_text string, comment_text string, author string, created_at string, story_id long, parent_id long, points long, num_comments long"


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.sha2(F.concat_ws(":", "document_id", "content"), 256))


def files(spark: SparkSession, path: str, repo: str, glob: str = "*", most: int = 100_000) -> DataFrame:
    """Text files of a tree: blank and oversized ones are left out; Markdown by ending, else code."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).where(F.col("length") <= most)
    base = F.regexp_replace(F.lit(path.rstrip("/")), "^file:(?://)?", "")
    name = F.expr("substring(p, length(b) + 2)")
    rows = raw.withColumn("p", F.regexp_replace("path", "^file:(?://)?", "")).withColumn("b", base).withColumn("file", name)
    rows = rows.where(~F.col("file").rlike(r"(^|/)(\.[^/]*|node_modules|dist|build|target|vendor)/"))
    content = F.decode("content", "UTF-8")
    kind = F.when(F.col("file").rlike(r"(?i)\.mdx?$"), "markdown").otherwise("code")
    rows = rows.select(content.alias("content"), kind.alias("source_type"), F.concat(F.lit(f"{repo}/"), "file").alias("source"), F.col("modificationTime").cast("string").alias("ts_raw"), F.concat(F.lit(f"{repo}/"), "file").alias("document_id"))
    return _identified(rows.where(F.col("content").rlike(r"\S")))


def issues(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Issues (pull requests left out): title as a heading, then the body; the time is the last update."""
    return _threads(spark.read.schema(_ISSUE).json(path).where("pull_request is null"), "github-issue", F.concat(F.lit(f"{repo}#"), "number"))


def _threads(rows: DataFrame, kind: str, key: Column, since: str | None = None) -> DataFrame:
    time = F.coalesce(F.nullif("updated_at", F.lit("")), F.nullif("created_at", F.lit("")))
    rows = rows.where(F.col("number").isNotNull() & ((F.coalesce("title", F.lit("")) != "") | (F.coalesce("body", F.lit("")) != "")))
    rows = rows.where(F.to_timestamp(time) >= F.lit(since).cast("timestamp")) if since else rows
    text = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    return _identified(rows.select(text.alias("content"), F.lit(kind).alias("source_type"), key.alias("source"), time.alias("ts_raw"), key.alias("document_id")))


def pulls(spark: SparkSession, path: str, repo: str, since: str | None = None) -> DataFrame:
    """Pull requests like issues; ``since`` is applied here, as their listing has no such filter."""
    return _threads(spark.read.schema(_ISSUE).json(path), "github-pr", F.concat(F.lit(f"{repo}#"), "number"), since)


def discussions(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Discussions like issues; they are dated by their creation."""
    rows = spark.read.schema("number long, title string, body string, createdAt string").json(path)
    rows = rows.withColumns({"updated_at": F.lit(None).cast("string"), "created_at": F.col("createdAt")})
    return _threads(rows, "github-discussion", F.concat(F.lit(f"{repo}/discussions/"), "number"))


def review_comments(spark: SparkSession, path: str, repo: str, since: str | None = None) -> DataFrame:
    """Comments on pull requests, each a document below its request; empty ones are left out."""
    rows = spark.read.schema("id long, body string, created_at string, updated_at string, pull_request_url string").json(path).where("coalesce(body, '') <> ''")
    time = F.coalesce(F.nullif("updated_at", F.lit("")), F.nullif("created_at", F.lit("")))
    rows = rows.where(F.to_timestamp(time) >= F.lit(since).cast("timestamp")) if since else rows
    key = F.concat(F.lit(f"{repo}#"), F.regexp_extract("pull_request_url", r"(\d+)$", 1), F.lit("/comment/"), "id")
    return _identified(rows.select(F.col("body").alias("content"), F.lit("github-pr-comment").alias("source_type"), key.alias("source"), time.alias("ts_raw"), key.alias("document_id")))


def _grouped(messages: DataFrame, kind: str) -> DataFrame:
    """Messages (channel, id, ts, author, text) as one chunk a session."""
    rows = sessions(messages.where(F.col("text").rlike(r"\S")), "channel", "author")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))), lambda m: m["text"]), "\n")
    out = rows.groupBy("channel", "session").agg(text.alias("content"), F.min("ts").cast("string").alias("ts_raw"), F.min_by("id", "ts").alias("first"))
    key = F.concat_ws("/", "channel", "first")
    return _identified(out.select("content", F.lit(kind).alias("source_type"), F.concat(F.lit("#"), "channel").alias("source"), "ts_raw", key.alias("document_id")))


def slack(spark: SparkSession, path: str, channel: str, since: str | None = None) -> DataFrame:
    rows = spark.read.schema(_SLACK).json(path).where("type = 'message' and text is not null")
    ts = F.timestamp_seconds(F.col("ts").cast("double"))
    rows = rows.select(F.lit(channel).alias("channel"), F.col("ts").alias("id"), ts.alias("ts"), F.col("user").alias("author"), "text")
    return _grouped(rows.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else rows, "slack-message")


def discord(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    rows = spark.read.schema(_DISCORD).option("multiLine", "true").json(path).select("channel.name", F.explode("messages").alias("m"))
    rows = rows.select(F.col("name").alias("channel"), F.col("m.id").alias("id"), F.try_to_timestamp("m.timestamp").alias("ts"), F.col("m.author.id").alias("author"), F.col("m.content").alias("text"))
    return _grouped(rows.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else rows, "discord-message")


def stories(spark: SparkSession, path: str) -> DataFrame:
    """Stories (title, address, text) and comments of a news site's search results."""
    rows = spark.read.schema(_STORY).json(path)
    story = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), "url", html_stripped(F.col("story_text")))
    text = F.when(F.col("title").isNotNull(), story).otherwise(html_stripped(F.col("comment_text")))
    kind = F.when(F.col("title").isNotNull(), "hn-story").otherwise("hn-comment")
    return _identified(rows.select(text.alias("content"), kind.alias("source_type"), F.concat(F.lit("hn/"), "objectID").alias("source"), F.col("created_at").alias("ts_raw"), F.col("objectID").alias("document_id")).where(F.col("content").rlike(r"\S")))


def website(pages: DataFrame) -> DataFrame:
    """Pages (url, html) as text without boilerplate elements; poor pages are left out."""
    text = html_stripped(without_boilerplate(F.col("html")))
    rows = pages.select(text.alias("content"), F.lit("doc-page").alias("source_type"), url_source(F.col("url")).alias("source"), F.lit(None).cast("string").alias("ts_raw"), F.col("url").alias("document_id"))
    return _identified(rows.where(~low_quality(F.col("content"))))


def lenient_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are dropped (run logs, tried logs, sidecars)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: Adapters by source type.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"repo": files, "github-issue": issues, "github-pr": pulls, "github-pr-comment": review_comments, "github-discussion": discussions, "slack-message": slack, "discord-message": discord, "hn-story": stories, "doc-page": website}
