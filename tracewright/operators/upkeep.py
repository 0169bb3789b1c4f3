"""Smaller operators around collections, replay, authored queries and experiment logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import importable

#: The timestamp a source type is dated by, and metadata keys that are not archived.
TIMESTAMP_KINDS = {"github-issue": "updated", "github-pr": "updated", "github-pr-comment": "updated", "github-discussion": "updated", "slack-message": "created", "discord-message": "created", "code": "committed", "markdown": "committed", "doc-page": "published"}
QUERY_TYPES = "lookup trace compare temporal causal howto entity-resolution".split()
DIFFICULTIES = "easy medium hard".split()
LAYER_HINTS = "chunking embedding edge-extraction ranking trace".split()
NOT_ARCHIVED = ["filePath", "language", "repo"]
CHARACTERS_A_TOKEN, CHUNK_OVERHEAD = 4, 15


def donors(archives: DataFrame, collection: Column, source_key: Column) -> DataFrame:
    """(collection, n): other collections with non-empty entries of the same source."""
    rows = archives.where((F.col("source_key") == source_key) & (F.col("collection") != collection) & (F.coalesce("storage_id", F.lit("")) != ""))
    return rows.groupBy("collection").agg(F.count("*").alias("n"))


def replay_timestamp(source_type: Column, metadata: Column, fetched: Column) -> Column:
    """struct(ts, kind): the metadata entry of the type's kind, else when it was fetched, as ``ingested``."""
    kinds = F.create_map(*(F.lit(x) for kv in TIMESTAMP_KINDS.items() for x in kv))
    kind = F.try_element_at(kinds, source_type)
    own = F.nullif(F.try_element_at(metadata, kind), F.lit(""))
    return F.when(own.isNotNull(), F.struct(own.alias("ts"), kind.alias("kind"))).otherwise(F.struct(fetched.alias("ts"), F.lit("ingested").alias("kind")))


def archived_metadata(metadata: Column) -> Column:
    """Metadata without local keys; null if nothing is left."""
    left = F.map_filter(metadata, lambda k, v: ~k.isin(NOT_ARCHIVED) & v.isNotNull())
    return F.when(F.size(left) > 0, left)


def backfilled(archive: DataFrame, chunks: DataFrame) -> DataFrame:
    """Archive entries (document_id, metadata) completed by the first chunk of the document that has metadata worth keeping."""
    found = chunks.withColumn("m", archived_metadata(F.col("metadata"))).where("m is not null")
    first = found.groupBy("document_id").agg(F.min_by(F.map_entries("m"), "ord").alias("first"))
    rows = archive.join(first, "document_id", "left")
    return rows.withColumn("metadata", F.coalesce("metadata", F.map_from_entries("first"))).drop("first")


def token_batches(chunks: DataFrame, budget: int) -> DataFrame:
    """(context, id, batch): chunks in order, a new batch when the next would exceed the budget.

    Each decision depends on the one before it in its context, so a context
    is one sorted stream: only lengths are sent, and a task holds one Arrow
    batch and a running sum, however many chunks a context has.
    """
    need = (F.ceil(F.coalesce(F.char_length("content"), F.lit(0)) / CHARACTERS_A_TOKEN) + CHUNK_OVERHEAD).alias("need")
    rows = chunks.select("context", "id", "ord", need).repartition("context").sortWithinPartitions("context", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, used, began = None, 0, 0, False
        for rows in batches:
            out = []
            for context, size in zip(rows.column("context").to_pylist(), rows.column("need").to_pylist(), strict=True):
                if not began or context != now:
                    now, batch, used, began = context, 0, 0, True
                if used and used + size > budget:
                    batch, used = batch + 1, 0
                used += size
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column("context"), rows.column("id"), pa.array(out, pa.int32())], names=["context", "id", "batch"])

    importable(chunks.sparkSession)
    return rows.mapInArrow(run, "context string, id long, batch int")


def silenced(incidents: DataFrame, filed: DataFrame, days: int) -> DataFrame:
    """Incidents (incident, day) that were not filed within the ``days`` before."""
    near = incidents.join(filed.select("incident", F.col("day").alias("filed")), "incident").where("filed <= day").where(F.date_diff("day", "filed") < days)
    return incidents.join(near.select("incident", "day").distinct(), ["incident", "day"], "left_anti")


def cached(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, misses) of texts (id, content) against a cache (key, vector): the key names model and text."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("\n", F.lit(model), "content"), 256))
    hits = keyed.join(cache, "key")
    return hits, keyed.join(cache, "key", "left_anti")


def glob_pattern(line: str) -> str | None:
    """A regular expression for one line of an ignore file; None for blanks and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    anchored = "/" in line.rstrip("/")
    body = re.escape(line.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|/)") + body + ("/" if line.endswith("/") else "(?:/|$)")


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last matching line of an ignore file excludes a path; a leading ! includes again."""
    out = F.lit(False)
    for line in lines:
        keep = line.strip().startswith("!")
        pattern = glob_pattern(line.strip().lstrip("!"))
        if pattern:
            out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def setting(*sources: Column) -> Column:
    """Command line before environment before file before default."""
    return F.coalesce(*sources)


def excerpts(chunks: DataFrame, most: int = 4000) -> DataFrame:
    """(document_id, excerpt): a document's chunks in order, joined by line ends and cut at ``most`` characters.

    A chunk and its separator are a character at least, so a document's first
    ``most + 1`` chunks are enough (the limit is pushed below the shuffle), and
    of these the ones whose separator begins before the cut are joined. Null
    contents come last and count for nothing; without any other the excerpt is null.
    """
    order = Window.partitionBy("document_id").orderBy(F.col("content").isNull(), "ord")
    before = F.sum(F.char_length("content") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most + 1)
    chunks = chunks.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= most)
    parts = F.array_sort(F.collect_list(F.struct("ord", "content")))
    text = F.substring(F.array_join(F.transform(parts, lambda x: x["content"]), "\n"), 1, most)
    return chunks.groupBy("document_id").agg(F.when(F.count("content") > 0, text).alias("excerpt"))


def authored_problems(queries: DataFrame, known: DataFrame) -> DataFrame:
    """``problems`` of authored queries, empty if sound; ``known`` (id) are the queries that exist already.

    queries: ord (their order), id, query, corpora, query_type, difficulty,
    layer_hints, evidence, source_types, min_results, collection. Of a
    repeated id all but the first are duplicates: the first places are found
    by an aggregate and joined, so no window holds an id's rows.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    unlike = lambda c, values: ~F.coalesce(F.col(c).isin(values), F.lit(False))
    first = queries.groupBy(F.col("id").alias("_id")).agg(F.min("ord").alias("_first"))
    old = known.select(F.col("id").alias("_old")).distinct()
    rows = queries.join(first, F.col("id") == F.col("_id"), "left").join(old, F.col("id") == F.col("_old"), "left")
    named = F.coalesce("id", F.lit("")) != ""
    tests = [
        (~named, "missing id"), (named & F.col("_old").isNotNull(), "known id"), (named & (F.col("ord") > F.col("_first")), "duplicate id"), (blank(F.col("query")), "empty query"), (empty("corpora"), "empty corpora"),
        (unlike("query_type", QUERY_TYPES), "query type"), (unlike("difficulty", DIFFICULTIES), "difficulty"), (F.size(F.array_except(F.coalesce("layer_hints", F.array().cast("array<string>")), F.array(*map(F.lit, LAYER_HINTS)))) > 0, "layer hint"),
        (empty("evidence"), "empty evidence"), (F.col("source_types").isNull(), "missing source types"), (F.coalesce("min_results", F.lit(0)) < 1, "min results"), (blank(F.col("collection")), "missing collection"), (empty("layer_hints"), "empty layer hints"),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in tests)))).drop("_id", "_first", "_old")


def greedy_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One-to-one matches of predicted edges (chunk, p, type, target) with gold ones (chunk, g, type, target, how): each gold edge in order takes the first free prediction.

    ``how`` is exact, substring (without regard to case) or regex. A chunk's edges are one group.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free, out = left.sort_values("p").to_dict("records"), []
        for g in right.sort_values("g").itertuples(index=False):
            for k, e in enumerate(free):
                fits = {"exact": e["target"] == g.target, "substring": g.target.lower() in e["target"].lower(), "regex": g.how == "regex" and bool(re.search(g.target, e["target"]))}
                if e["type"] == g.type and fits[g.how]:
                    out.append((key[0], int(g.g), int(e["p"])))
                    del free[k]
                    break
        return pd.DataFrame(out, columns=["chunk", "g", "p"])

    importable(predicted.sparkSession)
    return predicted.groupBy("chunk").cogroup(gold.groupBy("chunk")).applyInPandas(run, "chunk long, g long, p long")


def evidence_chains(paths: DataFrame, least: int = 3, most: int = 3) -> DataFrame:
    """The longest distinct type sequences (query_id, types, variety) of lineage paths with ``least`` source types: prefixes of others go, ``most`` stay."""
    rows = paths.where(F.col("variety") >= least).withColumn("label", F.array_join("types", ">"))
    rows = rows.groupBy("query_id", "label").agg(F.max("variety").alias("variety"), F.min("leaf").alias("leaf"))
    other = rows.select("query_id", F.col("label").alias("longer"))
    prefix = rows.join(other, "query_id").where(F.startswith("longer", F.concat("label", F.lit(">")))).select("query_id", "label").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("variety").desc(), "leaf")
    kept = rows.join(prefix, ["query_id", "label"], "left_anti").withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    return kept.withColumn("strength", F.least(0.5 + 0.15 * F.col("variety"), F.lit(1.0))).drop("r")
