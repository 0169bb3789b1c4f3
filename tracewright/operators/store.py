"""Collections on disk: segments by partition, a head manifest with compare-and-swap, artifact listings."""

from __future__ import annotations

import hashlib
import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import stored_segment


class Conflict(Exception):
    """The head moved since it was read."""


def write_segments(chunks: DataFrame, path: str) -> None:
    stored_segment(chunks).write.mode("append").partitionBy("segment_id").parquet(path)


def mount(spark: SparkSession, path: str, skip: list[str] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The chunks of a collection; skipped segments are pruned at the scan, excluded ids by an anti join."""
    rows = spark.read.parquet(path)
    if skip:
        rows = rows.where(~F.col("segment_id").isin(skip))
    return rows.join(exclude.select("id"), "id", "left_anti") if exclude is not None else rows


def read_head(spark: SparkSession, path: str) -> str | None:
    """The id (sha256 of its text) of the last head, or None. Heads are one JSON line a revision; one that is still being written is not there yet."""
    try:
        rows = spark.read.text(path)
    except Exception as e:  # only a missing folder means that there is no head yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    last = rows.where(F.col("value").endswith("}")).select(F.get_json_object("value", "$.revision").cast("long").alias("n"), F.sha2("value", 256).alias("id")).orderBy(F.col("n").desc()).first()
    return last["id"] if last else None


def _files(spark: SparkSession, path: str):
    """(file system, path) of a folder, by Spark's own file access."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_head(spark: SparkSession, path: str, revision: int, body: dict[str, str], previous: str | None) -> str:
    """A new head on top of ``previous``, or Conflict. Its file is named by the revision and must not exist: of two writers one fails."""
    if read_head(spark, path) != previous:
        raise Conflict(f"expected {previous}")
    text = json.dumps({"revision": str(revision), "prevHeadId": previous or ""} | body, ensure_ascii=False)
    files, folder = _files(spark, path)
    try:
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"head-{revision:012d}.json"), False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            raise Conflict(f"revision {revision} exists") from e
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return hashlib.sha256(text.encode()).hexdigest()


def projects(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's project files, sorted: letters, digits, _ and - before .json. A listing of projects, not of data."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(n.removesuffix(".json") for n in names if re.fullmatch(r"[a-zA-Z0-9_-]+\.json", n))


def write_blobs(contents: DataFrame, path: str) -> DataFrame:
    """Store ``contents`` (content: binary) under the sha256 of their bytes, each once; returns their ids."""
    rows = contents.select(F.sha2("content", 256).alias("id"), "content").groupBy("id").agg(F.any_value("content").alias("content"))
    rows.withColumn("shard", F.substring("id", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)
    return contents.select(F.sha2("content", 256).alias("id")).distinct()


def read_blobs(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, content, verified) of the wanted ids; content is null where a blob is missing, ``verified`` says whether the bytes have the id's hash.

    An id that is no sha256 names no blob, so it can't leave the folder.
    """
    wanted = ids.select("id").distinct().withColumn("shard", F.substring("id", 1, 2))
    stored = spark.read.schema("id string, content binary, shard string").parquet(path).dropDuplicates(["id", "shard"])
    found = wanted.where(F.col("id").rlike("^[0-9a-f]{64}$")).join(stored, ["id", "shard"])
    return wanted.join(found.select("id", "content"), "id", "left").select("id", "content", F.coalesce(F.sha2("content", 256) == F.col("id"), F.lit(False)).alias("verified"))


def segment_refs(heads: DataFrame, revisions: DataFrame) -> DataFrame:
    """(collection, segment_id): a head's (collection, revision, segments) pinned revision (revision, segments) if it has one, else its own segments."""
    pinned = revisions.select(F.col("revision"), F.col("segments").alias("pinned"))
    return heads.join(pinned, "revision", "left").select("collection", F.explode(F.coalesce("pinned", "segments")).alias("segment_id"))


def mounted(chunks: DataFrame, refs: DataFrame, skip: DataFrame | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks of the referenced segments but the skipped ones, those of them that are searched: without the excluded ids)."""
    wanted = refs.select("segment_id").distinct()
    if skip is not None:
        wanted = wanted.join(skip, "segment_id", "left_anti")
    rows = chunks.join(wanted, "segment_id", "left_semi")
    return rows, rows.join(exclude.select("id"), "id", "left_anti") if exclude is not None else rows


def reconciled(index: DataFrame, chunks: DataFrame, skipped: bool) -> DataFrame:
    """The index entries (id) to delete: those that no mounted chunk has. With skipped segments nothing can be told, so nothing goes."""
    return index.limit(0) if skipped else index.join(chunks.select("id"), "id", "left_anti")


def layer_id(edges: DataFrame, collection: str, extractor: str) -> DataFrame:
    """(layer_id, edges): a derived layer's id from its collection, extractor and edges whatever their order. Hashes of edges are summed map-side."""
    each = F.sha2(F.to_json(F.struct(*sorted(edges.columns))), 256)
    words = [F.conv(F.substring(each, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = edges.agg(F.count("*").alias("edges"), *(F.coalesce(F.sum(w), F.lit(0)).alias(f"w{k}") for k, w in enumerate(words)))
    return sums.select(F.sha2(F.concat_ws(":", F.lit(collection), F.lit(extractor), "edges", *(f"w{k}" for k in range(4))), 256).alias("layer_id"), "edges")


def artifacts(segments: DataFrame, layers: DataFrame, blobs: DataFrame) -> DataFrame:
    """(kind, id) of everything a collection is made of, plus its two sidecars."""
    spark = segments.sparkSession
    sidecars = spark.createDataFrame([("sidecar", "raw-index"), ("sidecar", "catalog")], "kind string, id string")
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
    return one(segments, "segment").unionByName(one(layers, "derived-edge-layer")).unionByName(one(blobs, "raw-source-blob")).unionByName(sidecars)


def uncovered(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Artifacts without a reference of the same kind and id."""
    return wanted.join(existing, ["kind", "id"], "left_anti")
