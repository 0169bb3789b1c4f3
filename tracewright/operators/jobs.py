"""Jobs over whole collections: batches into segments, reindexing, reingestion, publication, cached phases, staged evaluation, planning."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import signal_scores
from . import chunking, edges, ingest, upkeep
from .cluster import numbered

#: Sizes, the generator of planning, phases' schema.
MOST_CHARACTERS, SEGMENT_CHUNKS = 4000, 500
LCG = (9301, 49297, 233280)
HEADROOM, PHASE_SCHEMA = 3, 1


class Mismatch(Exception):
    """What was stored is not what was asked for."""


def segmented(chunks: DataFrame, order: str = "ord", size: int = SEGMENT_CHUNKS) -> DataFrame:
    """``chunks`` with a ``segment`` number: so many chunks each, in order, without a global sort."""
    return numbered(chunks, order).withColumn("segment", F.floor(F.col("number") / size)).drop("number")


def flushed(chunks: DataFrame, parts: list[DataFrame], embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch as it is stored: (chunks with vectors and signal scores, merged edges, summary of the segment).

    chunks: id, content, source_type, source, ts_raw, repo, segment_id; parts: edges of each
    extractor with its name. An empty batch gives empty tables.
    """
    stored = chunks.withColumns({"embedding": embed(F.col("content")), "signal_scores": signal_scores(F.col("content"))})
    return stored, edges.composite_edges(parts, chunks.count()), ingest.segment_summary(chunks)


def reindexed(chunks: DataFrame, same_model: bool, embed: Callable[[Column], Column], most: int | None = MOST_CHARACTERS) -> DataFrame:
    """(id, parent_id, content, embedding, preserved) of chunks (id, content, embedding) for a new index.

    A chunk within ``most`` characters keeps its vector if the model is the
    same; longer ones are cut, and all else is embedded again. Without
    ``most`` nothing is cut and everything is embedded.
    """
    if most is None:
        return chunks.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), "content", embed(F.col("content")).alias("embedding"), F.lit(False).alias("preserved"))
    short = F.coalesce(F.length("content"), F.lit(0)) <= most
    keeps = F.lit(same_model) & F.col("embedding").isNotNull()
    within = chunks.where(short).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), "content", F.when(keeps, F.col("embedding")).otherwise(embed(F.col("content"))).alias("embedding"), keeps.alias("preserved"))
    cut = chunking.oversized(chunks.where(~short), most)
    return within.unionByName(cut.select("id", "parent_id", "content", embed(F.col("content")).alias("embedding"), F.lit(False).alias("preserved")))


def reingested(archive: DataFrame, old_chunks: DataFrame, size: int = 512) -> DataFrame:
    """Chunks cut anew from archived documents (document_id, version, path, source_type, metadata, fetched, content).

    Metadata that the archive lacks comes from the document's first old chunk
    (document_id, ord, metadata); a chunk is dated by its document's metadata.
    """
    known = upkeep.backfilled(archive, old_chunks)
    made = chunking.split(known.select(F.col("document_id").alias("id"), "version", "path", "content"), size)
    dated = upkeep.replay_timestamp(F.col("source_type"), F.col("metadata"), F.col("fetched"))
    facts = known.select(F.col("document_id").cast("string").alias("document_id"), "source_type", "metadata", dated.alias("t"))
    return made.join(facts, "document_id").select(*made.columns, "source_type", "metadata", "t.ts", F.col("t.kind").alias("timestamp_kind"))


def published(artifacts: DataFrame, addresses: DataFrame) -> DataFrame:
    """References (kind, id, address, bytes, sha256) of artifacts (kind, id, content, recorded: the hash that the raw index has, else null).

    An artifact without an address (id, address) or a raw blob whose bytes
    are not the recorded ones stops the job.
    """
    rows = artifacts.join(addresses, "id", "left").withColumn("sha256", F.sha2("content", 256))
    checked = F.when(F.col("address").isNull(), F.raise_error(F.concat(F.lit("no address for "), "id")).cast("string")).when((F.col("kind") == "raw-source-blob") & ~F.col("sha256").eqNullSafe(F.col("recorded")), F.raise_error(F.concat(F.lit("checksum of "), "id")).cast("string"))
    return rows.select("kind", "id", checked.otherwise(F.col("address")).alias("address"), F.octet_length("content").cast("long").alias("bytes"), "sha256")


def read_phase(spark: SparkSession, path: str, phase: str, fingerprint: str) -> dict | None:
    """A phase's cached result, None if there is none yet; a cache of another schema, phase or configuration is an error."""
    try:
        rows = spark.read.text(path, wholetext=True).head(2)
    except Exception as e:  # only a missing file means that the phase has not run
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    stored = json.loads(rows[0]["value"])
    for field, wanted in (("schemaVersion", PHASE_SCHEMA), ("phase", phase), ("runConfigFingerprint", fingerprint)):
        if stored.get(field) != wanted:
            raise Mismatch(f"{field} of {path}: {stored.get(field)!r}, not {wanted!r}")
    return stored


def staged(stages: list[tuple[str, Callable[[], DataFrame]]], skip: frozenset[str] = frozenset()) -> tuple[list[tuple[str, str]], str]:
    """(verdict of each stage, verdict of all): a stage returns one row with a ``verdict``; skipped ones are listed as such and count for nothing."""
    out = [(name, "skipped" if name in skip else stage().first()["verdict"]) for name, stage in stages]
    told = {v for _, v in out}
    return out, "fail" if "fail" in told else "warn" if "warn" in told else "pass"


def planned(strata: DataFrame, candidates: DataFrame, templates: DataFrame, most: int, headroom: int = HEADROOM, seed: int = 1) -> DataFrame:
    """(place, source_type, query_type, artifact, template): samples for uncovered strata, those with the most artifacts first.

    strata: source_type, query_type, artifacts, ord; candidates: source_type,
    place (from 0 within the type), artifact; templates: source_type,
    query_type, template. Each stratum whose type has candidates draws one by
    the next number of a linear generator; those without a template are
    passed over, and the first ``most * headroom`` stay. Strata are a report.
    """
    a, c, m = LCG
    sizes = candidates.groupBy("source_type").agg(F.count("*").alias("n"))
    rows = strata.join(sizes, "source_type").withColumn("k", F.row_number().over(Window.orderBy(F.col("artifacts").desc(), "ord")))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(seed).cast("long"), lambda s, _: (s * a + c) % m)
    rows = rows.withColumn("place", F.floor(drawn / m * F.col("n")).cast("long") % F.col("n"))
    pairs = rows.join(candidates, ["source_type", "place"]).join(templates, ["source_type", "query_type"])
    kept = pairs.withColumn("r", F.row_number().over(Window.orderBy("k"))).where(F.col("r") <= most * headroom)
    return kept.select(F.col("r").alias("place"), "source_type", "query_type", "artifact", "template")
