"""Edges from a model: chunks in batches of bounded size, each batch failing alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, importable
from . import edges
from .experiments import model_json
from .upkeep import token_batches

#: What a model is asked to give: a JSON array of these.
RAW = "array<struct<type: string, sourceId: string, targetType: string, targetId: string, evidence: string, confidence: double>>"


def messages(chunks: DataFrame, budget: int) -> DataFrame:
    """(context, batch, ids, message): the chunks (context, id, ord, source_type, source, content) of each token batch as one JSON array.

    A batch has ``budget`` tokens at most, or one chunk of more.
    """
    placed = token_batches(chunks, budget)
    rows = chunks.withColumn("_c", F.coalesce(F.col("context").cast("string"), F.lit(""))).join(placed.select(F.coalesce("context", F.lit("")).alias("_c"), "id", "batch"), ["_c", "id"])
    told = F.struct(F.col("id").cast("string").alias("chunk_id"), F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("content", F.lit("")).alias("text"))
    held = rows.groupBy("context", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "id", told.alias("told")))).alias("c"))
    return held.select("context", "batch", F.transform("c.id", lambda i: i.cast("string")).alias("ids"), F.to_json(F.col("c.told")).alias("message"))


def answered(batches: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """``batches`` with ``answer`` and ``error``: what ``call`` gives for each message, or why it failed. Written once, so nothing is asked twice."""
    importable(batches.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            answers, errors = [], []
            for message in part.column("message").to_pylist():
                try:
                    answers.append(call(message))
                    errors.append(None)
                except Exception as e:  # a batch that fails is a row of its own, not the job's end
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([part.column("context"), part.column("batch"), part.column("ids"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["context", "batch", "ids", "answer", "error"])

    given = batches.select(F.col("context").cast("string").alias("context"), "batch", "ids", "message")
    return checkpointed(given.mapInArrow(run, "context string, batch int, ids array<string>, answer string, error string"))


def model_edges(chunks: DataFrame, call: Callable[[str], str], budget: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(edges after the gates, batches): what a model finds, and what became of each batch.

    ``call`` gets a message and returns an answer, in a task of its own
    process. Edges need all fields, evidence, and a source among the chunks
    of their batch; labels become canonical, confidence lies within 0.3 and
    0.8, and ``edges.validated`` gives each its type and, if refused, its
    reason. Batches: context, batch, ids, error (null: answered; ``no JSON``:
    an answer that has none) and found (raw edges in the answer). Every chunk
    is in exactly one.
    """
    rows = answered(messages(chunks, budget), call).withColumn("json", model_json(F.col("answer")))
    rows = rows.withColumn("raw", F.from_json("json", RAW))
    report = rows.select("context", "batch", "ids", F.coalesce("error", F.when(F.col("json").isNull(), "no JSON")).alias("error"), F.coalesce(F.size("raw"), F.lit(0)).alias("found"))
    each = rows.select("ids", F.posexplode("raw").alias("place", "e")).where(F.array_contains("ids", F.col("e.sourceId")))
    full = F.lit(True)
    for name in ("type", "sourceId", "targetType", "targetId"):
        full = full & (F.coalesce(F.col(f"e.{name}"), F.lit("")) != "")
    full = full & (F.trim(F.coalesce("e.evidence", F.lit(""))) != "")
    sure = F.least(F.greatest(F.coalesce("e.confidence", F.lit(0.5)), F.lit(0.3)), F.lit(0.8))
    found = each.where(full).select(edges.normalized_type(F.col("e.type")).alias("type"), F.col("e.sourceId").alias("source_id"), F.col("e.targetType").alias("target_type"), F.col("e.targetId").alias("target_id"), F.col("e.evidence").alias("evidence"), sure.alias("confidence"))
    return edges.validated(found), report
