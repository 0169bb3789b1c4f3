"""Schemas of the engine's tables and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
_field = T.StructField

CHUNKS = T.StructType([
    _field("id", _S, False), _field("ord", _L), _field("content", _S), _field("source_type", _S), _field("source", _S), _field("source_url", _S), _field("ts", T.TimestampType()), _field("ts_raw", _S), _field("timestamp_kind", _S),
    _field("chunk_index", _I), _field("total_chunks", _I), _field("metadata", T.MapType(_S, _S)), _field("document_id", _S), _field("document_version_id", _S), _field("content_fingerprint", _S),
    _field("embedding", T.ArrayType(T.FloatType())), _field("terms", T.ArrayType(_S)), _field("signal_scores", T.MapType(_S, _D)), _field("segment_id", _S),
])
EDGES = T.StructType([_field("seq", _L), _field("type", _S, False), _field("source_id", _S, False), _field("target_type", _S, False), _field("target_id", _S, False), _field("evidence", _S), _field("confidence", _D), _field("provenance", T.ArrayType(_S)), _field("extractor", _S), _field("layer_id", _S)])
CATALOG = T.StructType([_field("document_id", _S, False), _field("version", _S), _field("chunk_ids", T.ArrayType(_S)), _field("previous", T.ArrayType(_S)), _field("superseded", T.ArrayType(_S)), _field("state", _S), _field("mutability", _S)])
SCHEMA_VERSION = 1


def chunk_problems(dimensions: int) -> Column:
    """What is wrong with a stored chunk; an empty array if nothing is."""
    tests = [
        (F.col("id").isNull() | (F.col("id") == ""), "id"), (F.col("content").isNull(), "content"), (F.col("source_type").isNull(), "source_type"),
        (F.col("embedding").isNotNull() & (F.size("embedding") != dimensions), "embedding length"), (F.col("chunk_index") < 0, "chunk_index"), (F.col("chunk_index") >= F.col("total_chunks"), "total_chunks"),
    ]
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in tests)))


def validated(chunks: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with their problems)."""
    marked = chunks.withColumn("problems", chunk_problems(dimensions))
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)
