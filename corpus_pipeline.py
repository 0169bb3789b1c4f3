"""Five stages from raw documents to tokens; each stage's result is written and read again by the next.

toxicity drops documents that score 0.7 or more; near_dedup keeps the one
with the smallest doc_id of each group (five-word shingles, similarity 0.8 or
more); suffix_dedup cuts passages of 100 bytes or more that a document with a
smaller doc_id holds; decontaminate drops documents with a benchmark passage;
sentencepiece encodes what is left and decodes it again; all columns stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontam, neardup, pieces, suffixarray, toxicity
from tracewright.llm.common import shared_folder, table
from tracewright.llm.queries import TOKENIZER


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, k=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixarray.without_repeats(docs, length=100)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), size=10)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.Pieces.load(TOKENIZER), decoded=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The classifier's weights and the tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder."""
    base, docs, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:  # only the last stage's input is read again
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
