"""Importance resampling towards a target distribution over hashed n-grams.

Texts of a slice become one sequence of word ids. Its suffixes are sorted by
their first n ids (an id of 0 ends a text, so none crosses); neighbours in
that suffix array share an n-gram where their common prefix (LCP) is n or
longer. A run of such neighbours is one distinct n-gram: it is hashed once and
its bucket is scattered back to the places it came from. The hash is the
crc32 of the n-gram's UTF-8 bytes; that of a longer one is put together from
its prefix and its last word, without going over the bytes again.

A pass over each table counts buckets (a task sends one row a bucket at most);
a bucket's gain is how much likelier the target makes it, a table whose size
is a parameter. A second pass adds each document's gains up. Gumbel noise from
a hash of the doc_id turns the highest scores into a draw without
replacement. Places come from ranges of (score, doc_id) and a count for each
range, so no task sorts all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from . import kernels as K
from .common import checkpointed, mapped

#: Bytes of text that share a suffix array.
SLICE = 1 << 21
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Shift:
    """What n zero bytes make of a crc32: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""

    def __init__(self):
        one = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)  # the usual table
        byte = lambda c: one[c & 0xFF] ^ (c >> 8)
        steps = [np.array([[v << 8 * k for v in range(256)] for k in range(4)], np.uint32)]
        for _ in range(256):
            steps.append(byte(steps[-1]))
        self.low, self.high = np.stack(steps[:256]), [steps[256]]
        while len(self.high) < 24:
            t = self.high[-1]
            self.high.append(t[0][t & 0xFF] ^ t[1][t >> 8 & 0xFF] ^ t[2][t >> 16 & 0xFF] ^ t[3][t >> 24])

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        least = n & 0xFF
        out = self.low[least, 0, crc & 0xFF] ^ self.low[least, 1, crc >> 8 & 0xFF] ^ self.low[least, 2, crc >> 16 & 0xFF] ^ self.low[least, 3, crc >> 24]
        rest = n >> 8
        for t in self.high:
            if not rest.any():
                break
            at = np.flatnonzero(rest & 1)
            c = out[at]
            out[at] = t[0][c & 0xFF] ^ t[1][c >> 8 & 0xFF] ^ t[2][c >> 16 & 0xFF] ^ t[3][c >> 24]
            rest = rest >> 1
        return out


_shift: Shift | None = None


def buckets_of(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text; and for each n-gram length the text and the bucket of every occurrence, in text order."""
    global _shift
    _shift = _shift or Shift()
    starts, ends, doc = K.words(data, offsets, K.PUNCT)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    if not len(starts):
        return count, [doc] * most, [np.zeros(0, np.int64)] * most
    _, first, ids = np.unique(K.Text(data).ranges(starts, ends), return_index=True, return_inverse=True)
    folded = _FOLD[data].tobytes()
    crc_of = np.array([zlib.crc32(folded[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.uint32)
    size_of = (ends - starts)[first]
    n = len(ids)
    last = np.searchsorted(doc, doc, "right")  # where the word's text ends
    place = np.arange(n)
    deep = [np.where(place + k < last, np.r_[ids[k:] + 1, np.zeros(min(k, n), np.int64)][:n], 0) for k in range(most)]
    order = np.argsort(deep[0] << 32 | deep[1], kind="stable") if most == 2 else np.lexsort(deep[::-1])
    new = np.zeros(n, bool)
    new[0] = True
    texts, found, crc = [], [], None
    for k in range(most):
        key = deep[k][order]
        new[1:] |= key[1:] != key[:-1]  # the common prefix with the neighbour is shorter than k + 1
        run = np.cumsum(new) - 1
        head = order[new]
        word = np.maximum(deep[k][head] - 1, 0)
        if k:
            so_far = _shift(crc[head], np.ones(len(head), np.int64)) ^ np.uint32(zlib.crc32(b" "))
            hashed = _shift(so_far, size_of[word]) ^ crc_of[word]
        else:
            hashed = crc_of[word]
        crc = np.empty(n, np.uint32)
        crc[order] = hashed[run]
        whole = deep[k] > 0
        texts.append(doc[whole])
        found.append((crc[whole] % np.uint32(buckets)).astype(np.int64))
    return count, texts, found


def _counted(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column("text"), SLICE):
                for b in buckets_of(data, offsets, most, buckets)[2]:
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, most: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many n-grams of 1 to ``most`` words fall into each bucket; empty buckets are left out."""
    return mapped(texts.select("text"), _counted(most, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000) -> list[int]:
    """floor(1000 ln of the smoothed share in ``target`` over that in ``documents``) for each bucket."""
    ours, theirs = ({r["bucket"]: r["n"] for r in bucket_counts(t, most, buckets).collect()} for t in (documents, target))  # one row a bucket
    s, t = sum(ours.values()), sum(theirs.values())
    ratio = lambda b: (float(theirs.get(b, 0) + 1) * float(s + buckets)) / (float(ours.get(b, 0) + 1) * float(t + buckets))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weighted(documents: DataFrame, gain: list[int], most: int = 2) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain of a text's n-grams; 0 without any) of each row."""
    sent = documents.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for i, j, data, offsets in K.slices(batch.column("text"), SLICE):
                count, texts, found = buckets_of(data, offsets, most, len(gain))
                features, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for d, b in zip(texts, found, strict=True):
                    features += np.bincount(d, minlength=j - i)
                    sums = np.r_[0, np.cumsum(gain[b])]
                    total += sums[np.searchsorted(d, np.arange(j - i), "right")] - sums[np.searchsorted(d, np.arange(j - i))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(count.astype(np.int64)), pa.array(features), pa.array(total // np.maximum(features, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    given = documents.select("doc_id", "text")
    return mapped(given, run, StructType([given.schema["doc_id"], *StructType.fromDDL("n_words long, n_features long, weight long")]))


def resampled(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row; rank is null for rows that are not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred
    are drawn. Null and empty texts have no words and weight 0. A null doc_id
    counts as the empty text in the noise and as the smallest in ties; rows
    with equal doc_ids get equal noise and places in any order. Other columns
    are not read.
    """
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    # Written before it is dealt by ranges: their sampling would read all texts once more.
    scored = checkpointed(weighted(documents, gains(documents, target, most, buckets), most).withColumn("score", F.col("weight") + noise))
    falling = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    able = F.col("n_words") >= least_words
    ranged = checkpointed(scored.withColumn("able", able).repartitionByRange(F.col("able").desc(), *falling).withColumn("part", F.spark_partition_id()))
    sizes = ranged.where("able").groupBy("part").count().collect()  # one row a partition
    before, starts = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in sizes):
        starts.append((part, before))
        before += n
    drawn = before * percent // 100
    first = documents.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part", "able").orderBy(*falling))
    rank = F.when(F.col("able") & (F.col("before") + F.col("place") <= drawn), F.col("before") + F.col("place"))
    return ranged.withColumn("place", place).join(F.broadcast(first), "part", "left").select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
